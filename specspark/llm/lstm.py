"""A bidirectional LSTM that labels every element of a sequence, in numpy: forward pass, gradients and Adam."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One LSTM direction. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator):
        self.hidden = hidden
        self.w = rng.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden, 4 * hidden))
        self.b = np.zeros(4 * hidden)
        self.b[hidden : 2 * hidden] = 1.0

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (batch, time, inputs), mask (batch, time): hidden states; state stays where mask is 0."""
        batch, time, _ = x.shape
        n = self.hidden
        h, c = np.zeros((batch, n)), np.zeros((batch, n))
        out = np.zeros((batch, time, n))
        from_x = x @ self.w[: x.shape[2]] + self.b
        recurrent = self.w[x.shape[2] :]
        for t in range(time):
            z = from_x[:, t] + h @ recurrent
            s, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((i, f, o, g, c, tanh_c, h, m))
            c = m * new_c + (1 - m) * c
            h = m * o * tanh_c + (1 - m) * h
            out[:, t] = h
        return out

    def backward(self, x: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and b from those of the hidden states."""
        n, inputs = self.hidden, x.shape[2]
        recurrent = self.w[inputs:]
        d_w, d_b = np.zeros_like(self.w), np.zeros_like(self.b)
        d_h, d_c = np.zeros(d_out[:, 0].shape), np.zeros(d_out[:, 0].shape)
        for t in reversed(range(x.shape[1])):
            i, f, o, g, c, tanh_c, h, m = keep[t]
            d_h = d_h + d_out[:, t]
            on = m * d_h
            dc = m * d_c + on * o * (1 - tanh_c**2)
            d_z = np.concatenate((dc * g * i * (1 - i), dc * c * f * (1 - f), on * tanh_c * o * (1 - o), dc * i * (1 - g**2)), axis=1)
            d_w[:inputs] += x[:, t].T @ d_z
            d_w[inputs:] += h.T @ d_z
            d_b += d_z.sum(axis=0)
            d_h = d_z @ recurrent.T + (1 - m) * d_h
            d_c = dc * f + (1 - m) * d_c
        return d_w, d_b


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence's own elements in reverse; padding stays at the end."""
    time = np.arange(x.shape[1])
    at = np.where(time < lengths[:, None], lengths[:, None] - 1 - time, time)
    return np.take_along_axis(x, at[:, :, None], axis=1)


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(batch, mask, lengths)."""
    lengths = np.array([len(s) for s in sequences])
    x = np.zeros((len(sequences), max(1, lengths.max()), sequences[0].shape[1]))
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
    return x, (np.arange(x.shape[1]) < lengths[:, None]).astype(float), lengths


class Labeller:
    """Probability of label 1 for each element from the states of both directions."""

    def __init__(self, inputs: int, hidden: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Direction(inputs, hidden, rng), Direction(inputs, hidden, rng)
        self.w, self.b = rng.normal(0, 0.1, 2 * hidden), np.zeros(1)

    def _parameters(self) -> list[np.ndarray]:
        return [self.ahead.w, self.ahead.b, self.back.w, self.back.b, self.w, self.b]

    def _states(self, x, mask, lengths, keep=(None, None)):
        a = self.ahead.forward(x, mask, keep[0])
        b = _reversed(self.back.forward(_reversed(x, lengths), mask, keep[1]), lengths)
        return np.concatenate((a, b), axis=2)

    def predict(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        if not sequences:
            return []
        x, mask, lengths = padded(sequences)
        p = _sigmoid(self._states(x, mask, lengths) @ self.w + self.b)
        return [p[i, :n] for i, n in enumerate(lengths)]

    def _gradients(self, sequences: list[np.ndarray], labels: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        x, mask, lengths = padded(sequences)
        y = padded([np.asarray(v, dtype=float)[:, None] for v in labels])[0][:, :, 0]
        keep = ([], [])
        states = self._states(x, mask, lengths, keep)
        p = _sigmoid(states @ self.w + self.b)
        d = (p - y) * mask / mask.sum()
        loss = -(mask * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / mask.sum()
        d_states = d[:, :, None] * self.w
        n = self.ahead.hidden
        grads = [*self.ahead.backward(x, keep[0], d_states[:, :, :n])]
        grads += [*self.back.backward(_reversed(x, lengths), keep[1], _reversed(d_states[:, :, n:], lengths))]
        return float(loss), [*grads, (d[:, :, None] * states).sum(axis=(0, 1)), np.array([d.sum()])]

    def fit(self, sequences, labels, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 0) -> float:
        """Adam over shuffled batches of like lengths; the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        lengths = np.array([len(s) for s in sequences])
        first, second = [[np.zeros_like(p) for p in self._parameters()] for _ in range(2)]
        step, mean = 0, 0.0
        for epoch in range(epochs):
            order, losses = np.argsort(lengths * rng.uniform(0.8, 1.25, len(lengths))), []
            for k in rng.permutation(range(0, len(order), batch)):
                part = order[k : k + batch]
                loss, grads = self._gradients([sequences[i] for i in part], [labels[i] for i in part])
                losses.append(loss)
                step += 1
                scale = min(1.0, 5.0 / (np.sqrt(sum((g**2).sum() for g in grads)) + 1e-9))
                now = rate * (0.5 if epoch > 0.6 * epochs else 1) * (0.4 if epoch > 0.85 * epochs else 1)
                for p, g, m, v in zip(self._parameters(), grads, first, second):
                    m += 0.1 * (g * scale - m)
                    v += 0.001 * ((g * scale) ** 2 - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            mean = float(np.mean(losses))
        return mean
