"""Secret scans: three fixed patterns, and strings that a random-string model explains better than an identifier model.

Both models are first-order character chains over the 66 token characters with additive smoothing. A
token's score is the mean log-likelihood ratio of its transitions (random against ordinary, in nats a
character). They are trained from labelled strings: ``training_samples`` labels words of a bounded sample of
the table as ordinary (with identifiers joined from them) and what the patterns find there as random,
next to strings drawn from common key alphabets with a fixed seed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns; keyword letters in either case, ASCII only.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "markov")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
#: Characters that no token begins or ends with, and those that part a path or a name from a key.
EDGE, CUTS = "._-=/+", "/.=-_"
#: At most so many rows and so many distinct words are read to fit the models.
SAMPLE_ROWS, SAMPLE_WORDS = 1000, 20_000
#: A token is a secret at this mean ratio, when it also mixes two kinds of letters or digits.
MIN_SCORE = 0.7
SPANS = "array<struct<kind:string,start:int,end:int>>"

_CODE = np.full(128, -1, dtype=np.int16)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    for run in TOKEN.finditer(text):  # holds every key and every hex string that is long enough
        part, at = run[0], run.start()
        found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= MIN_ACCESS]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def chain(strings: Iterable[str], smoothing: float = 0.5) -> np.ndarray:
    """Log transition probabilities; the row after the last is for the first character."""
    n = len(ALPHABET)
    counts = np.full((n + 1, n), smoothing)
    for s in strings:
        codes = codes_of(s)
        if len(codes):
            np.add.at(counts, (np.r_[n, codes[:-1]], codes), 1)
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def codes_of(s: str) -> np.ndarray:
    raw = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    codes = _CODE[np.minimum(raw, 127)]
    return codes[codes >= 0].astype(np.int64)


def score(ratio: np.ndarray, s: str) -> float:
    codes = codes_of(s)
    return float(ratio[np.r_[len(ALPHABET), codes[:-1]], codes].mean()) if len(codes) else 0.0


def fit(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """The log ratio of the two chains from (string, 1 if random) pairs; needs both labels."""
    samples = list(samples)
    kinds = [[s for s, y in samples if y == label] for label in (1, 0)]
    if not all(kinds):
        raise ValueError("samples of both labels are needed")
    return chain(kinds[0]) - chain(kinds[1])


def training_samples(docs: DataFrame, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: words of the ``rows`` documents first by hash of their id (null ids aside), and drawn strings.

    The ids are chosen without their texts, so each task passes on ``rows`` numbers, not texts.
    """
    first = docs.filter("doc_id is not null").select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(rows).distinct()
    sample = docs.select("doc_id", "text").join(F.broadcast(first), F.xxhash64("doc_id") == F.col("h"), "left_semi").limit(rows)
    found = (
        sample.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_-]{3,}"), F.lit(0))).alias("w"))
        .distinct().orderBy(F.xxhash64("w")).limit(words)
    )
    own = [r["w"] for r in found.collect()]
    random_own = [w for w in own if any(b - a >= 0.8 * len(w) for a, _, b in base_spans(w))]
    ordinary = [w for w in own if not base_spans(w) and not (len(w) > 12 and sum(c.isdigit() for c in w) * 4 > len(w))]
    ordinary = ordinary or ["value", "index", "number", "result", "default", "context"]
    rng = np.random.default_rng(seed)
    joined = []
    for style in ("_", "-", "."):
        picks = rng.integers(0, len(ordinary), size=(1000, 3))
        joined += [style.join(ordinary[i] for i in p) for p in picks]
    camel = ["".join(ordinary[i].capitalize() for i in p) for p in rng.integers(0, len(ordinary), size=(1000, 3))]
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], "0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62])
    drawn = ["".join(a[i] for i in rng.integers(0, len(a), size=rng.integers(16, 64))) for a in alphabets for _ in range(1500)]
    return [(s, 0) for s in ordinary + joined + camel] + [(s, 1) for s in drawn + random_own]


def _parts(a: int, b: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What is left of a to b outside the sorted ``spans``."""
    out = []
    for x, _, y in spans:
        if x >= b:
            break
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return out + [(a, b)] if a < b else out


def _stretch(values: np.ndarray, ends: list[int]) -> tuple[int, int]:
    """The stretch of whole pieces (each up to one of ``ends``) with the largest sum."""
    sums = np.r_[0.0, np.cumsum(values)][[0, *ends]]
    low = np.minimum.accumulate(sums[:-1])
    j = int(np.argmax(sums[1:] - low))
    return [0, *ends][int(np.argmin(sums[: j + 1]))], ends[j]


def random_stretches(text: str, a: int, b: int, ratio: np.ndarray, least: float) -> list[tuple[int, int]]:
    """(start, end) of what scores as random in the token characters from a to b.

    The part is cut after ``/ . = - _``, and the stretch of pieces with the largest sum of log ratios is tried, then that of
    the sum above ``least`` a character, then the whole; what lies before and after a hit is looked at likewise.
    """
    out, todo = [], [(a, b)]
    while todo:
        a, b = todo.pop()
        while a < b and text[a] in EDGE:
            a += 1
        while a < b and text[b - 1] in EDGE:
            b -= 1
        if b - a < MIN_HEX:
            continue
        part = text[a:b]
        codes = codes_of(part)
        values = ratio[np.r_[len(ALPHABET), codes[:-1]], codes]
        ends = [i + 1 for i, c in enumerate(part) if c in CUTS] + [len(part)]
        whole = (0, len(part))
        for x, y in (whole,) if len(ends) == 1 else (_stretch(values, ends), _stretch(values - least, ends), whole):
            token = part[x:y].rstrip(EDGE)
            x += len(token) - len(token.lstrip(EDGE))
            token = token.lstrip(EDGE)
            kinds = sum(bool(re.search(k, token)) for k in ("[a-z]", "[A-Z]", "[0-9]"))
            if len(token) >= MIN_HEX and kinds >= 2 and score(ratio, token) >= least:
                out.append((a + x, a + x + len(token)))
                todo += [(a, a + x), (a + x + len(token), b)]
                break
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], ratio: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """The stretches of tokens outside the base spans that score as random."""
    found = []
    for run in TOKEN.finditer(text):
        near = [s for s in base if s[0] < run.end() and s[2] > run.start()]
        for part in _parts(*run.span(), near):
            found += [(a, 3, b) for a, b in random_stretches(text, *part, ratio, least)]
    return sorted(found)


def scanner(ratio: np.ndarray, least: float = MIN_SCORE):
    """A column function: the spans of a text by start, then kind; empty for a null or empty text."""

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if not text:
                out.append([])
                continue
            base = base_spans(text)
            spans = sorted(base + added_spans(text, base, ratio, least))
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
        return pd.Series(out)

    return scan


def find_secrets(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start and end (code points, end exclusive) of every secret in the whole text.

    Fitted on ``training_samples(docs)`` unless ``ratio`` is given. Kinds: assign, access, hex (the fixed
    patterns), markov (added by the models, never inside or across another). Null and empty texts have none; every row
    gives one row; a column called spans is replaced.
    """
    if ratio is None:
        ratio = fit(training_samples(docs))
    return docs.withColumn("spans", scanner(ratio)(F.col("text")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
