"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ``DIM`` signs, drawn from a seed and its code point. A trigram's vector
binds its letters' vectors, rolled by their position, by multiplication; a text's vector bundles (adds) those
of all its trigrams, counted over the whole text. A language's prototype bundles the unit vectors of its
training texts. A text gets the language whose prototype has the largest cosine with its vector.

Texts are lower-cased; every run of characters that are no letters is one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names

DIM, GRAM, SEED = 1024, 3, 11
UNDETERMINED = "und"
#: Prototypes (4 KB each) go to every task, so there may be at most so many languages; more is an error.
MAX_LANGS = 1000
#: Trigram vectors that a worker keeps at once (4 KB each).
CACHE = 20_000
#: Unit vectors are added as integers of this scale: sums don't depend on their order.
SCALE = 1 << 24


class Encoder:
    """Text vectors; letter and trigram vectors are kept between texts."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dim), dtype=np.float32)
        self.is_letter = np.zeros(0x110000, dtype=bool)
        self.known = np.zeros(0x110000, dtype=bool)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > CACHE:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).choice(np.float32([-1, 1]), self.dim)
        return self.letters[code]

    def symbols(self, text: str) -> np.ndarray:
        """Code points of the letters with single spaces between words and at both ends; empty without letters."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not self.known[codes].all():
            for c in np.unique(codes[~self.known[codes]]):
                self.is_letter[c], self.known[c] = chr(c).isalpha(), True
        seq = np.where(self.is_letter[codes], codes, 32).astype(np.uint64)
        seq = np.concatenate(([32], seq, [32])).astype(np.uint64)
        seq = seq[np.concatenate(([True], (seq[1:] != 32) | (seq[:-1] != 32)))]
        return seq if len(seq) > 2 else seq[:0]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        missing = [k for k in keys.tolist() if k not in self.rows]
        if missing:
            if len(self.rows) + len(missing) > CACHE:
                self.rows, missing = {}, keys.tolist()
            while len(self.rows) + len(missing) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for k in missing:
                row = self.rows[k] = len(self.rows)
                v = self.letter(k & 0x1FFFFF).copy()
                for i in range(1, GRAM):
                    v *= np.roll(self.letter((k >> (21 * i)) & 0x1FFFFF), i)
                self.table[row] = v
        return self.table[[self.rows[k] for k in keys.tolist()]]

    def encode(self, text: str | None) -> np.ndarray | None:
        """The unit vector of a text; None if it has no letter."""
        seq = self.symbols(text) if text else np.zeros(0, dtype=np.uint64)
        if not len(seq):
            return None
        keys = (seq[:-2] << np.uint64(42)) | (seq[1:-1] << np.uint64(21)) | seq[2:]
        keys, counts = np.unique(keys, return_counts=True)
        total = np.zeros(self.dim, dtype=np.float64)
        for i in range(0, len(keys), CACHE // 4):
            part = self.vectors(keys[i : i + CACHE // 4])
            total += counts[i : i + CACHE // 4].astype(np.float32) @ part
        norm = np.linalg.norm(total)
        return total / norm if norm else None


def fit(labelled: DataFrame, dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language from all rows of ``labelled`` (lang, text) with a lang and a letter.

    Each task adds up its texts and gives one vector a language; those are added element by element. The
    driver gets one vector a language.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, sums = Encoder(dim, seed), {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                v = encoder.encode(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + np.rint(v * SCALE).astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})

    rows = labelled.select("lang", "text").dropna().mapInPandas(partial, "lang string, v array<bigint>")
    summed = rows.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    found = vectors.limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        v = np.array(r["v"], dtype=np.float64)
        out[r["lang"]] = v / (np.linalg.norm(v) or 1.0)
    return out


def predictor(prototypes: dict[str, np.ndarray], dim: int = DIM, seed: int = SEED):
    """A column function: struct<lang, score> of a text; ``und`` and 0 without letters."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]).reshape(len(names), dim)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dim, seed)
        for texts in batches:
            langs, scores = [], []
            for text in texts:
                v = encoder.encode(text) if names else None
                if v is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    cosines = matrix @ v
                    best = int(cosines.argmax())
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@own_names
def identify(docs: DataFrame) -> DataFrame:
    """``docs`` with held_out, lang_pred and score.

    Prototypes come from all rows with a lang, a text and an id that isn't held out (none from null ids);
    the prediction uses the text alone. Null texts and texts without a letter give ``und`` and 0; so does
    every row when nothing can be learned. Equal cosines give the language first by name. Columns of these
    names are replaced; every row gives one row.
    """
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    predict = predictor(fit(train))
    df = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("__p", predict(F.col("text")))
    return df.withColumn("lang_pred", F.col("__p.lang")).withColumn("score", F.round("__p.score", 6)).drop("__p")
