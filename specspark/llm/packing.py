"""Packing token sequences: shortest pack first over the histogram of lengths.

Texts are tokenized and cut into pieces of at most ``size`` tokens (all but a text's last piece are full).
The driver sees only how many pieces there are of each length, at most ``size`` numbers. From the longest
length down, pieces go to the shortest pack that has room, kept as packing patterns with counts, so the
work depends on the number of lengths, not of documents. Each pattern slot stands for a range of ranks of its
length; pieces get ranks within their length and join the slots by rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

SIZE, END_ID = 2048, 1
#: Token ids of word pieces that a worker keeps.
CACHE = 500_000
#: Texts of these characters split the same way with ``re`` as in the tokenizer; others go through it whole.
UNUSUAL = re.compile("[^\t-\r -~¡-įı-ſ]")
#: The tokenizer's own split, written out for those characters after lower-casing.
SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\s0-9²³¹¼-¾a-zªµºß-öø-ſ]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; word pieces are encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Like ``_encode``, but all pieces in one call: every piece ends with an id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(pieces):
            return self._encode(pieces)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces that aren't kept yet are encoded together."""
        split = [None if UNUSUAL.search(t) or "<|" in t else SPLIT.findall(t.lower()) for t in texts]
        kept = self.kept
        missing = set().union(*(p for p in split if p)).difference(kept)
        if missing:
            if len(kept) > CACHE:
                kept.clear()
                missing = set().union(*(p for p in split if p))
            missing = list(missing)
            kept.update(zip(missing, self._encode_pieces(missing)))
        return [self._encode([t])[0] if p is None else b"".join(map(kept.__getitem__, p)) for t, p in zip(texts, split)]


def groups(texts: list[str], chars: int = 200_000) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together; a longer one is alone."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids) of each piece of each text with ``end_id`` at its end; a null
    text is empty. ids: little-endian unsigned 32-bit binary."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(path)
        for batch in batches:
            rows = []
            encoded = (x for part in groups([t or "" for t in batch["text"]]) for x in words.ids(part))
            for doc_id, ids in zip(batch["doc_id"], encoded):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, len(part) // 4, total, part))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(
        cut, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
    )


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) with counts that hold ``histogram[length]`` pieces of each length.

    Packs of one filled length are one group; from the longest length down, pieces fill the packs that
    are filled least, one each, as long as they fit; the rest open new packs.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, tuple[int, ...], int]] = []
        while left:
            filled = min(packs, default=size)
            if filled + length > size:
                break
            group = packs[filled]
            pattern, count = next(iter(group.items()))
            take = min(left, count)
            if take == count:
                del group[pattern]
                if not group:
                    del packs[filled]
            else:
                group[pattern] = count - take
            moved.append((filled + length, (*pattern, length), take))
            left -= take
            # a pack that just got a piece may take another of this length once none is shorter
            at = packs.setdefault(moved[-1][0], {})
            at[moved[-1][1]] = at.get(moved[-1][1], 0) + take
        if left:
            each = size // length
            whole, rest = divmod(left, each)
            for many, count in ((each, whole), (rest, 1 if rest else 0)):
                if count:
                    group = packs.setdefault(many * length, {})
                    key = (length,) * many
                    group[key] = group.get(key, 0) + count
    return [(p, c) for filled in sorted(packs, reverse=True) for p, c in packs[filled].items()]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset) of every slot of every pattern."""
    out, ranks, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            first = ranks.get(length, 0)
            out.append((length, first, first + count - 1, sequence, offset))
            ranks[length] = first + count
            offset += length
        sequence += count
    return out


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (doc_id, start, length up to ``size``, others) with sequence_id and offset.

    Pieces of one length are ranked by a hash bucket of (doc_id, start), then by these: no length is
    ranked in one task, however many pieces share it.
    """
    spark = pieces.sparkSession
    buckets = 4 * partitions(spark)
    pieces = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = written(pieces.groupBy("length", "__b").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    table = spark.createDataFrame(
        slots(shortest_pack_first(histogram, size)), "l bigint, lo bigint, hi bigint, seq bigint, off bigint"
    )
    within = Window.partitionBy("length", "__b").orderBy("doc_id", "start")
    ranked = pieces.withColumn("__n", F.row_number().over(within) - 1).join(firsts, ["length", "__b"])
    ranked = ranked.withColumn("__rank", F.col("__first") + F.col("__n"))
    at = (F.col("length") == F.col("l")) & F.col("__rank").between(F.col("lo"), F.col("hi"))
    # a few slots for each of the lengths: bounded by ``size``, not by the data
    placed = ranked.join(F.broadcast(table), at)
    return placed.select(
        *[c for c in pieces.columns if c != "__b"],
        (F.col("seq") + F.col("__rank") - F.col("lo")).alias("sequence_id"), F.col("off").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset) of every piece of every row of ``docs``.

    Each row gives at least one piece, since ``end_id`` ends it; a null or empty text is that id alone.
    Rows with equal or null ids are packed separately. Sequences are numbered from 0 and filled without
    gaps from offset 0. Other columns are left out. ``carry`` names columns to make of a piece's in place of ids: what
    only a digest of the ids is wanted of need not be written and shuffled with them.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = token_pieces(docs, path or default_tokenizer(), size, end_id)
    pieces = pieces.select("doc_id", "start", "length", "doc_tokens", *[c.alias(name) for name, c in carry.items()])
    return pack(written(pieces, "token-pieces"), size)
