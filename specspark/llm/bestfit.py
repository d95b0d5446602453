"""Packing token sequences by best fit and a local search that swaps documents between underfull bins.

Pieces are dealt to blocks at random. Each block is packed by best fit, longest first, and then searched: documents are
exchanged one for one, two for one or one for two, or moved, from the emptiest bin to fuller ones, so that the sum of squared fills
grows with every step and bins empty. Bins that stay underfull are dealt anew to blocks, whole, for further rounds of search; a
round only holds what can still be improved. A block is of bounded size, and their number grows with the table.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .packing import groups

SIZE, END_ID = 2048, 0
#: Pieces of a block; rounds of search after the first; a round is the last if it empties under this share of its bins.
BLOCK, ROUNDS, LEAST_GAIN = 16_384, 4, 0.002
#: Text parts whose token ids a worker keeps, and as many older ones.
CACHE = 250_000
#: Texts of these characters split the same way with ``re`` as in the tokenizer; others go through it whole.
UNUSUAL = re.compile("[^\t-\r -~¡-ſ]")
#: The tokenizer's own split, written out for those characters.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+")
#: Parts that stay apart when they follow each other.
JOINABLE = re.compile(f" [{LETTERS}]+| [{DIGITS}]+")
#: Parts that stay apart with a line break before each.
LINED = re.compile(f"[{LETTERS}]+|[{DIGITS}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; parts are encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # a space, as bytes are written there
        self.line_break = vocabulary.get("Ċ", -1)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_joined(self, parts: list[str]) -> list[bytes]:
        """Like ``_encode``, but all parts in one call: each begins with its only space, and so does its first token."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(parts):
            return self._encode(parts)
        raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _encode_lined(self, parts: list[str]) -> list[bytes]:
        """Like ``_encode``, but all parts in one call, each after a line break, which is a token of its own."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(f"\n{p}" for p in parts)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self.line_break)
        if len(at) != len(parts):
            return self._encode(parts)
        raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [raw[a + 4 : b] for a, b in zip(at, at[1:])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Parts that aren't kept yet are encoded together."""
        split = [None if UNUSUAL.search(t) or "<|" in t else SPLIT.findall(t) for t in texts]
        if len(self.kept) > CACHE:  # what is used again moves over, the rest goes at the next change
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        missing = set().union(*(p for p in split if p)).difference(kept)
        again = older.keys() & missing
        kept.update(zip(again, map(older.__getitem__, again)))
        missing -= again
        if missing:
            words = [p for p in missing if JOINABLE.fullmatch(p)]
            others = missing.difference(words)
            lined = [p for p in others if LINED.fullmatch(p)]
            others = list(others.difference(lined))
            for some, encode in ((words, self._encode_joined), (lined, self._encode_lined), (others, self._encode)):
                if some:
                    kept.update(zip(some, encode(some)))
        return [self._encode([t])[0] if p is None else b"".join(map(kept.__getitem__, p)) for t, p in zip(texts, split)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def byte_pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each text with ``end_id`` at its end; a null text is empty.

    Texts of more than ``size`` ids are cut into pieces of ``size``, the first of which may be shorter.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(path)
        for batch in batches:
            rows = []
            encoded = (x for part in groups([t or "" for t in batch["text"]]) for x in words.ids(part))
            for doc_id, ids in zip(batch["doc_id"], encoded):
                ids += end
                total = len(ids) // 4
                starts = [0, *range(total % size or size, total, size)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
                    rows.append((doc_id, piece, a, b - a, ids[4 * a : 4 * b]))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(cut, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class Bins:
    """Bins of one block: the lengths of items in each, and of underfull ones an index by what they could take in."""

    def __init__(self, size: int, bins: list[list[tuple[int, int]]] = ()):
        self.size = size
        #: (length, item) of each bin, and how full it is.
        self.items = list(bins)
        self.fill = [sum(n for n, _ in b) for b in self.items]
        #: By the most that it can take in for them: what one or two of a bin's items, or none, add up to; then the bin and these.
        self.reach: dict[int, dict[int, dict[tuple[int, int, int], None]]] = {}
        self.reaches = 0

    def best_fit(self, lengths: list[int]) -> None:
        """Put every item, longest first, into the fullest bin that has room, or a new one."""
        by_room: dict[int, list[int]] = defaultdict(list)
        rooms = 0  # bit r: some bin has room r
        for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
            length = lengths[item]
            room = _lowest(rooms, length)
            if room is None:
                b, room = len(self.items), self.size
                self.items.append([])
                self.fill.append(0)
            else:
                b = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            self.items[b].append((length, item))
            self.fill[b] += length
            if room > length:
                by_room[room - length].append(b)
                rooms |= 1 << (room - length)

    def search(self) -> int:
        """Exchange items between underfull bins, from the emptiest to fuller ones, as long as the sum of squared fills grows; how many times.

        A bin gives one or two items for none, one or two of another's, so that the other is as full as it can get. Of these
        exchanges the one that raises the sum most is made.
        """
        underfull = [b for b, f in enumerate(self.fill) if 0 < f < self.size]
        for b in underfull:
            self._list(b)
        made = 0
        for giver in sorted(underfull, key=lambda b: (self.fill[b], b)):
            if self.fill[giver] == self.size:
                continue
            self._unlist(giver)
            while self.fill[giver] and (best := self._best(giver)):
                self._exchange(giver, *best)
                made += 1
            if self.fill[giver]:
                self._list(giver)
        return made

    def _sums(self, b: int) -> Iterator[tuple[int, int, int]]:
        """(sum, one, other): the lengths of none, one and two items of a bin, each once."""
        many = sorted(Counter(n for n, _ in self.items[b]).items())
        yield 0, 0, 0
        for i, (x, times) in enumerate(many):
            yield x, x, 0
            for y, _ in many[i + (times == 1) :]:
                yield x + y, x, y

    def _list(self, b: int) -> None:
        room = self.size - self.fill[b]
        for total, one, other in self._sums(b):
            self.reach.setdefault(total + room, {}).setdefault(total, {})[b, one, other] = None
            self.reaches |= 1 << (total + room)

    def _unlist(self, b: int) -> None:
        room = self.size - self.fill[b]
        for total, one, other in self._sums(b):
            at = self.reach[total + room]
            del at[total][b, one, other]
            if not at[total]:
                del at[total]
            if not at:
                del self.reach[total + room]
                self.reaches &= ~(1 << (total + room))

    def _best(self, giver: int) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
        """(bin, given lengths, taken lengths) of the best exchange of those that leave the other bin least room."""
        best, most, mine = None, 0, self.fill[giver]
        for total, *given in self._sums(giver):
            reach = _lowest(self.reaches, total) if total else None
            if reach is None:
                continue
            taken = min(self.reach[reach])
            # the other bin's fill is then size - (reach - total), whichever bin it is
            gain = (total - taken) * (self.size - reach + total - mine)
            if taken < total and gain > most:
                b, *back = next(iter(self.reach[reach][taken]))
                best, most = (b, given, back), gain
        return best

    def _exchange(self, giver: int, b: int, given: list[int], taken: list[int]) -> None:
        self._unlist(b)
        for source, target, lengths in ((giver, b, given), (b, giver, taken)):
            for length in filter(None, lengths):
                at = next(i for i, (n, _) in enumerate(self.items[source]) if n == length)
                self.items[target].append(self.items[source].pop(at))
                self.fill[source] -= length
                self.fill[target] += length
        if self.fill[b] < self.size:
            self._list(b)


def _lowest(bits: int, least: int) -> int | None:
    """The lowest set bit from ``least`` on."""
    rest = bits >> least
    return least + (rest & -rest).bit_length() - 1 if rest else None


def _in_blocks(rows: DataFrame, block: Column, size: int, new: bool) -> DataFrame:
    """``rows`` with bin, offset and room (what its bin leaves free), each block packed (``new``) or its bins searched."""
    names = [f for f in rows.schema.fieldNames() if f not in ("bin", "offset", "room")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names), "bin bigint, offset bigint, room int"])

    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["__deal", "doc_id", "piece"], ignore_index=True, kind="stable")
        lengths = part["length"].tolist()
        if new:
            bins = Bins(size)
            bins.best_fit(lengths)
            ids = [key[0] << 20 | b for b in range(len(bins.items))]
        else:
            ids, held = [], {}
            for item, b in enumerate(part["bin"].tolist()):
                held.setdefault(b, []).append((lengths[item], item))
            ids = list(held)
            bins = Bins(size, list(held.values()))
        bins.search()
        bin_of, offset, room = (np.zeros(len(part), dtype=t) for t in (np.int64, np.int64, np.int32))
        for b, items in zip(ids, bins.items):
            at = 0
            for length, item in items:
                bin_of[item], offset[item] = b, at
                at += length
            for _, item in items:
                room[item] = size - at
        return part[names].assign(bin=bin_of, offset=offset, room=room)

    return rows.groupBy(block.alias("__block")).applyInPandas(packed, schema)


def pack_best_fit(pieces: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """``pieces`` (doc_id, piece, length up to ``size``, others) with sequence_id and offset, in few sequences of ``size`` tokens.

    At most ``block`` pieces or so are packed together. Bins that are full stay; the others are dealt whole to new blocks and
    searched again, until a round empties too few of them.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark, "best-fit")
    # equal rows are dealt apart; the number is written, so it stays
    rows = scratch.write(pieces.withColumn("__deal", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())), "pieces")
    blocks = max(partitions(spark), -(-rows.count() // block))
    left = scratch.write(_in_blocks(rows, F.pmod("__deal", F.lit(blocks)), size, True), "packed")
    scratch.drop(rows)
    done = []
    for i in range(1, ROUNDS + 1):
        done.append(left.filter(F.col("room") == 0))
        left = left.filter(F.col("room") > 0)
        before = left.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if before["bins"] < 2:
            break
        deal = F.pmod(F.xxhash64("bin", F.lit(i)), F.lit(-(-before["rows"] // block)))
        left = scratch.write(_in_blocks(left, deal, size, False), f"round-{i}")
        bins = left.filter(F.col("offset") == 0).count()
        if before["bins"] - bins <= LEAST_GAIN * before["bins"]:
            break
    for part in done:
        left = left.unionByName(part)
    return left.select(*pieces.columns, F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every row of ``docs`` (doc_id, text).

    Each row gives at least one piece, since ``end_id`` ends it; a null or empty text is that id alone. Rows with equal or null
    ids are packed separately; an empty table gives no rows. Sequences have any numbers and are filled without gaps from offset
    0. Other columns are left out. ``carry`` names columns to make of a piece's in place of ids.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    pieces = byte_pieces(docs, path or default_tokenizer(), size, end_id)
    return pack_best_fit(pieces.select("doc_id", "piece", "start", "length", *[c.alias(name) for name, c in carry.items()]), size)
