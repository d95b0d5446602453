"""Phrase collocations: n-grams of words counted in HAT-tries, scored by the weakest cut.

Phrases are counted level by level, one word longer each time. A task keeps a trie of word ids for each language: the root
leads to a phrase's first word, below it lies a hash container of the rest; a container that grows too large bursts into
containers below its second word. What a task keeps is bounded: beyond that, its largest subtrees are written out whole, as
sorted runs, one for each prefix partition. Runs of a partition meet in one place, where Spark's spilling aggregate merges them.

A phrase can only be frequent if the two phrases one word shorter in it are. These are put into a bit table of bounded size
which every task of the next level holds. It lets through what it can't tell apart, so counts are exact whatever its size.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

MIN_COUNT, MAX_WORDS, TOP, COVERED = 10, 3, 2000, 50
#: A phrase's word ids share a 63-bit number, 21 bits each.
BITS = 21
#: Entries and words that a task keeps, entries of a container before it bursts, bytes of text counted at once and of one text at most.
ENTRIES, WORDS, BURST, CHUNK, SEGMENT = 600_000, 400_000, 2048, 3 << 20, 2 << 20
#: The bit table has at most 2^27 bits (16 MB), 16 for each frequent phrase below that.
TABLE_BITS, BITS_EACH = 27, 16
#: A phrase's last word is dealt to this many parts, so that a frequent prefix isn't in one partition.
LAST_PARTS = 256
#: Rows of one rank group: groups of a language meet so many at a time.
FAN_IN = 16

#: A-Z to lower case, what ends a piece to a full stop, tab to space; all other bytes of UTF-8 stay.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
RUNS = "part int, lang string, phrases array<string>, counts array<bigint>"


def segments(text: bytes, words: int) -> Iterator[bytes]:
    """A text's words, with ``.`` between pieces and at the end, in parts of about ``SEGMENT`` bytes.

    A part begins with the last ``words`` - 1 words of the one before, so that every phrase lies in one part, and in one only.
    """
    text = text.translate(FOLD).replace(b".", b" . ")
    start, before = 0, b""
    while start < len(text):
        end = start + SEGMENT
        if end < len(text):
            cut = text.rfind(b" ", start + 1, end)
            if cut < 0:
                cut = text.find(b" ", end)
            end = cut if cut > 0 else len(text)
        part = before + text[start:end]
        yield part + b" ."
        if words > 1 and end < len(text):
            before = b" ".join(part.rsplit(None, words - 1)[-(words - 1) :]) + b" "
        start = end


def mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of phrases, longer by a word each."""
    with np.errstate(over="ignore"):
        h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def word_hash(word: bytes) -> int:
    return zlib.crc32(word) << 16 ^ zlib.crc32(word, 0x5EED)


class HatTrie:
    """Counts of one language's phrases of ``words`` words in a task.

    ``root`` leads from a first word's id to a container {ids of the other words: count}, or to a dict of such containers by
    second word once the first has burst. Single words are counted in the root itself, an array by id.
    """

    def __init__(self, lang: str, words: int):
        self.lang, self.words = lang, words
        self.start = np.array([word_hash(lang.encode())], dtype=np.uint64)
        self.root: dict[int, dict] = {}
        self.burst: set[int] = set()
        self.size: dict[int, int] = {}
        self.total = 0
        self.single = np.zeros(0, dtype=np.int64)

    def add_words(self, ids: np.ndarray) -> None:
        found = np.bincount(ids, minlength=len(self.single))
        found[: len(self.single)] += self.single
        self.single = found

    def add(self, codes: np.ndarray, counts: np.ndarray) -> int:
        """Add ``counts`` of distinct sorted ``codes``; how many entries are new."""
        shift = BITS * (self.words - 1)
        firsts = codes >> shift
        at = np.flatnonzero(np.diff(firsts, prepend=-1))
        rests, ns, ends = (codes & ((1 << shift) - 1)).tolist(), counts.tolist(), [*at[1:].tolist(), len(codes)]
        new = 0
        for first, lo, hi in zip(firsts[at].tolist(), at.tolist(), ends):
            node = self.root.get(first)
            if node is None:
                self.root[first] = dict(zip(rests[lo:hi], ns[lo:hi]))
                grown = hi - lo
            elif first in self.burst:
                grown = 0
                for rest, n in zip(rests[lo:hi], ns[lo:hi]):
                    below = node.setdefault(rest >> BITS, {})
                    had = len(below)
                    last = rest & ((1 << BITS) - 1)
                    below[last] = below.get(last, 0) + n
                    grown += len(below) - had
            else:
                had = len(node)
                for rest, n in zip(rests[lo:hi], ns[lo:hi]):
                    node[rest] = node.get(rest, 0) + n
                grown = len(node) - had
                if self.words > 2 and len(node) > BURST:
                    self._burst(first)
            self.size[first] = self.size.get(first, 0) + grown
            new += grown
        return new

    def _burst(self, first: int) -> None:
        below: dict[int, dict] = {}
        for rest, n in self.root[first].items():
            below.setdefault(rest >> BITS, {})[rest & ((1 << BITS) - 1)] = n
        self.root[first] = below
        self.burst.add(first)

    def take(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Remove whole subtrees: their codes and counts."""
        codes, ns = [], []
        for first in firsts:
            node, top = self.root.pop(first), first << (BITS * (self.words - 1))
            if first in self.burst:
                self.burst.discard(first)
                for second, below in node.items():
                    codes.extend([top | second << BITS | last for last in below])
                    ns.extend(below.values())
            else:
                codes.extend([top | rest for rest in node])
                ns.extend(node.values())
            del self.size[first]
        return np.array(codes, dtype=np.int64), np.array(ns, dtype=np.int64)


class Counter:
    """A task's tries, one for each language, and the words that they share."""

    def __init__(self, words: int, parts: int, passed: tuple[bytes, int] | None):
        self.words, self.parts = words, parts
        self.passed = None if passed is None else (np.frombuffer(passed[0], dtype=np.uint8), np.uint64(passed[1] - 1))
        self.held: dict[str, list[bytes]] = {}
        self.holds = 0
        self._forget()

    def _forget(self) -> None:
        self.tries: dict[str, HatTrie] = {}
        self.entries = 0
        self.ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.ids[b"."] = 0  # between pieces
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.names, self.ordered, self.rank = pa.array([], pa.binary()), [], np.zeros(0, dtype=np.int64)

    def hold(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        """Count a text's phrases, together with others' once there are enough."""
        for part in segments(text, self.words):
            self.held.setdefault(lang, []).append(part)
            self.holds += len(part)
            if self.holds > CHUNK:
                yield from self.count_held()

    def count_held(self) -> Iterator[pa.RecordBatch]:
        tokens = {lang: self._ids(parts) for lang, parts in self.held.items()}
        new = list(islice(self.ids, len(self.hashes), None))  # words lie in the order of their ids
        self.hashes = np.concatenate([self.hashes, np.array([word_hash(w) for w in new], dtype=np.uint64)])
        for lang, ids in tokens.items():
            self._count(lang, ids)
        self.held, self.holds = {}, 0
        if self.entries > ENTRIES:
            yield from self._spill(self.entries // 2)
        if len(self.ids) > WORDS:
            yield from self._finish()

    def _ids(self, parts: list[bytes]) -> np.ndarray:
        """The ids of all words of ``parts``, 0 between pieces: distinct words are looked up once."""
        found = pc.ascii_split_whitespace(pa.array(parts, pa.binary()).cast(pa.string())).flatten().dictionary_encode()
        words = found.dictionary.cast(pa.binary()).to_pylist()
        ids = np.fromiter((self.ids[w] if w else -1 for w in words), dtype=np.int64, count=len(words))[found.indices.to_numpy()]
        return ids[ids >= 0]

    def _count(self, lang: str, tokens: np.ndarray) -> None:
        """Count the phrases of ``tokens`` (ids, 0 between pieces)."""
        trie = self.tries.get(lang) or self._trie(lang)
        n = len(tokens) - self.words + 1
        if n <= 0:
            return
        fine = np.ones(n, dtype=bool)
        for i in range(self.words):
            fine &= tokens[i : i + n] > 0
        if self.words == 1:
            trie.total += int(fine.sum())
            trie.add_words(tokens[fine])
            return
        # the phrases one word shorter, by where they begin
        h, hs = np.broadcast_to(trie.start, (n + 1,)), self.hashes[tokens]
        for i in range(self.words - 1):
            h = mix(h, hs[i : i + n + 1])
        bits, mask = self.passed
        at = h & mask
        often = ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        fine &= often[:-1] & often[1:]
        where = np.flatnonzero(fine)
        codes = tokens[where]
        for i in range(1, self.words):
            codes = codes << BITS | tokens[where + i]
        if len(codes):
            self.entries += trie.add(*np.unique(codes, return_counts=True))

    def _trie(self, lang: str) -> HatTrie:
        self.tries[lang] = HatTrie(lang, self.words)
        return self.tries[lang]

    def _spill(self, least: int) -> Iterator[pa.RecordBatch]:
        """Write out the largest subtrees until ``least`` entries are gone."""
        trees = sorted(((n, lang, first) for lang, t in self.tries.items() for first, n in t.size.items()), reverse=True)
        chosen, gone = defaultdict(list), 0
        for n, lang, first in trees:
            if gone >= least:
                break
            chosen[lang].append(first)
            gone += n
        self.entries -= gone
        for lang, firsts in chosen.items():
            yield self._run(self.tries[lang], *self.tries[lang].take(firsts))

    def _names(self) -> tuple[pa.Array, np.ndarray]:
        """All words by id, and each one's place in their order."""
        if len(self.names) < len(self.ids):
            new = list(islice(self.ids, len(self.names), None))
            self.names = pa.concat_arrays([self.names, pa.array(new, pa.binary())])
            self.ordered = sorted(self.ordered + sorted(new))  # two runs that only need a merge
            self.rank = np.empty(len(self.names), dtype=np.int64)
            self.rank[np.fromiter(map(self.ids.__getitem__, self.ordered), dtype=np.int64, count=len(self.ordered))] = np.arange(len(self.ordered))
        return self.names, self.rank

    def _run(self, trie: HatTrie, codes: np.ndarray, ns: np.ndarray) -> pa.RecordBatch:
        """The sorted runs of these entries, a row for each prefix partition."""
        names, rank = self._names()
        words = [(codes >> (BITS * i)) & ((1 << BITS) - 1) for i in reversed(range(self.words))]
        h = np.broadcast_to(trie.start, codes.shape)
        for i, w in enumerate(words):
            h = mix(h, self.hashes[w] % np.uint64(LAST_PARTS) if i == 2 else self.hashes[w])
        part = (h % np.uint64(self.parts)).astype(np.int32)
        order = np.lexsort([*[rank[w] for w in reversed(words)], part])
        part, ns = part[order], ns[order]
        phrases = [names.take(pa.array(w[order])) for w in words]
        phrases = pc.binary_join_element_wise(*phrases, b" ") if self.words > 1 else phrases[0]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        return runs(part[at], trie.lang, [*at.tolist(), len(part)], phrases, ns)

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self.count_held()
        yield from self._finish()

    def _finish(self) -> Iterator[pa.RecordBatch]:
        """Write out everything; a language's number of words goes with the empty phrase."""
        for lang, trie in self.tries.items() if self.words == 1 else ():
            yield runs([0], lang, [0, 1], pa.array([b""]), [trie.total])
            ids = np.flatnonzero(trie.single)
            if len(ids):
                yield self._run(trie, ids, trie.single[ids])
        if self.entries:
            yield from self._spill(self.entries)
        self._forget()


def runs(part, lang: str, ends: list[int], phrases: pa.Array, ns) -> pa.RecordBatch:
    at = pa.array(ends, pa.int32())
    columns = [
        pa.array(part, pa.int32()), pa.array([lang] * len(part), pa.string()),
        pa.ListArray.from_arrays(at, phrases.cast(pa.string())), pa.ListArray.from_arrays(at, pa.array(ns, pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "lang", "phrases", "counts"])


def counted(docs: DataFrame, words: int, passed: tuple | None, min_count: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``words`` words found ``min_count`` times or more, from (lang, text) without nulls.

    ``passed``: the bit table (a broadcast) of the phrases one word shorter and its number of bits. For single words, the empty
    phrase has the number of words of each language.
    """
    spark = docs.sparkSession
    parts = partitions(spark)

    def count_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(words, parts, None if passed is None else (passed[0].value, passed[1]))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from counter.hold(lang, text.as_buffer().to_pybytes())
        yield from counter.finish()

    found = docs.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count_phrases, RUNS)
    # all runs of a prefix partition meet here; the aggregate needs no other exchange
    merged = found.repartitionById(parts, F.col("part")).select("part", "lang", F.inline(F.arrays_zip("phrases", "counts"))).groupBy("part", "lang", "phrases")
    merged = merged.agg(F.sum("counts").alias("n")).filter((F.col("n") >= min_count) | (F.col("phrases") == ""))
    return merged.select("lang", F.col("phrases").alias("phrase"), "n")


def bit_table(phrases: DataFrame) -> tuple[bytes, int]:
    """The bits at the hashes of (lang, phrase), and how many bits there are: a power of two, 2^``TABLE_BITS`` at most."""
    size = 1 << min(TABLE_BITS, max(10, (BITS_EACH * phrases.count() - 1).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.empty(batch.num_rows, dtype=np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h = np.array([word_hash(lang.encode())], dtype=np.uint64)
                for w in phrase.encode().split(b" "):
                    h = mix(h, np.array([word_hash(w)], dtype=np.uint64))
                at[i] = h[0]
            at &= np.uint64(size - 1)
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], names=["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(places, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size // 64, dtype=np.int64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return table.tobytes(), size


def first_ranked(df: DataFrame, by: str, deal: str, order: list, top: int) -> DataFrame:
    """The first ``top`` rows of each ``by`` in ``order``, with rank from 1: groups are cut to that in parts before they meet."""
    parts = partitions(df.sparkSession)
    df = df.withColumn("__part", F.pmod(F.xxhash64(deal), F.lit(parts)).cast("int"))
    while True:
        df = df.withColumn("rank", F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
        if parts == 1:
            return df.drop("__part")
        parts = -(-parts // FAN_IN)
        df = df.drop("rank").withColumn("__part", F.col("__part") % parts)


def phrase_counts(docs: DataFrame, scratch: Scratch, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> list[DataFrame]:
    """(lang, phrase, n), written, for each number of words from 1: phrases found ``min_count`` times or more in their language.

    Every occurrence inside a piece counts, overlapping ones too. The first table also has the empty phrase: the number of words.
    """
    if not 2 <= max_words <= 63 // BITS:
        raise ValueError(f"phrases have 2 to {63 // BITS} words")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    context, tables, passed = docs.sparkSession.sparkContext, [], None
    for words in range(1, max_words + 1):
        tables.append(scratch.write(counted(rows, words, passed, min_count), f"phrases-{words}"))
        if passed is not None:
            passed[0].unpersist()
        if words < max_words:
            table, bits = bit_table(tables[-1].filter(F.col("phrase") != ""))
            passed = context.broadcast(table), bits
    return tables


def mine_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language of ``docs`` (text, lang).

    A phrase of two words or more is found a times, its parts at a cut l and r times; floor(10^6 a^2 / (l r)) of its lowest
    cut (ties: the first) is its score. Phrases of which a longer one holds ``covered`` percent are left out. The first ``top``
    of a language by score, a (both falling) and phrase (bytes) are returned; n is the language's number of words.

    A null text is empty, a null language is ``und``; equal rows each count; a table without phrases gives no rows. Other
    columns aren't read. Scores are exact for counts under 10^16.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    tables = phrase_counts(docs, scratch, min_count, max_words)
    every, longer = tables[0], None
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.filter(F.col("phrase") != "")
    words = F.split("phrase", " ")
    asked = tables[1]
    for t in tables[2:]:
        asked = asked.unionByName(t)
    asked = asked.withColumnRenamed("n", "a").withColumn("w", words)
    cuts = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(every.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", big("a") * big("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", big("l") * big("r")).withColumn("s", F.expr("up div down"))
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("s", "k", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", F.col("c.s").alias("score"))
    for t in tables[2:]:
        w, size = F.col("w"), F.size("w")
        inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
        part = t.withColumn("w", words).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), F.col("n").alias("over"))
        longer = part if longer is None else longer.unionByName(part)
    if longer is not None:
        most = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
        scored = scored.join(most, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("over") < covered * F.col("a"), F.lit(True)))
    best = first_ranked(scored, "lang", "phrase", [F.desc("score"), F.desc("a"), "phrase"], top)
    total = tables[0].filter(F.col("phrase") == "").select("lang", "n")
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
