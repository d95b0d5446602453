"""Near-duplicate documents: an exact Jaccard join of word n-gram sets that skips work by relations between sets.

Sets are 64-bit hashes of five-word shingles. Equal sets are one class from the start. The join works in three steps.

*Which sets can have a link.* Two sets that link share at least ``ceil(t n)`` elements of either, so the first k elements that they
share, in any order common to all sets, are among the first ``n - ceil(t n) + k`` of each. k grows with n, and a set's partners have at
least ``ceil(t n)`` elements: so a set stays only if as many as their k of its first elements (``ahead``) are found in other sets';
what stays is read whole, and sets of which less than ``ceil(t n)`` elements are found in another one go, too.

*Lists in blocks by position.* Elements are ordered by the number of sets that hold them, rarest first. If e is the first
element that x and y share, they share at most ``n - position of e`` elements of either. So x looks into the list of e only for sizes
that its position allows, and y is in that list only if it could link with sets of its size or more from its position. Lists
are cut in blocks by size; blocks that a position rules out are never paired. Passages that many sets share stand last
in the order, so sets that hold something of their own aren't in these lists at all.

*Answers of similar sets.* Each set is compared with one leader first, of the heads of its lists the one it shares most lists with
(the head of a list is the set that has the element first). A set that links follows the leader, with known differences to it, and the
lists hold leaders in place of their followers. Leaders that meet in a block are compared once; for their followers that answer and
the differences tell most links or their absence, and only the rest is compared itself.

In lists of more than ``SHORT_LIST`` sets, leaders are also told apart by bitmaps: every element of a set turns over one of ``BITS`` bits,
so two sets differ in at least as many elements as their bitmaps in bits.

No list is cut or sampled and no candidate is dropped without such a proof.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, own_names, partitions
from .shingles import digest, shingle_sets, short_key

PERCENT = 75
#: k as a share of n. It changes how much is read before most sets are ruled out, not the result.
AHEAD = 0.12
#: Sizes of one block of a list differ by this factor at most.
BLOCK_RATIO = 1.1
#: Bits of a bitmap, in words of 64. Lists of at most ``SHORT_LIST`` sets are joined without bitmaps, which saves their bytes.
WORDS, SHORT_LIST = 8, 8
BITS = 64 * WORDS
#: Ids (8 bytes) that may be broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
#: Comparisons with one set that are made in one piece; the set is repeated for further ones.
PIECE = 1000
#: Elements that a task holds before it passes them on.
HELD = 1 << 21
SETS = "id bigint, n int, d binary, d1 bigint"


def least_overlap(n: Column) -> Column:
    """The least overlap of a set of ``n`` with any set that it links with: ceil(0.75 n)."""
    return F.ceil(n * PERCENT / 100.0).cast("int")


def links(o: Column, na: Column, nb: Column) -> Column:
    """100 o >= 75 (na + nb - o), in whole numbers."""
    return (100 + PERCENT) * o >= PERCENT * (na + nb)


def ahead(n: int, share: float) -> int:
    """How many elements of a set of ``n`` are looked at first."""
    return n + (-n * PERCENT // 100) + max(1, math.floor(share * n))


def shared_ahead(n: Column, share: float) -> Column:
    """How many of these a set that links with another finds among its partner's: k of the smallest partner."""
    return F.greatest(F.floor(share * least_overlap(n)), F.lit(1))


def _column(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def summaries(docs: DataFrame) -> DataFrame:
    """(id, n, d, d1) of each row of ``docs`` (id, text): size and digest of its set, and 64 bits of that."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [(len(s), digest(s, i)) for i, s in zip(ids, shingle_sets(batch.column(1)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary()),
                 pa.array([short_key(d) for _, d in found], pa.int64())], names=["id", "n", "d", "d1"],
            )

    return docs.select("id", "text").mapInArrow(read, SETS)


def _first_elements(docs: DataFrame, share: float) -> DataFrame:
    """(e, d1, c) of the ``ahead`` elements of all sets of ``docs``.

    Each is a row with c = 0, except those that a task finds in several sets itself: such an element is one row of a
    null d1, however many sets hold it, and c of its own rows (e is any number then) counts them for a set.
    """

    def flush(sets: dict[int, np.ndarray]) -> pa.RecordBatch:
        keys = np.array(list(sets), np.int64)
        e, d1 = np.concatenate(list(sets.values())), np.repeat(keys, [len(s) for s in sets.values()])
        order = np.argsort(e, kind="stable")
        e, d1 = e[order], d1[order]
        starts = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        several = np.diff(np.append(starts, len(e))) > 1
        inside = np.repeat(several, np.diff(np.append(starts, len(e))))
        counted, counts = np.unique(d1[inside], return_counts=True)
        marks = e[starts[several]]
        out_d = np.concatenate((d1[~inside], np.zeros(len(marks), np.int64), counted))
        null = np.zeros(len(out_d), bool)
        null[(~inside).sum() : (~inside).sum() + len(marks)] = True
        out_c = np.concatenate((np.zeros((~inside).sum() + len(marks), np.int32), counts.astype(np.int32)))
        out_e = np.concatenate((e[~inside].view(np.int64), marks.view(np.int64), counted))
        return pa.RecordBatch.from_arrays([pa.array(out_e), pa.array(out_d, mask=null), pa.array(out_c)], names=["e", "d1", "c"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                if len(s):
                    first = s[: ahead(len(s), share)].copy()
                    size += len(first)
                    held[short_key(digest(s, 0))] = first
                    if size > HELD:
                        yield flush(held)
                        held, size = {}, 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(read, "e bigint, d1 bigint, c int")


def _counted(rows: DataFrame) -> DataFrame:
    """(d1, c): how many elements of each set are found in another one, from ``rows`` of ``_first_elements`` (or more, where a set occurs twice).

    Rows lie sorted by element, and a run of one element is told as it passes; a task holds one batch and the run at its end.
    """

    def told(e: np.ndarray, d: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """d of the rows whose element has a mark or two different d; rows are sorted by (e, mark first, d)."""
        new = np.append(True, (e[1:] != e[:-1]) | (d[1:] != d[:-1]) | (mark[1:] != mark[:-1])) if len(e) else np.zeros(0, bool)
        e, d, mark = e[new], d[new], mark[new]
        if not len(e):
            return d
        starts = np.append(True, e[1:] != e[:-1])
        run = np.cumsum(starts) - 1
        shared = (np.bincount(run) > 1) | (np.bincount(run, weights=mark) > 0)
        return d[shared[run] & ~mark]

    def counts(d: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        keys, inverse = np.unique(d, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(inverse, weights=c, minlength=len(keys)).astype(np.int64))], names=["d1", "c"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        rest = (none, none, np.zeros(0, bool))
        for batch in batches:
            e, c = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            mark = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            d = batch.column(1).fill_null(0).to_numpy()
            known = c > 0
            if known.any():
                yield counts(d[known], c[known])
            e, d, mark = (np.concatenate((x, y[~known])) for x, y in zip(rest, (e, d, mark)))
            last = np.searchsorted(e, e[-1]) if len(e) else 0
            found = told(e[:last], d[:last], mark[:last])
            if len(found):
                yield counts(found, np.ones(len(found)))
            rest = (e[last:], d[last:], mark[last:])
        found = told(*rest)
        if len(found):
            yield counts(found, np.ones(len(found)))

    dealt = rows.repartition(partitions(rows.sparkSession), "e").sortWithinPartitions("e", F.asc_nulls_first("d1"))
    return dealt.mapInArrow(read, "d1 bigint, c bigint").groupBy("d1").agg(F.sum("c").alias("c"))


def bitmap(s: np.ndarray) -> np.ndarray:
    """``WORDS`` words whose bits tell whether an odd number of elements falls on them."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def whole_sets(docs: DataFrame) -> DataFrame:
    """(d, n, set, bits) of each row of ``docs`` (text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
            ends = np.cumsum([0, *(len(s) for s in sets)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s, 0) for s in sets], pa.binary()), pa.array(np.diff(ends), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _column(np.concatenate([np.zeros(0, np.uint64), *sets]))),
                 pa.array([bitmap(s).tolist() for s in sets], pa.list_(pa.int64()))], names=["d", "n", "set", "bits"],
            )

    return docs.select("text").mapInArrow(read, "d binary, n int, set array<bigint>, bits array<bigint>")


def _small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of ids and little else, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.count() <= limit else df


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) is connected with.

    Labels take the smallest neighbouring label and are followed to their end, again and again, until
    no edge crosses two labels; each round is a written table.
    """
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = scratch.write(ids.select("id", F.col("id").alias("component")), "labels")
    cross = scratch.write(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while not cross.isEmpty():
        both = cross.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        parent = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")), "parents")
        while True:  # follow each label to its end
            up = parent.select(F.col("a").alias("b"), F.col("b").alias("c"))
            step = parent.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
            before, parent = parent, scratch.write(step, "parents")
            scratch.drop(before)
            if parent.filter("moved").isEmpty():
                break
        to = parent.select("a", F.col("b").alias("c"))
        named = labels.join(to, F.col("component") == F.col("a"), "left").select("id", F.coalesce("c", "component").alias("component"))
        left = cross.join(to, "a", "left").select(F.coalesce("c", "a").alias("a"), "b")
        left = left.join(to.select(F.col("a").alias("b"), "c"), "b", "left").select("a", F.coalesce("c", "b").alias("b"))
        before = (labels, cross, parent)
        labels, cross = scratch.write(named, "labels"), scratch.write(left.filter("a <> b").distinct(), "edges")
        scratch.drop(*before)
    scratch.drop(cross)
    return labels


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").filter("id is not null")
        self.scratch = Scratch(docs.sparkSession, "near-duplicates")

    def run(self) -> DataFrame:
        """(id, n, component) of every row with an id, as a written table, the only one that is left."""
        w = self.scratch
        rows = w.write(summaries(self.docs), "summaries")
        links_found = self._links(rows)
        several = rows.groupBy("id").agg(F.min("d").alias("b"), F.max("d").alias("most")).filter("b <> most").select("id", "b")
        several = w.write(several, "several-texts")
        if not several.isEmpty():  # the texts of one id are one document
            links_found = links_found.unionByName(rows.join(_small(several), "id").select(F.col("d").alias("a"), "b").filter("a <> b"))
        labels = components(links_found, w)
        named = rows.join(labels, F.col("d") == labels["id"], "left").select(rows["id"], "n", F.coalesce("component", "d").alias("label"))
        groups = named.groupBy("label").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select(F.col("label").alias("l"), "least")
        done = named.join(groups, F.col("label") == F.col("l"), "left").select("id", "n", F.coalesce("least", "id").alias("component"))
        result = w.write(done, "components")
        w.drop_all(result)
        return result

    def _links(self, rows: DataFrame) -> DataFrame:
        """(a, b) of digests: links that connect whatever links between different sets connect."""
        w = self.scratch
        sets = self._candidates(rows)
        order = self._ordered(sets)
        lists = self._lists(order)
        star = self._star(lists, order)
        heads = star.select(F.col("b").alias("a")).distinct()
        follows = star.join(heads, "a", "left_anti")  # a set that others follow stays a leader
        own, lost, apart = F.col("s_a") - F.col("o"), F.col("s_b") - F.col("o"), F.col("n_a") + F.col("n_b") - 2 * F.col("o")
        follows = w.write(follows.select(F.col("a").alias("k"), F.col("b").alias("leader"), "n_a", own.alias("own"), lost.alias("lost"), apart.alias("apart")), "followers")
        pairs = w.write(self._block_pairs(lists, follows, order), "leader-pairs")
        compared = self._compared(pairs, order)
        edges = star.select("a", "b").unionByName(self._answers(compared, follows, order))
        names = sets.select("k", "d")
        edges = edges.join(names.withColumnRenamed("k", "a"), "a").select(F.col("d").alias("x"), "b")
        return w.write(edges.join(names.withColumnRenamed("k", "b"), "b").select(F.col("x").alias("a"), F.col("d").alias("b")), "links")

    def _candidates(self, rows: DataFrame) -> DataFrame:
        """(k, d, n, set) of the different sets that may have a link; k is a number of this table."""
        w = self.scratch
        found = w.write(_counted(_first_elements(self.docs, AHEAD)), "shared-elements")
        one = rows.filter("n > 0").groupBy("d", "d1", "id").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
        one = one.groupBy("d", "d1").agg(F.min(F.struct("id", "k", "n")).alias("m")).select("d", "d1", "m.*")
        kept = w.write(one.join(found, "d1").filter(F.col("c") >= shared_ahead(F.col("n"), AHEAD)).select("id", "d", "k"), "kept")
        read = whole_sets(self.docs.join(_small(kept.select("id").distinct()), "id", "left_semi"))
        if not kept.filter("k > 1").isEmpty():  # rows that repeat both id and text
            read = read.dropDuplicates(["d"])
        sets = w.write(read.withColumn("k", F.monotonically_increasing_id()), "sets")
        w.drop(found, kept)
        return sets

    def _ordered(self, sets: DataFrame) -> DataFrame:
        """(k, n, s, bits): the elements that other sets of ``sets`` hold, too, the rarest first, of sets with enough of them."""
        w = self.scratch
        rows = sets.select("k", F.explode("set").alias("e"))
        often = rows.groupBy("e").agg(F.count(F.lit(1)).cast("int").alias("f")).filter("f > 1")
        shared = rows.join(often, "e").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("s"))
        shared = shared.join(sets.select("k", "n", "bits"), "k").filter(F.size("s") >= least_overlap(F.col("n")))
        return w.write(shared.select("k", "n", F.col("s.e").alias("s"), "bits"), "ordered")

    def _lists(self, order: DataFrame) -> DataFrame:
        """(e, k, n, rest, head, c): prefix elements that c sets, two or more, have in theirs. rest: how many elements of the set there are from e on.

        Elements of a set that no other one holds come first of all, so those of ``s`` are its last.
        """
        own = F.col("n") - F.size("s")
        length = F.greatest(F.col("n") - least_overlap(F.col("n")) + 1 - own, F.lit(0))
        rows = order.select("k", "n", F.size("s").alias("m"), F.posexplode(F.slice("s", 1, length)).alias("i", "e"))
        rows = rows.select("e", "k", "n", (F.col("m") - F.col("i")).alias("rest"))
        first = F.min(F.struct((F.col("n") - F.col("rest")).alias("at"), F.col("k").alias("k")))
        heads = rows.groupBy("e").agg(first.alias("h"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("e", F.col("h.k").alias("head"), "c")
        return self.scratch.write(rows.join(heads, "e"), "lists")

    def _star(self, lists: DataFrame, order: DataFrame) -> DataFrame:
        """Compared pairs (a, b, ...) that link, one of each set a at most: b is the head of most of its lists."""
        votes = lists.filter("k <> head").groupBy("k", "head").agg(F.count(F.lit(1)).alias("c"))
        best = votes.groupBy("k").agg(F.max(F.struct("c", (-F.col("head")).alias("h"))).alias("m"))
        pairs = self.scratch.write(best.select(F.col("k").alias("a"), (-F.col("m.h")).alias("b")), "star-pairs")
        compared = self._compared(pairs, order)
        return self.scratch.write(compared.filter(links(F.col("o"), F.col("n_a"), F.col("n_b"))), "star")

    def _compared(self, pairs: DataFrame, order: DataFrame) -> DataFrame:
        """``pairs`` (a, b), a written table, with the overlap o of their sets, the sizes n_a, n_b and s_a, s_b of their shared elements.

        A set of many pairs is repeated for every ``PIECE`` of them.
        """
        df = pairs
        for c, other in (("a", "b"), ("b", "a")):
            parts = pairs.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("parts"))
            df = df.join(parts, c).withColumn("part", F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).drop("parts")
            sets = order.join(parts, order["k"] == parts[c]).select(
                F.col("k").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"set_{c}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            )
            df = df.join(sets, [c, "part"]).drop("part")
        o = F.size(F.array_intersect("set_a", "set_b"))
        return self.scratch.write(df.select("a", "b", "n_a", "n_b", F.size("set_a").alias("s_a"), F.size("set_b").alias("s_b"), o.alias("o")), "compared")

    @staticmethod
    def _block_pairs(lists: DataFrame, follows: DataFrame, order: DataFrame) -> DataFrame:
        """(a, b), a < b: leaders (or sets that follow none) that meet, or whose followers meet, in a block of a list.

        Of a linking pair x, y with y not the larger one, let e be the first common element: both have at least
        the needed overlap from e on. So y stands in e's list with ``rest`` of at least what it needs with a set of its own size, in the block
        of its size, and x's rest admits a size of at most 7/3 rest - n: x looks into the blocks from 0.75 n to that.

        x and y link if they differ in at most 1/7 of their sizes together. They differ in at least what their leaders' bitmaps
        do, less what each differs from its leader.
        """
        t = 100 + PERCENT
        words = [f"w{i}" for i in range(WORDS)]
        # a leader is repeated for every ``PIECE`` of its followers, whose rows are dealt to its copies by element
        groups = follows.groupBy("leader").agg(F.max("apart").alias("radius"), F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("parts"))
        leaders = order.select(F.col("k").alias("g"), *[F.get("bits", F.lit(i)).alias(x) for i, x in enumerate(words)]).join(groups, F.col("g") == F.col("leader"), "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        leaders = leaders.select("g", F.coalesce("radius", F.lit(0)).alias("radius"), *words, copies)
        named = follows.select("k", "leader").join(groups.select("leader", "parts"), "leader")
        led = lists.select("e", "k", "n", "rest", "c").join(_small(named), "k", "left").withColumn("g", F.coalesce("leader", "k"))
        led = led.withColumn("part", F.coalesce(F.pmod(F.xxhash64("e"), F.col("parts")), F.lit(0)).cast("int"))
        led = led.join(leaders, ["g", "part"]).withColumns({x: F.when(F.col("c") > SHORT_LIST, F.col(x)) for x in words})

        def block(n: Column) -> Column:
            return F.floor(F.log(n.cast("double")) / math.log(BLOCK_RATIO) + 1e-9).cast("int")

        best = [F.max("rest").alias("rest"), F.min("n").alias("least"), F.max("n").alias("most"), *[F.max(x).alias(x) for x in ("radius", *words)]]
        listed = led.filter(t * F.col("rest") >= 2 * PERCENT * F.col("n")).groupBy("e", block(F.col("n")).alias("block"), "g").agg(*best)
        low = least_overlap(F.col("n"))
        high = F.least(F.col("n"), F.floor(t * F.col("rest") / PERCENT).cast("int") - F.col("n"))
        looking = led.withColumn("low", low).withColumn("high", high).filter("low <= high")
        blocks = F.explode(F.sequence(block(F.col("low")), block(F.col("high")))).alias("block")
        looking = looking.select("e", blocks, "g", "rest", "n", "radius", *words).groupBy("e", "block", "g").agg(*best)
        fields = ("g", "rest", "least", "most", "radius", *words)
        x, y = (df.select("e", "block", *[F.col(c).alias(f"{c}_{i}") for c in fields]) for df, i in ((looking, "x"), (listed, "y")))
        near = t * F.least("rest_x", "rest_y") >= PERCENT * (F.col("least_x") + F.col("least_y"))
        sizes = (F.col("least_x") * PERCENT <= F.col("most_y") * 100) & (F.col("least_y") * PERCENT <= F.col("most_x") * 100)
        bits = sum((F.bit_count(F.col(f"{v}_x").bitwiseXOR(F.col(f"{v}_y"))) for v in words[1:]), F.bit_count(F.col("w0_x").bitwiseXOR(F.col("w0_y"))))
        like = t * (F.coalesce(bits, F.lit(0)) - F.col("radius_x") - F.col("radius_y")) <= (100 - PERCENT) * (F.col("most_x") + F.col("most_y"))
        met = x.join(y, ["e", "block"]).filter((F.col("g_x") != F.col("g_y")) & near & sizes & like)
        return met.select(F.least("g_x", "g_y").alias("a"), F.greatest("g_x", "g_y").alias("b")).distinct()

    def _answers(self, leaders: DataFrame, follows: DataFrame, order: DataFrame) -> DataFrame:
        """(a, b): links of the compared ``leaders`` and, where these don't link, of the sets that follow them.

        For x of leader a and y of b: o(a, b) - lost(x) - lost(y) <= o(x, y) <= o(a, b) + own(x) + own(y), where own counts elements of x
        that its leader lacks and some other set holds.
        """
        w = self.scratch
        linked = links(F.col("o"), F.col("n_a"), F.col("n_b"))
        found = leaders.filter(linked).select("a", "b")
        members = follows.select("leader", F.col("k"), F.col("n_a").alias("n"), "own", "lost")
        widest = w.write(members.groupBy("leader").agg(F.max("own").alias("wide"), F.min("n").alias("small")), "widest")
        # leaders that link have their followers linked by way of them: only the other pairs need a look
        apart = leaders.filter(~linked).select("a", "b", "n_a", "n_b", "o")
        for c in ("a", "b"):
            m = widest.select(F.col("leader").alias(c), F.col("wide").alias(f"wide_{c}"), F.col("small").alias(f"small_{c}"))
            apart = apart.join(m, c, "left").withColumn(f"wide_{c}", F.coalesce(f"wide_{c}", F.lit(0))).withColumn(f"small_{c}", F.least(f"small_{c}", f"n_{c}"))
        apart = w.write(apart.filter(links(F.col("o") + F.col("wide_a") + F.col("wide_b"), F.col("small_a"), F.col("small_b"))), "apart")
        if apart.isEmpty():
            return found
        # on either side the leader and those followers that could link with someone of the other side
        sides = []
        for c, d in (("a", "b"), ("b", "a")):
            selves = apart.select("a", "b", F.col(c).alias("k"), F.col(f"n_{c}").alias("n"), F.lit(0).alias("own"), F.lit(0).alias("lost"))
            some = apart.join(members, F.col(c) == members["leader"]).select("a", "b", "k", "n", "own", "lost", "o", f"wide_{d}", f"small_{d}")
            some = some.filter(links(F.col("o") + F.col("own") + F.col(f"wide_{d}"), F.col("n"), F.col(f"small_{d}"))).select("a", "b", "k", "n", "own", "lost")
            sides.append(selves.unionByName(some).select("a", "b", *[F.col(x).alias(f"{x}_{c}") for x in ("k", "n", "own", "lost")]))
        both = apart.select("a", "b", "o").join(sides[0], ["a", "b"]).join(sides[1], ["a", "b"])
        both = both.filter(links(F.col("o") + F.col("own_a") + F.col("own_b"), F.col("n_a"), F.col("n_b")) & ((F.col("k_a") != F.col("a")) | (F.col("k_b") != F.col("b"))))
        sure = links(F.col("o") - F.col("lost_a") - F.col("lost_b"), F.col("n_a"), F.col("n_b"))
        both = w.write(both.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), sure.alias("sure")), "follower-pairs")
        unsure = w.write(both.filter("not sure").select("a", "b").distinct(), "unsure")
        rest = self._compared(unsure, order).filter(linked)
        return found.unionByName(both.filter("sure").select("a", "b")).unionByName(rest.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Two documents link when their shingle sets have a Jaccard similarity of 0.75 or more; component_id is the
    smallest doc_id reachable by links. A text of one to four words is one shingle; null, empty and blank texts have none and
    link with nothing. Rows with one doc_id are one document: a link of any is a link of all. Rows with a null id link
    with nothing and have a null component_id. Other columns are left out.
    """
    done = Join(docs).run()
    numbered = done.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.col("component").alias("component_id"))
    nameless = summaries(docs.filter("doc_id is null").select(F.lit(None).cast("bigint").alias("id"), "text"))
    return numbered.unionByName(nameless.select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))


@own_names
def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: one of the smallest doc_id (of rows with that id,
    the first by hash of the text). Rows with a null id all stay."""
    found = Join(docs).run()
    w = Scratch(docs.sparkSession, "keep-one")
    gone = w.write(found.filter("component <> id").select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    kept = docs.join(_small(gone), "doc_id", "left_anti")
    again = found.filter("component = id").groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("id").alias("doc_id"))
    again = w.write(again, "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    # repeated rows of one id, a rarity: the first of each
    by_text = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    first = kept.join(_small(again), "doc_id", "left_semi").withColumn("__r", F.row_number().over(by_text)).filter("__r = 1")
    rest = kept.join(_small(again), "doc_id", "left_anti")
    return rest.select(*docs.columns).unionByName(first.select(*docs.columns))
