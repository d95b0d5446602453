"""Document fingerprints from closed syncmers (DataFrame functions only).

A closed syncmer is a k-mer whose smallest inner s-mer (by hash) is its first or its last one. Whether
a k-mer is chosen depends on nothing outside it, so two texts that share a passage choose the same
anchors in it, and the anchors' positions can be matched.

Texts of ``SHORT_CHARS`` code points or more are read as words (k = 3 words, s = 1 word), shorter
ones and those with more than ``WORD_CHARS`` code points a word (unspaced scripts, encoded data) as characters
(k = 9, s = 3), so that even a line of text has anchors. Two texts of different units are compared by characters. A fingerprint is the
``SKETCH`` smallest distinct anchor hashes, each with the position of its first occurrence:
``w:<hash>@<position>.<hash>@<position>...`` in hexadecimal, or ``c:`` for characters. A text with no
complete k-mer has one anchor, the hash of the whole text, so equal texts always have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SHORT_CHARS, WORD_CHARS = 480, 20
SKETCH = 64
CHAR_K, CHAR_S = 9, 3
#: Anchors agree in position when their offset differs from the median offset by this many units, or
#: this share of the matched span.
SLACK, SLACK_SHARE = 16, 0.1
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def _hash32(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 32)


def with_sketch(df: DataFrame, text: str, out: str, chars_only: bool = False) -> DataFrame:
    """Add ``out``: array<struct<h bigint, p int>>, the sketch of column ``text``, by hash; and
    ``{out}_short``: whether it is made of characters, always with ``chars_only``. A null text has a null sketch."""
    n, words, letters, units, anchors, smallest, small = (f"__{out}_{x}" for x in ("n", "w", "c", "u", "a", "s", "k"))
    short, t = f"{out}_short", F.col(text)
    keep = [c for c in df.columns]
    df = df.withColumn(n, F.char_length(t))
    if chars_only:
        df = df.withColumn(words, F.lit(None).cast("array<string>")).withColumn(short, F.lit(True))
    else:
        df = df.withColumn(words, F.when(F.col(n) >= SHORT_CHARS, F.split(F.btrim(t, F.lit(SPACE_CHARS)), SPACE)))
        df = df.withColumn(short, (F.col(n) < SHORT_CHARS) | (F.size(words) * WORD_CHARS < F.col(n)))
    # a list of characters: a place in a string is found from its start only
    df = df.withColumn(letters, F.when(F.col(short) & t.isNotNull(), F.split(t, F.lit(""))))
    c = F.col(letters)
    # hashes of the s-mers: of each word, or of each three characters
    count = F.greatest(F.col(n) - CHAR_S + 1, F.lit(0))
    s_mers = F.when(
        F.col(short),
        F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.array_join(F.slice(c, i, CHAR_S), ""))))
        .otherwise(F.array().cast("array<bigint>")),
    ).otherwise(F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(units, s_mers)
    u = F.col(units)
    width = CHAR_K - CHAR_S + 1
    chars = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(u) - width + 1, F.lit(1))),
            lambda i: F.array_min(F.slice(u, i, width)) == F.least(F.get(u, i - 1), F.get(u, i + (width - 2))),
        ),
        lambda i: F.struct(_hash32(F.array_join(F.slice(c, i, CHAR_K), "")).alias("h"), i.alias("p")),
    )
    triples = F.arrays_zip(
        u.alias("a"), F.slice(u, 2, F.size(u)).alias("b"), F.slice(u, 3, F.size(u)).alias("c"),
        F.sequence(F.lit(1), F.size(u)).alias("p"),
    )
    by_words = F.transform(
        F.filter(triples, lambda z: z["c"].isNotNull() & ~((z["b"] < z["a"]) & (z["b"] < z["c"]))),
        lambda z: F.struct(_hash32(z["a"], z["b"], z["c"]).alias("h"), z["p"].alias("p")),
    )
    df = df.withColumn(anchors, F.when(F.col(short), F.when(F.size(u) >= width, chars)).otherwise(by_words))
    whole = F.when(t.isNotNull(), F.array(F.struct(_hash32(t).alias("h"), F.lit(0).alias("p"))))
    df = df.withColumn(anchors, F.when(F.size(anchors) > 0, F.col(anchors)).otherwise(whole))
    a = F.col(anchors)
    hashes = F.array_distinct(F.transform(a, lambda x: x["h"]))
    df = df.withColumn(smallest, F.get(F.sort_array(hashes), F.lit(SKETCH - 1)))
    last = F.col(smallest)
    df = df.withColumn(small, F.sort_array(F.filter(a, lambda x: last.isNull() | (x["h"] <= last))))
    k = F.col(small)
    first = F.filter(k, lambda x, i: (i == 0) | (F.get(k, i - 1)["h"] != x["h"]))
    return df.withColumn(out, first).select(*keep, short, out)


def fingerprint(sketch: Column, short: Column) -> Column:
    """The sketch as text."""
    marks = F.transform(
        sketch, lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 8, "0")), F.lit("@"), F.lower(F.hex(x["p"].cast("bigint"))))
    )
    return F.concat(F.when(short, F.lit("c:")).otherwise(F.lit("w:")), F.array_join(marks, "."))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out`` in [0, 1]: of the ``SKETCH`` smallest hashes of both sketches together, the share
    that both hold at agreeing relative positions. Both must be of one unit."""
    union, both, d = f"__{out}_u", f"__{out}_b", f"__{out}_d"
    keep = [c for c in df.columns]
    ha, hb = (F.transform(F.col(x), lambda x: x["h"]) for x in (a, b))
    df = df.withColumn(union, F.slice(F.sort_array(F.array_union(ha, hb)), 1, SKETCH))
    ha, hb = (F.transform(F.col(x), lambda x: x["h"]) for x in (a, b))
    df = df.withColumn(both, F.array_intersect(F.array_intersect(F.col(union), ha), hb))
    shared = F.col(both)
    at = [F.filter(F.col(x), lambda z: (F.size(shared) > 0) & F.array_contains(shared, z["h"])) for x in (a, b)]
    df = df.withColumn(d, F.zip_with(at[0], at[1], lambda x, y: F.struct((x["p"] - y["p"]).alias("d"), x["p"].alias("p"))))
    offsets = F.col(d)
    middle, slack = f"{d}_m", f"{d}_s"
    df = df.withColumn(middle, F.get(F.sort_array(F.transform(offsets, lambda x: x["d"])), F.floor(F.size(offsets) / 2).cast("int")))
    df = df.withColumn(
        slack,
        F.greatest(F.lit(SLACK).cast("double"), SLACK_SHARE * F.array_max(F.transform(offsets, lambda x: x["p"]))),
    )
    m, s = F.col(middle), F.col(slack)
    agree = F.size(F.filter(offsets, lambda x: m.isNotNull() & s.isNotNull() & (F.abs(x["d"] - m) <= s)))
    value = F.when(F.size(union) > 0, agree / F.size(union)).otherwise(F.lit(0.0))
    return df.withColumn(out, value.cast("double")).select(*keep, out)


def _boundaries(df: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 increasing ids that cut ``df`` into ranges of like size: its quantiles.

    This list and the first id of each range are all that the driver sees; its length is the number
    of ranges, not of documents.
    """
    row = df.select("doc_id").agg(
        F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("q")
    ).first()
    return sorted(set(row["q"] or []))


def with_next(docs: DataFrame, carry: list[str], ranges: int | None = None) -> DataFrame:
    """Add ``next_<c>`` for each column c of ``carry``: its value in the next row by descending doc_id
    (nulls last; equal ids by the hash of their text), after the last row that of the first.

    Rows are dealt to ranges of ids by quantiles; each range gets a copy of the row that follows it, so
    no window spans more than one range and nothing is ordered in one task.
    """
    spark = docs.sparkSession
    ranges = ranges or min(4096, 8 * partitions(spark))
    cuts = _boundaries(docs, ranges)
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    at = F.lit(0)
    if cuts:
        ident = F.col("doc_id")
        blocks = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in b]) for b in fine])
        k = F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in coarse]), lambda b: b <= ident))
        docs = docs.withColumn("__block", F.when(ident.isNull(), F.lit(-1)).otherwise(k))
        block = F.col("__block")
        inner = F.size(F.filter(F.get(blocks, block - 1), lambda b: b <= ident))
        at = F.when(block <= 0, block).otherwise((block - 1) * step + inner)
    docs = docs.withColumn("__range", at.cast("int")).withColumn("__tie", F.xxhash64("text"))
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("i"), F.col("doc_id").isNotNull().alias("n"), F.col("__tie").alias("t"))
    docs = docs.withColumn("__key", key)
    # the first row of each range by descending order, and the range that stands before it
    heads = {r["__range"]: r["k"] for r in docs.groupBy("__range").agg(F.max("__key").alias("k")).collect()}
    order = sorted(heads, reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the first range follows the last
    if order:
        head = spark.createDataFrame(
            [(r, heads[r]["i"], heads[r]["n"], heads[r]["t"], before[r]) for r in order],
            "hr int, hi bigint, hn boolean, ht bigint, hb int",
        )
        is_head = (F.col("__range") == F.col("hr")) & (F.col("__key.i") == F.col("hi")) & (F.col("__key.n") == F.col("hn")) & (F.col("__key.t") == F.col("ht"))
        docs = docs.join(F.broadcast(head), is_head, "left")  # one row for a range: at most ``ranges`` rows
    else:
        docs = docs.withColumn("hb", F.lit(None).cast("int"))
    own = F.struct(F.col("__range").alias("r"), F.lit(0).alias("copy"))
    docs = docs.withColumn(
        "__to", F.explode(F.when(F.col("hb").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("hb").alias("r"), F.lit(1).alias("copy")))))
    ).withColumn("__r", F.col("__to.r")).withColumn("__copy", F.col("__to.copy"))
    w = Window.partitionBy("__r").orderBy("__copy", F.col("__key").desc())
    for c in carry:
        docs = docs.withColumn(f"next_{c}", F.lead(c).over(w))
    return docs.filter("__copy = 0")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row of ``docs`` (doc_id, text).

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as
    many (or all) of the next document by descending doc_id; after the last document comes the first.
    A null text is an empty one. A single document follows itself. Equal or null ids are taken in the
    order of their text's hash, so rows are neither lost nor doubled. Other columns are left out; an
    empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = with_sketch(base, "text", "own")
    df = with_next(base, ["text", "own", "own_short"])
    df = df.select("doc_id", "text", "own", "own_short", "next_text", F.col("next_own").alias("following"), F.col("next_own_short").alias("following_short"))
    df = df.withColumn("n_chars", F.char_length("text").cast("bigint"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited_text", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - cut).cast("int")), F.col("next_text").substr(F.lit(1), cut)))
    df = df.withColumn("edited_sha256", F.sha2(F.col("edited_text").cast("binary"), 256))
    df = with_sketch(df, "edited_text", "edited")
    # pairs of both units: the one of words is read as characters, too
    own, edited, following = (F.col(f"{x}_short") for x in ("own", "edited", "following"))
    df = df.withColumns({
        "own_text": F.when(~own & (edited | following), F.col("text")),
        "edited_text": F.when(own & ~edited, F.col("edited_text")),
        "following_text": F.when(own & ~following, F.col("next_text")),
    }).drop("text", "next_text")
    for x in ("own", "edited", "following"):
        df = with_sketch(df, f"{x}_text", f"{x}_chars", chars_only=True).drop(f"{x}_text", f"{x}_chars_short")
    for x, out in (("edited", "near_edited"), ("following", "near_next")):
        mixed = own != F.col(f"{x}_short")
        df = df.withColumn("__own", F.when(mixed & ~own, F.col("own_chars")).otherwise(F.col("own")))
        df = df.withColumn("__other", F.when(mixed & own, F.col(f"{x}_chars")).otherwise(F.col(x)))
        df = with_likeness(df, "__own", "__other", out).drop("__own", "__other")
    return df.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("own"), F.col("own_short")).alias("fingerprint"),
        fingerprint(F.col("edited"), F.col("edited_short")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
