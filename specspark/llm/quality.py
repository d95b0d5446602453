"""Quality rules: how far a document's histograms stand from those of its language (DataFrame functions only).

Two histograms of each text are compared with those of all texts of the same ``lang``: character classes,
and the language's ``COMMON_WORDS`` most frequent words with one bin for all others. The measure is the
Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Short texts give noisy
histograms, so a text below ``MIN_CHARS`` or ``MIN_WORDS`` isn't judged by that histogram.

A text that lacks its language's common words can't be further off than one with none of them, so the limit
of the word distance is set against that one's distance, the language's *lack*: its square is
``LACK_SHARE`` of the lack's square and what chance alone gives a text of so many words (bins / 8 ln 2 n bits), at
most ``LACK_MOST`` of the lack, and ``MAX_WORD_DISTANCE`` at most. Where chance alone reaches ``LACK_NOISE`` of the
lack's square, the words are too few to tell, and only ``MAX_WORD_DISTANCE`` holds.

The references are learned from the whole table: every word of a language is counted exactly, and the first
``COMMON_WORDS`` by count (ties by word) stay. The characters are classed in the counted words, each once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, own_names

COMMON_WORDS = 32
MIN_WORDS, MIN_CHARS = 60, 200
MAX_WORD_DISTANCE, MAX_CLASS_DISTANCE = 0.47, 0.26
LACK_SHARE, LACK_MOST, LACK_NOISE = 0.35, 0.97, 0.75
WINDOW = 8
#: Slots by hash in which a language's common words are marked: a word of an unmarked slot is none of them.
SLOTS = 1024
#: Up to so many languages the references (about 3 KB each) are broadcast; beyond it they are joined by shuffle.
BROADCAST_LANGS = 2000
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
#: Character classes counted by a pattern, of which none holds a lower-case letter or white space. Then come non-ASCII, white
#: space (the characters outside the words) and lower-case letters (what no other class holds).
CLASSES = ("[A-Z]", "[0-9]", "[.,;:!?'\"()-]", r"[\x00-\x08\x0E-\x1F+/=@\[\\\]^_`{}~\x7F]", SYMBOLS)


def words_of(text: Column) -> Column:
    """The non-empty words; null for a null text."""
    return F.array_remove(F.split(text, SPACE), "")


def not_lower(text: Column) -> Column:
    """``text`` without its lower-case letters: what the class patterns have to look through."""
    return F.regexp_replace(text, "[a-z]+", "")


def _class_counts(rest: Column) -> list[Column]:
    """Counts of ``CLASSES`` and of non-ASCII characters in a text's words, given as ``not_lower``."""
    counted = [F.regexp_count(rest, F.lit(c)).cast("double") for c in CLASSES]
    return [*counted, F.char_length(rest) - sum(counted[1:], counted[0])]


def _class_shares(counts: Column) -> Column:
    """Shares of the counted classes of all characters (the last number), and of what is left."""
    n = len(CLASSES) + 2
    total = F.greatest(F.get(counts, F.lit(n)), F.lit(1.0))
    left = F.get(counts, F.lit(n)) - F.aggregate(F.slice(counts, 1, n), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[F.get(counts, F.lit(i)) / total for i in range(n)], left / total)


def language_references(docs: DataFrame) -> DataFrame:
    """(lang, classes, common, shares, marked, lack): of all non-null texts of each lang (null is a language of its
    own) the shares of the character classes, the most frequent words' hashes, the words' shares with all others
    last, which slots hold a common word, and the distance from the shares of a text with none of the words.
    The table is written; the table of counted words behind it is deleted again."""
    scratch = Scratch(docs.sparkSession, "quality")
    texts = docs.select("lang", "text").filter("text is not null")
    words = texts.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counted = scratch.write(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("k")), "language-words")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("k"), "word"))
    first = counted.withColumn("place", place).filter(F.col("place") <= COMMON_WORDS)
    in_order = F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("word").alias("word"))))
    common = first.groupBy("lang").agg(in_order.alias("top"))
    classed = counted.withColumn("rest", not_lower(F.col("word")))
    classed = classed.select("lang", "k", F.char_length("word").alias("long"), F.array(*_class_counts(F.col("rest"))).alias("c"))
    width = len(CLASSES) + 1
    totals = classed.groupBy("lang").agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("long")).alias("in_words"),
        F.array(*[F.sum(F.col("k") * F.get("c", F.lit(i))) for i in range(width)]).alias("c"),
    )
    chars = texts.groupBy(F.col("lang").alias("l")).agg(F.sum(F.char_length("text")).alias("chars"))
    totals = chars.join(totals, F.col("lang").eqNullSafe(F.col("l")), "left").drop("lang").withColumnRenamed("l", "lang")
    none = F.array(*[F.lit(0.0)] * width)
    space = (F.col("chars") - F.coalesce("in_words", F.lit(0))).cast("double")
    totals = totals.withColumn("c", F.concat(F.coalesce("c", none), F.array(space, F.col("chars").cast("double"))))
    refs = totals.join(common.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    top = F.coalesce("top", F.array().cast("array<struct<k:bigint,word:string>>"))
    words_total = F.greatest(F.col("n"), F.lit(1)).cast("double")  # greatest skips the null of a language without words
    top_total = F.aggregate(top, F.lit(0.0), lambda a, x: a - x["k"])
    refs = refs.select(
        "lang", _class_shares(F.col("c")).alias("classes"), F.transform(top, lambda x: F.xxhash64(x["word"])).alias("common"),
        F.concat(F.transform(top, lambda x: -x["k"] / words_total), F.array((words_total - top_total) / words_total)).alias("shares"),
    )
    none = F.concat(F.transform("common", lambda x: F.lit(0.0)), F.array(F.lit(1.0)))
    slots = F.transform("common", lambda h: slot(h))
    refs = refs.withColumn("marked", F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.array_contains(slots, i)))
    refs = scratch.write(refs.withColumn("lack", js_distance(none, F.col("shares"))), "language-references")
    scratch.drop(counted)
    return refs


def slot(h: Column) -> Column:
    return h.bitwiseAND(SLOTS - 1).cast("int")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, 0 to 1; null where one is null."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    total = F.aggregate(both, F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.least(F.greatest(total / 2, F.lit(0.0)), F.lit(1.0)))


def with_repeats(df: DataFrame, words: str, out: str) -> DataFrame:
    """Add ``out``: how many words lie in windows of eight words that ``words``, the array of their hashes, holds twice or more."""
    h1, h8, order, at = (f"__{out}_{x}" for x in ("1", "8", "o", "p"))
    keep = [c for c in df.columns]

    def doubled(h: Column, by: int) -> Column:
        return F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))

    n = F.size(words)
    df = df.withColumn(f"{h1}2", doubled(F.col(words), 1)).withColumn(f"{h1}4", doubled(F.col(f"{h1}2"), 2))
    # a window that lacks words hashes from a null: only the first n - 3, n - 7 are whole
    df = df.withColumn(f"{h1}4", F.when(n > WINDOW, F.slice(F.col(f"{h1}4"), 1, F.greatest(n - 3, F.lit(1)))))
    four = F.col(f"{h1}4")
    # most texts repeat no four words, so no eight
    df = df.withColumn(h8, F.when(F.size(F.array_distinct(four)) < F.size(four), F.slice(doubled(four, 4), 1, F.greatest(n - (WINDOW - 1), F.lit(1)))))
    df = df.withColumn(h8, F.when(F.size(F.array_distinct(h8)) < F.size(h8), F.col(h8)))
    df = df.withColumn(order, F.sort_array(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    s = F.col(order)
    twins = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    df = df.withColumn(at, F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))))
    p = F.col(at)
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return df.withColumn(out, F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")).select(*keep, out)


def word_limit(n: Column, bins: Column, lack: Column) -> Column:
    """The largest word distance of a kept text of ``n`` words, given the reference's bins and lack."""
    chance = bins / (8 * math.log(2) * n)
    square = F.least(LACK_SHARE * lack * lack + chance, (LACK_MOST * lack) ** 2)
    told = chance <= LACK_NOISE * lack * lack
    return F.when(told, F.least(F.sqrt(square), F.lit(MAX_WORD_DISTANCE))).otherwise(MAX_WORD_DISTANCE)


#: What ``judge`` adds, in order.
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


@own_names
def judge(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text and any others) with ``ADDED`` columns; input columns of those names are replaced.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not
    base_failed and both distances at most their limits. A null or empty text has no words: counts
    are 0 and it fails. A null lang is a language of its own. Every row gives one row.
    """
    keep = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*keep)
    refs = language_references(docs)
    small = refs.count() <= BROADCAST_LANGS
    refs = refs.select(*[F.col(c).alias(f"__ref_{c}") for c in refs.columns])
    df = docs.join(F.broadcast(refs) if small else refs, F.col("lang").eqNullSafe(F.col("__ref_lang")), "left")
    t = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("__w", words_of(t)).withColumn("n_words", F.size("__w").cast("bigint"))
    df = df.withColumn("__in", F.array_join("__w", "")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).drop("__w")
    df = df.withColumn("__rest", not_lower(F.col("__in"))).withColumn("word_chars", F.char_length("__in").cast("bigint")).drop("__in")
    total = F.char_length(t).cast("double")
    df = df.withColumn("__c", F.array(*_class_counts(F.col("__rest")), total - F.col("word_chars"), total)).drop("__rest")
    df = df.withColumn("n_symbols", F.get("__c", F.lit(len(CLASSES) - 1)).cast("bigint"))
    common, marked = F.col("__ref_common"), F.col("__ref_marked")
    df = df.withColumn("__hits", F.filter("__h", lambda h: F.get(marked, slot(h)) & F.array_contains(common, h)))
    df = with_repeats(df, "__h", "n_repeat_words").drop("__h")
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint")).drop("__lines")
    df = df.withColumn("class_distance", js_distance(_class_shares(F.col("__c")), F.col("__ref_classes")))
    hits, n = F.col("__hits"), F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    seen = F.array(*[(F.size(hits) - F.size(F.array_remove(hits, F.get(common, F.lit(i))))) / n for i in range(COMMON_WORDS)])
    shares = F.concat(F.slice(seen, 1, F.size(common)), F.array((n - F.size(hits)) / n))
    df = df.withColumn("word_distance", js_distance(shares, F.col("__ref_shares")))
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    far = ((F.char_length(t) >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > word_limit(n, F.size("__ref_common"), F.col("__ref_lack")))
    )
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return df.select(*keep, *ADDED)


@own_names
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with the columns of ``docs``.

    The row id stops the filter from being pushed below the projections, where each step's expression would be
    written out inside the next.
    """
    return judge(docs).withColumn("__row", F.monotonically_increasing_id()).filter("kept AND __row >= 0").select(*docs.columns)
