"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bestfit
from .common import table
from .fingerprints import fingerprint_documents
from .html import extract_pages
from .jaccard import near_duplicates
from .langid import identify
from .linededup import drop_frequent_lines
from .mixing import mix
from .packing import pack_documents
from .phrases import mine_phrases
from .quality import judge
from .secrets import find_secrets, joined
from .warc import read_archive, write_archive
from .whitening import whiten

QUERIES = {}
ORACLES = {}


def op(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@op()
def op1_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


@op()
def op2_quality(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


_OP4 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS l FROM docs)
),
often AS (SELECT k FROM (SELECT DISTINCT r, k FROM lines WHERE k <> '') GROUP BY k HAVING count(*) >= 10),
marked AS (SELECT r, i, l, k IN (SELECT k FROM often) AS gone FROM lines)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (
  SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
         sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY r) JOIN docs USING (r)
"""


@op(_OP4)
def op4_line_dedup(spark, sf_dir):
    kept = drop_frequent_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@op()
def op10_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *[F.size(F.filter(spans["kind"], F.lit(k).__eq__)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@op()
def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@op()
def op3_html(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@op()
def op5_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), carry={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_OP7 = """
WITH n AS (SELECT source, count(*) AS k FROM documents GROUP BY source),
t AS (SELECT sum(k) AS rows, count(*) AS sources FROM n),
r AS (SELECT source, CAST(rows AS DOUBLE) / sources / k AS rate FROM n, t),
steps AS (SELECT source, rate, i, sum(CASE WHEN i = 0 THEN 0 ELSE ln(greatest(i, 1)) END) OVER (PARTITION BY source ORDER BY i) AS lf
          FROM r, generate_series(0, 400) AS g(i)),
c AS (SELECT source, i, sum(exp(i * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY i) AS p FROM steps),
u AS (SELECT doc_id, text, lang, source, n_chars, CAST(CAST('0x' || substr(md5('17:' || coalesce(source, '') || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) FILTER (WHERE c.p <= u.u) AS times
      FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(g.i AS INTEGER) AS copy FROM d, generate_series(0, 60) AS g(i) WHERE g.i < times
"""


@op(_OP7)
def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy")


@op()
def op8_warc(spark, sf_dir):
    files = write_archive(table(spark, sf_dir, "pages"))
    return read_archive(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, e FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS e FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
often AS (SELECT e FROM s GROUP BY e HAVING count(*) > 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM (SELECT * FROM s SEMI JOIN often USING (e)) a JOIN s b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT twoway.a, reach.c FROM twoway JOIN reach ON twoway.b = reach.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


@op(_OP9)
def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


_OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i+1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i+2], ' '))) FROM w),
f AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k+1:m], ' ') AS rp FROM c, (VALUES (1), (2)) t(k) WHERE k < m),
s AS (SELECT cuts.lang, cuts.phrase, a, k, x.n AS l, y.n AS r, CAST((1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
over AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE m = 3) GROUP BY ALL),
best AS (SELECT worst.*, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.phrase) AS rank
  FROM worst LEFT JOIN over ON over.lang = worst.lang AND over.phrase = worst.phrase WHERE NOT coalesce(100 * over >= 50 * a, false))
SELECT best.lang, rank, phrase, a, l, r, total.n, score FROM best JOIN total USING (lang) WHERE rank <= 2000
"""


@op(_OP11)
def op11_collocations(spark, sf_dir):
    return mine_phrases(table(spark, sf_dir, "documents"))


@op()
def op12_best_fit(spark, sf_dir):
    packed = bestfit.pack_documents(table(spark, sf_dir, "documents"), carry={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@op()
def op13_whitening(spark, sf_dir):
    white = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "e")
    rows = white.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "e.whitened", "e.explained", "identity_error")
