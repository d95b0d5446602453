"""Registered queries against their SQL on the smallest tables, if these are there."""

import decimal
import math
import os
import shutil
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

import __spark_entry__ as entry  # noqa: E402

#: A cross-section of the families; the driver compares all of them.
CHOSEN = "prepare_peaks bin_l2 mask_peaks formula_mass audit_lists fingerprint_rows split_keys energy_pairs expand_candidates ppm_match rank_candidates consensus_votes fdr_frontier bootstrap_delta silhouette window_patterns dedup_list stream_running_counts stream_ingest stream_dedup merge_mz dictionary_encode".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["hit_recall_curve", "library_search_metrics", "macro_metrics", "pair_rank", "stratified_metrics"])
def test_products_of_first_hits_return_a_row_a_query_and_task(spark, name, monkeypatch):
    """What later steps sort and hold in a task grows with the queries, not with the pairs."""
    from specspark.operators import tiles

    made, multiply = [], tiles.multiply

    def counted(*args, **kwargs):
        out = multiply(*args, **kwargs)
        made.append(out.count())
        return out

    monkeypatch.setattr(tiles, "multiply", counted)
    entry.queries()[name](spark, SF).collect()
    asked = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert made and max(made) <= asked * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_pair_rank_has_one_product_in_its_plan(spark):
    """Whether a query has a truth comes with its rank; the search for the best truth isn't run once more for it."""
    plan = entry.queries()["pair_rank"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["hit_recall_curve", "library_search_metrics", "macro_metrics", "pair_rank", "stratified_metrics"])
def test_ranks_without_a_row_a_pair(spark, con, name, monkeypatch):
    """Queries of first hits equal their SQL without the operator that makes every pair of query and candidate a row."""
    from specspark.operators import tiles

    def pairs(*args, **kwargs):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(tiles, "all_scores", pairs)
    test_query_equals_sql(spark, con, name)


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", ["corpus_pipeline.py", "empty folder", "nothing"])
def test_core_without_the_corpus_part(tmp_path, left):
    """With the corpus subpackage deleted, the entry still imports and offers every other query, whatever else is left of it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", *["corpus_pipeline.py"] * (left == "nothing"))
    copy = shutil.copytree(root, tmp_path / "copy", ignore=gone)
    if left == "empty folder":
        (copy / "specspark" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), *sorted(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)}, timeout=120)
    assert got.returncode == 0, got.stderr
    core = lambda names: [n for n in sorted(names) if not n.startswith("op") and n != "pipeline"]
    assert got.stdout.split() == core(entry.queries()) + core(entry.oracle_sql())


def test_normalized_scores_are_shuffled_packed(spark, con, monkeypatch):
    """Ranks of all scores of a query without a row a pair before them: a row a query and chunk of the library is shuffled."""
    from specspark.operators import tiles

    made, multiply = [], tiles.multiply
    monkeypatch.setattr(tiles, "multiply", lambda *a, **b: made.append(multiply(*a, **b)) or made[-1])
    test_query_equals_sql(spark, con, "normalize_scores")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert made[0].count() <= vectors.filter("vec_id % 100 = 0").count() * (vectors.count() // tiles.LIBRARY_CHUNK + parts)


def test_scores_are_rounded_as_the_sql_does(spark, tmp_path):
    """Best scores that lie between two of fewer digits: as doubles some are less than a half."""
    import duckdb

    halves = [0.5005, 0.5015, 0.5025, 0.5125, 0.2505, 0.145, 0.285, 0.0005]
    rows = []
    for i, x in enumerate(halves):  # each query has two axes of its own
        q, c = [0.0] * 16, [0.0] * 16
        q[2 * i], c[2 * i], c[2 * i + 1] = 1.0, x, math.sqrt(1 - x * x)
        rows += [(100 * i, q, i % 2), (100 * i + 1, c, 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("fdr_frontier", "fdr_working_point", "fdr_envelope", "top1_ties", "roc_curve"):
        df = entry.queries()[name](spark, str(tmp_path))
        cur = db.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        want = sorted((tuple(norm(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(norm(r[c]) for c in df.columns) for r in df.collect()), key=repr) == want, name


def test_hit_recall_curve_asks_for_every_vector(spark, monkeypatch):
    """No vector is left out of the queries, in the code or in the SQL."""
    from specspark.operators import tiles

    asked, multiply = [], tiles.multiply
    monkeypatch.setattr(tiles, "multiply", lambda q, *a, **b: asked.append(q.count()) or multiply(q, *a, **b))
    entry.queries()["hit_recall_curve"](spark, SF).collect()
    every = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert asked == [every, every]
    assert "% 100" not in entry.oracle_sql()["hit_recall_curve"]
