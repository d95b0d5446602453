"""Golden fixtures and properties of the core operators."""

import collections
import gzip
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.functions import peaks as pk
from specspark.functions import udf
from specspark.operators import audit as au
from specspark.operators import folds as fo
from specspark.operators import grouping as gr
from specspark.operators import joins as jn
from specspark.operators import listjoin as lj
from specspark.operators import metrics as mt
from specspark.operators import sampling as sm
from specspark.operators import search as se
from specspark.operators import tiles
from specspark.operators.running import before
from specspark.sources import mgf, tables

TWO = "BEGIN IONS\nTITLE=first\nPEPMASS=250.5 1000\n100.1 5 extra\n50 2\n# a comment\nEND IONS\nBEGIN IONS\nSCANS=7\nPEPMASS=99.5,3\n10 1\nEND IONS\n"


def spectra_of(spark, rows):
    return spark.createDataFrame(rows, "spectrum_id int, mz array<double>, intensity array<double>, precursor_mz double")


def test_mgf_reader(spark, tmp_path):
    (tmp_path / "two.mgf").write_text(TWO)
    with gzip.open(tmp_path / "three.mgf.gz", "wt") as f:
        f.write("BEGIN IONS\nNAME=n\nSCANS=-1\nPEPMASS=12,1\n5 5\nEND IONS\n")
    mgf.register(spark)
    got = {r["id"]: r for r in spark.read.format("mgf").load(str(tmp_path)).collect()}
    assert set(got) == {"first", "7", "n"}
    assert got["first"]["mz"] == [100.1, 50.0] and got["first"]["precursor_mz"] == 250.5 and got["7"]["precursor_mz"] == 99.5


@pytest.mark.parametrize("text, part", [
    ("BEGIN IONS\nTITLE=bad\n5 5\nEND IONS\n", "bad"), ("BEGIN IONS\nPEPMASS=5\n1 1\n", "isn't closed"),
    ("BEGIN IONS\nBEGIN IONS\n", "isn't closed"), ("BEGIN IONS\nTITLE=x\nPEPMASS=5\nEND IONS\n", "no peaks"), ("END IONS\n", "without a block"),
])
def test_mgf_errors(text, part):
    with pytest.raises(mgf.MgfError, match=part):
        list(mgf.parse(iter(text.splitlines())))
    list(mgf.parse(iter(text.splitlines()), strict=False))


def test_mgf_writer_round_trip(spark, tmp_path):
    mgf.register(spark)
    df = spark.createDataFrame([("a", [2.0, 1.0], [1.0, 5.0], 10.0, {"charge": "1"})], mgf.SCHEMA)
    df.write.format("mgf").mode("append").save(str(tmp_path / "o"))
    row = spark.read.format("mgf").load(str(tmp_path / "o")).first()
    assert (row["id"], row["mz"], row["intensity"], row["meta"]["CHARGE"]) == ("a", [1.0, 2.0], [5.0, 1.0], "1")


def test_mgf_stream_reads_each_file_once(spark, tmp_path):
    mgf.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mgf").write_text(TWO)
    for i in range(2):
        q = spark.readStream.format("mgf").load(str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(60)
        (tmp_path / "in/b.mgf").write_text(TWO)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_mzml(spark, tmp_path):
    import base64
    import zlib

    def array(values, kind, wide, packed):
        raw = np.array(values, "<f8" if wide else "<f4").tobytes()
        raw = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        params = f'<cvParam accession="{kind}" value=""/>' + ('<cvParam accession="MS:1000523" value=""/>' if wide else "") + ('<cvParam accession="MS:1000574" value=""/>' if packed else "")
        return f"<binaryDataArray>{params}<binary>{raw}</binary></binaryDataArray>"

    def spectrum(name, level):
        return (f'<spectrum id="{name}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="X" value="1"/><precursorList><precursor><selectedIonList><selectedIon><cvParam accession="MS:1000744" value="321.5"/><cvParam accession="Y" value="2"/></selectedIon></selectedIonList></precursor></precursorList>'
                f'<binaryDataArrayList>{array([1.5, 2.5], "MS:1000514", True, True)}{array([10, 20], "MS:1000515", False, False)}</binaryDataArrayList></spectrum>')

    (tmp_path / "m.mzML").write_text(f"<mzML><run><spectrumList>{spectrum('s1', 1)}{spectrum('s2', 2)}</spectrumList></run></mzML>")
    rows = mgf.read_spectra(spark, str(tmp_path / "m.mzML")).collect()
    assert [(r["id"], r["mz"], r["intensity"], r["precursor_mz"]) for r in rows] == [("s2", [1.5, 2.5], [10.0, 20.0], 321.5)]
    with pytest.raises(ValueError):
        mgf.read_spectra(spark, "x.raw")


def test_formula_counts_are_worked_out_once(spark):
    """However many columns are made of a row's counts, its text is read once for them, and a fixed formula is a constant."""
    from specspark.functions import chemistry as ch

    df = spark.createDataFrame([("C6H12O6",), ("CH3CH2OH",), ("",), (None,), ("NaCl2Si",)], "f string")
    counted = ch.with_counts(df, "c", "f")
    rest = ch.formula_diff(F.col("c"), ch.counts_of("CH4"))
    out = counted.withColumn("rest", rest).select("f", "c", ch.formula_mass(F.col("c")).alias("m"), *[ch.element(F.col("rest"), e).alias(e) for e in "CH"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2  # elements and numbers
    rows = {r["f"]: r for r in out.collect()}
    assert rows["CH3CH2OH"]["c"] == {"C": 2, "H": 6, "O": 1} and (rows["CH3CH2OH"]["C"], rows["CH3CH2OH"]["H"]) == (1, 2)
    assert rows["NaCl2Si"]["c"] == {"Cl": 2, "Na": 1, "Si": 1} and rows[""]["c"] == {} and rows[None]["c"] is None and len(rows) == 5
    constant = df.limit(1).select(ch.counts_of("CH3CH2OH").alias("k"), ch.formula_counts(F.lit("CH3CH2OH")).alias("v")).first()
    assert constant["k"] == constant["v"]


def test_ms_blocks(spark, tmp_path):
    (tmp_path / "a.ms").write_text(">compound c\n>parentmass 100.5\n>note x\n>note y\n\n>ms2 20 eV\n10 1\n20 2\n\n>collision 30\n11 1\n\n>ms1\n")
    rows = tables.read_ms_blocks(spark, str(tmp_path)).orderBy("block").collect()
    assert [r["mz"] for r in rows] == [[10.0, 20.0], [11.0]] and rows[0]["meta"]["note'"] == "y"
    tables.write_ms(tables.read_ms_blocks(spark, str(tmp_path)), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("*.ms"))) == 2  # a file a text
    back = tables.read_ms_blocks(spark, str(tmp_path / "out")).orderBy("file").collect()
    assert [r["mz"] for r in back] == [[10.0, 20.0], [11.0]]
    named = tables.read_ms_blocks(spark, str(tmp_path / "out")).withColumn("n", F.element_at(F.split("file", "/"), -1))
    tables.write_ms(named, str(tmp_path / "named"), "n")
    with pytest.raises(ValueError, match="names 2 texts"):
        tables.write_ms(named.withColumn("n", F.lit("same")), str(tmp_path / "bad"), "n")
    with pytest.raises(Exception, match="no file name"):
        tables.write_ms(named.withColumn("n", F.concat(F.lit("../"), "n")), str(tmp_path / "bad"), "n")
    with pytest.raises(ValueError):
        tables.ms_blocks(">ms2\n1 1\n")


def test_ms_compounds(spark, tmp_path):
    """Many compounds lie in few files, are cut apart wherever Spark splits a file, and come back with their own metadata."""
    df = spark.range(500).select(F.concat(F.lit("c "), "id").alias("n"), F.create_map(F.lit("parentmass"), F.col("id").cast("string"), F.lit("note"), F.lit("a>compound b")).alias("meta"),
                                 F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda x: x + 0.5).alias("mz"), F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda x: x * 1.0).alias("intensity"))
    out = str(tmp_path / "out")
    tables.write_ms_compounds(df.repartition(3), out, "n")
    assert len([f for f in os.listdir(out) if f.endswith(".ms")]) == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        read = tables.read_ms_compounds(spark, out)
        assert read.rdd.getNumPartitions() > 10
        got = {r["meta"]["compound"]: r for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 500 and read.count() == 500
    for i in range(500):
        r = got[f"c {i}"]
        assert r["meta"] == {"compound": f"c {i}", "parentmass": str(i), "note": "a>compound b"} and r["block"] == 0
        assert r["mz"] == [x + 1.5 for x in range(i % 5 + 1)] and r["intensity"] == [x + 1.0 for x in range(i % 5 + 1)]
    for j, odd in enumerate((F.lit(None).cast("string"), F.lit(" "), F.lit("#x"), F.lit("a\n>compound b"))):
        with pytest.raises(Exception, match="no compound"):
            tables.write_ms_compounds(df.limit(1).withColumn("n", odd), str(tmp_path / f"bad{j}"), "n")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.ms").write_text("# made\n>compound a\n>parentmass 1\n>ms2\n1 2\n")
    with pytest.raises(Exception, match="doesn't begin"):
        tables.read_ms_compounds(spark, str(tmp_path / "odd")).collect()


def test_tables_round_trips(spark, tmp_path):
    df = spectra_of(spark, [(1, [1.5, 2.5], [3.0, 4.0], 9.0)])
    back = tables.unpack_spectrum(tables.pack_spectrum(F.col("mz"), F.col("intensity")), F.size("mz"))
    assert df.select(back.alias("b")).first()["b"]["mz"] == [1.5, 2.5]
    text = tables.format_peak_tuples(F.col("mz"), F.col("intensity"), 1)
    assert df.select(text.alias("t"), tables.parse_peak_tuples(text).alias("p")).first()["t"] == "[('1.5', '3.0'), ('2.5', '4.0')]"
    p = spark.createDataFrame([("1, 2,x,4", "5,inf,1,0,9")], "mzs string, intensities string")
    assert tables.parse_peak_text(p).select("mz", "intensity").first() == ([1.0, 4.0], [5.0, 0.0])
    j = spark.createDataFrame([('{"a": ["x", "y"], "b": []}',)], "j string")
    assert [tuple(r) for r in tables.candidate_rows(j, "j").orderBy("pos").collect()] == [("a", 0, "x"), ("a", 1, "y")]
    s = tables.equal_shards(spark.range(23).withColumnRenamed("id", "o"), "o", 4)
    assert [r["n"] for r in s.groupBy("shard").agg(F.count("*").alias("n")).orderBy("shard").collect()] == [6, 6, 6, 5]
    assert s.groupBy("shard").agg((F.max("o") - F.min("o") + 1 == F.count("*")).alias("c")).filter("not c").count() == 0
    d = tables.dictionary_encode(spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "o int, v string"), "v", "o", "i")
    assert {r["v"]: r["i"] for r in d.collect()} == {"b": 0, "a": 1}
    spark.createDataFrame([(1.5, "nan")], "RT double, adduct string").write.parquet(str(tmp_path / "s"))
    row = tables.read_shards(spark, str(tmp_path / "s"), str(tmp_path / "missing")).first()
    assert row["rt"] == 1.5 and row["adduct"] is None and row["polarity"] is None


def test_prepare_peaks_ties(spark):
    df = spectra_of(spark, [(1, [5.0, 1.0, 3.0, 2.0, -1.0], [2.0, 2.0, 4.0, 2.0, 9.0], 9.0), (2, [1.0, 2.0], [1.0, 1.0], 9.0), (3, [3.0, 2.0, 1.0], [0.0, 0.0, 0.0], 5.0)])
    got = {r["spectrum_id"]: (r["mz"], r["intensity"]) for r in pk.prepare_peaks(df, 3).collect()}
    assert got == {1: ([1.0, 2.0, 3.0], [0.5, 0.5, 1.0]), 3: ([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])}
    assert pk.prepare_peaks(df, 3, on_zero_max="reject").count() == 1


def test_merge_mz_error(spark):
    df = spark.createDataFrame([([100.0, 200.0],)], "mz array<double>")
    with pytest.raises(Exception, match="too far apart"):
        df.select(pk.merge_mz(F.col("mz"), 10.0)).collect()


def test_audit_of_spoilt_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0, 0.0], [1.0, 1.0, 0.0]), (1, [2.0, 1.0, 3.0], [1.0, 0.0, 1.0]), (2, None, [1.0]), (3, [nan, -1.0, 1.0], [1.0, 1.0, -2.0]), (4, [0.0, 5.0], [0.0, 1.0])]
    df = spark.createDataFrame([(0, a, b, 100.0, 1, 10.0) for _, a, b in rows], "shard int, mz array<double>, intensity array<double>, precursor_mz double, polarity int, rt double")
    r = au.audit(df).first()
    assert (r["rows"], r["lists_null"], r["lengths_equal"], r["mz_nonfinite"], r["mz_negative"], r["interleaved"], r["pairs_invalid"], r["padding_mismatch"]) == (5, 1, 4, 1, 1, 1, 1, 1)
    assert (r["unsorted"], r["peaks_0"], r["peaks_1"], r["peaks_2"], r["peaks_3"]) == (1, 1, 2, 1, 1)
    assert au.check_closure(au.audit(df)).count() == 0
    assert au.check_schema(df) == [] and len(au.check_schema(spark.createDataFrame([(1, "x")], "mz int, rt string"))) == 3


def test_fingerprint_of_any_partitioning(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert {au.fingerprint(df.repartition(n)).first()[0] for n in (1, 4, 17)} == {au.fingerprint(df).first()[0]}
    assert au.run_identity({"a": 1}, df) == au.run_identity({"a": 1}, df) != au.run_identity({"a": 2}, df)


def test_balance_fails_when_short(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id int, c string")
    with pytest.raises(ValueError):
        sm.balance_exact(df, "c", "a", "b", "id", 1)
    assert sm.balance_exact(df, "c", "b", "a", "id", 1).groupBy("c").count().filter("count <> 2").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_samplers_ignore_partitions(spark, parts):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 20).alias("k")).repartition(parts)
    split = {r["k"]: r["split"] for r in sm.split_keys(df, "k", 3).collect()}
    assert sorted(split.values()).count("test") == 3 and len(split) == 20
    assert sorted(r["id"] for r in sm.choose_queries(df, "k", "id", 1).collect()) == sorted(r["id"] for r in sm.choose_queries(df.coalesce(1), "k", "id", 1).collect())


def test_complete_link_differs_from_single_link(spark):
    pairs = [("x", 1, 2, 0.9), ("x", 2, 3, 0.8), ("x", 1, 3, 0.2), ("x", 4, 5, 0.7), ("x", 3, 4, 0.6)]
    df = spark.createDataFrame(pairs, "block string, a int, b int, similarity double")
    at = lambda t: sorted((r["id"], r["cluster"]) for r in gr.complete_link(df, "block", t).collect())
    assert at(0.5) == [(1, 1), (2, 1), (4, 4), (5, 4)] and at(0.85) == [(1, 1), (2, 1)]


def test_nmi_ari(spark):
    df = spark.createDataFrame([(i % 4, i % 4, i // 4 % 4) for i in range(64)], "a int, b int, c int")
    assert gr.nmi(df, "a", "b").first()[0] == pytest.approx(1) and gr.ari(df, "a", "b").first()[0] == pytest.approx(1)
    assert gr.nmi(df, "a", "c").first()[0] == pytest.approx(0, abs=1e-9) and abs(gr.ari(df, "a", "c").first()[0]) < 0.06


def test_votes_and_fdr(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", "b"]), (1, ["c", "a"])], "g int, c array<string>")
    assert [r["candidate"] for r in mt.consensus(df, "g", "c", 2).orderBy("rank").collect()] == ["a", "b", "c"]
    scores = spark.createDataFrame([(0.9, True)] * 9 + [(0.8, False), (0.8, True)], "s double, c boolean")
    front = mt.fdr_frontier(scores, "s", "c").orderBy(F.desc("s")).collect()
    assert front[0]["fdr"] is None and front[1]["fdr"] == pytest.approx(1 / 11)


def test_joins(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k int, x double").withColumn("g", F.lit(1))
    b = spark.createDataFrame([(7, 10.2), (8, 9.8), (9, 25.0)], "id int, y double").withColumn("g", F.lit(1))
    got = {r["k"]: r["id"] for r in jn.nearest_join(a, b, ["g"], "x", "y", 0.5, ["k"], "id").collect()}
    assert got == {1: 7, 2: None, 3: None}
    with pytest.raises(ValueError):
        jn.merge_one_to_one(a, a.filter("k > 1"), "k")
    with pytest.raises(Exception, match="no vector"):
        jn.attach_vectors(a, spark.createDataFrame([(1, [1.0])], "k int, v array<double>"), "k", "v").collect()
    full = jn.fill_cache(a.select("k"), a.filter("k = 1").select("k", "x"), "k", lambda m: m.withColumn("x", F.lit(0.0)))
    assert sorted((r["k"], r["x"]) for r in full.collect()) == [(1, 10.0), (2, 0.0), (3, 0.0)]


def test_ann_recall(spark):
    r = np.random.default_rng(0)
    centers = r.normal(size=(10, 16))
    rows = [(i, (centers[i % 10] + 0.1 * r.normal(size=16)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    q = df.filter("k < 20")
    exact = {(x["query"], x["k"]) for x in se.blocked_topk(q, df, "k", "v", 5).collect()}
    found = {(x["query"], x["k"]) for x in se.ann_topk(df, "k", "v", q, 5).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_ann_has_k_rows_whatever_the_cells_hold(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.normal(size=8).tolist()) for i in range(40)] + [(90, [0.0] * 8), (91, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    out = se.ann_topk(df, "k", "v", df.filter("k in (0, 1, 90)"), 30, probes=1).groupBy("query").count().collect()
    assert {tuple(x) for x in out} == {(0, 30), (1, 30)}
    assert se.ann_topk(df.limit(0), "k", "v", df, 3).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_ann_recall_on_given_vectors(spark, scale):
    v = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = v.filter("vec_id % 100 = 0")
    exact = {(x["query"], x["vec_id"]) for x in se.blocked_topk(q, v, "vec_id", "v", 10).collect()}
    found = {(x["query"], x["vec_id"]) for x in se.ann_topk(v, "vec_id", "v", q, 10).collect()}
    assert len(found) == len(exact) and len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("descending", [False, True])
def test_running_folds_by_value_range(spark, descending):
    r = np.random.default_rng(3)
    rows = [(("a", "b", None)[int(r.integers(3))], float(v), int(r.integers(1, 9))) for v in r.choice(5000, 400, replace=False) / 7]
    df = spark.createDataFrame(rows, "g string, o double, n int")
    for by in ([], ["g"]):
        got = before(df, "o", {"s": ("sum", "n"), "m": ("max", "n")}, by, descending).collect()
        assert len(got) == len(rows)
        for x in got:
            earlier = [n for g, o, n in rows if (not by or g == x["g"]) and (o > x["o"] if descending else o < x["o"])]
            assert (x["s"], x["m"]) == (sum(earlier), max(earlier, default=None))
    assert before(df.limit(0), "o", {"s": ("sum", "n")}).count() == 0


@pytest.mark.parametrize("tile, most, k, own", [(4096, 1 << 20, 1, False), (5, 1 << 20, 6, True), (5, 0, 6, True), (5, 0, 100, True), (4096, 0, 1, False)])
def test_top_k_over_tiles(spark, monkeypatch, tile, most, k, own):
    """Queries sent to all tasks or dealt to cells with the library, many ties, ids that repeat, vectors without a direction."""
    r = np.random.default_rng(5)
    rows = [(i, r.integers(-2, 3, size=3).astype(float).tolist()) for i in range(60)] + [(70, None), (71, [0.0] * 3), (5, [1.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (8, [2.0, 2.0, 1.0]), (8, [2.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(3)
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    library = [(i, unit(v)) for i, v in rows if i is not None and v is not None]
    want = collections.defaultdict(list)
    for q, v in {(i, tuple(v)) for i, v in rows if i is not None and v is not None}:
        want[q] += [(-round(float(unit(v) @ w), 12) + 0.0, c) for c, w in library if c != q or not own]
    got = collections.defaultdict(list)
    for x in tiles.top_k(df, df, "k", "v", k, own, tile, most).collect():
        got[x["query"]].append((x["rank"], -x["score"] + 0.0, x["k"]))
    assert {q: sorted(x) for q, x in got.items()} == {q: [(i, *x) for i, x in enumerate(sorted(xs)[:k], 1)] for q, xs in want.items()}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_folds_of_a_search_equal_its_pairs(spark, monkeypatch, most):
    """Ranks, best of labels and weights without pairs: ties, a null label, a label without others, vectors without a direction."""
    from specspark.operators import weights as wt

    monkeypatch.setattr(tiles, "BROADCAST_BYTES", most)
    r = np.random.default_rng(8)
    rows = [(i, "xyz"[int(r.integers(3))] if i % 9 else None, r.integers(-2, 3, size=3).astype(float).tolist()) for i in range(50)] + [(60, "alone", [1.0, 2.0, 0.0]), (61, "x", [0.0] * 3)]
    df = spark.createDataFrame(rows, "k int, l string, v array<double>").repartition(3)
    asked = df.filter("k % 4 = 0")
    pairs = se.score_pairs(asked, df, "k", "v", "l").withColumn("score", F.round("score", 6)).withColumn("correct", F.coalesce(F.col("query_label") == F.col("l"), F.lit(False))).persist()
    want = {x["query"]: x["rank"] for x in se.first_hit_rank(pairs, "query", "k", "score", "correct").collect()}
    got = fo.first_hits(asked, df, "k", "v", "l").collect()
    assert {x["query"]: x["rank"] for x in got} == want and {x["candidates"] for x in got} == {len(rows) - 1}
    assert {x["query"] for x in got if not x["found"]} == {x["query"] for x in pairs.groupBy("query").agg(F.max("correct").alias("c")).filter("not c").collect()}
    by = lambda d, label, row: {tuple(x) for x in se.rank_molecules(d, "query", label, row, "score", 9).select("query", label, "rank", row, "score").collect()}
    known = pairs.filter("score is not null")
    assert by(fo.label_best(asked, df, "k", "v", "l").filter("score is not null"), "label", "candidate") == by(known, "l", "k")
    b = pairs.select("query", "k", "correct", F.lit("b").alias("m"), (F.col("k") * 7 % 10 / 10).alias("s")).filter("k % 3 <> 0")
    long = pairs.select("query", "k", "correct", F.lit("a").alias("m"), F.col("score").alias("s")).unionByName(b)
    members = lambda q, c, s: [s, np.where(c % 3 != 0, c * 7 % 10 / 10, 0.0)]
    assert fo.choose_weights(asked, df, "k", "v", "l", members, 2).first() == wt.choose_weights(long, "query", "k", "m", "s", "correct", ["a", "b"]).first()


def test_equal_masses_meet_a_peak_once(spark):
    """Many rows of one mass: same answers, and the join makes one row a peak and mass."""
    peaks = spark.createDataFrame([(1, "f", 100.0), (2, "f", 200.0), (3, "g", 100.0)], "id int, f string, mz double")
    masses = spark.createDataFrame([("f", 100.0 + i % 2 / 100, 40 - i, i) for i in range(40)], "f string, mass double, score int, k int")
    got = jn.ppm_match(peaks, masses, ["f"], "mz", "mass", "score", 1000.0, ["id"])
    assert [(x["id"], x["ppm"], x["score"], x["mass"], x["matches"]) for x in got.collect()] == [(1, 0.0, 2, 100.0, 40)]
    near = jn.nearest_join(peaks, masses, ["f"], "mz", "mass", 0.5, ["id"], "k")
    assert {(x["id"], x["k"], x["mass"]) for x in near.collect()} == {(1, 0, 100.0), (2, None, None), (3, None, None)}
    assert "__n" in got._jdf.queryExecution().toString() and "min(k" in near._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", [0.05, 0.6])
def test_lists_give_a_pair_once(spark, monkeypatch, threshold):
    """Tiles of four rows, so that all goes by lists and many lists hold the same pair."""
    monkeypatch.setattr(lj, "TILE", 4)
    r = np.random.default_rng(2)
    m = np.where(r.random((40, 9)) < 0.5, r.random((40, 9)), 0.0) + np.eye(40, 9)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([("x", i, b, float(m[i, b])) for i, b in zip(*(x.tolist() for x in np.nonzero(m)))], "blk string, id int, bin int, value double")
    got = [(x["a"], x["b"]) for x in lj.cosine_join(df, "blk", "id", threshold).collect()]
    assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(np.triu(m @ m.T >= threshold, 1)))))
    assert not hasattr(lj._List, "last_common")  # nothing is done pair by pair


def test_columns_fused_and_normalized_at_once(spark):
    rows = [(q, c, float((q * 7 + c * c) % 11) / 4) for q in range(3) for c in range(20)] + [(3, 0, 1.0), (4, 0, 2.0), (4, 1, 2.0)]
    df = spark.createDataFrame(rows, "q int, c int, s double")
    got = {(x["q"], x["c"]): x for x in se.normalize_all(df, "q", "s").collect()}
    for mode in ("zscore", "minmax", "rank"):
        for x in se.normalize_scores(df, "q", "s", mode).collect():
            assert got[x["q"], x["c"]][mode] == pytest.approx(x["s"])
    both = spark.createDataFrame([(1.0, 3.0), (2.0, None), (None, None)], "a double, b double")
    assert [x[0] for x in both.select(se.fuse_columns([(F.col("a"), 0.75), (F.col("b"), 0.25)])).collect()] == [1.5, 2.0, None]


def test_top_k_of_texts_and_of_nothing(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "k string, v array<float>")
    assert {(x["query"], x["k"]) for x in tiles.top_k(df, df, "k", "v", 1, most=0).collect()} == {("a", "b"), ("b", "a"), ("c", "b")}
    assert tiles.top_k(df.limit(0), df, "k", "v", 1).count() == tiles.top_k(df, df.limit(0), "k", "v", 1).count() == 0
    with pytest.raises(Exception, match="can't be compared"):
        tiles.top_k(df, spark.createDataFrame([("d", [1.0])], df.schema), "k", "v", 1).collect()


def test_mean_low_fdr_recall_is_the_area_under_the_steps(spark):
    df = spark.createDataFrame([(0.01, 0.2), (0.02, 0.1), (0.03, 0.6), (0.05, 0.7), (0.2, 1.0), (None, 0.9)], "fdr double, recall double")
    assert mt.mean_low_fdr_recall(df).first()[0] == pytest.approx((0.2 * 0.02 + 0.6 * 0.02) / 0.05)
    assert mt.mean_low_fdr_recall(df.limit(0)).first()[0] == 0.0


def test_encoder_and_sql_functions(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "k int, x double")
    out = {r["k"]: r["embedding"] for r in udf.encode_with(df, lambda b: np.c_[b["x"], b["x"] * 2], "k", 2, 3).collect()}
    assert out[4] == [4.0, 8.0]
    udf.register_functions(spark)
    assert spark.sql("SELECT vector_dot(array(1D, 2D), array(3D, 4D)), rt_scaled(double('NaN'))").first() == (11.0, 0.0)
    assert spark.sql("""SELECT * FROM explode_candidates('{"a": ["x"]}')""").first() == ("a", 0, "x")


def test_streams(spark, tmp_path):
    from specspark.streaming import jobs

    schema = "id int, shard int, mz array<double>, intensity array<double>, precursor_mz double, polarity int, rt double"
    rows = [(i, i % 2, [1.0 + i % 3, 2.0], [1.0, 2.0], 10.0, 1, 5.0) for i in range(9)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = jobs.shard_stream(spark, str(tmp_path / "in"), spark.createDataFrame(rows, schema).schema)
    jobs.ingest_stream(stream, str(tmp_path / "t"), str(tmp_path / "c1"), "id").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 9
    for name, df, mode in (("audit", jobs.audit_stream(stream), "complete"), ("dedup", jobs.dedup_stream(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert spark.table("audit").agg(F.sum("rows")).first()[0] == 9 and spark.table("dedup").count() == 3


def test_models_learn(spark):
    from specspark.ml import baselines as bl

    r = np.random.default_rng(1)
    rows = [(float(i % 2), float(i % 2 * 3 + r.normal()), None if i % 9 == 0 else float(r.normal()), "ab"[i % 2], [float(i % 2 * 2 + r.normal()), float(r.normal())]) for i in range(160)]
    df = spark.createDataFrame(rows, "label double, x double, y double, c string, v array<double>")
    data = bl.feature_pipeline(["x", "y"], ["c"]).fit(df).transform(df)
    svm, forest = bl.fit_linear_forest(data, trees=10)
    for model in (svm, forest, bl.fit_boosted(data, rounds=3)):
        assert model.transform(data).filter("prediction = label").count() > 140
    ridge, trees = bl.fit_counts(data, "x")
    assert ridge.summary.r2 > 0.5 and trees.transform(data).count() == 160
    assert bl.fit_logistic_cv(df, "v", folds=2).transform(df.withColumn("features", F.lit(None)).drop("features").withColumn("features", __import__("pyspark.ml.functions", fromlist=["x"]).array_to_vector("v"))).filter("prediction = label").count() > 110
    assert bl.fit_mlp_probe(df, df, "v", "label", 2, 2, (1,)) is not None


def test_complete_link_equals_greedy_and_has_no_member_limit(spark):
    import numpy as np

    r = np.random.default_rng(5)
    # many ties, pairs missing, in two blocks
    rows = [(k, a, b, round(float(r.random()), 1)) for k in ("x", "y") for a in range(24) for b in range(a + 1, 24) if r.random() < 0.8]

    def greedy(block, threshold):
        s, clusters = {(a, b): v for k, a, b, v in rows if k == block}, {i: [i] for i in range(24)}
        far = lambda x, y: min(s.get((min(i, j), max(i, j)), 0.0) for i in clusters[x] for j in clusters[y])
        while len(clusters) > 1:
            v, x, y = min((-far(x, y), x, y) for x in clusters for y in clusters if x < y)
            if -v < threshold:
                break
            clusters[x] += clusters.pop(y)
        return {(block, i, c) for c, m in clusters.items() if len(m) > 1 for i in m}

    df = spark.createDataFrame(rows, "block string, a long, b long, similarity double")
    for t in (0.3, 0.0):
        assert {tuple(x) for x in gr.complete_link(df, "block", t).collect()} == greedy("x", t) | greedy("y", t)
    hot = spark.range(3000).selectExpr("'h' AS block", "2 * id AS a", "2 * id + 1 AS b", "0.5D AS similarity")
    assert gr.complete_link(hot, "block", 0.3).count() == 6000


def test_consensus_weighs_a_place_by_the_length_of_its_list(spark):
    """Plurality is a tie; a second place of two is worth 1/2, one of four 3/4."""
    df = spark.createDataFrame([("g", 1, ["a", "b"]), ("g", 2, ["c", "d", "e", "f"])], "g string, m int, c array<string>")
    got = {r["candidate"]: r["borda"] for r in mt.consensus(df, "g", "c", 5).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 1.0, "d": 0.75, "e": 0.5, "f": 0.25}
    assert [r["winner"] for r in mt.vote_trajectory(df, "g", "m", "c", 5).orderBy("m").collect()] == ["a", "a"]


def test_frontier_leaves_out_scores_that_are_no_numbers(spark):
    rows = [(float("nan"), False), (float("inf"), False), (None, False), (0.9, True), (0.8, False)]
    got = mt.fdr_frontier(spark.createDataFrame(rows, "s double, c boolean"), "s", "c", least=1).orderBy("accepted").collect()
    assert [(r["s"], r["accepted"], r["correct"], r["fdr"]) for r in got] == [(0.9, 1, 1, 0.0), (0.8, 2, 1, 0.5)]


@pytest.mark.parametrize("tile, most", [(256, 64 << 20), (2, 0)])
def test_score_pairs_meets_every_row(spark, tile, most):
    v = np.random.default_rng(5).normal(size=(40, 4))
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "k int, v array<double>, l int")
    got = {(r["query"], r["k"]): (r["score"], r["query_label"], r["l"]) for r in tiles.all_scores(df.filter("k % 7 = 0"), df, "k", "v", "l", tile, most).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert set(got) == {(q, k) for q in range(0, 40, 7) for k in range(40) if q != k}
    assert all(s == pytest.approx(u[q] @ u[k]) and (a, b) == (q % 3, k % 3) for (q, k), (s, a, b) in got.items())


def test_side_tables_and_sinks(spark, tmp_path):
    out = lambda name: str(tmp_path / name)
    (tmp_path / "split.tsv").write_text("spec\tfold\na\ttrain\nb\ttest\n")
    assert sorted(map(tuple, tables.read_split_tsv(spark, out("split.tsv")).collect())) == [("a", "train"), ("b", "test")]
    (tmp_path / "t.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    tables.convert_table(spark, out("t.tsv"), out("csv"), ["x", "y"])
    assert sorted(map(tuple, spark.read.csv(out("csv"), header=True).collect())) == [("0", "1", "2"), ("1", "3", "4")]
    with pytest.raises(ValueError, match="columns"):
        tables.convert_table(spark, out("t.tsv"), out("csv2"), ["x", "z"])
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>")
    tables.write_embeddings(vectors, out("vectors"))
    assert spark.read.parquet(out("vectors")).first() == ("a", [1.0, 2.0])
    with pytest.raises(ValueError, match="no embeddings"):
        tables.write_embeddings(vectors.limit(0), out("none"))
    tables.write_equal_shards(spark.range(5).withColumnRenamed("id", "o"), out("shards"), "o", shards=2)
    rows = spark.read.parquet(out("shards")).groupBy("shard").agg(F.array_sort(F.collect_list("o")).alias("o"))
    assert {r["shard"]: r["o"] for r in rows.collect()} == {0: [0, 1, 2], 1: [3, 4]}
    tables.write_csv_gz(vectors.select("id"), out("gz"))
    assert list((tmp_path / "gz").glob("*.csv.gz")) and spark.read.csv(out("gz"), header=True).first()["id"] == "a"


def test_inventory_list_and_resume(spark, tmp_path):
    import hashlib

    folder = tmp_path / "files"
    folder.mkdir()
    for name, n in (("a", 3), ("b", 2)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / name))
        (file,) = (tmp_path / name).glob("*.parquet")
        file.rename(folder / f"{name}.parquet")
    inventory = au.file_inventory(spark, str(folder), "*.parquet")
    got = [tuple(r) for r in inventory.orderBy("name").select("name", "rows", "start", "end").collect()]
    assert got == [("a.parquet", 3, 0, 3), ("b.parquet", 2, 3, 5)]
    lines = [f"{hashlib.sha256(f.read_bytes()).hexdigest()}  {f.name}" for f in sorted(folder.glob("*.parquet"))]
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n")
    listed = au.read_sha_list(spark, str(tmp_path / "list.txt"))
    assert au.check_sha_list(inventory, listed).count() == 0
    spoilt = listed.withColumn("sha256", F.when(F.col("name") == "a.parquet", "0").otherwise(F.col("sha256")))
    assert [tuple(r) for r in au.check_sha_list(inventory, spoilt).collect()] == [("a.parquet", "sha256")]
    shards = spark.createDataFrame([(f"{x}.parquet",) for x in "abc"], "name string")
    assert [r["name"] for r in au.pending_shards(shards, listed, "name").collect()] == ["c.parquet"]
    assert sorted(r["name"] for r in au.pending_shards(shards, spoilt, "name", inventory).collect()) == ["a.parquet", "c.parquet"]


def test_stream_search_and_counts(spark, tmp_path):
    from specspark.streaming import jobs

    rows = [(i, [float(i == 0 or i == 2), float(i % 2), 1.0]) for i in range(4)]
    library = spark.createDataFrame(rows, "k int, v array<double>")
    library.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = jobs.shard_stream(spark, str(tmp_path / "in"), library.schema, 1)
    jobs.search_stream(stream, library, "k", "v", str(tmp_path / "s"), str(tmp_path / "cs")).awaitTermination(90)
    assert {r["query"]: r["k"] for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    jobs.count_stream(stream.withColumn("odd", F.col("k") % 2), "odd", "n", str(tmp_path / "c"), str(tmp_path / "cc")).awaitTermination(90)
    assert {r["odd"]: r["n"] for r in jobs.read_counts(spark, str(tmp_path / "c"), "odd", "n").collect()} == {0: 2, 1: 2}


def test_lists_masses_and_sql_functions(spark):
    from specspark.functions import chemistry as ch

    df = spark.createDataFrame([(["b", "a", "b", None, None],), ([],), (None,)], "l array<string>")
    assert [r["d"] for r in df.select(sm.dedup_list(F.col("l")).alias("d")).collect()] == [["b", "a", None], [], None]
    one = spark.range(1)
    mass = lambda f: ch.formula_mass(ch.formula_counts(F.lit(f)))
    assert one.select(mass("BH3")).first()[0] == pytest.approx(11.0093054 + 3 * 1.00782503207)
    water = one.select(mass("H2O")).first()[0]
    for name, lost in (("[M+H-H2O]+", 1), ("[M+H-2H2O]+", 2)):
        assert ch.ADDUCT_SHIFTS[name] == pytest.approx(ch.ADDUCT_SHIFTS["[M+H]+"] - lost * water, abs=1e-5)
    assert ch.ADDUCT_SHIFTS["[M-H-H2O]-"] == pytest.approx(ch.ADDUCT_SHIFTS["[M-H]-"] - water, abs=1e-5)
    assert ch.ADDUCT_SHIFTS["[M-H-CO2]-"] == pytest.approx(ch.ADDUCT_SHIFTS["[M-H]-"] - one.select(mass("CO2")).first()[0], abs=1e-5)
    udf.register_functions(spark)
    row = spark.sql("""SELECT total_intensity(array(1D, 2D)), scale_to_max(array(1D, 2D)), vector_cosine(array(3D, 4D), array(3D, 4D)),
        polarity_of('[M-H]-'), parse_collision('HCD 20.5 eV'), block_type('>ms2 x'), dedup_list(array('x', 'x', 'y'))""").first()
    assert tuple(row) == (3.0, [0.5, 1.0], 1.0, 0, 20.5, "ms2", ["x", "y"])


@pytest.mark.parametrize("blocks, rows, features", [(3, 60, 30), (1, 700, 40), (2, 400, 300)])
@pytest.mark.parametrize("threshold", [0.3, 0.9])
def test_similar_pairs_of_blocks(spark, blocks, rows, features, threshold):
    """Few and many rows a block, with copies; blocks of more rows than a tile go by lists."""
    r, vectors = np.random.default_rng(rows), []
    for i in range(rows):
        at = r.choice(features, int(r.integers(1, 9)), replace=False)
        v = r.random(len(at)) + 0.05
        vectors.append(vectors[i - 1] if i % 10 == 9 else (f"b{r.integers(blocks)}", dict(zip(at.tolist(), (v / np.linalg.norm(v)).tolist()))))
    long = [(b, i, x, y) for i, (b, v) in enumerate(vectors) for x, y in v.items()] + [(None, 9000 + i, 1, 1.0) for i in range(3)]
    df = spark.createDataFrame(long, "blk string, id int, bin int, value double")
    got = {(x["blk"], x["a"], x["b"]): x["similarity"] for x in lj.cosine_join(df, "blk", "id", threshold).collect()}
    m = np.zeros((rows, features))
    for i, (_, v) in enumerate(vectors):
        m[i, list(v)] = list(v.values())
    s = m @ m.T
    want = {(vectors[i][0], i, j): min(1.0, s[i, j]) for i, j in zip(*np.nonzero(np.triu(s >= threshold, 1))) if vectors[i][0] == vectors[j][0]}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        lj.cosine_join(df, "blk", "id", 0.0)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.75, 1.0])
def test_tanimoto_join_and_exclusion(spark, threshold):
    r = np.random.default_rng(11)
    sets = {}
    for i in range(420):
        sets[i] = sets[i - 1] if i % 12 == 11 else frozenset(r.choice(24 if i % 2 else 12, int(r.integers(1, 7)), replace=False).tolist())
    df = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s] + [(None, 1), (900, None)], "id int, bit int")
    pairs, members = lj.tanimoto_join(df, "id", "bit", threshold)
    alike = lambda a, b: len(a & b) / len(a | b)
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    reps = sorted(first.values())
    want = {(a, b): alike(sets[a], sets[b]) for n, a in enumerate(reps) for b in reps[n + 1 :] if alike(sets[a], sets[b]) >= threshold}
    got = {(x["a"], x["b"]): x["similarity"] for x in pairs.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    copies = collections.Counter(sets.values())
    assert {x["id"]: (x["representative"], x["copies"]) for x in members.collect()} == {i: (first[s], copies[s]) for i, s in sets.items()}
    if threshold not in (0.3, 0.75):
        return
    # one by one: the most unassigned neighbours, ties to the smallest id
    near = {i: {j for j in sets if j != i and alike(sets[i], sets[j]) >= threshold} for i in sets}
    free, picked = set(sets), []
    while True:
        head = min(free, key=lambda i: (-len(near[i] & free), i), default=None)
        if head is None or not near[head] & free:
            break
        taken = (near[head] & free) | {head}
        picked.append((head, len(taken) - 1, taken))
        free -= taken
    every = collections.defaultdict(set)
    for x in gr.sphere_exclusion(pairs, members, "id").collect():
        every[x["head"], x["count"]].add(x["id"])
    assert every == {(h, c): t for h, c, t in picked}
    if threshold == 0.75:
        assert {(x["id"], x["cluster"]) for x in gr.butina(pairs, members, "id", 3).collect()} == {(i, c) for c, (_, _, t) in enumerate(picked[:3]) for i in t}
        assert gr.sphere_exclusion(pairs.limit(0), members.filter("copies = 1"), "id").count() == 0


@pytest.mark.parametrize("wide, most", [(512, 1 << 25), (512, 0), (3, 0)])
def test_sets_in_tiles_or_lists_give_the_same_pairs_and_spheres(spark, monkeypatch, wide, most):
    """Matrices sent or dealt, and lists; the matrix path writes no pairs and clusters without them."""
    r = np.random.default_rng(4)
    sets = {i: frozenset(r.choice(14, int(r.integers(1, 7)), replace=False).tolist()) for i in range(160)}
    df = spark.createDataFrame([(i, b) for i, s in sets.items() for b in s], "id int, bit int")
    monkeypatch.setattr(lj, "WIDE", wide)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", most)
    alike = lambda a, b: len(a & b) / len(a | b)
    near = {i: {j for j in sets if j != i and alike(sets[i], sets[j]) >= 0.4} for i in sets}
    free, want = set(sets), {}
    for cluster in range(3):
        head = min(free, key=lambda i: (-len(near[i] & free), i))
        taken = (near[head] & free) | {head}
        want |= {i: cluster for i in taken}
        free -= taken
    found = lj.first_spheres(df, "id", "bit", 0.4, 3)
    assert found is None if wide == 3 else {x["id"]: x["cluster"] for x in found.collect()} == want
    first = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    reps = sorted(first.values())
    pairs = {(a, b) for n, a in enumerate(reps) for b in reps[n + 1 :] if b in near[a]}
    assert {(x["a"], x["b"]) for x in lj.tanimoto_join(df, "id", "bit", 0.4)[0].collect()} == pairs


def test_codes_find_neighbours_from_few_vectors(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(size=(900, 32)), r.normal(size=(1, 32)) + 0.05 * r.normal(size=(100, 32))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 32)], "k int, v array<double>")
    q = df.filter("k % 50 = 0")
    exact = {(x["query"], x["k"]) for x in se.blocked_topk(q.filter("k < 1000"), df.filter("k < 1000"), "k", "v", 10).collect()}
    for index in (None, se.ann_index(df, "k", "v")):
        found = {(x["query"], x["k"]) for x in se.ann_topk(df, "k", "v", q, 10, index=index).collect()}
        assert len(found) == len(exact) == 200 and len(exact & found) >= 195  # 40 of 1000 vectors are read for a query


def test_running_audit_equals_an_audit_of_all(spark, tmp_path, monkeypatch):
    """Counters that change batch by batch, whole states now and then, a batch that runs again."""
    from specspark.streaming import jobs

    monkeypatch.setattr(jobs, "WHOLE_EACH", 3)
    rows = [(i, None if i % 5 == 4 else i % 3, [1.0, float(i), 0.0], [1.0, 2.0] if i % 4 else [1.0, float("nan"), -1.0], float(i - 3), i % 3 - 1, 5.0 * i) for i in range(60)]
    schema = "id int, shard int, mz array<double>, intensity array<double>, precursor_mz double, polarity int, rt double"
    df = spark.createDataFrame(rows, schema)
    source, target, checkpoint = (str(tmp_path / x) for x in "abc")
    for i in range(10):
        df.filter(F.col("id") % 10 == i).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.shard_stream(spark, source, df.schema, 1)
    jobs.running_audit(stream, target, checkpoint, least_peaks=2).awaitTermination()
    want = {tuple(r) for r in au.audit(df, least_peaks=2).collect()}
    got = jobs.read_audit(spark, target)
    assert {tuple(r) for r in got.select(*au.audit(df).columns).collect()} == want
    folders = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "b").glob("batch=*"))
    assert folders[-1] == 9 and len(folders) < 10
    # the last batch was written but not committed: it runs again
    for name in ("9", ".9.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    jobs.running_audit(stream, target, checkpoint, least_peaks=2).awaitTermination()
    assert {tuple(r) for r in jobs.read_audit(spark, target).select(*au.audit(df).columns).collect()} == want


def test_ingest_keeps_one_row_a_key_over_all_batches(spark, tmp_path):
    from specspark.operators.keyruns import KeyRuns
    from specspark.streaming import jobs

    source, target, checkpoint = (str(tmp_path / x) for x in "abc")
    for i in range(10):
        keys = [(k, i) for k in (*range(i * 3, i * 3 + 6), i * 3, None)]
        spark.createDataFrame(keys, "k int, n int").coalesce(1).write.mode("append").parquet(source)
    stream = jobs.shard_stream(spark, source, "k int, n int", 1)
    jobs.ingest_stream(stream, target, checkpoint, "k", 3).awaitTermination()
    read = lambda: collections.Counter(r["k"] for r in spark.read.parquet(target).collect())
    want = collections.Counter(range(33)) + collections.Counter({None: 10})
    assert read() == want
    for name in ("9", ".9.crc"):
        (tmp_path / "c" / "commits" / name).unlink()
    jobs.ingest_stream(stream, target, checkpoint, "k", 3).awaitTermination()
    assert read() == want
    runs = KeyRuns(spark, f"{target}_keys", "k", "int", 3)
    assert runs.runs() == [(0, 7), (8, 8), (9, 9)]
    fresh = runs.unseen(spark.createDataFrame([(5,), (40,)], "k int"), 10)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the batch alone
    assert [r["k"] for r in fresh.collect()] == [40]
    assert [r["k"] for r in runs.unseen(spark.createDataFrame([(30,)], "k int"), 9).collect()] == [30]  # batch 9 doesn't see its own keys


def test_mgf_stream_log(tmp_path):
    """Files are told apart by name and time; a name that sorts first is read too, and a batch that runs again reads the same files."""
    for i, name in enumerate(["m.mgf", "z.mgf"]):
        (tmp_path / name).write_text(TWO)
        os.utime(tmp_path / name, (1_000_000 + i, 1_000_000 + i))
    reader = mgf.MgfStreamReader({"path": str(tmp_path)})
    names = lambda a, b: [os.path.basename(p.path) for p in reader.partitions(a, b)]
    first = reader.latestOffset()
    assert names(reader.initialOffset(), first) == ["m.mgf", "z.mgf"]
    (tmp_path / "a.mgf").write_text(TWO)
    os.utime(tmp_path / "a.mgf", (1_000_002, 1_000_002))
    second = reader.latestOffset()
    assert names(first, second) == ["a.mgf"] and names(reader.initialOffset(), first) == ["m.mgf", "z.mgf"]
    for name, t in (("late.mgf", 1_000_000 + 8 * 86_400), ("old.mgf", 1_000_003)):
        (tmp_path / name).write_text(TWO)
        os.utime(tmp_path / name, (t, t))
    third = reader.latestOffset()
    assert names(second, third) == ["late.mgf"] and set(map(os.path.basename, third["files"])) == {"late.mgf"}
    (tmp_path / "late.mgf").unlink()
    assert names(third, mgf.MgfStreamReader({"path": str(tmp_path)}).latestOffset()) == []  # older files don't come back


def test_row_numbers_follow_files_and_lines(spark, tmp_path):
    """Numbers run over files by name and lines in them, whatever sizes they have and however Spark splits them."""
    for name, first, n in (("b.csv", 0, 3), ("c.csv", 3, 4000), ("a.csv", 4003, 500), ("d.csv", 4503, 0)):
        (tmp_path / name).write_text("k,t\n" + "".join(f"{first + i},{'x' * (i % 50)}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = spark.read.csv(str(tmp_path), header=True, schema="k int, t string")
        assert rows.rdd.getNumPartitions() > 8
        got = {r["k"]: r["i"] for r in tables.row_numbers(rows, "i").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = [*range(4003, 4503), *range(0, 3), *range(3, 4003)]
    assert got == {k: i for i, k in enumerate(order)}


@pytest.mark.parametrize("members, steps, part", [(1, 4, 4096), (2, 5, 7), (3, 4, 4096), (4, 3, 7)])
def test_simplex_weights(spark, monkeypatch, members, steps, part):
    from specspark.operators import weights as wt

    monkeypatch.setattr(wt, "PART", part)
    grid = wt.simplex(members, steps)
    assert len({tuple(w) for w in grid.tolist()}) == len(grid) and np.allclose(grid.sum(axis=1), 1) and (grid >= 0).all()
    r = np.random.default_rng(members)
    rows = [(q, c, f"m{m}", float(r.integers(0, 6)) / 4, bool(q < 9 and c % 5 == q % 5)) for q in range(10) for c in range(30) for m in range(members) if r.random() < 0.8]
    df = spark.createDataFrame([(q, c, m, s, t) for q, c, m, s, t in rows], "q int, c int, m string, s double, t boolean")
    names = [f"m{m}" for m in range(members)]
    table = collections.defaultdict(lambda: [0.0] * members)
    for q, c, m, s, _ in rows:
        table[q, c][names.index(m)] = max(table[q, c][names.index(m)], s)
    want = []
    for i, w in enumerate(grid):
        ranks = []
        for q in range(9):
            order = sorted((-round(float(np.dot(w, v)), 9), c) for (p, c), v in table.items() if p == q)
            hits = [n for n, (_, c) in enumerate(order, 1) if c % 5 == q % 5]
            ranks += hits[:1]
        want.append((-np.mean([x == 1 for x in ranks]), -round(np.mean([1 / x for x in ranks]), 9), -np.mean([x <= 5 for x in ranks]), i))
    best = min(want)
    got = wt.choose_weights(df, "q", "c", "m", "s", "t", names, steps).first()
    assert got["weights"] == pytest.approx(grid[best[3]].tolist())
    assert (got["top1"], got["mrr"], got["top5"]) == pytest.approx((-best[0], -best[1], -best[2]))
    assert wt.choose_weights(df.filter("not t"), "q", "c", "m", "s", "t", names, steps).count() == 0


def test_bootstrap_draws_and_estimate(spark, monkeypatch):
    from specspark.operators import metrics

    rows = [(f"k{i}", float(i % 7 - 2), 1.0 + i % 3, "s" if i % 4 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, a double, b double, s string").repartition(3)
    times = metrics.multiplicities([r[0] for r in rows], 30, 9)
    assert times.shape == (200, 30) and abs(times.mean() - 1) < 0.05 and abs(times.var() - 1) < 0.1
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    plain = (a @ times) / (b @ times)
    of = np.array([r[3] is None for r in rows])
    top = sum((a[m] @ times[m]) * m.sum() / times[m].sum(axis=0) for m in (of, ~of))
    low = sum((b[m] @ times[m]) * m.sum() / times[m].sum(axis=0) for m in (of, ~of))
    for stratum, d in ((None, plain), ("s", top / low)):
        got = mt.bootstrap_delta(df, "k", "a", "b", 30, 9, stratum=stratum).first()
        assert (got["low"], got["high"], got["mean"]) == pytest.approx((np.percentile(d, 2.5), np.percentile(d, 97.5), d.mean()))
        assert got["estimate"] == pytest.approx(a.sum() / b.sum())


def test_working_point_without_a_row(spark):
    df = spark.createDataFrame([(0.9, 20, 2, 10, 0.9, 0.2), (0.5, 40, 30, 10, 0.25, 0.8)], "score double, accepted bigint, correct bigint, eligible bigint, fdr double, recall double")
    assert tuple(mt.fdr_working_point(df, 0.5, "score").first()) == (0.5, 40, 30, 10, 0.25, 0.8)
    assert tuple(mt.fdr_working_point(df, 0.1, "score").first()) == (None, 0, 0, 10, None, 0.0)


def test_sql_functions_equal_the_projections(spark):
    from specspark.functions import chemistry as ch
    from specspark.functions import vectors as ve

    udf.register_functions(spark)
    nan, inf = float("nan"), float("inf")
    df = spectra_of(spark, [(1, [3.0, 1.0, 2.0, 9.5, 0.0], [5.0, 50.0, 50.0, 1.0, 2.0], 8.0), (2, [1.0, 2.0], [0.0, 3.0], 2.0), (3, [1.0, nan, 2.0, 3.0, inf], [1.0, 2.0, -1.0, 4.0, 1.0], 3.0), (4, [], [], 1.0), (5, [1.0, 2.0, 3.0, 4.0], [0.0] * 4, 50.0)])
    df.createOrReplaceTempView("s")
    got = lambda sql: {r[0]: repr(r[1]) for r in spark.sql(f"SELECT spectrum_id, {sql} FROM s WHERE {sql} IS NOT NULL").collect()}
    pairs = lambda d: {r[0]: repr(r[1]) for r in d.select("spectrum_id", F.zip_with("mz", "intensity", lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))).collect()}
    assert got("prepare_peaks(mz, intensity, 2)") == pairs(pk.prepare_peaks(df.filter("spectrum_id <> 3"), 2)) | {3: got("prepare_peaks(mz, intensity, 2)")[3]}
    assert got("top_peaks(mz, intensity, 2)") == pairs(pk.top_peaks(df, 2))
    assert got("normalize_spectrum(mz, intensity)") == pairs(pk.normalize_spectrum(df))
    assert got("strongest_peaks(mz, intensity, 3, 1.5D)") == pairs(pk.strongest(df, 3, 1.5))
    assert got("parent_filter(mz, intensity, precursor_mz)") == pairs(pk.parent_filter(df))
    padded = pk.pad_peaks(df, 3)
    assert got("pad_list(intensity, 3)") == {r[0]: repr(r[1]) for r in padded.select("spectrum_id", "intensity").collect()}
    assert got("peak_mask(mz, 3)") == {r[0]: repr(r[1]) for r in padded.select("spectrum_id", "mask").collect()}
    fine = "spectrum_id <> 3"
    assert {k: v for k, v in got("CASE WHEN spectrum_id <> 3 THEN spectrum_signature(mz, intensity) END").items()} == {r[0]: repr(r[1]) for r in df.filter(fine).select("spectrum_id", pk.signature(F.col("mz"), F.col("intensity"))).collect()}
    assert got("CASE WHEN spectrum_id <> 3 THEN peak_key(mz) END") == {r[0]: repr(r[1]) for r in df.filter(fine).select("spectrum_id", pk.peak_key(F.col("mz"))).collect()}
    assert got("unit_vector(intensity)") == {r[0]: repr(r[1]) for r in df.select("spectrum_id", ve.l2(F.col("intensity"))).collect()}
    assert got("fuse_vectors(intensity, intensity)") == {r[0]: repr(r[1]) for r in df.select("spectrum_id", ve.fuse_vectors(F.col("intensity"), F.col("intensity"))).collect()}
    formulas = spark.createDataFrame([("C6H12O6",), ("CH4",), ("C2H5Cl",), ("CHSO4N2C",), ("CO2",), ("Xx2",), ("",), (None,)], "f string")
    formulas.createOrReplaceTempView("f")
    counts = ch.formula_counts(F.col("f"))
    want = formulas.select("f", counts.alias("c"), ch.formula_mass(counts).alias("m"), ch.family_label(counts).alias("l"), ch.has_valid_elements(counts, ["C", "H", "O"]).alias("v"), ch.element(counts, "O").alias("o")).collect()
    sql = spark.sql("SELECT f, formula_counts(f) AS c, formula_mass(formula_counts(f)) AS m, family_label(formula_counts(f)) AS l, has_valid_elements(formula_counts(f), array('C', 'H', 'O')) AS v, element_count(formula_counts(f), 'O') AS o FROM f").collect()
    for a, b in zip(want, sql):
        assert (a["c"], a["l"], a["v"], a["o"]) == (b["c"], b["l"], b["v"], b["o"]) and (a["m"] is None) == (b["m"] is None) and a["m"] == (b["m"] if a["m"] is None else pytest.approx(b["m"]))
    row = spark.sql("SELECT adduct_of(1), adduct_of(2), neutral_mass(100D, '[M+H]+'), neutral_mass(1D, 'x'), bin_floor(29.9D, 10D), bin_even(25D, 10D), has_neutral_loss(array(81.99D), 100D, 18.01D, 0.02D)").first()
    assert tuple(row) == ("[M+H]+", None, pytest.approx(100 - ch.ADDUCT_SHIFTS["[M+H]+"]), None, 2, 2, True)
    assert len(udf.SQL_FUNCTIONS) >= 33


def _far_sets(spark, n=300):
    import random

    draw = random.Random(5)
    sets = {k: sorted(draw.sample(range(90), draw.randint(1, 6)) if k % 3 else draw.sample(range(70), 2)) for k in range(n)}
    return sets, spark.createDataFrame([(k, b) for k, s in sets.items() for b in s], "k bigint, bit int")


def test_what_sets_shuffle_grows_with_the_rows_not_with_their_square(spark, monkeypatch):
    """Many sets are dealt to cells of several tiles each, as words of 64 bits; pairs and spheres are those of a plain loop."""
    from specspark.operators import listjoin as lj
    from specspark.operators import tiles

    monkeypatch.setattr(lj, "SET_TILE", 8)
    monkeypatch.setattr(tiles, "BROADCAST_BYTES", 0)
    sets, bits = _far_sets(spark)
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.4
    met = []
    monkeypatch.setattr(tiles, "multiply", lambda *a, f=tiles.multiply, **b: met.append(f(*a, **b)) or met[-1])
    pairs, members = lj.tanimoto_join(bits, "k", "bit", 0.4)
    first = {}
    for k, s in sets.items():
        first.setdefault(tuple(s), k)
    heads = sorted(first.values())
    want = {(a, b) for a in heads for b in heads if a < b and like(sets[a], sets[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {(r["k"], r["representative"]) for r in members.collect()} == {(k, first[tuple(s)]) for k, s in sets.items()}
    copies = [int(x) + 1 for x in re.findall(r"explode\(sequence\(0, (\d+)", met[0]._jdf.queryExecution().analyzed().toString())]
    assert len(copies) == 2 and max(copies) <= 4  # as many as shuffle partitions, not as rows / tile
    left, want = dict(sets), {}
    for c in range(5):
        near = {a: [b for b in left if like(left[a], left[b])] for a in left}
        head = min(near, key=lambda a: (-len(near[a]), first[tuple(left[a])], a))
        want |= {k: c for k in near[head]}
        left = {k: s for k, s in left.items() if k not in near[head]}
    found = lj.first_spheres(bits, "k", "bit", 0.4, 5)
    assert {r["k"]: r["cluster"] for r in found.collect()} == want


def _blocks_of(spark, seed, n=60, wide=8):
    """Unit vectors in two blocks, many of them equal, and their bins."""
    draw = np.random.default_rng(seed)
    rows = {}
    for i in range(n):
        v = draw.integers(0, 3, wide) * (draw.random(wide) < 0.5)
        v[i % wide] += 1
        rows[("x" if i % 3 else "y", 7 * i)] = v / np.linalg.norm(v)
    return rows, spark.createDataFrame([(b, k, f, float(x)) for (b, k), v in rows.items() for f, x in enumerate(v) if x], "block string, k bigint, bin int, value double")


@pytest.mark.parametrize("tile", [5, 1000])
def test_blocks_of_few_bins_without_lists(spark, monkeypatch, tile):
    """Rows of large blocks are copied once for each tile of their block, not for each of their features; pairs are those of a plain loop."""
    monkeypatch.setattr(lj, "BLOCK_TILE", tile)
    monkeypatch.setattr(lj, "TILE", 4)
    monkeypatch.setattr(lj, "list_join", lambda *a: pytest.fail("lists"))
    rows, bins = _blocks_of(spark, 3)
    for threshold in (1e-12, 0.5):
        want = {(b, i, j): x for (b, i), v in rows.items() for (c, j), w in rows.items() if b == c and i < j and (x := min(1.0, v @ w)) >= threshold}
        got = [(r["block"], r["a"], r["b"], r["similarity"]) for r in lj.cosine_join(bins, "block", "k", threshold).collect()]
        assert len(got) == len(want) and all(want[b, i, j] == pytest.approx(s) for b, i, j, s in got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_from_vectors_writes_no_pairs(spark, monkeypatch, seed):
    """A block is linked from its vectors; larger blocks still go by their pairs. Both equal merging the best pair, one by one."""
    rows, bins = _blocks_of(spark, seed)
    want = set()
    for block in ("x", "y"):
        parts = [[k] for b, k in rows if b == block]
        alike = lambda p, q: min(round(min(1.0, rows[block, i] @ rows[block, j]), 12) for i in p for j in q)  # noqa: B023, E731
        while True:
            s, a, b = min((-alike(p, q), *sorted((min(p), min(q)))) for p in parts for q in parts if p is not q)
            if -s < 0.6:
                break
            p, q = (next(x for x in parts if min(x) == y) for y in (a, b))
            parts = [x for x in parts if x is not p and x is not q] + [p + q]
        want |= {(block, i, min(p)) for p in parts if len(p) > 1 for i in p}
    exact = bins.withColumn("value", F.round("value", 15))
    for most in (8192, 30, 1):
        monkeypatch.setattr(lj, "LINK_ROWS", most)
        if most == 8192:
            monkeypatch.setattr(gr, "complete_link", lambda *a: pytest.fail("pairs"))
        else:
            monkeypatch.undo()
            monkeypatch.setattr(lj, "LINK_ROWS", most)
        got = gr.complete_link_of_bins(exact, "block", "k", 0.6)
        assert {(r["block"], r["id"], r["cluster"]) for r in got.collect()} == want


def test_normalized_equals_rows(spark, monkeypatch):
    """Packed scores against rows: ties, a zero vector, a null one and a query of its own only."""
    from specspark.operators import tiles

    draw = np.random.default_rng(2)
    rows = [(10 * k, [float(x) for x in draw.integers(-1, 2, 4)] if k % 9 else [0.0] * 4) for k in range(70)]
    df = spark.createDataFrame([*rows, (-5, None)], "k bigint, v array<double>")
    plain = tiles.all_scores(df.filter("k % 30 = 0").withColumn("l", F.lit(0)), df.withColumn("l", F.lit(0)), "k", "v", "l")
    want = {(x["query"], x["k"]): x for x in se.normalize_all(plain.withColumn("score", F.round("score", 6)), "query", "score").collect()}
    monkeypatch.setattr(tiles, "LIBRARY_CHUNK", 7)
    got = fo.normalized(df.filter("k % 30 = 0"), df, "k", "v").collect()
    assert len(got) == len(want)
    for x in got:
        for c in ("zscore", "minmax", "rank"):
            assert x[c] == pytest.approx(want[x["query"], x["candidate"]][c], abs=1e-9)


def test_exact_percentiles_without_a_map_of_values(spark):
    """Percentiles of groups, one null, one without values, and of the whole; no aggregate holds all distinct values of a group."""
    draw = np.random.default_rng(4)
    data = {g: [round(float(x), 2) for x in draw.exponential(9, n)] for g, n in (("a", 101), (None, 38), ("b", 1), ("c", 2))}
    df = spark.createDataFrame([*[(g, x) for g, v in data.items() for x in v], ("d", None), ("a", None)], "g string, x double")
    out = mt.distribution(df, "x", ["g"])
    assert "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["g"]: r for r in out.collect()}
    assert len(got) == 5 and got["d"]["median"] is None and got["d"]["min"] is None
    for g, v in [*data.items(), ("all", sum(data.values(), []))]:
        r = got[g] if g != "all" else mt.distribution(df, "x").first()
        assert [r["min"], r["p05"], r["median"], r["mean"], r["p95"], r["max"]] == pytest.approx([min(v), *np.percentile(v, [5, 50]), np.mean(v), np.percentile(v, 95), max(v)])
    errors = mt.regression_metrics(df.withColumn("p", F.col("x") * 2), "x", "p", 5.0, ["g"])
    assert "percentile(" not in errors._jdf.queryExecution().optimizedPlan().toString()
    assert {r["g"]: r["median_error"] for r in errors.collect() if r["g"] != "d"} == pytest.approx({g: np.median(v) for g, v in data.items()})
