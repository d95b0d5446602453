"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and clashing columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from specspark.llm import fingerprints, html, jaccard, langid, linededup, mixing, packing, quality, secrets, shingles, warc

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, w string, kept string, set string, copy string, leader string"


def words(n, seed=0):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    far = base[:40] + words(80, 2)
    texts = [None, "", " \t\n ", "one", "Two words", "a b c d", "a b c d e", "naïve Ünïcode ßtraße 日本語 text here now", " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(far),
             "same line\nother\nSAME LINE  \n\nx", "\n".join(["shared passage of the corpus"] + words(3, 5)), " ".join(words(9000, 9)), "again and again " * 30, " ".join(base)]
    out = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, None) for i, t in enumerate(texts)]
    out += [(100 + i, f"shared passage of the corpus\nline {i}\n" + " ".join(words(30, 50 + i)), "de", "hot", 1) for i in range(12)]
    out += [(None, "no id here", "en", "s2", 3), (5, "a b c d e f g", "en", "s2", 3), (5, "a b c d", "en", "s2", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "q", "l") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, rows, empty):
    got = fingerprints.fingerprint_documents(docs).collect()
    assert len(got) == len(rows)
    order = [r for r in sorted((r for r in rows if r[0] is not None and r[0] != 5), key=lambda r: -r[0])]
    by = {r["doc_id"]: r for r in got}
    for a, b in zip(order, order[1:]):
        if 5 in range(b[0], a[0]) or a[0] == 0:
            continue
        x, y = a[1] or "", b[1] or ""
        m = len(x) // 3
        assert by[a[0]]["edited_sha256"] == hashlib.sha256((x[: len(x) - m] + y[:m]).encode()).hexdigest()
        assert by[a[0]]["n_chars"] == len(x)
    prints = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None and r[0] != 5:
            prints[r[1] or ""].add(by[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values())
    assert by[14]["near_edited"] > 0.3 > by[14]["near_next"]
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_fingerprint_anchors_are_closed_syncmers(spark):
    text = " ".join(words(200, 3))
    df = fingerprints.with_sketch(spark.createDataFrame([(text,)], "text string"), "text", "own")
    sketch = df.first()["own"]
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in text.split()], "w string").select(F.xxhash64("w")).collect()]
    chosen = {i for i in range(198) if min(hashes[i : i + 3]) in (hashes[i], hashes[i + 2])}
    assert {x["p"] - 1 for x in sketch} <= chosen and len(sketch) == fingerprints.SKETCH


def test_quality_base_counts(docs, rows, empty):
    got = quality.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        marked = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), dup, len(marked))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(marked) > 30 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_js_distance(spark):
    p, q = [0.5, 0.3, 0.2, 0.0], [0.1, 0.4, 0.25, 0.25]
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    m = (np.array(p) + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    assert df.select(quality.js_distance(F.col("p"), F.col("q"))).first()[0] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2))


def test_line_dedup(docs, rows, empty, tmp_path):
    ws = " \t\n\x0b\x0c\r"
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(ws))
    count = collections.Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    want = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        left = [x for x in lines if count[key(x)] < 10]
        want[(r[0], len(lines), len(lines) - len(left), "\n".join(left))] += 1
    out = linededup.drop_frequent_lines(docs)
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == want
    assert linededup.drop_frequent_lines(empty).count() == 0
    # through levels, with anti-joins from the second batch on
    runs = linededup.LineRuns(docs.sparkSession, 10)
    for i in range(5):
        runs.add(linededup.batch_counts(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(5)) == i)))
    assert [x for x in runs.log if x[0] == 0] == [(0, 0), (0, 1), (0, 1), (0, 2), (0, 1)] and (2, 2) in runs.log
    single = linededup.LineRuns(docs.sparkSession, 10)
    single.add(linededup.batch_counts(docs))
    assert sorted(runs.frequent().collect()) == sorted(single.frequent().collect()) != []
    assert collections.Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_frequent_lines(docs, batches=7).collect()) == want
    for r in (runs, single):
        r.drop()
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith("line_run")]


def test_line_runs_do_not_shuffle_a_run(spark):
    """Anti-joins and merges read runs as they lie: only the batch is exchanged."""
    rows = spark.range(500).select((F.col("id") % 50).alias("h1"), F.lit(1).cast("bigint").alias("h2"), F.lit(20).cast("bigint").alias("n"))
    runs = linededup.LineRuns(spark, 10)
    runs.add(rows.filter("h1 < 30").dropDuplicates(["h1"]))
    runs.add(rows.filter("h1 >= 20").dropDuplicates(["h1"]))  # 20 to 29 have been found often
    merged = spark.table(runs.runs[0][1])
    assert sorted((r["h1"], r["n"]) for r in merged.collect()) == [(i, 20) for i in range(50)]
    a, b = (spark.table(runs.runs[0][1]) for _ in range(2))
    assert "Exchange" not in a.hint("merge").join(b, ["h1", "h2"], "full")._jdf.queryExecution().executedPlan().toString()
    runs.drop()


def test_columns_of_the_operators_own_names_stay(spark):
    own = ("__t", "__drop", "__k", "__p", "__u", "__n", "__w", "__c", "__hits", "__lines", "__row")
    df = spark.createDataFrame([(1, "some text\nmore", "en", "s")], "doc_id bigint, text string, lang string, source string")
    df = df.withColumns({c: F.lit(f"my {c}") for c in own})
    for f in (linededup.drop_frequent_lines, mixing.mix, quality.judge, quality.keep_good, langid.identify, jaccard.keep_one):
        out = f(df)
        assert set(own) <= set(out.columns), f
        assert all(r[c] == f"my {c}" for r in out.collect() for c in own)


def brute_components(rows):
    sets, ids = [], []
    for r in rows:
        if r[0] is None:
            continue
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
        ids.append(r[0])
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            u = sets[a] | sets[b]
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(u):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return collections.Counter((i, len(s), find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize("share, ratio", [(0.12, 1.1), (0.0, 2.0), (0.75, 1.02)])
def test_near_duplicates(docs, rows, empty, monkeypatch, share, ratio):
    monkeypatch.setattr(jaccard, "AHEAD", share)
    monkeypatch.setattr(jaccard, "BLOCK_RATIO", ratio)
    monkeypatch.setattr(jaccard, "PIECE", 2)
    got = jaccard.near_duplicates(docs).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == brute_components(rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    if share == 0.12:
        assert jaccard.near_duplicates(empty).count() == 0
        one = jaccard.keep_one(docs)
        assert one.columns == docs.columns
        kept = [r["doc_id"] for r in one.collect()]
        assert sorted(x for x in kept if x is not None) == sorted({c for _, _, c in brute_components(rows)})


@pytest.mark.parametrize("seed, many", [(1, 150), (2, 150), (3, 700)])
def test_near_duplicates_of_passages(spark, seed, many):
    """Many sets made of a few passages and some words of their own: long lists, new prefixes and sets without other elements."""
    r = np.random.default_rng(seed)
    passages = [words(int(r.integers(20, 50)), 100 + i) for i in range(4)]
    rows = []
    for i in range(many):
        parts = [passages[k] for k in r.choice(4, size=r.integers(1, 3), replace=False)] + [words(int(r.integers(0, 14)), 1000 + i)]
        if r.random() < 0.3:
            parts = [passages[0][: int(r.integers(15, 20))], words(int(r.integers(0, 5)), 2000 + i)]
        rows.append((i, " ".join(x for p in parts for x in p)))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter(tuple(x) for x in got) == brute_components(rows)


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs, {"hot": 3.0, "s1": 1.0, None: 1.0}, total=100).collect()
    n = collections.Counter(r[3] for r in rows)
    rate = {s: w / 5 * 100 / n[s] for s, w in {"hot": 3.0, "s1": 1.0, None: 1.0}.items()}
    want = collections.Counter()
    for r in rows:
        if r[3] not in rate:
            continue
        key = f"{mixing.SEED}:{r[3] or ''}:{'' if r[0] is None else r[0]}"
        u, p, c, k = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13, np.exp(-rate[r[3]]), 0.0, 0
        c = p
        while c <= u:
            k += 1
            p *= rate[r[3]] / k
            c += p
        want[(r[0], r[1], r[3])] += k
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out) == want
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns[:2] == ["doc_id", "text"]


def test_damaged_records_are_an_error():
    members = [warc.record(i, "u", bytes(np.random.default_rng(i).integers(0, 256, 2000, dtype=np.uint8)), "x", None) for i in range(2)]
    whole = b"".join(members)
    assert len(list(warc.members(warc.as_bytes(members), len(whole), 0, len(whole)))) == 2
    cut = bytearray(whole)
    at = len(members[0]) // 2
    cut[at : at + 400] = bytes(400)
    with pytest.raises(ValueError, match="damaged|complete"):
        list(warc.members(warc.as_bytes([bytes(cut)]), len(cut), 0, len(cut)))


def test_mixing_of_a_large_mean(spark):
    """One rare source has a mean of 9000 repetitions: tables stay small, copies are gapless, equal at every partitioning."""
    few = spark.createDataFrame([(i, "t", "rare") for i in range(4)], "doc_id bigint, text string, source string")
    out = mixing.mix(few, total=36_000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.count_distinct("copy").alias("k")).collect()
    assert len(out) == 4 and all(r["a"] == 0 and r["b"] == r["n"] - 1 and r["k"] == r["n"] for r in out)
    assert all(abs(r["n"] - 9000) < 6 * 9000**0.5 for r in out)
    again = mixing.mix(few.repartition(3), total=36_000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in out} == {r["doc_id"]: r["n"] for r in again}
    tables = spark.createDataFrame([(500.0,)], "r double").select(mixing.poisson_table("r").alias("p")).first()["p"]
    assert len(tables) < 800 and abs(tables[500] - 0.5119) < 1e-3


def test_packing(docs, rows, empty):
    size = 64
    out = packing.pack_documents(docs, size=size).collect()
    tk = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for r in rows:
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), size):
            want[(r[0], s, len(ids[s : s + size]), len(ids), zlib.crc32(np.array(ids[s : s + size], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["doc_tokens"], zlib.crc32(bytes(r["ids"]))) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert packing.pack_documents(empty).count() == 0


def test_word_tokenizer_equals_tokenizer():
    w, plain = packing.WordTokenizer(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    assert all("<|" in t.content for t in plain.get_added_tokens_decoder().values())
    odd = ["Ünï Ça'll don't ''s we've A1²½ x_y ÷× ßẞ İI ǅ <|endoftext|> \x1fab \x85 \xa0q ſK 'S'T", "日本語 naïve‘s", "", "ΌΣΟΣ'LL", "plain 'twas\ttext\n\n..,!! 12 345 it's",
           "a <|endoftext|> b <|startoftext|> c"]
    r = np.random.default_rng(4)
    usual = [chr(c) for c in range(0x180) if not packing.UNUSUAL.search(chr(c))]
    odd += ["".join(r.choice(usual, 60)) for _ in range(1500)]
    odd += ["".join(r.choice([*"'sStTrReEvVmMlLdD 1²ß.", " "], 40)) for _ in range(500)]
    odd += ["".join(chr(c) for c in r.integers(1, 0xD7FF, 30)) for _ in range(300)]
    want = [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    assert w.ids(odd) == want


def test_shortest_pack_first_holds_the_histogram():
    r = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(r.choice(np.arange(1, 65), 40, replace=False), r.integers(1, 500, 40))}
    patterns = packing.shortest_pack_first(histogram, 64)
    held = collections.Counter()
    for p, c in patterns:
        assert sum(p) <= 64
        for length in p:
            held[length] += c
    assert held == histogram
    fill = sum(sum(p) * c for p, c in patterns) / (64 * sum(c for _, c in patterns))
    assert fill > 0.95


def test_language_identification(spark, empty):
    r = np.random.default_rng(0)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ver", "ich"], "cc": ["é", "eau", "ou", "tre"]}
    rows = []
    for i in range(240):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang], 3)) for _ in range(12)), lang if i % 10 else None, "s"))
    rows += [(900, None, "aa", "s"), (901, "123 !!", "aa", "s"), (None, "kato", "aa", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    for g, row in zip(sorted(got, key=lambda g: str(g["doc_id"]).zfill(5)), sorted(rows, key=lambda x: str(x[0]).zfill(5))):
        if g["doc_id"] in (900, 901):
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
        elif g["doc_id"] is not None:
            assert g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2)
            assert g["lang_pred"] == list(parts)[g["doc_id"] % 3] and 0 < g["score"] <= 1
    assert langid.identify(empty).count() == 0


def test_language_binding():
    e = langid.Encoder()
    a, b, c = (e.letter(ord(x)) for x in "abc")
    assert np.array_equal(e.vectors(np.array([(97 << 42) | (98 << 21) | 99], dtype=np.uint64))[0], np.roll(a, 2) * np.roll(b, 1) * c)


def test_secrets(spark, docs, empty):
    r = np.random.default_rng(5)
    key = "".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40))
    text = f"é token = 'abcdefgh1234' AKIA{'B7' * 8} x {'0f' * 10} Api_Key:short {key} internationalization_of_words"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "plain words only, nothing-else-to_find here")], "doc_id bigint, text string")
    ratio = secrets.fit(secrets.training_samples(docs))
    got = {x["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in secrets.find_secrets(df, ratio).collect()}
    assert got[2] == got[3] == got[4] == []
    assert [k for k, _, _ in got[1]] == ["assign", "access", "hex", "markov"]
    assert text[got[1][3][1] : got[1][3][2]] == key and text[got[1][0][1] : got[1][0][2]] == "token = 'abcdefgh1234"
    assert secrets.find_secrets(empty).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same" * 50), (2, None, "same" * 50), (3, "http://c/", None), (4, "http://d/", ""), (None, "x", "same" * 50), (5, "é", "<p>" + "ü" * 200_000), (6, "http://e/", "\x1f\x8b\x08 WARC/1.1 in a payload")]
    files = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    for size in (37, 5000, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_archive(files, size).collect()}
        assert len(got) == len(rows)
        for i, url, h in rows:
            p = (h or "").encode()
            assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["url"]) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), url)
            if got[i]["record_type"] == "response":
                assert bytes(got[i]["payload"]) == p
        assert (got[1]["refers_to"], got[3]["refers_to"], got[2]["refers_to"]) == (2, 4, None)
    none = warc.write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert warc.read_archive(none).count() == 0


def test_reader_skips_false_magic():
    m = [warc.record(1, "u", b"abc" + warc.MAGIC, "x", None), b"junk" + warc.MAGIC + b"more", warc.record(2, "u", b"d", "y", None)]
    f = warc.as_bytes(m)
    n = len(f.getvalue())
    for size in (1, 7, 100, n):
        found = [r for s in range(0, n, size) for r in warc.members(f, n, s, s + size)]
        assert [b"X-Page-ID: 1" in x for x in found] == [True, False]


def test_html(spark):
    page = "<html><head><title>t</title><script>if (a < b) '</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A title &amp; more</h1><p>First <b>bold</b>\n text of the story, long enough to read.<p>Second part, also of the story; it goes on.</article><section id=comments><div class=comment><p>I liked it.</p></div></section><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p"), (5, "u", "<nav>menu</nav>")], "page_id int, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract_pages(df).collect()}
    want = "A title & more First bold text of the story, long enough to read. Second part, also of the story; it goes on."
    assert got[1] == (want, len(want)) and got[2] == got[3] == ("", 0)


def test_html_head_ends_at_the_first_element_that_it_cannot_hold():
    texts = lambda page: [b.text for b in html.blocks(page)]
    assert texts("<html><head><title>x</title><p>The text</p><p>more</p></html>") == ["The text", "more"]
    assert texts("<head><meta charset=utf-8><STYLE>p {}</Style><noscript><p>no</p></noscript><title>x</title></head><body><p>The text</p>") == ["The text"]
    assert texts("<script>İ < 1 </SCRIPT><p>after</p><script>open <p>never") == ["after"]


def test_html_held_out_accuracy():
    model, right, total = html.trained(), 0, 0
    for i in range(60):
        found = html.blocks(html.PageMaker(9_000_000 + i).page())
        if found:
            p = model.predict([html.vectors(found)])[0] >= 0.5
            right += sum(a == (b.label == "1") for a, b in zip(p, found))
            total += len(found)
    assert right / total > 0.97


def test_lstm_gradients():
    from specspark.llm.lstm import Labeller

    r = np.random.default_rng(0)
    m = Labeller(3, 2, 1)
    xs, ys = [r.normal(size=(4, 3)), r.normal(size=(2, 3))], [np.array([1, 0, 1, 0]), np.array([0, 1])]
    _, grads = m._gradients(xs, ys)
    for p, g in zip(m._parameters(), grads):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = p[i], 1e-5
        p[i] = old + e
        up = m._gradients(xs, ys)[0]
        p[i] = old - e
        down = m._gradients(xs, ys)[0]
        p[i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[i], rel=1e-4, abs=1e-8)


def test_partitions_do_not_matter(docs):
    a = sorted(map(str, fingerprints.fingerprint_documents(docs.repartition(1)).collect()))
    assert a == sorted(map(str, fingerprints.fingerprint_documents(docs.repartition(7)).collect()))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp
    from specspark.llm.common import written

    df = docs
    for name, stage in cp.STAGES[:-1]:
        before = df
        df = written(stage(spark, df, ""), name)
        assert df.columns == cp.COLUMNS, name
        if name == "near_duplicates":
            kept = {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before.collect()])}
            assert {r["doc_id"] for r in df.collect()} == kept
        if name == "line_dedup":
            assert df.count() == before.count()
    pieces = cp.STAGES[-1][1](spark, df, "").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in df.collect()}


def prose(lang_words, n, seed):
    """Text of ``n`` words: every second one from the frequent ``lang_words``, the others made of letters, with usual punctuation."""
    r = np.random.default_rng(seed)
    other = ["".join(chr(97 + c) for c in r.integers(0, 26, r.integers(4, 9))) for _ in range(n)]
    out = [lang_words[r.integers(0, len(lang_words))] if i % 2 else w for i, w in enumerate(other)]
    return ". ".join(" ".join(out[i : i + 12]).capitalize() for i in range(0, n, 12)) + "."


EN = "the of and to a in is that it for was on are as with his they at be this from have or by one had not but what all".split()
DE = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird".split()


def quality_kept(spark, planted):
    texts = [(i, prose(EN if lang == "en" else DE, 300, i), lang) for i, lang in enumerate(["en", "de"] * 60)]
    got = quality.judge(spark.createDataFrame(texts + planted, "doc_id bigint, text string, lang string")).collect()
    return {r["doc_id"]: r["kept"] for r in got}


def test_quality_rejects_symbol_junk(spark):
    # 30 words and more, no window of eight twice: only the character classes tell
    junk = lambda marks, seed: " ".join("".join(np.random.default_rng([seed, i]).choice(list(marks), 9)) for i in range(50))
    planted = [(1000 + i, junk(marks, i), lang) for i, (marks, lang) in enumerate((m, x) for m in ("=_@~", "{}[]", "^/\\+`") for x in ("en", "de"))]
    kept = quality_kept(spark, planted)
    assert not any(kept[i] for i, _, _ in planted)
    assert all(kept[i] for i in range(120))


def test_quality_rejects_text_without_common_words(spark):
    random_words = lambda seed: prose(["".join(chr(97 + c) for c in np.random.default_rng([seed, i]).integers(0, 26, 6)) for i in range(400)], 300, seed)
    planted = [(1000 + i, prose(DE if lang == "en" else EN, n, i), lang) for i, (n, lang) in enumerate((n, x) for n in (120, 300, 2000) for x in ("en", "de"))]
    planted += [(2000 + i, random_words(i), lang) for i, lang in enumerate(("en", "de"))]
    planted += [(3000 + i, prose(EN if lang == "en" else DE, n, 50 + i), lang) for i, (n, lang) in enumerate((n, x) for n in (62, 80, 120, 2000) for x in ("en", "de"))]
    kept = quality_kept(spark, planted)
    assert not any(kept[i] for i, _, _ in planted if i < 3000)
    assert all(k for i, k in kept.items() if i < 1000 or i >= 3000)


def test_fingerprints_of_mixed_units(spark):
    r = np.random.default_rng(3)
    line = lambda n: " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(n))
    text = line(80)[:479]
    unspaced = "".join(chr(0x4E00 + c) for c in r.integers(0, 3000, 3000))
    rows = [
        (8, text + "xy"), (7, text), (6, text + "zz"),  # 481, 479 and 481 characters
        (5, line(110)[:600]), (4, "short one"),  # the edited text has 409
        (3, unspaced), (2, unspaced[:1500] + "変" + unspaced[1500:]), (1, line(300)),
    ]
    got = {x["doc_id"]: x for x in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[8]["near_next"] > 0.8 and got[7]["near_next"] > 0.8
    assert got[5]["near_edited"] > 0.4 and got[5]["near_next"] < 0.1
    assert got[3]["near_next"] > 0.8 and got[2]["near_edited"] > 0.4 and got[3]["near_edited"] > 0.4
    assert got[6]["near_next"] < 0.1 and got[1]["near_next"] < 0.1


def test_secrets_beside_base_spans_and_in_paths():
    r = np.random.default_rng(9)
    draw = lambda n, a: "".join(a[i] for i in r.integers(0, len(a), n))
    letters = secrets.ALPHABET[:62]
    names = ["home", "user", "conf", "value", "number", "service", "default", "index", "library", "x", "key", "path", "data", "client", "config"]
    ordinary = ["/".join(r.choice(names, 4)) for _ in range(800)] + ["_".join(r.choice(names, 3)) for _ in range(800)] + ["=".join(r.choice(names, 2)) for _ in range(400)]
    ratio = secrets.fit([(s, 0) for s in ordinary] + [(draw(40, letters), 1) for _ in range(2000)])
    found = lambda t: [(t[a:b]) for a, _, b in secrets.added_spans(t, secrets.base_spans(t), ratio, secrets.MIN_SCORE)]
    key, other = draw(40, letters), draw(32, letters)
    hexed = draw(16, "0123456789abcdef")
    for t, want in (
        (f"use AKIA{draw(16, letters[26:])}/{key} now", [key]),
        (f"{hexed}-{key}", [key]),
        (f"/home/user/conf/x={key}", [key]),
        (f"config/{key}/library/service/default/index/{other}", [key, other]),
        ("home/user/library/service/config/default_value.index", []),
        (f"see {key}.", [key]),
    ):
        assert found(t) == want, t


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_of_edited_copies(spark, seed):
    """Copies of one text with more and more edits, some of them copies of copies: links beside the leader's own."""
    r = np.random.default_rng(seed)
    made = [words(100, 7)]
    for i in range(250):
        text = list(made[int(r.integers(0, len(made)))] if r.random() < 0.3 else made[0])
        for _ in range(int(r.integers(1, 8))):
            text[int(r.integers(0, len(text)))] = f"edit{seed}{int(r.integers(0, 400))}"
        made.append(text[int(r.integers(0, 12)) :])
    rows = [(i, " ".join(t)) for i, t in enumerate(made)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_components(rows)
    assert len({c for _, _, c in want}) > 5
    assert collections.Counter(tuple(x) for x in got) == want


def test_shingle_sets_in_parts(monkeypatch):
    """Long texts are hashed in parts: the sets stay the same, as those of words and of any white space."""
    texts = ["", None, "a b", "A  B ", "one two three four five", "One two\tthree\x0bfour  five\n", "x" * 3000 + " y z w v u t é É", "a b c d e a b c d e a b c d e"]
    whole = [s.tolist() for s in shingles.shingle_sets(pa.array(texts))]
    assert [len(s) for s in whole] == [0, 0, 1, 1, 1, 1, 5, 5]
    assert whole[2] == whole[3] and whole[4] == whole[5]
    monkeypatch.setattr(shingles, "PART", 7)
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(texts))] == whole
    assert [s.tolist() for s in shingles.shingle_sets(pa.array(["q", *texts]).slice(1))] == whole


def test_near_duplicates_of_an_id_with_two_texts(spark):
    t = [words(120, 300 + i) for i in range(6)]
    near = lambda w, i: " ".join([*w[:i], "changed", *w[i + 1 :]])
    rows = [
        (3, " ".join(t[0])), (5, " ".join(t[0])), (5, " ".join(t[1])), (9, near(t[1], 60)),  # a copy and a near text
        (13, " ".join(t[2])), (15, near(t[2], 50)), (15, " ".join(t[3])), (19, near(t[3], 70)), (20, near(t[3], 20)),  # two near texts
        (30, " ".join(t[4])), (31, " ".join(t[5])),
    ]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(3, 3), (5, 3), (9, 3), (13, 13), (15, 13), (19, 13), (20, 13), (30, 30), (31, 31)}


def test_warc_keeps_payloads_of_an_id_with_two_texts(spark):
    rows = [(7, "u7", "<p>same</p>"), (9, "u9", "<p>same</p>"), (7, "v7", "<p>other</p>")]
    files = warc.write_archive(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    got = {(r["url"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in warc.read_archive(files).collect()}
    assert got == {("u7", "revisit", 9, None), ("u9", "response", None, b"<p>same</p>"), ("v7", "response", None, b"<p>other</p>")}


def test_byte_ids_of_parts_encoded_together(monkeypatch):
    """Letters and digits, with or without a space before them, are encoded in one call each, to the ids that the tokenizer gives whole texts."""
    from specspark.llm import bestfit

    words = bestfit.ByteTokenizer(bestfit.default_tokenizer())
    texts = ["Erndly says\nShes 35 of 76ers, ²³ and 1½ Übung.\n\n12\n", "Don't 2024 I'll 3f  x", "", " Ab 9\nAb9", "\n", "7"]
    alone = []
    encode = words._encode
    monkeypatch.setattr(words, "_encode", lambda parts: alone.extend(parts) or encode(parts))
    got = words.ids(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert not any(p.strip().isalnum() for p in alone)
