"""Phrases, best-fit packing and whitening against brute force, exact round trips and numpy."""

import collections
import os
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from specspark.llm import bestfit, phrases, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute_phrases(rows, min_count=10, top=2000, covered=50):
    out = []
    f, n = brute_counts(rows)
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if p.count(" ") and a >= min_count}
        best = []
        for p, a in found.items():
            if any(q != p and f" {p} " in f" {q} " and 100 * b >= covered * a for q, b in found.items()):
                continue
            w = p.split(" ")
            cuts = [(10**6 * a * a // (c[" ".join(w[:k])] * c[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            best.append((-score, -a, p.encode(), c[" ".join(w[:k])], c[" ".join(w[k:])]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    r = np.random.default_rng(7)
    words = ["the", "The", "new", "york", "times", "of", "ä", "été", "x-y", "\x01", "a\x1fb", "日本", "'s", "end"]
    ends = [" ", " ", " ", " ", "\t ", ". ", ", ", "\n", "!?", "  ", "\x0b", ":"]
    text = lambda n: "".join(words[r.integers(0, len(words))] + ends[r.integers(0, len(ends))] for _ in range(n))
    rows = [(["en", "fr", None, "und"][i % 4], text(int(r.integers(0, 60)))) for i in range(120)]
    return rows + [("en", None), ("de", ""), ("de", " .\t"), (None, None)] + [("en", "new york times of old . new york")] * 30


def test_phrases_equal_brute_force(spark, talk):
    docs = spark.createDataFrame([(t, lang, "x", 1) for lang, t in talk], "text string, lang string, phrase string, part int")
    for args in ({}, {"min_count": 3, "top": 7, "covered": 80}):
        got = sorted(tuple(r) for r in phrases.mine_phrases(docs, **args).collect())
        assert got == brute_phrases(talk, **args)
        assert len(got) > 20
    assert phrases.mine_phrases(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrases.mine_phrases(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="words"):
        phrases.mine_phrases(docs, max_words=4)


@pytest.mark.parametrize("limits", [{}, {"SEGMENT": 16, "CHUNK": 90}, {"ENTRIES": 20, "CHUNK": 150}, {"WORDS": 6, "CHUNK": 120, "BURST": 2}, {"BURST": 1, "ENTRIES": 60, "CHUNK": 600, "SEGMENT": 7}])
def test_hat_trie_counts_whatever_it_keeps(monkeypatch, talk, limits):
    """Bursting, spilling, forgetting words and cutting long texts change no count; runs are sorted, a partition's phrases lie in it alone."""
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    f, n = brute_counts(talk)
    for k in (1, 2, 3):
        table = (b"\xff" * 128, 1024)
        counter = phrases.Counter(k, 5, None if k == 1 else table)
        batches = [b for lang, t in talk for b in counter.hold(lang or "und", (t or "").encode())] + list(counter.finish())
        got, parts = collections.defaultdict(collections.Counter), collections.defaultdict(set)
        for b in batches:
            for row in b.to_pylist():
                assert row["phrases"] == sorted(row["phrases"], key=lambda p: p.encode().split(b" "))
                assert len(set(row["phrases"])) == len(row["phrases"])
                got[row["lang"]].update(dict(zip(row["phrases"], row["counts"])))
                for p in row["phrases"]:
                    parts[row["lang"], p].add(row["part"])
        assert all(len(x) == 1 for (_, p), x in parts.items() if p)
        for lang in n:
            if k == 1:
                assert got[lang].pop("") == n[lang]
            assert +got[lang] == collections.Counter({p: c for p, c in f[lang].items() if p.count(" ") == k - 1}), (lang, k)


def test_bit_table_lets_all_frequent_phrases_through(spark):
    rows = [("en", f"w{i} ä{i % 7}") for i in range(500)]
    table, size = phrases.bit_table(spark.createDataFrame(rows, "lang string, phrase string"))
    assert size == 8192 and len(table) == size // 8
    for lang, phrase in rows:
        h = np.array([phrases.word_hash(lang.encode())], dtype=np.uint64)
        for w in phrase.encode().split():
            h = phrases.mix(h, np.array([phrases.word_hash(w)], dtype=np.uint64))
        at = int(h[0]) & (size - 1)
        assert table[at >> 3] >> (at & 7) & 1


def test_phrases_of_a_very_long_text(spark):
    text = ("alpha beta gamma. " * 20 + "one two ") * 20_000
    rows = [("en", text), (None, "alpha beta " * 11)]
    docs = spark.createDataFrame([(t, lang) for lang, t in rows], "text string, lang string")
    assert sorted(tuple(r) for r in phrases.mine_phrases(docs).collect()) == brute_phrases(rows)


def test_first_ranked_in_parts(spark):
    rows = [(g, f"p{i:04}", i * 7 % 50) for g in "ab" for i in range(300)]
    got = phrases.first_ranked(spark.createDataFrame(rows, "g string, p string, s int").repartition(3), "g", "p", [phrases.F.desc("s"), "p"], 40).collect()
    for g in "ab":
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:40]
        assert [tuple(r)[:3] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == want


def test_byte_tokenizer_equals_tokenizer():
    w, plain = bestfit.ByteTokenizer(bestfit.default_tokenizer()), Tokenizer.from_file(bestfit.default_tokenizer())
    odd = ["Ünï Ça'll don't ''s we've A1²½ x_y ÷× ßẞ İI ǅ <|endoftext|> \x1fab \x85 \xa0q ſK 'S'T", "日本語 naïve‘s", "", "  two  spaces \n\n x\t\ty ", "a<|endoftext|>b", "!'s ''ll 's"]
    r = np.random.default_rng(4)
    usual = [chr(c) for c in range(0x180) if not bestfit.UNUSUAL.search(chr(c))]
    odd += ["".join(r.choice(usual, 60)) for _ in range(1500)]
    odd += ["".join(r.choice([*"'sStTrReEvVmMlLdD 1²ß.", " ", "\n"], 40)) for _ in range(500)]
    odd += ["".join(chr(c) for c in r.integers(1, 0xD7FF, 30)) for _ in range(300)]
    want = [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    assert w.ids(odd) == want
    assert w.ids(odd) == want  # from what is kept


def test_best_fit_packing(spark):
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(0, 90, int(r.integers(1, 60))))) for i in range(200)]
    rows += [(300, None), (301, ""), (None, "no id"), (None, "no id"), (7, rows[7][1]), (400, "long " * 5000)]
    docs = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id bigint, text string, bin string, __deal int")
    size = 64
    out = bestfit.pack_documents(docs, size=size).collect()
    tk, want, tokens = Tokenizer.from_file(bestfit.default_tokenizer()), collections.Counter(), 0
    for doc_id, text in rows:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((x["doc_id"], x["piece"], x["start"], x["length"], zlib.crc32(bytes(x["ids"]))) for x in out) == want
    by = collections.defaultdict(list)
    for x in out:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by) <= 1.02 * -(-tokens // size)
    assert bestfit.pack_documents(docs.limit(0)).count() == 0


def test_search_raises_squared_fill_and_keeps_items():
    r = np.random.default_rng(5)
    emptied = 0
    for trial in range(40):
        size = int(r.integers(20, 200))
        lengths = r.integers(1, size + 1, int(r.integers(1, 300))).tolist() if trial % 2 else r.integers(size // 5, size // 2 + 1, 300).clip(1).tolist()
        bins = bestfit.Bins(size)
        bins.best_fit(lengths)
        start, squares = len(bins.items), sum(f * f for f in bins.fill)
        assert start >= -(-sum(lengths) // size)
        made = bins.search()
        assert sorted(i for b in bins.items for _, i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for _, i in b) == f <= size for b, f in zip(bins.items, bins.fill))
        assert sum(f * f for f in bins.fill) >= squares + 2 * made
        emptied += start - sum(f > 0 for f in bins.fill)
    assert emptied > 0


@pytest.mark.parametrize("bins, want", [
    ([[6, 3], [5, 4]], 2),  # full to 9 each: one for one makes 10 and 8
    ([[7], [3], [3]], 2),  # a move
    ([[5, 3], [6, 2], [4]], 2),  # two swaps empty the third
])
def test_exchanges(bins, want):
    numbered, i = [], 0
    for b in bins:
        numbered.append([(n, i + k) for k, n in enumerate(b)])
        i += len(b)
    b = bestfit.Bins(10, numbered)
    b.search()
    assert sum(f > 0 for f in b.fill) == want
    assert max(b.fill) == 10


@pytest.mark.parametrize("d", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["apart", "clustered", "pairs", "falling", "rank"])
def test_refined_eigenvectors(d, kind):
    r = np.random.default_rng(d)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    e = {"apart": np.linspace(1, 2, d), "clustered": 1 + 1e-9 * r.normal(size=d), "pairs": np.repeat(r.normal(size=d) ** 2, 2)[:d],
         "falling": 10.0 ** -np.linspace(0, 12, d), "rank": np.where(np.arange(d) < d // 2 + 1, 3 + 1e-7 * np.arange(d), 0)}[kind]
    a = (q * e) @ q.T * 50
    a = (a + a.T) / 2
    values, x = whitening.eigenvectors(a)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-14
    assert np.abs(a @ x - x * values).max() < 1e-13 * np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * np.abs(a).max()
    if kind == "apart":
        first = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
        exact = np.linalg.eigh(a)[1][:, ::-1]
        off = lambda y: np.abs(np.abs((y * exact).sum(axis=0)) - 1).max()
        assert off(x) < 1e-14 and (d < 5 or off(x) < off(first))


def brute_whitening(vectors, components):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64).astype(object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    far = x * n - total
    y = far.astype(np.float64) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    return [int((f * f).sum()) for f in far], y @ q[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum(), n


def test_whitening(spark):
    r = np.random.default_rng(1)
    good = (r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) + 5).astype(np.float32)
    good[20:60] = good[19]  # copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(good)]
    rows += [(None, rows[0][1]), (3, rows[5][1])]
    bad = [None, [], [None] * 12, [float("nan")] + [1.0] * 11, [float("inf")] * 12, [-float("inf")] + [0.0] * 11, [1.0] * 11 + [None], [1e30] * 12, [1.0] * 7]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows + [(1000 + i, b) for i, b in enumerate(bad)]], "vec_id bigint, embedding array<float>, k string, n int")
    out = whitening.whiten(df, components=5).collect()
    deviations, white, explained, n = brute_whitening([v for _, v in rows], 5)
    assert collections.Counter((x["vec_id"], x["n"], x["deviation"]) for x in out) == collections.Counter((k, n, d) for (k, _), d in zip(rows, deviations))
    want = {k: w for (k, _), w in zip(rows[:300], white)}
    for x in out:
        if x["vec_id"] is not None and x["vec_id"] != 3:
            assert np.abs(np.abs(x["whitened"]) - np.abs(want[x["vec_id"]])).max() < 1e-9
        assert np.allclose(x["explained"], explained, rtol=1e-12)
        assert x["identity_error"] < 1e-12
    got = np.array([x["whitened"] for x in out])
    assert np.abs(got.T @ got / n - np.eye(5)).max() < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    (one,) = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert (one["n"], one["deviation"], one["whitened"], one["explained"]) == (1, 0, [], [])
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], schema)).collect()
    assert all(len(x["whitened"]) == 1 and x["explained"] == [1.0] for x in flat)
    # entries beyond 32 bits: whole numbers that pass 64 bits are worked out in full
    big = [[2.0**40 * i, 3.0 - i] for i in range(5)]
    out = whitening.whiten(spark.createDataFrame(list(enumerate(big)), "vec_id bigint, embedding array<double>")).collect()
    deviations = brute_whitening(big, 2)[0]
    assert [x["deviation"] for x in sorted(out, key=lambda x: x["vec_id"])] == [d if d < 2**63 else None for d in deviations]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_on_the_given_tables(spark):
    """The registered queries over whole tables, against brute force, the plain tokenizer and numpy."""
    from specspark.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()]
    got = QUERIES["op11_collocations"](spark, SF)
    assert [d for _, d in got.dtypes] == ["string", "bigint", "string", *["bigint"] * 5]
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases([(lang, text) for _, lang, text in docs])

    tk, want, tokens = Tokenizer.from_file(bestfit.default_tokenizer()), set(), 0
    for doc_id, _, text in docs:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
        tokens += len(ids)
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        want |= {(doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    out = QUERIES["op12_best_fit"](spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    out = out.collect()
    assert len(out) == len(want) and {tuple(x)[:5] for x in out} == want
    by = collections.defaultdict(list)
    for x in out:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    assert all(sorted(p)[i][0] == sum(n for _, n in sorted(p)[:i]) for p in by.values() for i in range(len(p))) and max(sum(n for _, n in p) for p in by.values()) <= 2048
    assert len(by) <= -(-tokens // 2048) + 2

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    deviations, white, explained, n = brute_whitening([v for _, v in rows], 32)
    out = QUERIES["op13_whitening"](spark, SF)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    table = {(x["vec_id"], x["component"]): x for x in out.collect()}
    assert len(table) == 32 * n
    for i, (vec_id, _) in enumerate(rows):
        for k in range(32):
            x = table[vec_id, k + 1]
            assert (x["n"], x["deviation"]) == (n, deviations[i]) and abs(abs(x["whitened"]) - abs(white[i, k])) < 1e-9
            assert x["explained"] == pytest.approx(explained[k], rel=1e-9) and x["identity_error"] < 1e-10
