"""Brute force, round trips and edge cases of the llm operators."""

import collections
import hashlib
import io
import math
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, fingerprints, language, lm, ngram_join, packing, passages, queries, urls, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, bucket int, key string, sid long, a long, batch long"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(120))
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, None), (4, "", "fr"), (5, "Été là-bas, où?", "fr"), (6, LONG, "en"), (7, "42 -- !!", None), (None, base, "en"), (8, "one two", "en"), (9, base.replace(base.split()[60], "changed"), "en"), (2**62, "\t \n", "en"), (-5, "ΑΣ " + base[:300], None)]
    return spark.createDataFrame([(k, t, l, 1, "k", 2, 3, 4) for k, t, l in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_all_queries_run(spark):
    """Each registered query gives rows whose number is that of its contract."""
    count = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    got = {n: f(spark, SF).count() for n, f in queries.queries().items()}
    assert all(got[n] == count("documents") for n in ("op1_simhash", "op4_language_id", "op5_lm_scoring", "op8_ngram_jaccard"))
    assert got["op2_url_filter"] == got["op10_warc"] == count("pages") and got["op7_best_fit_packing"] >= count("documents")
    assert got["op9_chat_format"] == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1


def test_oracles(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        q = con.sql(sql)
        cols = list(q.columns)
        got = [tuple(r[c] for c in cols) for r in queries.queries()[name](spark, SF).collect()]
        assert sorted(got, key=str) == sorted(q.fetchall(), key=str), name


def test_fingerprints(spark, odd, none):
    got = fingerprints.edited_fingerprints(odd, "doc_id", "text").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = sorted((k, hashlib.sha256(fingerprints.edited(t, rows[(i + 1) % len(rows)][1]).encode()).hexdigest(), len(t)) for i, (k, t) in enumerate(rows) if k is not None)
    assert sorted((r.doc_id, r.edited_sha256, r.n_chars) for r in got if r.doc_id is not None) == want and len(got) == len(rows)
    of = {r.doc_id: r.fingerprint for r in got}
    assert of[1] == of[2] == of[None] and of[3] == of[4] == "0" * 32
    assert fingerprints.edited_fingerprints(none, "doc_id", "text").count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    centre = [rng.getrandbits(128) for _ in range(20)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(6))) for c in centre for _ in range(12)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v >> 64), signed(v & (2**64 - 1))) for v in values], "hi long, lo long")
    for radius, blocks in ((3, 4), (2, 5)):
        got = fingerprints.near_fingerprints(df, df, radius, blocks)
        want = sum((x ^ y).bit_count() <= radius for x in values for y in values)
        assert got.count() == want == got.distinct().count()


def test_urls(spark):
    cases = {"HTTP://A.Example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"), "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "x://b.net/fr/1": ("b.net", "/fr/1", "net/fr/", "block"), "http://c.com": ("c.com", "", None, "allow"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://notcom/": ("notcom", "/", None, "allow"), "http://q.com#a?b": ("q.com", "", None, "allow"), "http://h.com/a?b/c": ("h.com", "/a", "com/", "allow"), "": ("", "", None, "allow")}
    clean, spam = "<p>farm garden house words garden</p>", "<p>spam farm <b>words</b></p>"
    rows = [(i, u, clean, 1) for i, u in enumerate([*cases, *["http://garden.example.org/en/7"] * 12])]
    rows += [(len(rows) + i, "http://spamfarm.example.org/en/5", spam, 1) for i in range(6)]
    rows += [(100, f"http://{'a' * 400}.org/x", None, 1), (100, f"http://{'a' * 400}.org/x", None, 1), (None, "http://é.com/x", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    all_ = urls.filter_urls(pages, "page_id", "url", "html").collect()
    got = {r.page_id: r for r in all_}
    assert len(all_) == len(rows) and got[100].segmented == "a" * 400 + " org" and got[None].segmented == "é com"
    for i, want in enumerate(cases.values()):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want
    n = len(cases)
    assert got[n].verdict == "allow" and got[n + 12].verdict == "block" and got[n + 12].segmented == "spam farm example org"
    assert urls.filter_urls(pages.where("false"), "page_id", "url", "html").count() == 0
    # naive Bayes by hand, over tokens instead of buckets
    tokens = lambda r: [("h", t) for t in r.segmented.split()] + [("p", t) for t in urls.path_tokens(r.path)]
    label = {k: int("spam" in (h or "")) for k, _, h, _ in rows}
    seen = collections.Counter((label[r.page_id], t) for r in all_ for t in tokens(r))
    used = len({t for _, t in seen})
    total = [sum(c for (x, _), c in seen.items() if x == y) for y in (0, 1)]
    prior = math.log((sum(label[r.page_id] for r in all_) + 1) / (sum(1 - label[r.page_id] for r in all_) + 2))
    for r in all_:
        want = prior + sum(math.log((seen[1, t] + 1) / (total[1] + used)) - math.log((seen[0, t] + 1) / (total[0] + used)) for t in tokens(r))
        assert math.isclose(r.log_odds, want, abs_tol=1e-9)


def test_urls_of_unseen_pages(spark):
    """Precision and recall on pages that train nothing, against the labels of their text."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    out = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(4)) == 2
    got = {r.page_id: r.log_odds > 0 for r in urls.filter_urls(pages, "page_id", "url", "html", train=~out).collect()}
    want = {r.page_id: bool(urls.labelled(r.html, frozenset(urls.SEEDS))) for r in pages.where(out).collect()}
    hits = sum(got[k] and v for k, v in want.items())
    assert sum(want.values()) > 20 and hits >= 0.9 * sum(want.values()) and hits >= 0.75 * sum(got[k] for k in want)


def test_urls_know_every_word(spark):
    """More words of one count than a model of 50,000 would hold: names are still cut at them."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    words = [f"{letters(i)}q" for i in range(60_000)]
    rows = [(i, f"http://{words[i * 150]}{words[i * 150 + 77]}.org/{i}", " ".join(words[i * 150 : i * 150 + 150])) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.segmented for r in urls.filter_urls(pages, "page_id", "url", "html").collect()}
    model = urls.Segmenter({w: 1 for w in words} | {s: 1 for s in urls.SEEDS})
    assert got == {i: " ".join(model.split(u[7:].split(".")[0]) + model.split("org")) for i, u, _ in rows}
    assert got[7].startswith(f"{words[1050]} {words[1127]} ")


def test_viterbi_is_the_best_split():
    counts = {"a": 5, "ab": 9, "b": 3, "ba": 2, "abc": 1, "c": 4}
    model = urls.Segmenter(counts)
    cost = lambda ws: sum(model.cost.get(w, model.unknown + 2.5 * len(w)) for w in ws)

    def splits(s):
        return [[]] if not s else [[s[:i], *r] for i in range(1, len(s) + 1) for r in splits(s[i:])]

    for name in ("abcab", "bababc", "xab", "abxxc", "a"):
        assert math.isclose(cost(model.split(name)), min(map(cost, splits(name))))


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", language.held_out("doc_id", 4, 2))
    got = language.predict(docs, "text", language.train(docs.where("not held"), "text", "lang"), ["doc_id", "held", "lang"])
    right = got.where("held").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    model = language.train(odd, "text", "lang")
    by = {(r.doc_id, r.text): r for r in language.predict(odd, "text", model, ["doc_id", "text"]).collect()}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in by if not any(c.isalpha() for c in k[1] or "")) and len(by) == 12
    assert by[(6, LONG)].lang_pred == "en" and all(0 <= r.score <= 1 for r in by.values())
    assert language.predict(none, "text", model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in language.predict(odd, "text", language.train(none, "text", "lang"), ["doc_id"]).collect()} == {"und"}


def test_language_counts_every_gram_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choice("abc É1 ß") for _ in range(500))
    whole = np.sort(language.grams([text])[0])
    monkeypatch.setattr(language, "PIECE", 7)
    parts = [language.grams([t for _, t, _ in run], [n for _, _, n in run])[0] for run in language.pieces([None, text, ""])]
    assert np.array_equal(np.sort(np.concatenate(parts)), whole)


def test_language_against_naive_bayes_by_hand(spark):
    """Posteriors from plain dictionaries of n-grams, evidence tempered as the operator says."""
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, make("abcde") if i % 2 else make("cdefg"), ["x", "y"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(df, "text", language.train(df.where("doc_id < 30"), "text", "lang"), ["doc_id"]).collect()
    of = lambda t: [(k, f" {t} "[i : i + k]) for k in language.ORDERS for i in range(1, len(t) + 2 - k + 1) if f" {t} "[i : i + k].strip()]
    grams = lambda t: [g for g in of(t) if len(g[1]) == g[0]]
    seen = {y: collections.Counter(g for _, t, x in rows[:30] if x == y for g in grams(t)) for y in "xy"}
    logs = {}
    for y in "xy":
        total = sum(seen[y].values()) + 0.5 * language.BUCKETS
        logs[y] = {g: math.log((seen[y][g] + 0.5) / total) for g in set(seen["x"]) | set(seen["y"])} | {None: math.log(0.5 / total)}
    for r in got:
        g = grams(rows[r.doc_id][1])
        points = {y: min(1, language.EVIDENCE / len(g)) * sum(logs[y].get(x, logs[y][None]) for x in g) + math.log(0.5) for y in "xy"}
        best = max(points, key=points.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(math.exp(p - points[best]) for p in points.values())) < 0.02


def test_lm_base_and_weights(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id is null or doc_id < 0 or doc_id > 1000"))
    got = lm.score_corpus(docs, "doc_id", "text", language.held_out("doc_id", 5, 1)).collect()
    rows = [(r.doc_id, [*words(r.text), None]) for r in docs.collect()]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    one = collections.Counter(w for k, ws in rows if not held(k) for w in ws)
    n, v = sum(one.values()), len(one)
    want = sorted((str(k), held(k), len(ws), sum(one[w] > 0 for w in ws), n, round(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for k, ws in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    ours = [r for r in got if r.held_out]
    assert sum(r.score for r in ours) > sum(r.base_score for r in ours) and all(r.score < 0 for r in got)
    assert lm.score_corpus(none, "doc_id", "text", language.held_out("doc_id", 5, 1)).count() == 0
    only = lm.score_corpus(docs.limit(3), "doc_id", "text", F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only)


def test_lm_totals_in_a_fresh_worker(tmp_path):
    """A worker that no other operator ran in has imported nothing but the module itself."""
    keys, counts = lm.packed_keys(np.array([3, 5], np.uint64)), lm.planes(np.array([1, 2], np.uint64))
    sent = lm.batch_of(lm.MESSAGE, list(zip(*[(0, n, 0, 0, keys, counts, None) for n in (1, 2)], strict=True)))
    with pa.OSFile(str(tmp_path / "sent"), "wb") as f, pa.ipc.new_file(f, sent.schema) as to:
        to.write(sent)
    code = f"""
import pyarrow as pa
from palimpsest.llm import lm
out = lm._total_up(pa.ipc.open_file({str(tmp_path / "sent")!r}).read_all()).to_pylist()
print([(r["batch"], r["n_types"], r["n_tokens"]) for r in out])
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "[(-1, 2, 6), (1, None, None), (2, None, None)]", done.stderr


def test_lm_score_against_exact_interpolation(spark):
    """Scores with weights from expectation-maximisation over every held-out token, no grid of half bits."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = language.held_out("doc_id", 5, 1)
    dev = ~held & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(lm.DEV)) == 0)
    rows = docs.select("doc_id", "text", held.alias("held"), dev.alias("dev")).collect()
    got = {r.doc_id: r.score for r in lm.score_corpus(docs, "doc_id", "text", held).collect()}
    tokens = {r.doc_id: [*words(r.text), None] for r in rows}
    pairs = lambda t: list(zip([None, *t[:-1]], t, strict=True))
    count = lambda rs: (collections.Counter(w for r in rs for w in tokens[r.doc_id]), collections.Counter(p for r in rs for p in pairs(tokens[r.doc_id])))
    (c1, c2), (d1, d2) = count([r for r in rows if not r.held]), count([r for r in rows if not r.held and not r.dev])
    n, nd, uniform = sum(c1.values()), sum(d1.values()), 1 / (len(c1) + 1)
    bucket = lambda c: min(c.bit_length(), lm.CONTEXTS - 1)
    part = lambda one, two, m, v, w: (two[v, w] / one[v] if one[v] else 0.0, one[w] / m, uniform)
    seen = [(bucket(d1[v]), part(d1, d2, nd, v, w)) for r in rows if r.dev for v, w in pairs(tokens[r.doc_id])]
    assert len(seen) > 500
    lam = np.full((lm.CONTEXTS, 3), 1 / 3)
    at, parts = np.array([b for b, _ in seen]), np.array([p for _, p in seen])
    for _ in range(lm.ITERATIONS):
        share = lam[at] * parts
        share /= share.sum(1, keepdims=True)
        each = np.zeros_like(lam)
        np.add.at(each, at, share)
        whole = (each.sum(0) + 1e-9) / (each.sum() + 3e-9)
        lam = (each + whole) / (each + whole).sum(1, keepdims=True)
    lam[0, 1:] += lam[0, 0] / 2
    lam[0, 0] = 0
    for r in rows:
        want = sum(math.log10(lam[bucket(c1[v])] @ part(c1, c2, n, v, w)) for v, w in pairs(tokens[r.doc_id]))
        assert math.isclose(got[r.doc_id], want, rel_tol=0.01), (r.doc_id, got[r.doc_id], want)


def test_totals_in_a_tree(spark):
    """Every batch is told the same sums however many levels they pass, counts beyond 32 bits and dev counts included."""
    from palimpsest.llm._common import packed_keys, planes, unplanes

    rng = np.random.default_rng(3)
    rows, every, dev = [], collections.Counter(), collections.Counter()
    for batch in range(40):
        for shard in (0, 1):
            for kind in (0, 1):
                keys = np.unique(rng.integers(0, 30, 12)).astype(np.uint64)
                counts = rng.integers(0, 2**33, len(keys)).astype(np.uint64)
                for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
                    every[shard, kind, k] += c
                    dev[shard, kind, k] += c * (batch % 4 == 0)
                rows.append((shard, batch, int(batch % 4 == 0), kind, bytearray(packed_keys(keys)), bytearray(planes(counts)), None, keys.tolist()))
    sent = spark.createDataFrame([r[:7] for r in rows], lm.MESSAGE)
    keys = {(r[0], r[1], r[3]): r[7] for r in rows}
    for fan in (64, 7, 3):
        got = lm.totals(sent, 40, fan).collect()
        told = {(r.shard, r.batch, r.kind): r for r in got if r.batch >= 0}
        assert told.keys() == keys.keys() and sum(r.batch >= 0 for r in got) == len(keys)
        for (shard, batch, kind), r in told.items():
            names = keys[shard, batch, kind]
            assert unplanes(bytes(r.total), np.uint64).tolist() == [every[shard, kind, k] for k in names]
            assert (r.dev_total is None) == (batch % 4 != 0)
            if r.dev_total is not None:
                assert unplanes(bytes(r.dev_total), np.uint64).tolist() == [dev[shard, kind, k] for k in names]
        ends = [r for r in got if r.batch == -1]
        assert sum(r.n_tokens for r in ends) == sum(c for (_, kind, _), c in every.items() if kind == 0)
        assert sum(r.n_dev for r in ends) == sum(c for (_, kind, _), c in dev.items() if kind == 0)


def test_interpolation_sums_to_one():
    """Over all words after any context the mixture is a distribution."""
    grid = np.zeros((lm.CONTEXTS, lm.STEPS, lm.STEPS))
    grid[3, 4, 20] = 10
    grid[3, lm.STEPS - 1, 10] = 5
    w = lm.weights(grid, 1e-3)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[3, 0] > 0.4


def brute_classes(rows, width, num, den):
    sets = [frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset() for _, w in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [(k, len(s) if s else 0, least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_classes(spark, odd, none, width, num):
    rng = random.Random(width)
    texts = []
    for _ in range(60):
        w = [rng.choice("stuvwxyz") + str(rng.randrange(30)) for _ in range(rng.choice([3, 8, 12, 14, 20, 25, 60, 150]))]
        for _ in range(rng.randrange(1, 6)):
            texts.append(" ".join(w))
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice("stuvwxyz") + str(rng.randrange(30))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    got = ngram_join.jaccard_classes(docs, "doc_id", "text", width, num, 100).collect()
    want = brute_classes([(r.doc_id, words(r.text)) for r in docs.collect()], width, num, 100)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got)
    assert ngram_join.jaccard_classes(none, "doc_id", "text").count() == 0


def test_jaccard_of_a_hot_group(spark):
    """Near copies beyond the length of short lists, repeated rows, and other sets that share their shingles."""
    rng = random.Random(2)
    make = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(n)]
    hot, rows = make(100), []
    for i in range(420):
        w = list(hot)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(100)] = f"m{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows += [" ".join(hot[:40] + make(60)) for _ in range(60)] + rows[:5] * 3
    rng.shuffle(rows)
    rows = [(3 * i, t) for i, t in enumerate(rows)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), "doc_id", "text").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_classes([(k, words(t)) for k, t in rows], 3, 90, 100))


def test_lists_are_the_same_however_they_are_cut():
    """Lists over several tasks and batches: whole ones and pieces hold each entry of a list of two or more once."""
    import pyarrow as pa

    rng = random.Random(9)
    sizes = [1, 2, 3, 31, 32, 33, 40, 1, 1, 2500, 2, 1024, 1025, 1, 5]
    rows = [(k, i) for k, n in enumerate(sizes) for i in sorted(rng.sample(range(10**6), n))]
    for cuts in ([], [700], [3, 40, 41, 900, 2600]):
        pieces: dict = collections.defaultdict(list)
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[x : min(x + 97, b)]], pa.int64()) for j in (0, 1)], names=["key", "sid"]) for x in range(a, b, 97)]
            for out in ngram_join.scan(iter(batches)):
                for key, ids, whole in zip(*(c.to_pylist() for c in out.columns), strict=True):
                    assert len(ids) <= (ngram_join.SHORT if whole else ngram_join.PIECE) and (not whole or len(ids) == sizes[key])
                    pieces[key] += ids
        for key, n in enumerate(sizes):
            want = [i for k, i in rows if k == key]
            assert sorted(pieces[key]) == want or (n == 1 and not pieces[key])


def test_subsets_meet_whenever_light_sets_link():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(5, 20))
        a = np.unique(rng.integers(1, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(rng.choice(a, len(a) - int(rng.integers(0, 2)), replace=False), rng.integers(1, 2**63, int(rng.integers(0, 2))).astype(np.uint64)))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 90 * (len(a) + len(b) - same) and max(len(a), len(b)) <= 20:
            keys = [set(ngram_join.subset_keys(x, 20, 90, 100).tolist()) for x in (a, b)]
            assert keys[0] & keys[1]


def test_compact_windows_are_those_of_the_cartesian_tree():
    rng = np.random.default_rng(3)
    for n in (10, 60, 400, 3000):
        h = rng.integers(1, 50 if n == 400 else 2**62, n).astype(np.uint64)
        want = set()
        for c in range(n):
            left = right = c
            while left and h[left - 1] > h[c]:
                left -= 1
            while right < n - 1 and h[right + 1] >= h[c]:
                right += 1
            if right - left + 1 >= passages.LEAST:
                want.add((c, c - left, right - c))
        got = set(zip(*(x.tolist() for x in passages.compact_windows(np.concatenate([h, [np.uint64(0)]]))), strict=True))
        assert got == want


def test_passages(spark, odd, none):
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.choice('klmn')}{rng.randrange(10**6)}" for _ in range(n)]
    hot, near = fresh(60), fresh(80)
    rows = []
    for i in range(60):
        body = near.copy()
        body[40] = f"other{i}"
        rows.append((1000 + i, " ".join(fresh(70) + hot + fresh(30) + (body if i % 3 == 0 else []))))
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = passages.repeated_passages(docs, "doc_id", "text").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert 1000 not in by and None not in by and 6 not in by
    for i in range(1, 60):
        assert any(r.start <= 70 and r.start + r.n_words >= 130 for r in by[1000 + i])
        if i % 3 == 0:
            assert any(r.start + r.n_words >= 230 for r in by[1000 + i])
    assert any(r.source_id == 1 or r.source_id == -5 for r in by[2])
    assert passages.repeated_passages(none, "doc_id", "text").count() == 0
    assert passages.without_spans("a b  c\nd e", [(1, 2)]) == "a d e" and passages.without_spans("a b", [(0, 2)]) == ""


def _in_common(x, y):
    """Jaccard similarity of the shingles of two spans, each as often as it occurs."""
    x, y = (collections.Counter(tuple(w[i : i + passages.WIDTH]) for i in range(len(w) - passages.WIDTH + 1)) for w in (x, y))
    same = (x & y).total()
    return same / (x.total() + y.total() - same)


def test_repeats_with_inserted_and_deleted_words(spark):
    rng = random.Random(11)
    new = lambda n: [rng.randrange(2**32) for _ in range(n)]
    wanted = 0
    for _ in range(400):
        p = new(rng.randrange(56, 200))
        q = []
        for at in range(0, len(p), 12):  # edits are over WIDTH words apart, so that no gap is over GAP
            part = p[at : at + 12]
            if at and len(part) == 12 and rng.random() < 0.15:
                n = rng.randrange(1, 4)
                part = new(n) + part if rng.random() < 0.5 else part[n:]
            q += part
        if len(q) < passages.MIN_WORDS:
            continue
        a, b = (np.array(x, np.uint32) for x in (new(30) + p + new(20), new(70) + q + new(33)))
        near = _in_common(p, q)
        seed = next(d for d in range(20, 60) if len(passages.Runs([(a, b, [d])]).start))
        got = passages.passages(a, b, [seed])
        whole = [r for r in got if r[0] == 70 and r[0] + r[1] == 70 + len(q)]
        assert bool(whole) == (near >= passages.SIMILAR), near
        for start, n, source, similarity in got:
            ends = [source + m for m in range(n - 40, n + 41) if m >= passages.MIN_WORDS and source + m <= len(a)]
            assert n >= passages.MIN_WORDS and similarity >= passages.SIMILAR
            assert any(math.isclose(similarity, _in_common(a[source:e].tolist(), b[start : start + n].tolist())) for e in ends)
        wanted += near >= passages.SIMILAR
    assert wanted > 100
    text = lambda n: [f"{rng.choice('klmn')}{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(40):
        body = text(80)
        rows += [(2 * i, " ".join(text(70) + body + text(30))), (2 * i + 1, " ".join(text(20) + body[:40] + text(1) + body[40:] + text(50)))]
    found = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    # three min-hashes meet on nearly all pairs; each one found is whole
    assert len(found) >= 36 and all((k % 2, r.start, r.n_words, r.source_id, r.source_start) == (1, 20, 81, k - 1, 70) for k, r in found.items())


def test_holders_of_a_common_line_find_their_partners():
    """Links under keys that 600 documents hold: of pairs that share a few words more than the line."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(7)
    word = lambda: np.uint64(rng.getrandbits(64))
    line = [word() for _ in range(46)]
    sides = [([word() for _ in range(60)], [word() for _ in range(60)]) for _ in range(600)]
    pairs = [(i, i + 300) for i in range(0, 300, 5)]
    for i, j in pairs:
        sides[j][0][-3:], sides[j][1][:3] = sides[i][0][-3:], sides[i][1][:3]
    docs = [(i, np.array(a + line + b, np.uint64)) for i, (a, b) in enumerate(sides)]
    rows = pa.Table.from_batches([passages.window_rows(docs[i : i + 40]) for i in range(0, len(docs), 40)])
    order = [(c, "ascending") for c in ("key", "ctx", "doc", "c")]
    seen = collections.Counter()
    for second in (False, True):
        out = pa.Table.from_batches(list(passages.scan(iter(rows.sort_by(order).to_batches(100)), second)), schema=rows.schema)
        for a, b, same in zip(*(out.filter(pc.is_valid(out["a"]))[c].to_pylist() for c in ("a", "b", "same")), strict=True):
            seen[a, b] += 2 if same else 1
        rows = out.filter(pc.is_null(out["a"]))
    assert sum(seen[p] > 1 for p in pairs) >= 0.75 * len(pairs) and len(seen) < 40 * len(docs)


def test_equal_texts_are_searched_once(spark, monkeypatch):
    """Copies are whole repeats of the first; a repeat that the first has is theirs too, and they add no pairs to verify."""
    rng = random.Random(18)
    text = lambda n: [f"{rng.choice('klmn')}{rng.randrange(10**9)}" for _ in range(n)]
    line = text(60)
    old, new = " ".join(text(30) + line), " ".join(line + text(90))
    rows = [(1, old), *((i, new) for i in range(10, 40)), (10, new), (50, " ".join(text(7) + line)), (60, "too few"), (61, "too few")]
    sizes, passages_of = [], passages.written
    monkeypatch.setattr(passages, "written", lambda df, label: (out := passages_of(df, label), sizes.append(out.count()) if label == "passage-pairs" else None)[0])
    docs = spark.createDataFrame(rows, "d long, t string").repartition(5)
    got = sorted((r.doc_id, r.start, r.n_words, r.source_id, r.source_start, r.similarity) for r in passages.repeated_passages(docs, "d", "t").collect())
    assert got == [(10, 0, 60, 1, 30, 1.0), *((i, 0, 150, 1, 30, 1.0) for i in range(11, 40)), (50, 7, 60, 1, 30, 1.0)]
    assert sizes == [3]


def test_contamination(spark, odd, none):
    items = [(1, " ".join(LONG.split()[5000:5030])), (2, "One, TWO!"), (3, None), (4, ""), (5, "never seen anywhere at all " * 3), (6, " ".join(LONG.split()[9:29] + ["x"] * 3)), (2, "one two")]
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contamination(odd, "doc_id", "text", bench, "item_id", "text").collect()}
    assert got == {(6, 1): 1.0, (8, 2): 1.0} | ({(6, 6): 16 / 19} if 16 / 19 >= 0.8 else {})
    assert decontaminate.contamination(none, "doc_id", "text", bench, "item_id", "text").count() == 0
    assert decontaminate.contamination(odd, "doc_id", "text", bench.where("false"), "item_id", "text").count() == 0


def test_contamination_misses_no_small_item(spark):
    """Items of few shingles in a long document, and shares just over the least, against brute force."""
    rng = random.Random(12)
    fresh = lambda n: [f"q{rng.randrange(10**7)}" for _ in range(n)]
    texts, items = [fresh(6000) for _ in range(6)], []
    for n in (4, 5, 6, 7, 8, 21):
        for _ in range(80):
            at = rng.randrange(5900)
            items.append(texts[len(items) % 6][at : at + n])
            if n == 21:  # 17 shingles, 14 of them held
                items[-1][18:] = fresh(3)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.containment for r in decontaminate.contamination(docs, "doc_id", "text", bench, "item_id", "text").collect()}
    want = {}
    runs = [{n: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for n in (4, 5)} for t in texts]
    for k, item in enumerate(items):
        n = min(5, len(item))
        grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        want |= {(k, d): share for d, r in enumerate(runs) if (share := len(grams & r[n]) / len(grams)) >= 0.8}
    assert got == want and len(want) >= len(items)


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(packing.vocabulary_path())
    texts = ["", "ΑΣ ΟΔΟΣ", "don't it's2U3 'll'd'", "ﬁ Å e\u0301 \u0300x", "漢字かな 🎉🎉a", "x\u200bY ǅ ß ẞ 'S'T ½²", "a<|endoftext|>b <| c", "tab\tnew\nline\x1cx\x85y\u00a0z", LONG[:3000], "٣٤ ẛx \U0001f600'm", "\u0345 İstanbul"]
    for t in texts:
        assert encode(t) == encode.whole(t), t


def test_encoder_is_kept_for_the_tasks_of_a_worker(monkeypatch):
    path = packing.vocabulary_path()
    encode = packing.encoder(path)
    assert packing.encoder(path) is encode
    monkeypatch.setattr(packing, "WORDS", 100)
    assert encode(LONG[:9000]) == encode.whole(LONG[:9000]) and len(encode) <= 100


def test_passages_whichever_text_is_longer(spark):
    """The shorter text of a pair is sent to the longer one: the spans are the same both ways, also of rows that share an id."""
    rng = random.Random(8)
    fill = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    one, two = fill(60), fill(70)
    texts = [(1, f"{fill(300)} {one}"), (2, f"{one} {fill(5)}"), (3, f"{two} {fill(3)}"), (4, f"{fill(40)} {two} {fill(200)}"), (4, fill(80))]
    got = sorted((r.doc_id, r.start, r.n_words, r.source_id, r.source_start, r.similarity) for r in passages.repeated_passages(spark.createDataFrame(texts, "d long, t string"), "d", "t").collect())
    assert got == [(2, 0, 60, 1, 300, 1.0), (4, 40, 70, 3, 0, 1.0)]


def test_plan_keeps_one_stock():
    """The search holds a path, not a histogram for each of its nodes."""
    rng = random.Random(3)
    counts = {k: rng.randrange(1, 9) for k in rng.sample(range(1, 4097), 3000)}
    tracemalloc.start()
    plan = packing.plan_packing(counts, nodes=400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    used = collections.Counter()
    for f, n in plan:
        assert sum(f) <= 4096
        used.update({k: m * n for k, m in collections.Counter(f).items()})
    assert used == counts and peak < 8 << 20


def test_packing(spark, odd, none):
    got = packing.pack(odd, "doc_id", "text").collect()
    encode = packing.Encoder(packing.vocabulary_path())
    want = collections.Counter()
    for r in odd.collect():
        ids = encode.whole(r.text or "") + (1).to_bytes(4, "little")
        for p, at in enumerate(range(0, len(ids), 4 * 4096)):
            want[(r.doc_id, p, at // 4, len(ids[at : at + 16384]) // 4, zlib.crc32(ids[at : at + 16384]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack(none, "doc_id", "text").count() == 0


def test_plans_against_the_best_packing():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.randrange(10, 70) for _ in range(9)]
        best = [9]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + sizes[i] <= 100:
                    place(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        plan = packing.plan_packing(collections.Counter(sizes), 100)
        assert sum(n for _, n in plan) == best[0]
        assert collections.Counter(x for f, n in plan for x in f * n) == collections.Counter(sizes)


def test_chat_events(spark):
    rows = [(1, 0, 0, "message", "user", "hi <|im_end|> \\n \\"), (1, 1, 0, "message", "assistant", ""), (1, 1, 1, "delta", None, "Hel"), (1, 1, 2, "delta", None, "lo"), (1, 2, 0, "message", "user", "old"), (1, 2, 5, "edit", None, "new"), (1, 3, 0, "message", "assistant", "bad"), (1, 3, 1, "regenerate", None, "go"), (1, 3, 2, "delta", None, "od"), (1, 4, 0, "message", "user", "gone"), (1, 4, 1, "retract", None, None), (None, None, None, "message", None, None), (2, 0, 0, "message", "a\nb\\", "<|<|im_start|>"), (3, 0, 0, "message", "user", "x"), (3, 0, 0, "message", "user", "x"), (3, 1, 0, "message", "assistant", LONG)]
    events = spark.createDataFrame(rows, "conv long, turn long, seq long, kind string, role string, text string")
    chunks = chat.format_events(events.withColumn("chunk", F.lit(1)))
    told = collections.defaultdict(list)
    for r in chunks.collect():
        told[r.conv] += list(chat.turns_of(r.text))
    assert told[1] == [("user", "hi <|im_end|> \\n \\"), ("assistant", "Hello"), ("user", "new"), ("assistant", "good")]
    assert told[2] == [("a\nb\\", "<|<|im_start|>")] and told[3] == [("user", "x"), ("user", "x"), ("assistant", LONG)] and told[None] == [("", "")]
    back = {r.conv_id: r for r in chat.read_back(chunks).collect()}
    for conv, turns in told.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert back[conv].n_turns == len(turns) and back[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert back[conv].loss_chars == len(loss) and back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_events(events.where("false"))).count() == 0


def test_warc_roundtrip_and_damage(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (5, None, big), (5, "http://b", big), (3, "x y\r\nz", "short"), (2, "u", "short"), (None, "n", None), (None, "m", big), (9, "l", LONG)]
    pages = spark.createDataFrame([(k, u, h, 1, "d") for k, u, h in rows], "page_id long, url string, html string, refers_to int, digest string")
    listed = warc.write_archives(pages, "page_id", "url", "html")
    got = warc.read_archives(listed).collect()
    assert len(got) == len(rows)
    for k, _, h in rows:
        data = (h or "").encode()
        mine = [r for r in got if r.key == k and r.payload_digest == hashlib.sha1(data).hexdigest()]
        revisit = h == big and k != 5
        assert mine and all((r.record_type, r.refers_to, r.payload_bytes) == (("revisit", 5) if revisit else ("response", None)) + (len(data),) for r in mine)
        assert all(r.payload is None if revisit else bytes(r.payload) == data for r in mine)
    assert warc.read_archives(warc.write_archives(pages.where("false"), "page_id", "url", "html")).count() == 0
    one = warc.record(1, "u", b"payload")
    for size in (1, 7, 4096):
        assert [warc.parsed(m)[6] for m in warc.members(io.BytesIO(one + one), size)] == [b"payload"] * 2
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.members(io.BytesIO(one[:-9])))
    text = zlib.decompress(one, 31)
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(text.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    with pytest.raises(ValueError, match="frame"):
        warc.parsed(text[:-1])
