"""The ten operators and the pipeline against brute force and on the defined odd cases."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from tallyspark.llm import (bpe, components, decontam, langid, lm, neardup, pii, queries, topk, toxicity, urls,  # noqa: E402
                            warc)
from tallyspark.llm.common import word_codes  # noqa: E402
from tallyspark.session import ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, TOKENS string, rep int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, long and repeated texts, ties, and extra columns with clashing names."""
    ship_package(spark)
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(1, base, "en"), (1, base, "en"), (2, base, None), (3, None, "en"), (4, "", "en"), (5, " \n\t", None),
            (None, base, "en"), (6, "der schnelle braune Fuchs springt über den faulen Hund", "de"), (7, "word", "en"),
            (8, "1234 !!", "en"), (9, base.upper(), "en"), (10, " ".join(f"w{i % 997}" for i in range(20000)), "en"),
            (11, base + " x", None), (12, "mail a.b@c.de and 10.0.0.1 and +1 (269) 555-3296", "en")]
    return spark.createDataFrame([(i, t, g, None, None, "x", 1, "y") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    ship_package(spark)
    return spark.createDataFrame([], DOCS)


# ---- registered queries
def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    ok, msg = compare(spark, SF, name, queries.QUERIES[name], queries.ORACLE_SQL[name], duck(SF))
    assert ok, msg


# ---- shared parts
def test_word_codes_tell_words_apart():
    texts = ["The cat\tthe  CAT", "", "é É cat", "a b", "ab"]
    codes, off = word_codes(texts, "space")
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    seen = {}
    assert len(codes) == len(words) and list(off) == [0, 4, 4, 7, 9, 10]
    assert all(seen.setdefault(w, c) == c for w, c in zip(words, codes)) and len(set(seen.values())) == len(seen)


def test_components_of_a_long_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.components(e.limit(0)).count() == 0


# ---- 1 WARC
def test_warc_round_trip_and_odd_rows(spark, tmp_path):
    ship_package(spark)
    big = "x" * 1500
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", None), (4, "u", "é" * 10),
            (None, "u", big), (5, "u", "short"), (6, "u", "short")]
    p = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    a = warc.write_warc(p, path=str(tmp_path / "w"), roll_bytes=500, shards=2)
    got = sorted(((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["refers_to"]) for r in
                  warc.read_warc(spark, a).collect()))
    assert got == [(0, "response", 1500, None), (1, "revisit", 1500, 2), (2, "response", 1500, None),
                   (2, "response", 1500, None), (3, "response", 0, None), (4, "response", 20, None),
                   (5, "response", 5, None), (6, "response", 5, None)]
    assert all(f["records"] for f in a.manifest(spark).collect()) and a.manifest(spark).count() > 2
    b = warc.write_warc(p, path=str(tmp_path / "v"), roll_bytes=500, shards=2)
    same = lambda x: sorted((r["file"], r["sha256"]) for r in x.manifest(spark).collect())
    assert same(a) == same(b)                                            # deterministic
    (tmp_path / "w/data" / a.manifest(spark).first()["file"]).write_bytes(b"broken")
    with pytest.raises(Exception):
        warc.read_warc(spark, a).collect()
    assert warc.read_warc(spark, warc.write_warc(p.limit(0), path=str(tmp_path / "e"))).count() == 0


# ---- 2 decontamination
def test_decontamination_finds_copies_and_paraphrases_only(spark):
    ship_package(spark)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(8)) for _ in range(6)]
    fill = lambda n: " ".join(word() for _ in range(n))
    para = items[2].split()
    for i in range(0, len(para), 6):
        para[i] = word()
    docs = [(1, fill(90) + " " + items[0] + " " + fill(50)), (2, fill(200)), (3, " ".join(para)), (4, None), (5, ""),
            (6, items[4].upper().replace(" ", ",  ")), (6, items[4].upper().replace(" ", ",  ")), (None, items[1]),
            (7, " ".join(items[3].split()[:8]) + fill(40))]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, ids int")
    b = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, ""), (None, fill(20))],
                              "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    assert got == {(1, 0), (3, 2), (6, 4)}
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_finds_copies_of_a_hot_item_beside_rare_words(spark):
    """Every copy of an item that most documents hold has a rare word of another item next to it."""
    item = " ".join(f"hot{i}" for i in range(15))
    other = [f"rare{i}" for i in range(40)]
    docs = [(i, " ".join(f"f{i}x{j}" for j in range(70)) + f" {other[i % 40]} {item} {other[(i * 7 + 1) % 40]} " +
             " ".join(f"g{i}x{j}" for j in range(30))) for i in range(2000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(0, item), (1, " ".join(other[:20])), (2, " ".join(other[20:]))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(i, 0) for i in range(2000)}


def test_decontamination_finds_copies_of_long_items(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (70, 400, 1500, 3000, 5000)]
    fill = lambda n: " ".join(word() for _ in range(n))
    docs = [(i, f"{fill(53)} {t} {fill(71)}") for i, t in enumerate(items)] + [(i, fill(900)) for i in range(10, 40)]
    d = spark.createDataFrame(docs + [(50, " ".join(items[3].split()[:1500]))], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()} == {(i, i) for i in range(5)}


def test_lcs_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        assert decontam.lcs(a, b) == m[-1][-1]


# ---- 3 BPE
def test_bpe_equals_the_library(spark):
    ship_package(spark)
    rng = random.Random(2)
    shared = " ".join(f"passage{rng.randrange(10 ** 6)}" for _ in range(900))
    texts = [shared, shared + " tail", "head " + shared, None, "", "a<|endoftext|>b  c\n\n d", "日本語 \u0085 ẞ 𝒳 don't",
             "x" * 5000, " ".join("zq" for _ in range(3000))]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, shared, 1), (None, shared, 1)],
                              "doc_id long, text string, ids int")
    ref = bpe._reference()
    rows = bpe.decode(bpe.encode(d)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = shared if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == ref.encode(t, add_special_tokens=False).ids
        assert r["text"] == t
    assert bpe.encode(d.limit(0)).count() == 0


def test_bpe_query_on_the_tables(spark):
    ref = bpe._reference()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_chunked_bpe"](spark, SF).collect():
        ids = np.array(ref.encode(text[r["doc_id"]], add_special_tokens=False).ids, dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


# ---- 4 language ID
def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        lengths, switch = rng.integers(0, 12, 5), rng.uniform(0.1, 6)
        e = (rng.normal(size=(lengths.sum(), 3)) * 2).astype(np.float32)
        path, s = langid.viterbi(e, lengths, switch), 0
        for n in lengths:
            x, p = e[s:s + n].astype(float), path[s:s + n].astype(int)
            s += n
            if n:
                v = x[0]
                for t in range(1, n):
                    v = np.maximum(v, v.max() - switch) + x[t]
                assert abs(x[np.arange(n), p].sum() - switch * (np.diff(p) != 0).sum() - v.max()) < 1e-4


def test_language_spans_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(docs.filter("doc_id % 2 = 0"))
    test = docs.filter("doc_id % 2 = 1").join(langid.predict(docs, m), "doc_id")
    assert test.filter("lang = lang_pred").count() / test.count() > 0.97
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) between 500 and 900 and doc_id % 2 = 0").collect()}
    langs = [s[2] for s in langid.spans(by["de"] + " " + by["fr"], m)]
    assert langs[0] == "de" and langs[-1] == "fr"
    got = {r["doc_id"]: r for r in langid.predict(odd, langid.fit(odd)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 8)) and got[6]["lang_pred"] == "de"
    assert langid.predict(odd, langid.fit(none)).filter("lang_pred = 'und'").count() == odd.count()
    assert langid.predict(none, m).count() == 0


# ---- 5 LM scoring
def test_network_gradient_and_normalisation():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in lm.initial().items()}
    ctx, y = rng.integers(0, lm.VOCABULARY + 1, (40, 2 * lm.CONTEXT)), rng.integers(0, lm.VOCABULARY, 40)
    _, g = lm.forward(p, ctx, y, gradient=True)
    for k in p:
        i = tuple(np.argwhere(np.abs(g[k]) > 1e-6)[0])
        f = []
        for e in (1e-5, -2e-5):
            p[k][i] += e
            f.append(-lm.forward(p, ctx, y).mean())
        p[k][i] += 1e-5
        assert abs((f[0] - f[1]) / 2e-5 - g[k][i]) < 1e-5
    one = np.repeat(ctx[:1], lm.VOCABULARY, axis=0)
    assert abs(np.exp(lm.forward(p, one, np.arange(lm.VOCABULARY))).sum() - 1) < 1e-6


def test_training_predicts_every_position(monkeypatch):
    texts = ["Copyright notice " + " ".join(f"w{i % 13}" for i in range(n)) for n in (0, 5, 9000, 300)] * 2 + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    codes = word_codes([t or "" for t in texts], "alnum")[0]
    vocab = (np.unique(codes), np.arange(len(np.unique(codes))), np.zeros(lm.VOCABULARY))
    seen = []
    monkeypatch.setattr(lm, "step", lambda p, square, ctx, y: seen.append(y))
    run = lm._train_batches(type("Held", (), {"value": (vocab, lm.pack(lm.initial()))}))
    assert sum(b.column(0)[0].as_py() for b in run([batch])) == len(codes)
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(lm.tokens(codes, vocab)))


def test_lm_prefers_text_in_order(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    m = lm.train(docs)
    uniform = spark.createDataFrame([(1, " ".join(f"z{i}q" for i in range(300)))], "doc_id long, text string")
    mean = lm.score(docs, m).agg(F.avg("mean_log_likelihood")).first()[0]
    assert mean > lm.score(uniform, m).first()["mean_log_likelihood"]
    assert mean > lm.score(docs, (m[0], lm.pack(lm.initial()))).agg(F.avg("mean_log_likelihood")).first()[0] + 0.3
    got = {r["doc_id"]: r for r in lm.score(odd, lm.train(odd)).collect()}
    assert got[3]["n_tokens"] == 0 and got[3]["log_likelihood"] == 0 and got[3]["mean_log_likelihood"] is None
    assert got[10]["n_tokens"] == 20000 and lm.score(none, lm.train(none)).count() == 0


# ---- 6 URLs
def test_url_rules_and_parsing(spark):
    ship_package(spark)
    rows = [(1, "HTTP://WWW.Example.COM/en/1?x", "www.example.com", "/en/1", "www.example.com/en/"),
            (2, "https://example.com", "example.com", "", None), (3, None, "", "", None), (4, "no host", "", "", None),
            (5, "a://b.example.com/en/9#t", "b.example.com", "/en/9", "example.com/en/"), (6, "x://net/es/", "net", "/es/", "net/es/"),
            (7, "h://xnet/es/1", "xnet", "/es/1", None), (None, "h://É.net/fr/", "É.net", "/fr/", "net/fr/")]
    d = spark.createDataFrame([(r[0], r[1], None, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in urls.judge(d, queries.URL_RULES).collect()}
    for i, _, host, path, rule in rows:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
    assert got[3]["verdict"] == "allow" and urls.judge(d.limit(0), queries.URL_RULES).count() == 0


def test_segmentation_is_the_cheapest_split():
    cost = {"ab": 2.0, "abc": 2.5, "cd": 1.0, "d": 9.0}
    assert urls.best_split("abcd", cost) == ["ab", "cd"] and urls.best_split("", cost) == []


def test_segmentation_uses_long_words(spark):
    long = ["internationalization", "x" * 61]
    pages = spark.createDataFrame([(f"<p>{long[0]} {long[1]} shop word</p>",)] * 3, "html string")
    labels = spark.createDataFrame([(f"{long[0]}shop",), (f"my{long[1]}",), (long[1],), ("a",)], "label string")
    got = {r["label"]: r["words"] for r in urls.segment(labels, urls.word_counts(pages)).collect()}
    assert got == {f"{long[0]}shop": [long[0], "shop"], f"my{long[1]}": ["m", "y", long[1]], long[1]: [long[1]], "a": ["a"]}


# ---- 7 top-k
def test_maxscore_equals_brute_force_with_ties(spark):
    ship_package(spark)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)).round(1)
    x[50:80] = x[50]
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 6), (1060, [float("inf")]), (None, [1.0] * 6), rows[7]]
    d = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<double>, block int")
    got = {}
    for r in topk.top_k(d, F.col("vec_id") % 20 == 0, k=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(64 * x).astype(int)
    assert set(got) == set(range(0, 300, 20))
    for q, hits in got.items():
        s = v @ v[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:20]
        assert sorted(hits) == [(k + 1, i, s[i]) for k, i in enumerate(best)]
    assert topk.top_k(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- 8 toxicity
def test_folding_and_held_out_quality(spark, odd, none):
    assert toxicity.fold_text("You 1d10t!! sсum L0SER").split() == ["you", "idiot", "scum", "ioser"]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lex = toxicity.fit(docs, labels)
    r = toxicity.score(docs, lex).join(labels.select("doc_id", "toxic"), "doc_id")
    assert r.filter("toxic = 0 and predicted = 1").count() == 0
    assert r.filter("toxic = 1 and predicted = 1").count() >= 0.7 * r.filter("toxic = 1").count()
    lab = spark.createDataFrame([(i, t, 0) for i, t in ((1, 1), (2, None), (3, 1), (4, 0), (None, 1))], "doc_id long, toxic int, quality int")
    got = toxicity.score(odd, toxicity.fit(odd, lab)).collect()
    assert len(got) == odd.count() and all(0 <= g["score"] <= 1 for g in got)
    assert all(g["score"] == 0 for g in toxicity.score(odd, toxicity.fit(odd, lab.limit(0))).collect())
    assert toxicity.score(none, lex).count() == 0


def test_exception_phrases_cancel():
    lex = toxicity.Lexicon({" moron": 5.0}, frozenset({("", " moron", "mountain")}), -3.0, 4.0, True)
    a = lex.automaton()
    assert toxicity.value(toxicity.fold_text("see moron mountain"), a, lex) == 0
    assert toxicity.value(toxicity.fold_text("see moron valley"), a, lex) > 0


# ---- 9 near-duplicates
def _brute(rows, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    changed |= comp[a] != low or comp[b] != low
                    comp[a] = comp[b] = low
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates_against_brute_force(spark, odd, none):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(400)]
    rows = []
    for g in range(8):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 150]))]
        for _ in range(9):
            t = list(text)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
               neardup.near_duplicates(d, percent=percent).collect()}
        assert got == _brute(rows, percent)
    got = neardup.near_duplicates(odd, percent=85).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() - 1 and by[2]["component_id"] == 1 and by[9]["component_id"] == 1
    assert by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[3]["kept"] and by[7]["n_shingles"] == 1
    assert neardup.near_duplicates(none).count() == 0


def test_pair_left_of_a_template_group_is_compared(spark):
    """The hub and the others of every group leave for their own shingles; the two that remain are near copies."""
    for percent, common, own, more in ((80, 94, 10, 24), (85, 124, 10, 22)):
        line = " ".join(f"t{i}" for i in range(common))
        rows = [(g, f"{line} " + " ".join(f"o{g}x{i}" for i in range(more if g < 40 else own))) for g in range(42)]
        d = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
               neardup.near_duplicates(d, percent=percent).collect()}
        assert got == _brute(rows, percent) and got[41][1] == 40


# ---- 10 personal data
def _base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    n = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(n(m)) <= 19 and pii.luhn(n(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(n(m)) <= 15]


def test_base_patterns_and_added_spans(spark, odd, none):
    rng = random.Random(3)
    for _ in range(5000):
        chars = rng.choice(["a@.b_1", "1234. +()-", "a.@-%é 1", "0123456789 -", "1.2345"])
        t = "".join(rng.choice(chars) for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == _base(t)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in pii.find(docs, pii.fit(docs)).join(docs, "doc_id").collect():
        base = pii._joined(_base(r["text"]))
        assert r["base"] == base and set(base.split(",")) <= set(r["spans"].split(",") + [""])
    got = {r["doc_id"]: r for r in pii.find(odd, pii.fit(odd)).collect()}
    assert (got[12]["n_email"], got[12]["n_ip"], got[12]["n_phone"]) == (1, 1, 1) and got[3]["spans"] == ""
    assert got[12]["masked"] == "mail <EMAIL> and <IP> and <PHONE>"
    assert pii.find(odd, pii.fit(none)).count() == odd.count() and pii.find(none, pii.fit(none)).count() == 0


def test_repeated_tokens_agree():
    """A skip link carries a sure label to an uncertain repeat far away."""
    k = len(pii.LABELS)
    m = pii.Model(np.zeros((pii.FEATURES, k)), np.zeros((k, k)), 3 * np.eye(k))
    m.unary[1, 4] = 8.0
    g = pii.Graph([(0, 1), (5, 6)], [[1], [2]], [], [(0, 1)], [False, False])
    p = pii.marginals(g, m)
    assert p[1].argmax() == 4 and p[1, 4] > 0.7


# ---- pipeline
def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in out.collect()}
    brute = {i for i, (_, c) in _brute([(r["doc_id"], r["text"]) for r in docs.collect()], 80).items() if c == i}
    leaks = {r["doc_id"] for r in decontam.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids == brute - leaks
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        got.collect()
        assert name == "encoding" or got.columns == odd.columns
    assert corpus_pipeline.near_dedup(spark, odd, SF).filter("doc_id = 1").count() == 1
