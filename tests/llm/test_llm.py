"""The training-data operators against brute force, libraries and round trips, with odd rows of every kind."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from mktstream.llm import bpe, decontam, entry, exact_dedup, langid, license_scan, line_dedup, ngram_join, pii, quality, token_counts  # noqa: E402
from mktstream.llm.graph import components  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \t\n", "one", "One TWO three", "é ÉCOLE ß", "a line that is long\nb", "A Line that is long\n", "a line that is long\nb", "x " * 30_000, "Mit License, apache  license"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", None) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "a line that is long", "en", "s", 1)], SCHEMA).withColumn("id", F.lit("clash"))


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op1_ngram_join", "op3_exact_dedup", "op4_line_dedup"])
def test_native_queries_match_sql(spark, name, tmp_path):
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / "out"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TABLE want AS {entry.oracle_sql()[name]}")
    pick = ", ".join(sorted(r[0] for r in con.sql("DESCRIBE want").fetchall()))
    kinds = [dict(con.sql(f"SELECT column_name, column_type FROM (DESCRIBE {q})").fetchall()) for q in ("want", f"SELECT * FROM '{tmp_path}/out/*.parquet'")]
    assert kinds[0] == kinds[1]
    assert con.sql(f"SELECT count(*) FROM (SELECT {pick} FROM want EXCEPT ALL SELECT {pick} FROM '{tmp_path}/out/*.parquet')").fetchall() == [(0,)]


def plain_shingles(text, k):
    words = [w for w in re.split("[\x20\x09-\x0D]+", lower(text)) if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute_components(rows, rule):
    sets = {d: plain_shingles(t, rule.words) for d, t in rows}
    label = {d: d for d in sets}
    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if rule.den * len(x & y) >= rule.num * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {d: low if v == high else v for d, v in label.items()}
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("chunk", [512, 3])
def test_ngram_join_matches_brute_force(spark, chunk):
    rng, rule = random.Random(1), ngram_join.Rule(4, 85, 100)
    base = [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(4)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice("klmno")
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, "one two"), (103, "ONE two"), (104, "\t"), (105, "\x1c a\x85b \x0b\xc9 c"), (106, "\x1c A\x85b\t\xc9 c"), (107, "\x1c a\x85b \xe9 c")]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id bigint, text string"), rule, chunk=chunk).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, rule)


def test_ngram_join_of_odd_rows(spark, odd):
    got = ngram_join.similar(odd, ngram_join.Rule(4, 85, 100)).collect()
    assert len(got) == len(ODD) + 2
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (6, 8)} == {6: 6, 8: 6}
    assert ngram_join.similar(odd.limit(0), ngram_join.Rule(4, 85, 100)).count() == 0


def test_ngram_join_keeps_rows_of_one_identifier_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (3, b, 3), (3, c, 4), (None, a, 5), (4, None, 6), (4, None, 7)], "doc_id bigint, text string, set int")
    rule = ngram_join.Rule(5, 80, 100)
    assert sorted(r.set for r in ngram_join.without_near_copies(docs, rule).collect()) == [0, 2, 4, 5, 6, 7]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar(docs.where("doc_id is not null"), rule).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (3, 2), (3, 3), (4, 4), (4, 4)]


def test_ngram_join_of_large_blocks(spark):
    """A family dealt out in many chunks, sets of several sizes tied to it by common shingles, and two that meet in step 3."""
    rng, rule = random.Random(7), ngram_join.Rule(4, 85, 100)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join("x" + str(i) if k == i % 110 else w for k, w in enumerate(base))) for i in range(60)]
    for i in range(60, 80):
        cut = rng.randrange(40, 100)
        rows.append((i, " ".join(base[:cut] + [f"y{i}-{k}" for k in range(rng.randrange(3, 30))])))
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id bigint, text string"), rule, chunk=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, rule)


def test_ngram_join_ties_no_unlike_sets_by_a_short_one():
    """Unlike long sets that share a shingle with a short one make no block; those that link do, whatever the widths of their bitmaps."""
    rng, rule = np.random.default_rng(3), ngram_join.Rule(4, 85, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in [3, 20, *[1000 + i for i in range(40)], 130, 250, 2040]]
    unlike = len(sets)
    sets += [np.unique(np.concatenate([s[: len(s) * 96 // 100], rng.integers(0, 1 << 63, len(s) // 9, dtype=np.uint64)])) for s in sets[-3:] + sets[20:22]]
    rows = [(7, i, len(s), ngram_join.bitmap(s, ngram_join.bits_for(len(s))).tobytes()) for i, s in enumerate(sets)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["token", "sid", "n", "bits"])
    found = {tuple(sorted(e)) for b in ngram_join.candidate_pairs(rule)(iter([batch])) for e in zip(*[c.to_pylist() for c in b.columns])}
    assert found == {(unlike - 3, unlike), (unlike - 2, unlike + 1), (unlike - 1, unlike + 2), (20, unlike + 3), (21, unlike + 4)}
    assert len(rows[unlike - 2][3]) < len(rows[unlike + 1][3])


def test_ngram_join_in_rounds(spark, monkeypatch):
    """Postings with bitmaps, chunks that are compared and their texts go to the disk a share at a time; shares together are the whole."""
    asked, rounds = [], ngram_join.in_rounds
    monkeypatch.setattr(ngram_join, "in_rounds", lambda n, keys, of_share, label, *a, **b: asked.append(label) or rounds(3, keys, of_share, label, *a, **b))
    monkeypatch.setattr(ngram_join, "POSTING_BYTES", 1)
    monkeypatch.setattr(ngram_join, "POSTING_TIMES", 0)
    rng, rule = random.Random(8), ngram_join.Rule(4, 85, 100)
    base = [f"w{i}" for i in range(110)]
    rows = [(i, " ".join("x" + str(i) if k == i % 110 else w for k, w in enumerate(base))) for i in range(40)]
    rows += [(i, " ".join(base[: rng.randrange(60, 95)] + [f"y{i}-{k}" for k in range(rng.randrange(3, 30))])) for i in range(40, 70)]
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id bigint, text string"), rule, chunk=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, rule)
    assert {"pairs", "candidates"} <= set(asked)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    label = {x: x for e in edges for x in e}
    for a, b in edges * 80:
        label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: v for x, v in label.items() if x in got} and all(label[x] == x for x in label if x not in got)


def test_bpe_is_the_library(spark, odd):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCAB), bpe.ByteBpe.load(VOCAB)
    rng = random.Random(4)
    pieces = ["a", "B", " ", "\n", "é", "中", "😀", "'ll", "12", "_", "\x1c", "\x85", "　", "\0", "<|endoftext|>", "ing", "the"]
    for text in [t for _, t in documents()] + ["".join(rng.choices(pieces, k=rng.randrange(14))) for _ in range(3000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        data = own.encode(text)
        assert np.frombuffer(data, "<u4").tolist() == ids
        assert own.decode(data) == library.decode(ids, skip_special_tokens=False)
    got = bpe.encode_decode(odd, VOCAB).collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[3].decoded_sha256 == sha("one")
    ids = bpe.encode_decode(odd, VOCAB, digests=False)
    assert ids.where("not round_trip").count() == 0
    assert bpe.decode(ids.where("doc_id = 5"), VOCAB).first().text == ODD[5]


def test_exact_dedup_of_odd_rows(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "in"))
    for digest in (exact_dedup.sha256, lambda c: F.lit(b"same")):  # all digests collide: bytes decide
        got = exact_dedup.exact_dedup(spark, str(tmp_path / "in"), digest=digest).collect()
        assert len(got) == len(ODD) + 2 and sum(r.kept for r in got) == len({lower(t) for t in ODD} | {"a line that is long"})
        assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (6, 8)} == {(8, 2)}
        assert {(r.keep_id, r.group_size) for r in got if r.doc_id == 4} == {(4, 2)}
    odd.limit(0).write.parquet(str(tmp_path / "none"))
    assert exact_dedup.exact_dedup(spark, str(tmp_path / "none")).count() == 0


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    make([(1, "a"), (2, "b")])
    exact_dedup.exact_dedup(spark, str(tmp_path / "in"), str(tmp_path / "state")).collect()
    make([(3, "A"), (4, "c")])
    got = exact_dedup.exact_dedup(spark, str(tmp_path / "in"), str(tmp_path / "state")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_line_dedup_of_odd_rows(spark, odd):
    got = line_dedup.line_dedup(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_dropped"]
    rows = {r.doc_id: r for r in got.where("doc_id in (0, 6, 7, 8)").collect()}
    assert [(rows[i].text, rows[i].n_lines, rows[i].n_dropped) for i in (0, 6, 7, 8)] == [("", 1, 0), (ODD[6], 2, 0), ("", 2, 1), ("b", 2, 1)]
    assert got.where("doc_id is null").first().text == "a line that is long"
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0
    named = odd.withColumns({"n_lines": F.lit("mine"), "lost": F.lit(1), "gone_id": F.lit(2), "line_count": F.lit(3), "pos": F.lit(4)})
    kept = line_dedup.without_repeated_lines(named)
    assert kept.columns == named.columns and {r.n_lines for r in kept.collect()} == {"mine"}
    same = spark.createDataFrame([(1, "x\na shared line"), (1, "a shared line\ny"), (0, "A shared line"), (2, None), (2, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text, r.n_dropped) for r in line_dedup.line_dedup(same).collect()) == [(0, "A shared line", 0), (1, "x", 1), (1, "y", 1), (2, "", 0), (2, "", 0)]
    many = spark.createDataFrame([(1, "\n".join(f"line number {i}" for i in range(4000))), (2, "\n".join(f"line number {i}" for i in range(0, 8000, 2)))], "doc_id bigint, text string")
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(many).collect()} == {1: (4000, 0), 2: (4000, 2000)}


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup_matches_brute_force(spark, min_docs):
    rng = random.Random(11)
    pool = [" A line of the pool %d " % i for i in range(12)] + ["short", "", "Another line \x1c", "another LINE \x1c"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for i in range(40)]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    lost = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) >= min_docs}
    want = {i: "\n".join(x for x in t.split("\n") if lost.get(key(x), i) >= i) for i, t in rows}
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_docs=min_docs).collect()
    assert {r.doc_id: r.text for r in got} == want


def test_license_scan_matches_brute_force(spark, odd):
    rows = documents() + [(1000 + i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for d, t in rows:
        words = license_scan.words_of(t or "")
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r, at = got[d], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    text = "x Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction y"
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().labels == "mit"
    assert license_scan.license_scan(odd).count() == len(ODD) + 2
    assert license_scan.license_scan(odd.limit(0)).count() == 0


def test_license_labels_match_brute_force(spark):
    """Every template at every place, against texts made of templates with words changed, dropped and put between."""
    rng, rows = random.Random(9), []
    texts = [(label, license_scan.words_of(t)) for label, entries in license_scan.TEMPLATES.items() for t, _ in entries]
    for n in range(240):
        words = list(rng.choice(texts)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(["software", "other", "license", "the"])
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words)), "between")
        more = rng.choice(texts)[1] if rng.random() < 0.3 else []
        rows.append((n, " ".join(rng.choices(["the", "software", "is", "license", "word"], k=rng.randrange(9)) + words + ["and"] + more).upper()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = license_scan.RareTokenIndex(license_scan.idf_of(docs))
    got = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    for n, text in rows:
        words, best, labels = license_scan.words_of(text), 0.0, set()
        for t in index.templates:
            for s in range(len(words)):
                there = words[s : s + len(t.words)]
                score = round(sum(x for w, x, d in zip(t.words, t.weights, there) if w == d), 9)
                if words[s + t.at : s + t.at + len(t.phrase)] == t.phrase and score >= index.min_score:
                    best, labels = max(best, min(score, 1.0)), labels | {t.label}
        base = {label for p, label in license_scan.PHRASES.items() if any(words[i : i + len(p.split())] == p.split() for i in range(len(words)))}
        assert got[n].labels == ",".join(sorted(labels | base)), n
        assert abs(got[n].score - (1.0 if base else best)) < 1e-6, n
    assert len({r.labels for r in got.values()}) > 8


def test_token_counts_match_greedy_search(spark, odd):
    vocab = {s for s in bpe.ByteBpe.load(VOCAB).strings if s != b"<|endoftext|>"}

    def greedy(w):
        n = 0
        while w:
            w, n = w[next(k for k in range(len(w), 0, -1) if w[:k] in vocab) :], n + 1
        return n

    got = {r.doc_id: r for r in token_counts.token_counts(spark.read.parquet(f"{SF}/documents.parquet"), VOCAB).collect()}
    for d, t in documents()[:60]:
        words = (t or "").encode().split()
        assert (got[d].n_words, got[d].n_tokens) == (len(words), sum(greedy(b" " + w) for w in words))
    pieces = {b" a", b" ab", b"b", b"bc", b" abcd", b"c", b"d", b"x", b" "}
    few = token_counts.PieceCounter(pieces)

    def longest(w):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in pieces), 0)
            if not k:
                return 1
            w, n = w[k:], n + 1
        return n

    rng = random.Random(13)
    for _ in range(2000):
        word = b" " + bytes(rng.choices(b"abcdx?", weights=[5, 5, 5, 5, 3, 1], k=rng.randrange(1, 9)))
        assert few.count(word) == longest(word), word
    rows = token_counts.token_counts(odd, VOCAB).collect()
    assert len(rows) == len(ODD) + 2 and [(r.n_words, r.n_tokens) for r in rows[:3]] == [(0, 0)] * 3
    assert token_counts.token_counts(odd.limit(0), VOCAB).count() == 0 == bpe.encode_decode(odd.limit(0), VOCAB).count()


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 1
    rated = quality.quality(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good, bad = [r.keep for r in rated if r.quality == 1], [r.keep for r in rated if r.quality == 0]
    assert len(bad) > 50 and np.mean(good) > 0.99 and np.mean(bad) < 0.1


def test_quality_of_odd_rows(spark, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert quality.quality(odd, labels).count() == len(ODD) + 2
    assert quality.quality(odd, labels.limit(0)).where("p_quality is null").count() == 0
    assert quality.quality(odd.limit(0), labels).count() == 0 == quality.keep_good(odd.limit(0), labels).count()
    named = odd.withColumns({"bins": F.lit(1), "p_site": F.lit("mine"), "p_quality": F.lit(2), "host": F.lit(3), "__bins": F.lit(4), "hk": F.lit(5), "quality": F.lit(6)})
    kept = quality.keep_good(named, labels, threshold=0.0)
    assert kept.columns == named.columns and kept.count() == len(ODD) + 2 and {r.p_site for r in kept.collect()} == {"mine"}


def test_quality_matches_brute_force(spark):
    """Posteriors of hosts and paths, from the same classifier, document by document."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choices(["word", "Another", "1234", "!!!", "word word"], k=rng.randrange(1, 60)))
    rows = [(i, text(), f"https://www.Host{i % 5}.com/p{i % 3}/x" if i % 7 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, url string")
    labels = spark.createDataFrame([(i, int("!!!" not in rows[i][1])) for i in range(0, 120, 2)], "doc_id bigint, quality int")
    keys = quality.Keys(url="url")
    bins, n = quality.binned(docs, "doc_id", "text", keys)
    model = quality.fit(bins, n, labels)
    sig = lambda x: 1 / (1 + np.exp(-x))
    e = {i: sum(model.log_odds[f][b] for f, b in enumerate(quality.features(t))) for i, t, _ in rows}
    first = {i: sig(x + quality._logit(model.prior)) for i, x in e.items()}  # prior: the rate of all
    site = {i: (f"host{i % 5}.com", f"p{i % 3}") if u else ("", "") for i, _, u in rows}
    got = {r.doc_id: r for r in quality.quality(docs, labels, keys=keys).collect()}
    prior = model.prior
    for i, _, _ in rows:
        others = [j for j in site if j != i and site[j][0] == site[i][0]]
        own = [j for j in others if site[j] == site[i]]
        h = (sum(first[j] for j in others) + model.host_strength * prior) / (len(others) + model.host_strength)
        p = (sum(first[j] for j in own) + model.path_strength * h) / (len(own) + model.path_strength)
        assert abs(got[i].p_site - p) < 0.05, i
        assert abs(got[i].p_quality - sig(e[i] + np.log(got[i].p_site / (1 - got[i].p_site)))) < 1e-9


def test_hosts_and_paths_of_urls(spark):
    urls = ["https://www.Example.com:80/En/x?y", "http://u@a.org", "//b.net/c/", "HTTP://d.de/f", None, "nothing", "https://e.io?q=/x/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", quality.host_of(F.col("url")).alias("h"), quality.path_of(F.col("url")).alias("p")).orderBy("i").collect()
    assert [(r.h, r.p) for r in rows] == [("example.com", "En"), ("a.org", ""), ("b.net", "c"), ("d.de", ""), (None, None), ("", ""), ("e.io", "")]


def test_quality_draws_both_classes(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 40)
    bins = spark.createDataFrame([(i, [int(i < 3)] * quality.N_FEATURES) for i in range(2000)], "id bigint, bins array<int>")
    labels = spark.createDataFrame([(i, int(i >= 3)) for i in range(2000)], "doc_id bigint, quality int")
    log_odds, prior = quality.classifier(bins, labels)
    assert all(row[0] > 0 > row[1] for row in log_odds) and prior > 0.99


def test_decontamination_finds_planted_passages(spark, odd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)] + [(9, "Two Words"), (10, None)]
    docs = []
    for i in range(40):
        words = [word() for _ in range(200)]
        if i < 5:
            words[50:50] = items[i][1].split()
        elif i < 10:
            passage = items[i - 5][1].upper().split()
            for k in (4, 11, 19, 25):
                passage[k] = "other"
            words[50:50] = passage
        elif i == 10:
            words += ["two", "words,"]
        docs.append((i, " ".join(words)))
    got = decontam.contaminations(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i % 5) for i in range(10)} | {(10, 9)}
    assert all(r.first_word == 50 for r in got if r.doc_id < 5)
    assert decontam.without_benchmark(odd, spark.createDataFrame(items, "item_id bigint, text string")).count() == len(ODD) + 2
    assert decontam.contaminations(odd, spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_decontamination_finds_every_pattern_of_substitutions(spark):
    items, docs = [], []
    for n, m in [*((n, n - decontam.least_equal(n)) for n in range(1, 13)), (13, 2), (14, 2), (15, 3), (16, 3), (20, 4)]:
        words = [f"w{n}i{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for places in itertools.combinations(range(n) if n < 13 else range(1, n - 1), m):
            docs.append((len(docs), n, " ".join(["before", *("other" if k in places else w for k, w in enumerate(words)), "after"])))
        if n < 13:  # one more substitution is too many
            docs.append((len(docs), None, " ".join(["before", *words[m + 1 :], "after"])))
    got = decontam.contaminations(spark.createDataFrame(docs, "doc_id bigint, n bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, n) for d, n, _ in docs if n}
    assert all((r.first_word, r.n_words) == (1, r.item_id) for r in got)


def brute_overlaps(text, item):
    """The longest overlap of a text with an item, over all diagonals and all runs."""
    h, w, best = decontam.word_hashes(text), decontam.word_hashes(item), (0, 0)
    for first in range(-len(w), len(h)):
        a, b = max(0, -first), min(len(w), len(h) - first)
        same = [h[first + k] == w[k] for k in range(a, b)]
        if len(w) < decontam.MIN_WORDS:
            if w.size and len(same) == len(w) and sum(same) >= decontam.least_equal(len(w)):
                best = max(best, (len(w), sum(same)))
            continue
        for i in range(len(same)):
            for j in range(i + decontam.MIN_WORDS - 1, len(same)):
                if same[i] and same[j] and sum(same[i : j + 1]) >= decontam.MIN_SHARE * (j - i + 1) - 1e-9:
                    best = max(best, (j - i + 1, sum(same[i : j + 1])))
    return best


@pytest.mark.parametrize("block_words", [2_000_000, 40])
def test_decontamination_matches_brute_force(spark, odd, monkeypatch, block_words):
    """Random overlaps with substitutions, few words so that seeds hit by chance, and repetitive texts; in one block and in many."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontam, "OFTEN", 3)
    rng = random.Random(21)
    items = [(i, " ".join(rng.choices(["a", "b", "cc", "d"] if i % 2 else [f"w{k}" for k in range(30)], k=rng.choice([1, 3, 6, 12, 13, 16, 25])))) for i in range(14)]
    items += [(20, "na " * 30), (21, "na na no " * 9), (22, None), (23, "...")]
    docs = []
    for i in range(40):
        words = rng.choices(["a", "b", "cc", "d", "na", "no"] if i % 3 else [f"w{k}" for k in range(30)], k=rng.randrange(0, 40))
        item = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            if item:
                item[rng.randrange(len(item))] = "other"
        docs.append((i, " ".join(words + item + words[:5])))
    got = decontam.contaminations(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    want = {(d, i): best for d, t in docs for i, x in items if x and (best := brute_overlaps(t, x)) != (0, 0)}
    assert {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in got} == want and len(want) > 40
    hit = {d for d, _ in want}
    kept = decontam.without_benchmark(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - hit
    assert decontam.without_benchmark(odd.limit(0), spark.createDataFrame(items, "item_id int, text string")).count() == 0


def test_decontamination_of_repetitive_texts_is_quick():
    import time

    own, began = decontam.Benchmark([(1, "same " * 1000)]), time.perf_counter()
    assert own.overlaps(["same " * 20_000])[0][0][1:] == (1000, 1000)
    assert time.perf_counter() - began < 20
    rng = np.random.default_rng(1)
    a, b = np.unique(rng.integers(0, 3000, 900)), np.unique(rng.integers(0, 2000, 700))
    assert decontam.distances(a, b).tolist() == np.unique(a[:, None] - b).tolist()


def test_decontamination_masks_miss_no_overlap_of_any_length():
    """Of all strings that no mask hits, by their last places, the best balance of 1 an equal word and -4 another one."""
    span = max(map(len, decontam.MASKS))
    masks = [(len(m), int(m, 2)) for m in decontam.MASKS]
    states = np.arange(1 << span)
    free = np.all([states & m != m for _, m in masks], axis=0)
    best = np.full(1 << span, -(10**9))
    best[1] = 1
    for n in range(2, 301):
        step = np.full(1 << span, -(10**9))
        for bit, gain in ((0, -4), (1, 1)):
            np.maximum.at(step, (states << 1 | bit) & ((1 << span) - 1), best + gain)
        best = np.where(free, step, -(10**9))
        assert n < decontam.MIN_WORDS or best[1::2].max() < 0, n


def test_pii_surrogates(spark, odd):
    s = pii.Surrogates(b"key")
    text = "Mail anna.b.12@mail3.example.com or +1 (626) 555-5759, card 4652288524086166, 39.104.242.48; Frau Anna Huber, again anna.b.12@mail3.example.com"
    new, kinds = pii.scrub(text, s)
    assert kinds == ["email", "phone", "card", "ipv4", "name", "email"]
    assert not any(v in new for v in ("anna.b.12", "555-5759", "4652288524086166", "39.104.242.48", "Huber"))
    assert new.count(re.search(r"\S+@\S+", new)[0]) == 2 and len(new) >= len(text) - 12
    assert pii.luhn(re.search(r"card (\d+)", new)[1])
    rows = pii.pii_surrogates(odd, b"key").collect()
    assert [r.text for r in rows[:11]] == ODD and rows[0].n_entities == 0
    assert pii.pii_surrogates(odd.limit(0), b"key").count() == 0


@pytest.mark.parametrize(("alphabet", "length"), [(pii.DIGITS, 1), (pii.DIGITS, 2), (pii.DIGITS, 4), (pii.LATIN, 1), (pii.LATIN, 3), (pii.GREEK, 2), (pii.CYRILLIC, 3)])
def test_replacement_is_a_bijection_without_fixed_points(alphabet, length):
    keyed = pii.Keyed(b"another key")
    values = ["".join(v) for v in itertools.product(alphabet, repeat=length)]
    out = [keyed.letters(v, alphabet, "t") for v in values]
    assert sorted(out) == sorted(values) and not any(a == b for a, b in zip(values, out))


def entities_of(kind, rng):
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n, a=pii.LATIN: "".join(rng.choices(a, k=n))
    if kind == "card":
        body = digits(15)
        return body + next(c for c in "0123456789" if pii.luhn(body + c))
    if kind == "iban":
        body = digits(18)
        return f"DE{pii.iban_check('DE', body):02}{body}"
    script = rng.choice([pii.LATIN, pii.GREEK, pii.CYRILLIC, "\u738b\u5c0f\u660e\u674e\u56db\u5f20\u4e09", "\u00e9\u00e8\u00fc\u00f1\u00e5a"])
    return {
        "email": lambda: f"{rng.choice([letters(5), letters(3, script), digits(4), '_'])}@{letters(6)}.com", "ipv4": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+49 30 {digits(7)}", "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "aws_key": lambda: "AKIA" + "".join(rng.choices(pii.BASE32, k=16)),
        "secret": lambda: rng.choice([letters(12), digits(9), "________", "0f" * 8]), "name": lambda: letters(rng.randrange(2, 8), script).capitalize(),
    }[kind]()


@pytest.mark.parametrize("kind", ["email", "ipv4", "card", "ssn", "phone", "iban", "aws_key", "secret", "name"])
def test_surrogates_leak_nothing_and_never_collide(kind):
    """Over many documents: no original stays, each has one surrogate, different ones different ones, check digits fit, scripts stay."""
    rng, s = random.Random(kind), pii.Surrogates(b"key")
    values = {entities_of(kind, rng) for _ in range(1500)} | (set(sum(pii.GIVEN.values(), ())) if kind == "name" else set())
    made = {v: s.make(kind, v) for v in sorted(values)}
    assert not [v for v, n in made.items() if v == n] and len(set(made.values())) == len(made)
    assert made == {v: pii.Surrogates(b"key").make(kind, v) for v in values}
    if kind == "card":
        assert all(pii.luhn(n) for n in made.values())
    if kind == "iban":
        assert all(int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1 and n[:2] == "DE" for n in made.values())
    if kind == "name":
        script = lambda t: {pii.script_of(c) for c in t if c.isalpha()}
        assert all(script(v) == script(n) for v, n in made.items())
        assert all(made[n] in names for names in pii.GIVEN.values() for n in names)


def test_surrogates_are_the_same_in_every_document():
    s = pii.Surrogates(b"key")
    alone, beside = pii.scrub("Dr Mary came", s)[0].split()[1], pii.scrub("Dr Karin and Dr Mary", s)[0].split()[-1]
    assert alone == beside != "Mary"
    new, kinds = pii.scrub("Dr \u738b\u5c0f\u660e, \u0438\u0432\u0430\u043d@\u043f\u043e\u0447\u0442\u0430.example.com, password: ________ and jos\u00e9@x.org", s)
    assert kinds == ["name", "email", "secret", "email"]
    assert not any(v in new for v in ("\u738b\u5c0f\u660e", "\u0438\u0432\u0430\u043d", "\u043f\u043e\u0447\u0442\u0430", "____", "\u00e9"))


def test_pii_surrogates_of_every_mention_script_and_phone_form():
    s = pii.Surrogates(b"key")
    new, kinds = pii.scrub("Before, Smith came. Mr James Smith spoke; Smith said, and James SMITH too. Smithy stays.", s)
    surname = re.search("Before, (.+) came", new)[1]
    assert "James" not in new and "SMITH" not in new and not re.search(r"\bSmith\b", new) and kinds == ["name"] * 4
    assert new.count(surname) == 3 and surname.upper() in new and new.endswith("Smithy stays.")
    new, _ = pii.scrub("Dr Anna Huber and Frau Huber", s)
    assert new.split()[2] == new.split()[5] != "Huber"
    for name in ("王伟", "محمد", "दिनेश", "כהן", "김철수", "Éé"):
        new, kinds = pii.scrub(f"Dr {name}, {name}", s)
        assert name not in new and kinds == ["name", "name"], name
    assert "王伟" not in pii.scrub("Dr 王伟, 那么王伟说", s)[0]
    assert "王伟@" not in pii.scrub("王伟@example.com", s)[0]
    for phone, country in {"+33 1 23 45 67 89": "+33", "+49 30 12345678": "+49", "+34 612 34 56 78": "+34", "+16265555759": "+1", "+4915112345678": "+49", "030 12345678": "0", "01 23 45 67 89": "0", "612 34 56 78": "", "0612345678": "0", "0033 1 23 45 67 89": "0033"}.items():
        new, kinds = pii.scrub(f"Call {phone}, or not", s)
        got = new[5:-8]
        assert kinds == ["phone"] and got != phone and re.sub(r"\d", "1", got) == re.sub(r"\d", "1", phone) and got.startswith(country), (phone, new)
        digits = lambda t: re.sub(r"\D", "", t[len(country) :])
        assert sum(a == b for a, b in zip(digits(got), digits(phone))) < len(digits(phone)) - 2
    assert pii.scrub("In 2024 12 of 1500 paid 3.50 on 01.02.2024 at 10:30", s)[1] == []


def test_language_id_on_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out("doc_id")))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    rows = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(odd, langid.train(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def naive_language(model, text):
    """The mixture of one text, window by window and language by language."""
    x = model.windows(text)
    k, n = x.shape[1], len(x)

    def fit(langs):
        share = {j: 1 / len(langs) for j in langs}
        like = [{j: np.exp(row[j] - row.max()) for j in langs} for row in x]
        for _ in range(langid.ROUNDS):
            total = dict.fromkeys(langs, 0.0)
            for row in like:
                z = sum(share[j] * row[j] for j in langs)
                for j in langs:
                    total[j] += share[j] * row[j] / max(z, 1e-300)
            share = {j: v / n for j, v in total.items()}
        return share, sum(np.log(max(sum(share[j] * row[j] for j in langs), 1e-300)) + r.max() for row, r in zip(like, x))

    shares, _ = fit(list(range(k)))
    order, best = sorted(range(k), key=lambda j: (-shares[j], j)), (-np.inf, None, 0.0)
    for m in range(1, k + 1):
        share, value = fit(order[:m])
        value -= langid.PENALTY * m * np.log(1 + n)
        if value <= best[0]:
            break
        lead = max(sorted(share), key=lambda j: share[j])
        best = (value, lead, share[lead])
    return model.languages[best[1]], best[2]


def test_language_id_matches_brute_force(spark):
    """Texts of one language and of up to six, by a model of seven."""
    rng = random.Random(4)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{i}": ["".join(rng.choices(alphabet[i * 3 : i * 3 + 8], k=rng.randrange(3, 8))) for _ in range(60)] for i in range(7)}
    say = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    model = langid.train(spark.createDataFrame([(say(lang, 300), lang) for lang in words for _ in range(3)], "text string, lang string"))
    texts = [" ".join(say(lang, rng.randrange(60, 90)) for lang in rng.sample(sorted(words), m)) for m in (1, 1, 2, 3, 5, 6) for _ in range(2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.identify(rows, model).collect()}
    for i, text in enumerate(texts):
        lang, score = naive_language(model, text)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-6, i
    assert got[11].score < 0.25  # six languages, each with its own share
    assert langid.identify(rows.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where("not round_trip").count() == 0


def test_pipeline_stages_of_odd_rows(spark, odd):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and an empty table."""
    import corpus_pipeline

    clash = odd.withColumns({n: F.lit(n) for n in ("bins", "host", "set", "lost", "sid", "node", "label", "n_lines", "p_site", "__lost", "item_id", "quality")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, SF)
        assert out.columns == clash.columns, name
        assert out.where("doc_id is null").count() == (1 if name != "quality classifier" else out.where("doc_id is null").count()), name
        assert {r.bins for r in out.collect()} <= {"bins"} and stage(spark, clash.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash, SF).count() == len(ODD) + 2


def test_pipeline_matches_its_stages_by_brute_force(spark):
    """The last three decisions on the whole table: near copies by plain sets, benchmark passages by all diagonals of shared words."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    label = brute_components(rows, corpus_pipeline.NEAR)
    keep = {d for d, _ in rows if label[d][1] == d}
    assert {r.doc_id for r in corpus_pipeline.near_copy_stage(spark, docs, SF).collect()} == keep
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {g for x in items for w in [decontam.word_hashes(x).tolist()] for g in zip(w, w[1:], w[2:])}
    clean = {d for d, t in rows for w in [decontam.word_hashes(t or "").tolist()] if not known & set(zip(w, w[1:], w[2:])) and len(set(w)) > 3}
    left = {r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, SF).collect()}
    assert clean <= left
    whole = {d for d, t in rows for x in items if len(x.split()) >= 13 and x in (t or "")}
    assert whole and not whole & left
