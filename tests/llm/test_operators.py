"""The ten operators: brute force on small inputs, and defined edge cases."""

from __future__ import annotations

import itertools
import json
import math
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigframe.llm import (ann, chat, covertree, jaccard, langid, mixing, packing, queries, segments, shingles, tokens,
                          toxicity, warc)
from sigframe.llm.bpe import Encoder
from sigframe.llm.common import components, scratch

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string, score int, toxic int"
LONG = " ".join(f"w{k % 977} x{k % 89}" for k in range(40_000))
ROWS = [
    (1, "The cat sat on the mat. It was a good mat, and the cat was glad.", "en", "b", 1, "t", 1, 1),
    (1, "The cat sat on the mat. It was a good mat, and the cat was glad.", "en", "b", 1, "t", 1, 1),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "t", 1, 1),
    (4, " \t\n ", "de", "", 3, "t", 1, 1),
    (None, "Der Hund lag auf dem Teppich und schlief den ganzen Tag lang.", "de", None, 9, "t", 2, 2),
    (5, LONG, None, "b", len(LONG), "t", 2, 2),
    (6, "!!! ... 123", "fr", "c", 11, "t", 2, 2),
    (7, "<|endoftext|>a  b 中文 <|endoftext|>", "fr", "c", 11, "t", 2, 2),
    (8, "THE CAT sat on the mat. It was a good mat, and the cat was glad.", "en", "c", 1, "t", 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# 1 ------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def _vectors(spark, n=240, dim=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[40:80] = x[40]  # copies
    x[80:120] = x[80] * (1 + np.arange(40, dtype=np.float32)[:, None])  # one direction
    x[120:160] = x[120] + 0.02 * rng.normal(size=(40, dim)).astype(np.float32)
    rows = [(k, [float(v) for v in r], 0, 1, "s") for k, r in enumerate(x)]
    rows[5] = (5, None, 0, 1, "s")
    rows[6] = (6, [0.0] * dim, 0, 1, "s")
    rows[7] = (7, [1.0, None, *[1.0] * (dim - 2)], 0, 1, "s")
    rows[8] = (8, [float("nan")] * dim, 0, 1, "s")
    rows[9] = (9, [float("inf")] * dim, 0, 1, "s")
    rows[10] = (10, [1.0, 2.0], 0, 1, "s")
    good = {k: np.array(r[1], dtype=np.float64) for k, r in enumerate(rows) if k not in (5, 6, 7, 8, 9, 10)}
    return spark.createDataFrame(rows, VECTORS), good


def _nearest(good, q, k):
    d = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)
    return d[:k]


def test_search_is_exact_at_factor_one_and_bounded_otherwise(spark):
    df, good = _vectors(spark)
    asked = df.where("vec_id % 10 = 0")
    got = ann.search(df, asked, k=5, shard_rows=100, query_rows=7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(by) == {q for q in good if q % 10 == 0}  # 10 has no candidate of its length
    hits = total = 0
    relaxed = ann.search(df, asked, k=5, factor=1.5, shard_rows=100, query_rows=7).groupBy("query_id").agg(
        F.collect_set("vec_id").alias("ids"))
    wide = {r["query_id"]: set(r["ids"]) for r in relaxed.collect()}
    for q, found in by.items():
        want = _nearest(good, q, 5)
        assert [i for _, i in found] == [i for _, i in want]
        assert np.allclose([s for s, _ in found], [s for s, _ in want], rtol=1e-12, atol=1e-12)
        hits += len(wide[q] & {i for _, i in want})
        total += 5
    assert hits >= 0.9 * total


def test_search_without_rows(spark):
    df, _ = _vectors(spark)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.where("vec_id = 6")).count() == 0


def test_repeated_queries_are_one_and_vectors_of_one_id_are_several(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)]
    points = spark.createDataFrame([*rows, (3, [3.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [0.0, 1.0])] * 10 + [(100, [20.2, 1.0])], "vec_id long, embedding array<double>")
    got = ann.search(points, asked.withColumn("key", F.lit(1)).withColumn("dim", F.lit(2)), k=5, shard_rows=8).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_key"], r["rank"])):
        by.setdefault(r["query_key"], []).append(r["vec_id"])
    assert sorted(by.values()) == [[1, 2, 3, 3, 4], [20, 21, 19, 22, 18]]


def test_search_scans_a_leaf_at_most_twice_and_measures_what_product_distances_cannot_tell(monkeypatch):
    rng = np.random.default_rng(3)
    calls = []
    scan = ann.Search.scan
    monkeypatch.setattr(ann.Search, "scan", lambda self, begin, end, who: calls.append(len(who)) or scan(self, begin, end, who))
    for x in (rng.normal(size=(1500, 40)), 1e3 + 1e-6 * rng.normal(size=(300, 5)), rng.integers(0, 3, (400, 4)).astype(float),
              rng.normal(size=(300, 6)) * 10.0 ** rng.integers(-160, 160, (300, 1))):
        ids, q = rng.permutation(len(x)), np.concatenate([x[:100], rng.normal(size=(20, x.shape[1]))])
        q_ids = np.concatenate([ids[:100], -np.arange(1, 21)])
        tree = ann.Tree(x)
        calls.clear()
        s = ann.Search(tree, ids, q, q_ids, 7, 1.0)
        leaves = (tree.nodes[:, 2] < 0).sum()
        assert len(calls) <= 2 * leaves and sum(calls) <= len(q) * leaves
        d = ann.distances(q, x)
        d[ids[None] == q_ids[:, None]] = np.inf
        want = np.array([np.lexsort((ids, row))[:7] for row in d])
        there = np.isfinite(s.d)
        assert (s.d == np.take_along_axis(d, want, 1)).all() and (s.i == ids[want])[there].all()


def test_search_sends_tiles_of_bounded_size(spark):
    rows = [(k, [float(k % 97), float(k % 89 + 1)]) for k in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.search(df, df, k=3, shard_rows=8, query_rows=16)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    good = {k: np.array(v) for k, v in rows}
    for q in range(0, 1200, 100):
        assert [i for _, i in sorted(got[q])] == [i for _, i in _nearest(good, q, 3)]
    assert len(got) == 1200


# 2 ------------------------------------------------------------------------------------------

def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _set(text, k=5):
    w = _words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _groups(docs, percent=80):
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: _set(t) for i, t in docs.items()}
    for a, b in itertools.combinations(sorted(docs), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}, {i: len(s) for i, s in sets.items()}


def test_shingles_equal_word_sets():
    texts = [r[1] for r in ROWS] + ["a b c d", "a b c d e", "A B C D E\x0bf", "é É ß a b", "x" * 3000]
    for t, s in zip(texts, shingles.shingle_sets(texts), strict=True):
        assert len(s) == len(_set(t))
    one, two = shingles.shingle_sets(["A b C d e F", "a B c D E f"])
    assert one.tolist() == two.tolist()


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(11)
    for n in [*range(1, 40), 63, 64, 65, 100, 127, 128, 250, 700]:
        for _ in range(6):
            a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            spare = (len(a) - 1) // 5 + 1
            for drop in range(0, spare + 1, max(1, spare // 4)):
                for add in {0, spare - drop}:
                    b = np.unique(np.concatenate([a[drop:], rng.integers(1, 1 << 62, max(0, add)).astype(np.uint64)]))
                    both = len(np.intersect1d(a, b))
                    if both and 100 * both >= 80 * (len(a) + len(b) - both):
                        assert set(segments.signatures(a, 80, 100).tolist()) & set(segments.signatures(b, 80, 100).tolist())


def test_run_out_sets_meet_by_deletion_or_empty_segments():
    """All pairs of small sets over few tokens: every linked pair shares a signature at 50 %."""
    rng = np.random.default_rng(5)
    universe = rng.integers(1, 1 << 62, 14).astype(np.uint64)
    sets = [np.unique(rng.choice(universe, size=rng.integers(1, 13), replace=False)) for _ in range(150)]
    signed = [set(segments.signatures(s, 50, 100).tolist()) for s in sets]
    for (a, x), (b, y) in itertools.combinations(zip(sets, signed, strict=True), 2):
        both = len(np.intersect1d(a, b))
        if 2 * both >= len(a) + len(b) - both:
            assert x & y


def test_join_equals_brute_force_with_dense_groups(spark):
    rng = np.random.default_rng(2)
    vocab = [f"v{k}" for k in range(5000)]
    docs, n = {}, 0
    for size in (3, 8, 30, 80):
        base = list(rng.choice(vocab, size))
        for _ in range(14):
            w = list(base)
            for _ in range(rng.integers(0, max(1, size // 12) + 1)):
                w[rng.integers(0, size)] = str(rng.choice(vocab))
            docs[n] = " ".join(w)
            n += 1
    passage = " ".join(rng.choice(vocab, 25))
    for _ in range(15):  # a shared passage alone does not link
        docs[n] = passage + " " + " ".join(rng.choice(vocab, 40))
        n += 1
    want, sizes = _groups(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: (sizes[i], want[i]) for i in docs}
    assert 1 < len(set(want.values())) < n
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("block", [3, 2048])
def test_join_by_blocks_and_by_signatures_loses_no_link(spark, monkeypatch, block):
    """Chains of texts that link only to their neighbours, around passages that all share; groups
    larger than a block are cut into pairs of blocks or into their signatures."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(31)
    docs = {}
    passage = [f"p{k}" for k in range(40)]
    for c in range(4):
        w = [f"c{c}w{k}" for k in range(120)]
        for step in range(12):
            docs[len(docs)] = " ".join(w + passage)
            for k in rng.choice(120, 2, replace=False):
                w[k] = f"c{c}s{step}x{k}"
    for k in range(25):
        docs[len(docs)] = " ".join([*passage, *(f"u{k}y{j}" for j in range(60))])
    want, sizes = _groups(docs)
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs.items()], "doc_id long, text string, _ng_th int, fp string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}
    assert got == {i: (sizes[i], want[i]) for i in docs}
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and {r["_ng_th"] for r in kept.collect()} == {7}
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_forest_has_fewer_rows_than_members_and_misses_no_link():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 40, 30)).astype(np.uint64) for _ in range(80)]
    fp, sigs = np.arange(80), [np.array([k % 3, 9], dtype=np.int64) for k in range(80)]
    links = jaccard._forest(fp, fp // 2, fp % 2, sigs, sets, True, 60, 100)
    assert len(links) < 40
    def close(edges):
        name = list(range(40))
        for a, b in edges:
            x, y = name[a // 2], name[b // 2]
            name = [min(x, y) if v in (x, y) else v for v in name]
        return name
    brute = [(a, b) for a, b in itertools.combinations(range(80), 2) if 100 * len(np.intersect1d(sets[a], sets[b]))
             >= 60 * len(np.union1d(sets[a], sets[b]))]
    assert set(links) <= set(brute) and close(links) == close(brute)
    across = jaccard._forest(fp, fp, fp % 2, sigs, sets, False, 60, 100)
    assert across and all((a + b) % 2 for a, b in across)


def test_join_refuses_shares_that_its_bands_cannot_serve(none):
    with pytest.raises(ValueError):
        jaccard.link(none, percent=49)


def test_join_edges(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd).collect()),
                 key=str)
    assert len(got) == len(ROWS)
    assert [g for g in got if g[0] == 1] == [(1, 12, 1)] * 2 and (8, 12, 1) in got
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4)} <= set(got)
    assert [g[2] for g in got if g[0] is None] == [None]
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 6, 7, None]
    assert jaccard.keep_one(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)] + [(100 + k, 99) for k in range(1, 30)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99} | {100 + k: 99 for k in range(1, 30)}


# 3 ------------------------------------------------------------------------------------------

def test_language_held_out_accuracy_and_edges(spark, odd, none):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held >= 0.95
    assert got.where("accepted").count() >= 0.98 * got.count()
    model = langid.fit(odd)
    assert set(model.dictionaries) == {"de", "en", "fr"}
    out = langid.identify(odd, model)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(odd.columns) <= set(out.columns)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {2, 3, 4, 6}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(none, model).count() == 0
    assert langid.fit(none).dictionaries == {}
    assert {r["lang_pred"] for r in langid.identify(odd, langid.Model({})).collect()} == {"und"}


# 4 ------------------------------------------------------------------------------------------

def test_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())
    want = sorted((i, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    got = tokens.token_counts(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert tokens.token_counts(none, PATH).count() == 0


def test_encoder_on_random_strings():
    rng = np.random.default_rng(1)
    enc = Encoder(PATH)
    parts = list(" \n\t\r\x0b\x1c 'abcé1²½_.!中 　😀s​") + ["<|endoftext|>", " the", " of", "'ll", "  "]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(0, 25)))
        want = enc.tok.encode(t, add_special_tokens=False).ids
        assert enc.ids(t).tolist() == want and enc.count(t) == len(want)
        direct, merged = enc.counts(t)
        assert direct + merged == len(want)


def test_every_character_of_the_short_path_is_cut_as_the_library_does():
    enc = Encoder(PATH)
    marks = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    for c in marks:
        for t in (c, f"a{c}b", f" {c}{c} 1{c}", f"{c} a", f"'{c}s", f"{c}'ll {c}"):
            assert enc.count(t) == len(enc.tok.encode(t, add_special_tokens=False).ids), (t, c)


def test_whole_strings_are_proved_and_used_in_every_script(spark):
    enc = Encoder(PATH)
    texts, names = enc.whole
    assert len(texts) == len(names) > 49_000
    for t in ("the", " the", " été", "123", "...", "\n\n", " и", "の", " 中"):
        n = len(enc.tok.encode(t, add_special_tokens=False).ids)
        assert (t in texts) == (n == 1), t
        assert enc.counts(t) == ((1, 0) if n == 1 else enc.counts(t)) and sum(enc.counts(t)) == n
    assert enc.counts("the same 中, and the same の.  \n\nthe end")[0] >= 9  # two spaces and other scripts
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and lang is not null").select("lang", "text")
    share = {}
    for r in rows.collect():
        d, m = enc.counts(r["text"])
        a, b = share.get(r["lang"], (0, 0))
        share[r["lang"]] = a + d, b + m
    assert len(share) >= 4 and all(d > 0.1 * (d + m) for d, m in share.values()), share


# 5 ------------------------------------------------------------------------------------------

def test_archives_round_trip(spark):
    body = "<html>" + "é" * 100 + "</html>"
    rows = [(3, "http://a/ x", body, "c"), (1, None, body, "c"), (2, "http://b", None, "c"), (4, "u", "", "c"),
            (5, "u", "short", "c"), (6, "u", "short", "c"), (None, "u", body, "c"),
            (7, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, "c"), (9, "u", body, "c"), (9, "u", body, "c"),
            (8, "u", "long " * 200_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, type string")
    path = f"{scratch(spark)}/archives-test"
    warc.write_archives(pages, path, archive_bytes=1 << 19)
    records = warc.read_records(spark, path)
    assert records.count() == 3 * len(rows)
    got = warc.assemble(records).collect()
    assert sum(r["copies"] for r in got) == len(rows)
    by = {r["metadata"]["fields"].get("pageId"): r for r in got}
    for page_id, url, html, _ in rows:
        r = by[None if page_id is None else str(page_id)]
        want = (html or "").encode()
        assert r["response"]["payload_bytes"] == len(want)
        assert r["response"]["type"] == ("revisit" if page_id in (3, 9) else "response")
        if r["response"]["type"] == "response":
            assert bytes(r["response"]["payload"]) == want
        else:
            assert r["response"]["refers_to"] == by["1"]["capture_id"]
        assert r["request"]["target_uri"] == (None if url is None else url.replace(" ", "%20"))
    empty = f"{scratch(spark)}/archives-empty"
    warc.write_archives(pages.limit(0), empty)
    assert warc.assemble(warc.read_records(spark, empty)).count() == 0


# 6 ------------------------------------------------------------------------------------------

def test_cover_tree_links_equal_brute_force(spark):
    df, good = _vectors(spark)
    df = df.union(df.where("vec_id = 41"))  # a repeated row
    ids = [*good, 41]
    x = np.array([good[i] / np.linalg.norm(good[i]) for i in ids])
    near = (x @ x.T) >= 0.9
    n = dict(zip(ids, (near.sum(axis=1) - 1).tolist(), strict=True))
    root = {i: i for i in good}
    for _ in range(len(ids)):
        new = {i: min(root[ids[j]] for j in np.flatnonzero(near[k])) for k, i in enumerate(ids)}
        if new == root:
            break
        root = new
    for rows, centres in ((37, 4), (4096, 128)):
        got = covertree.near_duplicates(df, 0.9, block_rows=rows, centres=centres, sample_rows=60).collect()
        assert len(got) == 241
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"]) == ((n[i], root[i]) if i in good else (0, i)), i
            assert r["kept"] == (i == r["component_id"])
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_links_lengths_that_the_sample_lacks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim, n in ((3, 60), (4, 9), (5, 8), (6, 7), (7, 200)):  # a sample of two classes has two of them at most
        x = rng.normal(size=(n, dim))
        x[1::2] = x[::2][:n // 2] + 1e-3 * rng.normal(size=(n // 2, dim))  # pairs that link without being equal
        rows += [(len(rows) + k, v) for k, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    links = [(i, j) for i, j in itertools.combinations(n, 2)
             if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.99]
    for i, j in links:
        n[i], n[j] = n[i] + 1, n[j] + 1
    for _ in links:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    for block_rows in (5, 4096):
        got = covertree.near_duplicates(df, 0.99, block_rows=block_rows, sample_rows=1).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (n[i], root[i]) for i in n}
    assert all(n[i] for i, v in rows[60:68])


# 7 ------------------------------------------------------------------------------------------

def _check_packing(spark, docs, window=2048, **how):
    enc = Encoder(PATH)
    got = packing.pack(docs, PATH, window=window, **how).toPandas()
    want = sorted(np.append(enc.ids(r["text"]), 1).tolist() for r in docs.collect())
    pieces = got.sort_values(["sequence_id", "offset"])
    for _, s in pieces.groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1].tolist()] and s["length"].sum() <= window
    for r in got.itertuples():
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    back = []
    for p in pieces.itertuples():  # a stream's pieces are in order
        if p.start == 0:
            back.append([])
        assert p.start == len(back[-1])
        back[-1] += list(p.ids)
        assert p.doc_tokens >= len(back[-1])
    assert sorted(back) == want
    return pieces


def test_packing_is_a_partition_with_little_padding(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    p = _check_packing(spark, docs, block_tokens=20_000)
    n, total = p["sequence_id"].nunique(), int(p["length"].sum())
    assert n * 2048 - total <= 0.03 * total + 2048
    _check_packing(spark, odd, window=64)
    _check_packing(spark, docs.limit(50), order_by=["doc_id"])
    assert packing.pack(none, PATH).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        docs = np.unique(np.append(rng.integers(1, n + 1, 4), n))
        sentences = np.unique(rng.integers(1, n + 1, 8))
        how = {"window": 16, "sentence_penalty": 2, "token_penalty": 5, "grid": 1}
        ends = packing.cut_points(n, docs, sentences, **how)

        def price(e):
            return 0 if e in docs or e == n else 2 if e in sentences else 5

        best = [0] + [10**9] * n
        for j in range(1, n + 1):
            best[j] = min(best[i] + 16 - (j - i) + price(j) for i in range(max(0, j - 16), j))
        sizes = np.diff([0, *ends])
        assert ends[-1] == n and sizes.max() <= 16
        assert sum(16 - int(s) + price(e) for s, e in zip(sizes, ends, strict=True)) == best[n]


# 8 ------------------------------------------------------------------------------------------

def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "add", '{"y": 2, "x": 1}', ["gone", None]), (1, 1, "b", "add", '{"x": "1"}', ["a", "a"]),
        (1, 2, "c", "add", "{", ["b", "a"]), (1, 3, "a", "add", "{}", []), (1, 3, "a", "add", "{}", []),
        (2, 0, "p", "add", '{"x": 1, "é": [1.5, true, null]}', ["q"]), (2, 1, "q", "other", "{}", ["p"]),
        (2, 2, None, "add", "{}", None), (None, None, "n", None, None, None), (3, 0, "nan", "add", '{"x": NaN}', None),
    ], "thread long, position long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, 5, "a", "three"), (1, 6, "a", None), (2, 9, "zz", "x"), (2, 9, None, "y")],
                                    "thread long, position long, call_id string, content string")
    schema = {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}}
    got = chat.link_calls(calls, results, {"add": schema}).collect()
    by = {}
    for r in got:
        by.setdefault((r["call_id"], r["status"]), []).append(r)
    assert sorted((k[0] or "", k[1], len(v)) for k, v in by.items()) == [
        ("", "nameless", 1), ("", "orphan", 1), ("a", "linked", 2), ("a", "repeated", 2), ("b", "unanswered", 1),
        ("c", "unanswered", 1), ("n", "unanswered", 1), ("nan", "unanswered", 1), ("p", "unanswered", 1),
        ("q", "unanswered", 1), ("zz", "orphan", 1)]
    level = {k[0]: v[0]["level"] for k, v in by.items() if k[1] in ("linked", "unanswered")}
    assert level == {"a": 0, "b": 1, "c": 2, "p": None, "q": None, "n": 0, "nan": 0}
    error = {k[0]: v[0]["error"] for k, v in by.items() if k[1] in ("linked", "unanswered")}
    assert error == {"a": None, "b": "$.x: not integer", "c": "not JSON", "p": None, "q": "unknown tool",
                     "n": "unknown tool", "nan": "not JSON"}
    texts = sorted(r["json"] for r in by["a", "linked"])
    assert texts[0].startswith('{"arguments":{"x":1,"y":2},"id":"a","level":0,"name":"add","needs":["gone",null],"result":')
    assert all(json.dumps(json.loads(r["json"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r["json"]
               for r in got)
    assert chat.link_calls(calls.limit(0), results.limit(0), {}).count() == 0


def test_levels_equal_longest_paths(spark):
    rng = np.random.default_rng(8)
    needs = {n: {n - 1} for n in range(1, 60)}  # a chain
    needs |= {n: set(rng.choice(n, size=int(rng.integers(1, 4))).tolist()) for n in range(60, 160)}
    needs |= {200: {202}, 201: {200}, 202: {201}, 203: {202, 5}, 204: {203}, 205: {205}, 206: {205}}  # cycles
    want: dict[int, int] = {0: 0}
    for n in range(1, 160):
        want[n] = 1 + max(want[m] for m in needs[n])
    calls = spark.createDataFrame([(str(n),) for n in [0, *needs]], "call_id string")
    edges = spark.createDataFrame([(str(n), str(m)) for n, ms in needs.items() for m in ms], "call_id string, needs string")
    got = {int(r["call_id"]): r["level"] for r in chat.levels(calls, edges).collect()}
    assert got == want


# 9 ------------------------------------------------------------------------------------------

def test_ordinal_regression_learns_grades():
    rng = np.random.default_rng(6)
    clean, bad = [f"good{k}" for k in range(300)], [f"vile{k}" for k in range(12)]
    rows = []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        ws = set(rng.choice(clean, 40)) | (set(rng.choice(bad, 3 * g - 1, replace=False)) if g else set())
        rows.append((ws, g))
    m = toxicity.fit_rows(rows[:600], bits=16)
    assert list(m.thresholds) == sorted(m.thresholds) and (m.weights >= 0).all()
    z = [sum(m.weights[toxicity.features(w, 16)].sum() for w in ws) for ws, _ in rows[600:]]
    p = toxicity._above(np.array(z), m.thresholds)
    grade = (p > 0.5).sum(axis=1)
    true = np.array([g for _, g in rows[600:]])
    assert (grade == true).mean() > 0.85 and np.corrcoef(p.sum(axis=1), true)[0, 1] > 0.95


def test_toxicity_held_out_and_edges(spark, odd, none):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = queries.op9_toxicity_severity(spark, d).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    n = {(r["toxic_is"], r["toxic"]): r["count"] for r in got.select(
        (labels["toxic"] > 0).alias("toxic_is"), "severity", F.col("toxic_prob").__ge__(0.5).alias("toxic")).groupBy(
        "toxic_is", "toxic").count().collect()}
    assert n[True, True] >= 0.9 * (n[True, True] + n.get((True, False), 0))
    assert n.get((False, True), 0) <= 0.03 * (n[False, False] + n.get((False, True), 0))
    model = toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    out = toxicity.score(odd, model)
    assert out.count() == len(ROWS) and not out.where("toxic or grade > 0").count()
    assert out.where("doc_id in (2, 3, 4) and severity = 0").count() == 3
    assert toxicity.score(none, model).count() == 0


# 10 -----------------------------------------------------------------------------------------

def test_targets_fill_by_weight(spark):
    sizes = {"a": 10.0, "b": 1000.0, "c": 30.0, None: 60.0}
    df = spark.createDataFrame([(s is None, s or "", int(v), 1) for s, v in sizes.items()],
                               "_nul boolean, _src string, source_size long, rows long")
    got = {None if r["_nul"] else r["_src"]: r["target"] for r in mixing.targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    weight = {"a": 3, "b": 1, "c": 2, None: 3}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(w for s, w in weight.items() if s not in full)
        over = [s for s in weight if s not in full and weight[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]
    assert got == pytest.approx({s: full.get(s, weight[s] * level) for s in weight})


def test_due_inverts_the_integral(spark):
    knots = mixing.CURRICULUM
    shares = [k / 50 for k in range(51)]
    df = spark.createDataFrame([(t, u) for t in range(3) for u in shares], "turn int, share double")
    for r in df.withColumn("t", mixing.due(F.col("share"), F.col("turn"), knots)).collect():
        xs = np.linspace(0, 1, 200_001)
        ws = np.interp(xs, *zip(*knots[r["turn"]], strict=True))
        upto = np.trapezoid(ws[xs <= r["t"] + 1e-12], xs[xs <= r["t"] + 1e-12]) / np.trapezoid(ws, xs)
        assert abs(upto - r["share"]) < 2e-5


def test_mix_edges_and_reruns(spark, odd, none):
    out = mixing.assign(odd)
    rows = out.collect()
    assert len(rows) == len(ROWS) and set(out.columns) == {*odd.columns, "size", "source_size", "taken", "position"}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1 and r["target"] <= 2 * r["source_size"]
        assert r["size"] == len(_words(next(x[1] for x in ROWS if x[0] == r["doc_id"])))
    taken = pd.DataFrame([("<null>" if r["source"] is None else r["source"], r["taken"], r["target"]) for r in rows], columns=["s", "n", "t"])
    for _, g in taken.groupby("s"):
        assert g["n"].sum() == math.floor(g["t"].iloc[0])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.assign(odd.repartition(5)).collect()))
    assert mixing.assign(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0
