"""Operators 11 to 13: brute force on small inputs, and defined edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigframe.llm import linededup, prefixtrie, queries, vafile

# 11 -----------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, end string, node string, n int, hs int"


def _turns(seed=1, convs=90):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(convs):
        kind = c % 9
        n = 0 if kind == 8 else int(rng.integers(1, 14)) if kind else 70 + c % 3
        same = int(rng.integers(0, 3))
        for t in range(n):
            text = "x" * (t % 5) if kind == 0 and t < 60 else "ab"[int(rng.integers(2))] if same else "a"
            out.append((c, t, ["user", "assistant"][t % 2], text))
    out += [(7, None, None, None), (7, None, None, None), (12, 3, "user", "tie"), (12, 3, "user", "tie"), (None, 0, "user", "lost"),
            (-3, 0, "user", "é"), (-3, 1, None, ""), (10**15, 5, "user", "中文 text"), (10**15 + 1, 5, "user", "a\nb")]
    return [(*r, "e", "n", 1, 2) for r in out]


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def _nodes_of(conv):
    members, ends = defaultdict(set), defaultdict(set)
    for c, ts in conv.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
        ends[tuple(ts)].add(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            if p:
                saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode())
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()),
                  key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_equals_brute_force(spark):
    rows = _turns()
    seqs = prefixtrie.rebuild(prefixtrie.sequences(spark.createDataFrame(rows, TURNS)))
    got = sorted((tuple(r) for r in prefixtrie.nodes(seqs).select(*COLUMNS).collect()), key=str)
    assert got == _nodes_of(_rebuilt(rows))


def test_trie_turnless_only_and_empty(spark):
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    one = spark.createDataFrame([(c, 0, "user", "gone", "", "", 0, 0)], TURNS)
    got = prefixtrie.nodes(prefixtrie.rebuild(prefixtrie.sequences(one))).select(*COLUMNS).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    none = spark.createDataFrame([], TURNS)
    assert prefixtrie.nodes(prefixtrie.rebuild(prefixtrie.sequences(none))).collect() == []


def test_trie_locates_every_conversation_at_its_longest_shared_prefix(spark):
    """Half the conversations in the trie; the others' exit depths by fat binary search."""
    rows = _turns(3)
    entries = prefixtrie.paths(prefixtrie.sequences(spark.createDataFrame(rows, TURNS))).dropDuplicates(["end"])
    even = entries.where(F.col("conv_id") % 2 == 0)
    odd = entries.where(F.col("conv_id") % 2 != 0)
    known = {h for r in even.collect() for h in r["hs"]}
    trie = prefixtrie.build(even).df
    found = prefixtrie.locate(odd.select("end", "n", "hs", "cum"), trie, 7).collect()
    assert len(found) == odd.count()
    for r in found:
        assert r["l"] == sum(h in known for h in r["hs"])
    # compacted: no node but the root has a single child unless a conversation ends there
    nodes = trie.collect()
    kids = defaultdict(int)
    for n in nodes:
        kids[n["par"]] += 1
    ends = {r["end"] for r in even.select("end").collect()}
    assert all(kids[n["ext"]] != 1 or n["ext"] in ends for n in nodes if n["hi"])
    assert sum(len(n["edge"]) for n in nodes) == len(known)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 70) for b in range(a + 1, 70)]
    got = spark.createDataFrame(pairs, "a int, b int").select(
        "a", "b", prefixtrie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_member_lists_over_several_chunks(spark):
    ids = [-9000, -1, 0, 5, 8191, 8192, 20000, 10**12]
    got = prefixtrie.members_sha256(spark.createDataFrame([(b"a", i) for i in ids[::-1]] + [(b"b", 3)], "end binary, conv_id long"))
    want = {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"3").hexdigest()}
    assert {bytes(r["end"]): r["sha"] for r in got.collect()} == want


# 12 -----------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, cluster string, cells int, k0 int"


def _vectors(n=300, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 64)) * 0.3
    x = (centres[rng.integers(9, size=n)] + 0.05 * rng.normal(size=(n, 64))).astype(np.float32)
    x[50:90] = x[min(50, n - 1)]
    rows = [(i, [float(v) for v in x[i]], "c", 1, 2) for i in range(n)]
    rows += [rows[3], rows[3], (900, None, "", 0, 0), (901, [1.0] * 63, "", 0, 0), (902, [float("nan")] + [0.0] * 63, "", 0, 0),
             (903, [None] + [0.0] * 63, "", 0, 0), (904, [float("inf")] + [0.0] * 63, "", 0, 0), (None, [0.5] * 64, "", 0, 0)]
    return rows


def _plain(rows, k=16, rounds=3):
    """The contract, row by row."""
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v, *_ in rows
            if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist())
    cents = [g for _, g in sorted(kept, key=key)[:k]]
    for r in range(rounds + 1):
        at = [min(range(len(cents)), key=lambda c: (int(((g - cents[c]) ** 2).sum()), c)) for _, g in kept]
        if r < rounds:
            for c in range(len(cents)):
                own = [g for (_, g), a in zip(kept, at) if a == c]
                if own:
                    cents[c] = sum(own) // len(own)
    dist = [int(((g - cents[a]) ** 2).sum()) for (_, g), a in zip(kept, at)]
    per = defaultdict(int)
    for a, d in zip(at, dist):
        per[a] += d
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in cents]
    return sorted(((i, a, d, per[a], sum(dist), sha[a]) for (i, _), a, d in zip(kept, at, dist)), key=str)


CLUSTERS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("n,bits", [(300, 6), (300, 2), (5, 4)])
def test_va_file_equals_plain_rounds(spark, n, bits):
    rows = _vectors(n)
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    out = vafile.cluster(spark.createDataFrame(rows, VECTORS), ["vec_id"], seed_key=seed, bits=bits).select(*CLUSTERS)
    assert sorted((tuple(r) for r in out.collect()), key=str) == _plain(rows)


def test_va_file_keeps_columns_and_handles_empty_tables(spark):
    rows = _vectors(40)
    out = vafile.cluster(spark.createDataFrame(rows, VECTORS), ["vec_id", "cells", "k0", "cluster"], k=3)
    assert out.columns == ["vec_id", "cells", "k0", *CLUSTERS[1:]]
    assert out.select("cells", "k0").distinct().count() == 2
    none = vafile.cluster(spark.createDataFrame([], VECTORS), ["vec_id"], k=3)
    assert none.columns == CLUSTERS and none.collect() == []
    unfit = vafile.cluster(spark.createDataFrame(rows[-5:-1], VECTORS), ["vec_id"], k=3)
    assert unfit.collect() == []


def test_va_file_refuses_components_whose_distances_do_not_fit(spark):
    big = spark.createDataFrame([(1, [1e9] * 64, "", 0, 0)], VECTORS)
    with pytest.raises(ValueError, match="would not fit"):
        vafile.cluster(big, ["vec_id"], k=1)


def test_cells_bound_every_distance_and_settle_most_rows():
    rng = np.random.default_rng(5)
    centres = rng.integers(-30, 30, size=(16, 64))
    grid = centres[rng.integers(16, size=2000)] + rng.integers(-2, 3, size=(2000, 64))
    borders = vafile.Cells(grid[:500], grid.min(axis=0), grid.max(axis=0), 5)
    cells = borders.encode(grid)
    packed = pa.array(vafile.pack_cells(cells, 5), pa.binary())
    assert (vafile.unpack_cells(packed, 64, 5) == cells).all() and len(packed[0].as_py()) == 40
    least, most = borders.tables(centres)
    far = ((grid[:, None, :] - centres[None]) ** 2).sum(axis=2)
    d = np.arange(64)
    assert (least[d, cells].sum(axis=1) <= far).all() and (far <= most[d, cells].sum(axis=1)).all()
    left = borders.candidates(cells, (least, most))
    assert left[np.arange(len(far)), far.argmin(axis=1)].all()
    assert (left.sum(axis=1) == 1).mean() > 0.9


# 13 -----------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, lost string, row string, n_lines int, k1 string, t1 int"
LINE = "This line is in many documents"


def _docs():
    rows = [
        (1, f"own first line of one\n{LINE}\nlast"), (2, f"\t {LINE.upper()} \r\n{LINE}\nother text of document two"),
        (3, f"{LINE}\n\n{LINE.lower()}"), (3, f"{LINE}\n\n{LINE.lower()}"), (9, LINE), (4, None), (5, ""), (6, "\n"),
        (7, "Zwölf Boxkämpfer jagen ÉVA\nshort"), (8, "zwölf boxkämpfer jagen ÉVA"), (10, "zwölf boxkämpfer jagen Éva"),
        (11, "ZWÖLF boxkämpfer jagen ÉVA"), (12, " \x0b" + "a" * 19 + "\n" + "b" * 20), (13, "a" * 19 + "\n" + "b" * 20),
        (14, "a" * 19 + "\n" + "B" * 20 + "\x0c"), (15, "a pair of equal documents"), (16, "a pair of equal documents"),
        (None, LINE), (None, LINE + "\ntwo"), (17, "\n".join([f"line number {i} of a very long text" for i in range(30_000)] + [LINE])),
        (18, "nobody has  this line but three "), (19, "nobody has  this line but three"), (20, "nobody has  this line but three"),
    ]
    return [(i, t, "en", "x", "y", 7, "z", 3) for i, t in rows]


def _deduped(rows, chars=20, docs=3):
    blanks, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(blanks).translate(lower)
    ids = defaultdict(set)
    for i, t, *_ in rows:
        for line in re.split("\n", t or ""):
            ids[key(line)].add((i is not None, i or 0))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or len(ids[key(x)]) < docs or max(ids[key(x)]) == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    rows = _docs()
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(5))
    assert out.columns == ["doc_id", "text", "lang", "lost", "row", "k1", "t1", "n_lines", "n_dropped"]
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str)
    assert got == _deduped(rows)
    assert sum(r[2] for r in got) > 6


def test_line_dedup_thresholds_and_empty_table(spark):
    rows = _docs()
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOCS), min_chars=19, min_docs=2)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()), key=str) == _deduped(rows, 19, 2)
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).collect() == []


def test_line_dedup_has_no_python_in_its_plan(spark):
    for df in (linededup.dedup_lines(spark.createDataFrame(_docs(), DOCS)),
               linededup.frequent_lines(spark.createDataFrame(_docs(), DOCS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|Pandas|Arrow|MapPartitions", plan)


# registered ---------------------------------------------------------------------------------


def test_queries_are_registered_with_sql():
    for q in ("op11_prefix_trie", "op12_va_file_clusters", "op13_line_dedup"):
        assert q in queries.QUERIES and q in queries.SQL


def test_work_columns_of_language_and_toxicity_do_not_clash(spark):
    from sigframe.llm import langid, toxicity

    docs = spark.createDataFrame([(1, "some words of a text", "en", "mine"), (2, None, "en", "mine")],
                                 "doc_id long, text string, _lid_text string, _tox_text string")
    model = langid.fit(docs.withColumnRenamed("_lid_text", "lang"))
    seen = langid.identify(docs, model)
    assert {(r["_lid_text"], r["_tox_text"]) for r in seen.collect()} == {("en", "mine")}
    scored = toxicity.score(docs, toxicity.fit(docs, docs.selectExpr("doc_id", "0 as toxic")))
    assert {(r["_lid_text"], r["_tox_text"], r["toxic"]) for r in scored.collect()} == {("en", "mine", False)}
