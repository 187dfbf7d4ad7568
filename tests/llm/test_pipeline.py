"""The pipeline's stages, each against a plain version of its decision."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from sigframe.llm import langid, queries, toxicity
from sigframe.llm.bpe import Encoder
from sigframe.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = queries.language_model(docs)
    own = langid.Classifier(model)
    kept = corpus_pipeline.language(spark, docs, SF)
    want = {r["doc_id"] for r in docs.collect() if own(r["text"])[0] != "und" and own(r["text"])[1] >= 0.004}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == want
    assert len(want) >= 0.97 * docs.count()

    model = queries.toxicity_model(kept, table(spark, SF, "labels"))
    bits = len(model.weights).bit_length() - 1
    score = {r["doc_id"]: sum(model.weights[toxicity.features(w, bits)].sum() for w in toxicity.words(r["text"]))
             for r in kept.collect()}
    clean = corpus_pipeline.toxic(spark, kept, SF)
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, z in score.items() if z < model.thresholds[0]}

    from test_operators import _groups

    groups, _ = _groups({r["doc_id"]: r["text"] for r in clean.collect()})
    single = corpus_pipeline.duplicates(spark, clean, SF)
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == set(groups.values())

    mixed = corpus_pipeline.mixture(spark, single, SF)
    assert mixed.columns == columns
    n = Counter(r["doc_id"] for r in mixed.collect())
    assert set(n) <= set(groups.values()) and max(n.values()) <= 2

    packed = corpus_pipeline.packs(spark, mixed, SF)
    enc = Encoder(public_tokenizers.path(queries.TOKENIZER))
    want_ids = Counter()
    for r in mixed.collect():
        want_ids[r["doc_id"]] += len(enc.ids(r["text"])) + 1
    got = Counter()
    for r in packed.collect():
        got[r["doc_id"]] += r["length"]
    assert got == want_ids


def test_run_returns_pieces_and_survives_empty_and_null_rows(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.agg({"length": "sum"}).first()[0] > 0
    rows = [(1, None, None, None, None), (None, "a text of some words here", "en", None, 3), (2, "", "en", "s", 0),
            (2, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for n in (len(rows), 0):
        spark.createDataFrame(rows[:n], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(
            f"{tmp_path}/labels.parquet")
        got = corpus_pipeline.run(spark, str(tmp_path)).collect()
        # the text's 6 words have a target of 9, of which the mix writes two copies: 6 words and, rounded up, 3
        assert [r["doc_id"] for r in got] == ([None, None] if n else [])
        assert len({(r["length"], r["doc_tokens"], r["start"], r["ids_crc32"]) for r in got}) == (1 if n else 0)


def test_packing_keeps_the_training_order_of_several_files(spark, tmp_path):
    docs = table(spark, SF, "documents")
    order = corpus_pipeline.mixture(spark, docs, SF).collect()
    bounds = [0, 5, 30, 31, 90, 100, len(order)]  # files of unequal size, a scan takes the last one first
    slices = [[tuple(r) for r in order[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    path = f"{tmp_path}/mixed"
    stored = spark.sparkContext.parallelize(range(len(slices)), len(slices)).flatMap(lambda k: slices[k])
    spark.createDataFrame(stored, docs.schema).write.parquet(path)
    pieces = corpus_pipeline.packs(spark, spark.read.parquet(path), SF).orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces if r["start"] == 0] == [r["doc_id"] for r in order]

    direct = corpus_pipeline.packs(spark, corpus_pipeline.mixture(spark, docs, SF), SF)
    pieces = direct.orderBy("sequence_id", "offset").collect()
    assert [r["doc_id"] for r in pieces if r["start"] == 0] == [r["doc_id"] for r in order]
    turn = {s: k % 3 for k, s in enumerate(sorted({r["source"] for r in order}))}
    kind = {r["doc_id"]: turn[r["source"]] for r in order}  # asked for early, steadily, late
    half = len({r["sequence_id"] for r in pieces}) // 2
    first = set(sorted({r["sequence_id"] for r in pieces})[:half])
    early, late = ([sum(r["length"] for r in pieces if kind[r["doc_id"]] == k and (r["sequence_id"] in first) == begins)
                    for k in range(3)] for begins in (True, False))
    assert early[0] / sum(early) > late[0] / sum(late) and early[2] / sum(early) < late[2] / sum(late)


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_every_operator_is_registered_once(name):
    import __spark_entry__ as entry

    assert sum(q.startswith(name) for q in entry.queries()) == 1 and np.isin("pipeline", list(entry.queries()))


def test_stages_send_few_rows_at_a_time(spark):
    """Whole texts go to a Python worker in short batches, unless the session names their length."""
    from sigframe.session import BATCH_SETTING, TEXT_ROWS

    docs = spark.createDataFrame([(i, f"plain words of number {i}", None, "s", 9) for i in range(30)],
                                 "doc_id long, text string, lang string, source string, n_chars long")

    def longest():
        rows = spark.range(3 * TEXT_ROWS + 1).coalesce(1).mapInPandas(lambda fs: (f.head(1).assign(id=len(f)) for f in fs), "id long")
        return max(r["id"] for r in rows.collect())

    had = spark.conf.get(BATCH_SETTING, None)
    try:
        for stage in (corpus_pipeline.language, corpus_pipeline.toxic, corpus_pipeline.duplicates, corpus_pipeline.packs):
            spark.conf.unset(BATCH_SETTING)
            assert stage(spark, docs, SF).count() > 0 and longest() == TEXT_ROWS
        spark.conf.set(BATCH_SETTING, "70")
        corpus_pipeline.language(spark, docs, SF)
        assert longest() == 70
    finally:
        spark.conf.unset(BATCH_SETTING) if had is None else spark.conf.set(BATCH_SETTING, had)
