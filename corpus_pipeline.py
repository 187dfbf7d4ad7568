"""Corpus pipeline: language ID, toxicity, near duplicates, mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all that the stage
before kept, read again from Parquet; the first four return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.llm import jaccard, langid, mixing, packing, toxicity
from sigframe.llm.common import table, written
from sigframe.llm.queries import TOKENIZER, language_model, toxicity_model
from sigframe.session import text_batches

#: SQL has no compressor, no tokenizer and no regression: see tests/llm for the brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents without a letter, or whose two best languages are
    all but equal, go.  Where no label is there to learn from, all stay that
    have a letter."""
    text_batches(spark)
    model = language_model(docs)
    if not model.dictionaries:
        return docs.where(F.regexp_like(F.col("text"), F.lit(r"\p{L}")))
    seen = langid.identify(docs, model)
    return seen.where("accepted").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents of severity grade 1 or more, more likely than not, go."""
    text_batches(spark)
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not toxic").select(*docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of linked ones stays."""
    text_batches(spark)
    return jaccard.keep_one(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: a row per copy that the mix takes, in training order."""
    return mixing.mix(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_part``, ``_file`` and ``_row``, which give the order in
    which its rows were written.  A scan does not keep it: it takes files by size
    and puts several in a partition.  What is not a table of files is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = written(docs)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")  # 100000 is after 99999
    return docs.select("*", part.alias("_part"), F.col("_metadata.file_name").alias("_file"),
                       F.col("_metadata.row_index").alias("_row"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of sequences of 2048 ids, documents in the order in
    which the stage before wrote them, which is training order."""
    text_batches(spark)
    return packing.pack(in_order(docs), public_tokenizers.path(TOKENIZER), order_by=["_part", "_file", "_row"],
                        with_ids=False).drop("ids")


STAGES = [("language_id", language), ("toxicity", toxic), ("ngram_jaccard", duplicates), ("mixing", mixture),
          ("packing", packs)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
