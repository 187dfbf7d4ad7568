"""Operator 4: token counts by the whole-token shortcut (see ``bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.bpe import encoder


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """Tokens of every whole text under the byte-level BPE file ``path``.

    One map over the rows, no shuffle; memory is one Arrow batch of texts.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows and null ids
    each give a row; other columns are not read.  An empty table gives none.

    Returns ``(<id_col>, n_bytes, n_tokens, over_limit)``.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "n_bytes": b["n_bytes"],
                                "n_tokens": [enc.count(t) for t in b["text"]]})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInPandas(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
