"""Operator 3: language identification by compression.

For every language a raw-content zstandard dictionary is laid out from labelled
texts.  A text is encoded against each dictionary, chunk by chunk over its whole
length, and goes to the language with the smallest total; where the runner-up
is too close, the document is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import unused
from sigframe.session import ship_package

_WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, in order of the language's name."""

    dictionaries: dict[str, bytes]
    level: int = 3
    chunk: int = 4096


def letters(text: str | None) -> str:
    """Lower-case runs of letters with single spaces, '' if there is no letter."""
    words = _WORDS.findall(text.lower()) if text else []
    return " ".join(words) if any(c.isalpha() for w in words for c in w) else ""


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        rows_per_language: int = 400, max_row_bytes: int = 32_768, dictionary_bytes: int = 131_072,
        max_languages: int = 500) -> Model:
    """Dictionaries from a bounded sample of labelled rows.

    Bounds: at most ``rows_per_language`` rows a language, none over
    ``max_row_bytes``, so that the driver holds little whatever the input.  Rows
    are taken in the order of a hash of ``key_col``, so reruns agree.  Rows with
    null language or text are left out; an empty table gives an empty model.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
                           F.pmod(F.xxhash64(F.col(key_col)), F.lit(1 << 40)).alias("h")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_row_bytes))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return Model({})
    near = None
    for lang, n in counts.items():  # about twice the wanted rows of each language, by hash
        cut = int(min(1.0, (2 * rows_per_language + 50) / n) * (1 << 40))
        hit = (F.col("lang") == lang) & (F.col("h") < cut)
        near = hit if near is None else near | hit
    sample: dict[str, list[tuple[int, str]]] = {}
    for r in rows.where(near).collect():
        sample.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang in sorted(sample):
        parts, size = [], 0
        for text in dict.fromkeys(letters(t) for _, t in sorted(sample[lang])[:rows_per_language]):
            data = text.encode() + b" "
            if len(data) > 1 and size + len(data) <= dictionary_bytes:
                parts.append(data)
                size += len(data)
        if parts:
            out[lang] = b"".join(parts)
    return Model(out)


class Classifier:
    """Compressors of a model; one per worker task."""

    def __init__(self, model: Model):
        import zstandard as zstd

        self.names, self.by, self.chunk = list(model.dictionaries), [], model.chunk
        for raw in model.dictionaries.values():
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=model.level)
            self.by.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and margin: how much larger, as a share of itself, the
        runner-up's encoding is.  A single language has margin 1."""
        clean = letters(text)
        if not clean or not self.names:
            return UNKNOWN, 0.0
        data = clean.encode()
        parts = [data[i:i + self.chunk] for i in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), name)
                       for name, c in zip(self.names, self.by, strict=True))
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = 0.004) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the margin, 0 to 1) and
    ``accepted``.

    One map over the rows, no shuffle; the model is at most
    ``max_languages * dictionary_bytes`` and goes with the task.  Null texts and
    texts without a letter are ``und`` with score 0 and are rejected, as are
    texts whose margin is under ``min_margin``; equal sizes go to the smaller
    language name, with margin 0.  Columns of these three names in ``docs`` are
    replaced; every other column and every repeated row is kept.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    schema, work = docs.schema, unused(docs, "_lid_text")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = Classifier(model)
        for b in batches:
            got = [classify(t) for t in b[work]]
            b["lang_pred"], b["score"] = [g[0] for g in got], [g[1] for g in got]
            yield b.drop(columns=work)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    out = docs.withColumn(work, _text(docs, text_col)).mapInPandas(
        run, f"{fields}, lang_pred string, score double")
    return out.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_margin))


def _text(docs: DataFrame, text_col: str) -> Column:
    return docs[text_col].cast("string")
