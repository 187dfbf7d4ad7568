"""Line dedup: lines that repeat across documents stay in one of them.

A line's key is the line without white space at its ends and with A-Z in lower
case.  Three steps, all of built-in functions:

1. explode lines, hash their keys, count the distinct documents per hash;
2. join the frequent hashes back to the exploded lines: the positions a document loses;
3. take those positions out of the document's lines and join the rest in order.

Only hashes, ids and positions are exploded; a text is shuffled once, as its own
lines.  The table of frequent hashes is written first, so its size is known when
it is joined: Spark broadcasts it if it is small and otherwise splits the
partitions of a line that is in a third of all documents.

A key is compared by 128 bits of hash; two different keys share them with a
probability of about 2^-128.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import written

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """``line`` stripped, A-Z in lower case, all other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() is the same for ASCII, and many times faster than translate()
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(
        F.translate(bare, UPPER, UPPER.lower()))


def _hashes(value: Column, a: str, b: str) -> list[Column]:
    return [F.xxhash64(value).alias(a), F.xxhash64(F.lit(1), value).alias(b)]


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``(id, t1, t2, pos, k1, k2)``: the lines whose keys are long enough."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *_hashes(text, "t1", "t2"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.where(F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars).select(
        "id", "t1", "t2", "pos", *_hashes(line_key(F.col("line")), "k1", "k2"))


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                   min_docs: int = 3) -> DataFrame:
    """``(k1, k2, n_docs, last)``: the keys of at least ``min_chars`` code points in at
    least ``min_docs`` documents, and the largest id that holds each."""
    counted = _lines(docs, id_col, text_col, min_chars).groupBy("k1", "k2").agg(
        (F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))).alias("n_docs"), F.max("id").alias("last"))
    return counted.where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3) -> DataFrame:
    """The rows of ``docs`` with ``text_col`` replaced by its remaining lines, joined
    by a line feed, and with ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses its lines in all of them but the largest id.

    A document is an id: rows that share one count once, and all of them that
    hold a frequent key keep it if their id is the largest.  Null ids are one
    document, smaller than every other.  A null text is read as empty, which is
    one empty line, and comes back empty.  All other columns stay; columns of
    the input named ``n_lines`` or ``n_dropped`` are replaced.  Empty input gives
    an empty result.
    """
    frequent = written(frequent_lines(docs, id_col, text_col, min_chars, min_docs).select("k1", "k2", "last"))
    lost = _lines(docs, id_col, text_col, min_chars).join(frequent, ["k1", "k2"]).where(
        ~F.col("id").eqNullSafe(F.col("last"))).groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("lost"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    # rows of one id and one text lose the same lines, so id and text hash are their key;
    # split() stays below the join, so that get() in the lambda reads an array and doesn't split again
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                       *_hashes(text, "t1", "t2"), F.split(text, "\n").alias("lines")).alias("r")
    same = F.col("r.id").eqNullSafe(F.col("l.id")) & (F.col("r.t1") == F.col("l.t1")) & (F.col("r.t2") == F.col("l.t2"))
    all_of = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(
        F.transform(F.array_except(all_of, "lost"), lambda i: F.get("lines", i)))
    out = rows.join(lost.alias("l"), same, "left").select("row", "lost", "lines", F.array_join(kept, "\n").alias("kept"))
    cols = [F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns
            if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, F.size("lines").cast("long").alias("n_lines"),
                      F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"))
