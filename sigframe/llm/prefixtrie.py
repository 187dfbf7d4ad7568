"""Prefix trie of conversations: a z-fast trie whose dictionary is a table.

A conversation is the row of its prefix hashes, one for each depth (a chain of
md5 over the turns), so two conversations share their first d turns where their
hashes at d agree.  Only points where conversations part or end are nodes of the
compacted trie; a node's edge holds the hashes and byte counts of the depths
since its parent's end.

A node over the depths (lo, hi] is filed under its handle: the hash at the number
in (lo, hi] that the greatest power of two divides.  A conversation finds its exit
node by fat binary search: probe the handle table at the two-fattest depth of
what is left of (a, b]; a hit moves a to the node's end, a miss moves b below the
probe.  So log2(turns) joins locate a batch of any size, then the edge found
(or, past its end, the child that starts with the next turn) tells where the
conversation leaves the trie.

Conversations are inserted in batches of growing size.  A batch cuts edges where
its conversations leave them, and turns its own remainders into new nodes:
their depths are grouped by hash, and those where they part or end are nodes.
At the end, counts run up the trie (each node's ancestors come from pointer
doubling) and the edges are expanded to one row a depth.

Equal conversations are one entry with a count from the start, and every sum is
combined before it is shuffled, so a first turn, a conversation or a node that a
third of all conversations share is no task of its own.  A conversation without
its texts (24 bytes a turn) is one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Step, written
from sigframe.session import ship_package

ROOT = hashlib.md5(b"").digest()
#: Sixteenths of the conversations that are in the trie after each batch.
BATCHES = (2, 16)
#: Ids in one chunk of a list of members.
CHUNK_BITS = 13


def sequences(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: turns in order, each a struct of ``h`` (hash of role and
    text) and ``b`` (UTF-8 bytes of the text).

    Turns are ordered by ``turn`` (null first), then role, then hash; repeated rows
    are turns of their own.  Null roles and texts are empty.  Rows without a
    ``conv_id`` belong to no conversation and are left out.  Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", role.alias("role"), F.unhex(F.md5(F.concat(F.md5(role), F.md5(text)))).alias("h"),
                 F.octet_length(text).cast("long").alias("b")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["b"].alias("b"))).alias("turns"))


def rebuild(seqs: DataFrame, every: int = 5, most: int = 8) -> DataFrame:
    """Each conversation c starts with the first h turns of conversation c - c % ``every``
    (all, if it has fewer; none, if it is absent), h = crc32(c) % (``most`` + 1); its own
    turns after its first h follow.  ``%`` has the sign of c."""
    heads = seqs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    rows = seqs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(heads, "base", "left").withColumn("h", h)
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return rows.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(
        F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def paths(seqs: DataFrame) -> DataFrame:
    """``(conv_id, end, n, hs, cum)``: hash after each turn, bytes up to each depth from 0, hash of the whole."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ends, hashes, sums = [], [], []
            for hs, bs in zip(f["hs"], f["bs"]):
                at, chain = ROOT, []
                for h in hs:
                    at = hashlib.md5(at + h).digest()
                    chain.append(at)
                ends.append(at)
                hashes.append(chain)
                sums.append(np.concatenate([[0], np.cumsum(np.asarray(bs, np.int64))]))
            yield pd.DataFrame({"conv_id": f["conv_id"], "end": ends, "n": [len(c) for c in hashes], "hs": hashes, "cum": sums})
    ship_package(seqs.sparkSession)
    return seqs.select("conv_id", F.col("turns.h").alias("hs"), F.col("turns.b").alias("bs")).mapInPandas(
        run, "conv_id long, end binary, n int, hs array<binary>, cum array<long>")


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the greatest power of two divides, 0 <= a < b."""
    k = (F.length(F.bin(a.bitwiseXOR(b).cast("long"))) - 1).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", b, k), k)


def _hash(depth: Column, of: str = "hs") -> Column:
    """Hash at a depth of a conversation's row."""
    return F.when(depth <= 0, F.lit(ROOT)).otherwise(F.get(F.col(of), depth - 1))


def _no_match(cond: Column, key: Column, own: str) -> Column:
    """``key`` where ``cond`` holds, else a value that is in no table and differs from row to row."""
    return F.when(cond, key).otherwise(F.concat(F.col(own), F.lit(b"-")))


def _agree(hs: str, lo: str, hi: str, edge: str) -> Column:
    """Depth down to which a conversation follows an edge."""
    same = F.zip_with(F.slice(hs, F.col(lo) + 1, F.col(hi) - F.col(lo)), F.col(edge), lambda x, y: x.eqNullSafe(y))
    return F.col(lo) + F.size(F.filter(same, lambda t: t))


def locate(batch: DataFrame, trie: DataFrame, rounds: int) -> DataFrame:
    """``batch`` with its exit node ``at`` (that ends at ``at_hi``) and ``l``, the number
    of turns it shares with the trie; ``rounds`` is the bit length of the most turns."""
    handles = trie.where("hi > 0").select(
        F.get("edge", two_fattest(F.col("lo"), F.col("hi")) - F.col("lo") - 1).alias("_key"), F.col("ext").alias("_ext"),
        F.col("hi").alias("_hi"))
    x = batch.withColumns({"a": F.lit(0), "b": F.col("n"), "at": F.lit(ROOT)})
    for _ in range(rounds):
        left = F.col("a") < F.col("b")
        x = x.withColumn("f", F.when(left, two_fattest(F.col("a"), F.col("b"))))
        x = x.withColumn("_key", _no_match(left, _hash(F.col("f")), "end")).join(handles, "_key", "left")
        hit = F.col("_ext").isNotNull()
        x = x.withColumns({"at": F.when(hit, F.col("_ext")).otherwise(F.col("at")),
                           "a": F.when(hit, F.col("_hi")).otherwise(F.col("a")),
                           "b": F.when(~hit & left, F.col("f") - 1).otherwise(F.col("b"))}).drop("_key", "_ext", "_hi", "f")
    nodes = trie.select(F.col("ext").alias("at"), F.col("lo").alias("_lo"), F.col("hi").alias("at_hi"), F.col("edge").alias("_edge"))
    x = x.drop("a", "b").join(nodes, "at").withColumn("l", _agree("hs", "_lo", "at_hi", "_edge")).drop("_lo", "_edge")
    on = (F.col("l") == F.col("at_hi")) & (F.col("n") > F.col("l"))
    child = trie.where("hi > 0").select(F.get("edge", F.lit(0)).alias("_key"), F.col("ext").alias("_ext"), F.col("lo").alias("_lo"),
                                        F.col("hi").alias("_hi"), F.col("edge").alias("_edge"))
    x = x.withColumn("_key", _no_match(on, _hash(F.col("l") + 1), "end")).join(child, "_key", "left")
    hit = F.col("_ext").isNotNull()
    return x.withColumns({"l": F.when(hit, _agree("hs", "_lo", "_hi", "_edge")).otherwise(F.col("l")),
                          "at": F.when(hit, F.col("_ext")).otherwise(F.col("at")),
                          "at_hi": F.when(hit, F.col("_hi")).otherwise(F.col("at_hi"))}).drop("_key", "_ext", "_lo", "_hi", "_edge")


def _cut(trie: DataFrame, found: DataFrame) -> DataFrame:
    """``trie`` with the edges cut where conversations of ``found`` leave or end inside them."""
    cuts = found.where("l < at_hi").groupBy(F.col("at").alias("ext")).agg(F.sort_array(F.collect_set("l")).alias("cuts"))
    ends = F.concat(F.coalesce("cuts", F.array().cast("array<int>")), F.array("hi"))
    pieces = trie.join(cuts, "ext", "left").select("*", F.posexplode(ends).alias("i", "to")).withColumn(
        "from", F.when(F.col("i") == 0, F.col("lo")).otherwise(F.get("cuts", F.col("i") - 1)))
    off = F.col("from") - F.col("lo")
    width = F.col("to") - F.col("from")
    return pieces.select(
        F.when(F.col("to") == F.col("hi"), F.col("ext")).otherwise(F.get("edge", F.col("to") - F.col("lo") - 1)).alias("ext"),
        F.when(F.col("i") == 0, F.col("par")).otherwise(F.get("edge", off - 1)).alias("par"),
        F.col("from").alias("lo"), F.col("to").alias("hi"), F.slice("edge", off + 1, width).alias("edge"),
        F.slice("cum", off + 1, width + 1).alias("cum"))


def _grown(found: DataFrame) -> DataFrame:
    """The nodes below the points where the conversations of ``found`` leave the trie.

    The depths past those points are grouped by hash.  Each conversation makes the
    node at its own end; a node where several part makes the conversation
    with the smallest hash."""
    past = found.where("n > l").select("end", "hs", F.explode(F.sequence(F.col("l") + 1, F.col("n"))).alias("d"), "n")
    past = past.select("end", "d", F.get("hs", F.col("d") - 1).alias("h"), F.get("hs", F.col("d")).alias("nxt"),
                       (F.col("d") == F.col("n")).alias("stops"))
    forks = past.groupBy("h").agg(F.min("end").alias("maker"), F.max("end").alias("_other"), F.max("stops").alias("stops"),
                                  F.min("nxt").alias("_a"), F.max("nxt").alias("_b"))
    forks = written(forks.where((F.col("maker") != F.col("_other")) & (F.col("stops") | (F.col("_a") != F.col("_b")))).select(
        "h", "maker", "stops"))
    on = past.select("end", "d", "h").join(forks, "h").groupBy("end").agg(F.sort_array(F.collect_list(F.struct(
        "d", ((F.col("maker") == F.col("end")) & ~F.col("stops")).alias("makes")))).alias("forks"))
    rows = found.where("n > l").join(on, "end", "left")
    own = F.struct(F.col("n").alias("d"), F.lit(True).alias("makes"))
    mine = F.filter(F.coalesce("forks", F.array().cast("array<struct<d:int,makes:boolean>>")), lambda p: p["d"] < F.col("n"))
    rows = rows.withColumn("stops", F.concat(mine, F.array(own))).select("*", F.posexplode("stops").alias("i", "p")).withColumn(
        "lo", F.when(F.col("i") == 0, F.col("l")).otherwise(F.get("stops", F.col("i") - 1)["d"]))
    width = F.col("p.d") - F.col("lo")
    return rows.where("p.makes").select(
        _hash(F.col("p.d")).alias("ext"), _hash(F.col("lo")).alias("par"), "lo", F.col("p.d").alias("hi"),
        F.slice("hs", F.col("lo") + 1, width).alias("edge"), F.slice("cum", F.col("lo") + 1, width + 1).alias("cum"))


NODE = "ext binary, par binary, lo int, hi int, edge array<binary>, cum array<long>"


def build(entries: DataFrame) -> Step:
    """The compacted trie over ``entries`` (``end, n, hs, cum``, no two equal ends): a
    row per node with its end's hash ``ext``, its parent's ``par``, its depths
    (``lo``, ``hi``], their hashes and the bytes up to each of the depths lo to hi."""
    spark = entries.sparkSession
    rounds = int(entries.agg(F.max("n")).first()[0] or 0).bit_length()
    trie = Step(spark.createDataFrame([(ROOT, None, 0, 0, [], [0])], NODE))
    share = F.pmod(F.xxhash64("end"), F.lit(16))
    for before, upto in zip((0, *BATCHES), BATCHES):
        batch = entries.where((share >= before) & (share < upto)).select("end", "n", "hs", "cum")
        if before:
            found = Step(locate(batch, trie.df, rounds))
        else:
            found = Step(batch.withColumns({"at": F.lit(ROOT), "at_hi": F.lit(0), "l": F.lit(0)}))
        grown = Step(_cut(trie.df, found.df).unionByName(_grown(found.df)))
        found.drop()
        trie.drop()
        trie = grown
    return trie


def members_sha256(members: DataFrame) -> DataFrame:
    """``(end, sha)``: SHA-256 of the ascending, comma-joined ids of each ``end``.

    Ids are joined in chunks of neighbouring ids first; the chunks of one list
    then go through one task as a stream, since a SHA-256 depends on its bytes in order."""
    chunks = members.groupBy("end", F.call_function("shiftright", F.col("conv_id"), F.lit(CHUNK_BITS)).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, digest = None, None
        for f in frames:
            out = []
            for e, ids in zip(f["end"], f["ids"]):
                if e != end:
                    if end is not None:
                        out.append((end, digest.hexdigest()))
                    end, digest = e, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["end", "sha"])
        if end is not None:
            yield pd.DataFrame([(end, digest.hexdigest())], columns=["end", "sha"])

    return chunks.repartition("end").sortWithinPartitions("end", "chunk").select("end", "ids").mapInPandas(
        run, "end binary, sha string")


def ancestors(trie: DataFrame) -> DataFrame:
    """``(ext, path)``: the ends of all nodes above each node, nearest first, by pointer doubling."""
    step = Step(trie.select("ext", F.when(F.col("par").isNull(), F.array().cast("array<binary>")).otherwise(
        F.array("par")).alias("path")))
    last = F.element_at("path", -1)
    while not step.df.where((F.size("path") > 0) & (last != F.lit(ROOT))).isEmpty():
        up = step.df.where(F.size("path") > 0).select(F.col("ext").alias("_up"), F.col("path").alias("_more"))
        open_ = F.when(F.size("path") > 0, last != F.lit(ROOT)).otherwise(F.lit(False))
        nxt = Step(step.df.withColumn("_up", _no_match(open_, F.try_element_at("path", F.lit(-1)), "ext")).join(up, "_up", "left").select(
            "ext", F.when(F.col("_more").isNull(), F.col("path")).otherwise(F.concat("path", "_more")).alias("path")))
        step.drop()
        step = nxt
    return step.df


def nodes(seqs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``seqs`` (``conv_id``, ``turns``
    as ``sequences`` gives them; ids not null and distinct): ``node`` (its hash),
    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    The empty prefix is the root, whose parent is null; no conversations, no rows.
    """
    spark = seqs.sparkSession
    every = written(paths(seqs))
    ends = written(every.groupBy("end").agg(F.count(F.lit(1)).alias("own"), F.min("conv_id").alias("conv_id")))
    if ends.isEmpty():
        return spark.createDataFrame([], "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
                                         "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    entries = written(every.join(ends, ["end", "conv_id"]).select("end", "n", "hs", "cum"))
    trie = build(entries).df
    up = ancestors(trie)
    lines = up.select("ext", F.explode(F.concat(F.array("ext"), "path")).alias("top"))
    sizes = lines.join(ends.select(F.col("end").alias("ext"), "own", "conv_id"), "ext").groupBy(F.col("top").alias("ext")).agg(
        F.sum("own").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    below = trie.where(F.col("par").isNotNull()).groupBy(F.col("par").alias("ext")).agg(F.count(F.lit(1)).alias("n_children"))
    sized = written(trie.join(sizes, "ext").join(below, "ext", "left").join(
        members_sha256(every.select("end", "conv_id")).withColumnRenamed("end", "ext"), "ext", "left"))
    saved = (F.col("n_convs") - 1) * (F.element_at("cum", -1) - F.get("cum", F.lit(0)))
    totals = lines.join(sized.select("ext", F.col("n_children").isNull().cast("long").alias("leaf"), saved.alias("saved")), "ext").groupBy(
        F.col("top").alias("ext")).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved"))
    above = sized.select(F.col("ext").alias("par"), F.col("conv_id").alias("above"))
    full = sized.join(totals, "ext").join(above, "par", "left")
    no_ends = hashlib.sha256(b"").hexdigest()
    # a node's last depth comes with its own children and ends, the depths before it have one child and no end
    depths = full.select("*", F.posexplode(F.when(F.col("hi") == 0, F.array(F.col("ext"))).otherwise(F.col("edge"))).alias("i", "node"))
    at_end = F.col("i") == F.size("cum") - 2
    root = F.col("hi") == 0
    return depths.select(
        "node", "conv_id", F.when(root, 0).otherwise(F.col("lo") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(root | at_end, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * (F.get("cum", F.col("i")) - F.get("cum", F.lit(0)))).alias("saved_tokens"),
        F.when(root | at_end, F.coalesce("sha", F.lit(no_ends))).otherwise(F.lit(no_ends)).alias("ends_sha256"))
