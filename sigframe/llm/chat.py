"""Operator 8: tool-call linking.

Calls and results are hash-joined by call identifier, calls are put in
topological order of what they depend on, arguments are validated against the
tool's schema, and every link is serialised as canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import Step, written

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list,
          "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no white space, and text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problem(value: Any, schema: Mapping[str, Any], at: str = "$") -> str | None:
    """The first violation of a JSON schema (type, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength), in the
    order of the value's keys, or None."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(isinstance(value, _KINDS[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds):
            return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{at}: too long"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{at}: too small"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{at}: too large"
    if isinstance(value, dict):
        for k in sorted(schema.get("required", ())):
            if k not in value:
                return f"{at}.{k}: missing"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k in known:
                if (found := problem(value[k], known[k], f"{at}.{k}")) is not None:
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for n, x in enumerate(value):
            if (found := problem(x, schema["items"], f"{at}[{n}]")) is not None:
                return found
    return None


def chains(single: DataFrame) -> DataFrame:
    """``(call_id, anchor, steps)`` for calls that need exactly one other
    (``call_id, needs``): the first call up the chain that does not, and how many
    steps away it is.  Calls on or behind a cycle have no row.

    Pointer jumping: each round joins the pointers with themselves and doubles
    the steps they span, so a chain of n calls takes log2(n) rounds, and what
    still moves after log2 of all calls goes round in a cycle."""
    step = Step(single.select("call_id", F.col("needs").alias("anchor"), F.lit(1).cast("long").alias("steps"),
                              F.lit(False).alias("done")))
    for _ in range(step.df.count().bit_length() + 1):
        up = step.df.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("up"), F.col("steps").alias("more"))
        moved = step.df.where("not done").join(up, "anchor", "left").select(
            "call_id", F.coalesce("up", "anchor").alias("anchor"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("up").isNull().alias("done"))
        nxt = Step(step.df.where("done").unionByName(moved))
        step.drop()
        step = nxt
        if step.df.where("not done").isEmpty():
            break
    return step.df.where("done").drop("done")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``(call_id, level)`` in topological order: level 0 depends on nothing,
    others are one above the highest they depend on; calls on or behind a cycle
    have no row.

    Calls that need one other are chains, which ``chains`` shortens to their
    anchor.  Kahn's rounds place the calls that need several, each one join of
    the calls placed last with the dependencies, written to the shared folder;
    there are as many as such calls follow each other."""
    needed = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("open"))
    edges = written(edges.join(needed, "call_id"))
    chain = written(chains(edges.where("open = 1")))
    several = edges.where("open > 1").join(
        chain.select(F.col("call_id").alias("needs"), "anchor", "steps"), "needs", "left").select(
        "call_id", F.coalesce("anchor", "needs").alias("anchor"),
        (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    several = written(several)
    left = Step(several.groupBy("call_id").agg(F.count(F.lit(1)).alias("open"), F.lit(0).cast("long").alias("level")))
    last = Step(calls.join(edges, "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level")))
    out = last.df
    while not left.df.isEmpty():
        met = several.join(last.df.select(F.col("call_id").alias("anchor"), "level"), "anchor").groupBy("call_id").agg(
            F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("steps")).alias("above"))
        state = Step(left.df.join(met, "call_id", "left").select(
            "call_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"),
            F.greatest("level", "above").alias("level")))
        last = Step(state.df.where("open = 0").select("call_id", "level"))
        left.drop()
        left = Step(state.df.where("open > 0"))
        state.drop()
        if last.df.isEmpty():  # the rest is on or behind a cycle
            break
        out = out.unionByName(last.df)
    behind = chain.join(out.select(F.col("call_id").alias("anchor"), "level"), "anchor").select(
        "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return out.unionByName(behind)


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """Link tool calls with their results.

    ``calls``: ``(thread, position, call_id, name, arguments, needs)``, the
    arguments JSON text, ``needs`` an array of the call ids whose results the
    call uses.  ``results``: ``(thread, position, call_id, content)``.

    Returns a row per call and result of it (calls without one have a row of
    their own, and so have results without a call): ``(thread, call_position,
    result_position, call_id, status, level, valid, error, json)``.

    ``status`` is ``linked``, ``unanswered``, ``orphan`` (no such call),
    ``repeated`` (the call's id was given before, by position and content; such
    calls get no results) or ``nameless`` (null id).  ``level`` is the place in
    topological order, null on or behind a cycle; needed ids that no call has,
    or null, are not waited for.  ``valid`` and ``error`` tell whether arguments
    match the tool's schema (``unknown tool``, ``not JSON`` otherwise); both are
    null for orphans.  ``json`` is the canonical JSON of id, name, arguments
    (their text if they are no JSON), needs, level and result.  Results are
    never gathered by call, so one id with a third of all results is only a
    skewed join.  Empty tables give no rows; other columns are not read.
    """
    c = calls.select(F.col("thread").cast("long"), F.col("position").cast("long").alias("call_position"), "call_id",
                     "name", "arguments", "needs")
    nameless = c.where("call_id is null").withColumn("status", F.lit("nameless"))
    c = written(c.where("call_id is not null"))
    body = F.struct(F.col("call_position").isNull(), "call_position", "thread", "name", "arguments",
                    F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    # equal rows stay apart: the first of them is the call, all others are repeats
    per = c.groupBy("call_id", body.alias("b")).agg(F.count(F.lit(1)).alias("many"))
    firsts = per.groupBy("call_id").agg(F.min("b").alias("b"))
    chosen = written(firsts.select("call_id", "b.call_position", "b.thread", "b.name", "b.arguments", "b.needs"))
    again = per.join(firsts.select("call_id", F.col("b").alias("fb")), "call_id").withColumn(
        "many", F.col("many") - F.when(F.col("b") == F.col("fb"), 1).when(
            F.to_json("b") == F.to_json("fb"), 1).otherwise(0)).where("many > 0")
    again = again.select("call_id", "b.*", F.explode(F.sequence(F.lit(1), F.col("many").cast("int")))).select(
        "thread", "call_position", "call_id", "name", "arguments", "needs", F.lit("repeated").alias("status"))
    ids = chosen.select(F.col("call_id").alias("needs"))
    edges = chosen.select("call_id", F.explode(F.array_distinct("needs")).alias("needs")).join(ids, "needs")
    placed = written(chosen.join(levels(chosen.select("call_id"), edges), "call_id", "left"))
    r = results.select(F.col("thread").cast("long").alias("result_thread"),
                       F.col("position").cast("long").alias("result_position"), "call_id", "content",
                       F.lit(True).alias("answered"))
    linked = placed.join(r, "call_id", "left").withColumn(
        "status", F.when(F.col("answered"), "linked").otherwise("unanswered"))
    orphan = r.join(chosen.select("call_id"), "call_id", "left_anti").withColumn("status", F.lit("orphan")) \
        .withColumn("thread", F.col("result_thread"))
    rows = linked.unionByName(nameless, True).unionByName(again, True).unionByName(orphan, True)
    rows = rows.select("thread", "call_position", "result_position", "call_id", "status", "level", "name", "arguments",
                       "needs", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            valid, error, text = [], [], []
            for x in b.itertuples(index=False):
                v, e, t = _serialised(x, schemas)
                valid.append(v)
                error.append(e)
                text.append(t)
            out = b[["thread", "call_position", "result_position", "call_id", "status", "level"]].astype(
                {c: "Int64" for c in ("thread", "call_position", "result_position", "level")})
            yield out.assign(valid=pd.array(valid, "boolean"), error=error, json=text)

    return rows.mapInPandas(run, "thread long, call_position long, result_position long, call_id string, "
                                 "status string, level long, valid boolean, error string, json string")


def _serialised(x: Any, schemas: Mapping[str, Mapping[str, Any]]) -> tuple[bool | None, str | None, str]:
    number = lambda v: None if pd.isna(v) else int(v)
    result = None
    if x.status in ("linked", "orphan"):
        result = {"content": x.content, "position": number(x.result_position)}
    if x.status == "orphan":
        return None, None, canonical({"id": x.call_id, "result": result})
    try:
        arguments = json.loads(x.arguments, parse_constant=_no_constant) if x.arguments is not None else None
        error = problem(arguments, schemas[x.name]) if x.name in schemas else "unknown tool"
    except ValueError:
        arguments, error = x.arguments, "not JSON"
    needs = [] if x.needs is None else [n for n in x.needs]
    return error is None, error, canonical({"arguments": arguments, "id": x.call_id, "level": number(x.level),
                                            "name": x.name, "needs": needs, "result": result})


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: The tool that a conversation's user turns call.
REPLY = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}}


def transcripts(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a conversation table: a user turn calls the tool
    ``reply`` with its text, and needs the call of two turns before if there is
    one; an assistant turn is the result of the call of the turn before.  Other
    roles are neither.  Turns with null conv_id or turn have no call id."""
    def named(back: int):
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))

    calls = conversations.where("role = 'user'").select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("position"), named(0).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array_compact(F.array(named(2))).alias("needs"))
    results = conversations.where("role = 'assistant'").select(
        F.col("conv_id").alias("thread"), F.col("turn").alias("position"), named(1).alias("call_id"),
        F.col("text").alias("content"))
    return calls, results
