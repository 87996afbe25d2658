"""Chat formatting: tool calls linked with their results, ordered, validated and serialised.

`link` hash-joins calls (conv_id, seq, call_id, name, arguments, after) with
results (conv_id, seq, call_id, content) by conversation and identifier.  A
call's `after` lists the calls whose results it needs.  A call's position is its
seq, or one more than the last position of what it needs, whichever is larger,
so calls keep the order of the conversation where that is a topological one,
and sorting by (position, seq) always is.  Calls on a cycle, and no others, are
marked as cyclic; what they need of their own cycle doesn't move them, and a
call behind a cycle comes behind the call it needs.  Arguments are parsed as
JSON and held against the tool's schema (tool, field, type, required).  Each
call becomes one line of canonical JSON: keys sorted, no spaces.

Only conversations in which a call needs one that doesn't come before it are
ordered anew.  One with at most `GROUP_LINKS` needs is ordered by one pass over its
calls' identifiers, seqs and needs (strongly connected components, needed ones
first), whose time is linear in them, however deep they are and however many
others a call needs.

A larger conversation stays rows, so that one that holds a third of the table is
as well spread as the rest.  There a call that waits for one other call has the
position max(a, b + that call's).  Such functions compose, so whole chains are
followed by pointer doubling, in a number of rounds that is the logarithm of
their length; a call that waits for several has to see all but one of them placed
first.  Calls that never get a position lie on cycles or behind them; the same in
the other direction leaves those between cycles, of which the paths are followed
to tell who comes back to itself.

Calls and results meet by conversation and call identifier together, so no
conversation's texts are gathered.

Nulls and edges: calls without an identifier have no results; of several calls
with one identifier, equal rows among them, the first by seq counts and the
others are marked as repeated; of several results the first is taken and their
number told.  A null seq sorts first.  Arguments that are no JSON object are
invalid and serialised as a string; texts of any length are read whole.  A tool
without a schema is unknown and its calls are invalid.  Results without a call
are returned by `orphans`.  Columns besides those named are not read, so they
may have any names.  Empty tables give empty tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

KEY = ["conv_id", "call_id"]
#: needs of a conversation that is ordered in one pass, at most
GROUP_LINKS = 50_000


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: each user turn calls the tool `reply`, and the assistant's next turn is its result.

    A call needs the user's turn before it, or, as a question that the next one makes clear, the turn after it where the
    number of its characters is divisible by three.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def name(turn):
        return F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    args = F.to_json(F.struct(F.col("turn"), F.col("text")), {"ignoreNullFields": "false"})
    ahead = F.coalesce(F.length("text") % 3 == 0, F.lit(False))
    after = F.when(ahead, F.array(name(F.col("turn") + 2))).when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    calls = rows.filter("role = 'user'").select("conv_id", F.col("turn").alias("seq"), name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), args.alias("arguments"), after.alias("after"))
    results = rows.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("seq"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def placed(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, call_id, position) of the calls of starts (conv_id, call_id, position) from which no edge (conv_id, call_id, need) leads to a cycle.

    A call's position is at least its start and more than that of each call it needs.
    """
    waiting, own = stored(edges), starts
    out = stored(starts.join(edges.select(*KEY).distinct(), KEY, "left_anti"))
    fresh = out
    while True:
        # what is needed of the calls placed last is known now
        told = waiting.join(fresh.select("conv_id", F.col("call_id").alias("need"), (F.col("position") + 1).alias("least")), ["conv_id", "need"], "left")
        told = stored(told)
        raised = told.filter("least IS NOT NULL").groupBy(*KEY).agg(F.max("least").alias("least"))
        own = stored(own.join(raised, KEY, "left").select(*KEY, F.greatest("position", "least").alias("position")))
        before = waiting.count()
        waiting = stored(told.filter("least IS NULL").select(*KEY, "need"))
        open_ = waiting.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("need").alias("need"))
        ready = own.join(told.select(*KEY).distinct(), KEY, "left_semi").join(open_.select(*KEY), KEY, "left_anti")
        # a call that waits for one other: max(a, b + that one's position)
        lone = open_.filter("n = 1").drop("n").join(own, KEY).select(*KEY, "need", F.col("position").alias("a"), F.lit(1).cast("long").alias("b"))
        lone = stored(lone)
        moving = None
        while True:
            on = lone.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("far"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            joined = lone.join(on, ["conv_id", "need"], "left")
            hop = joined.select(*KEY, F.coalesce("far", "need").alias("need"), F.greatest("a", F.col("a2") + F.col("b")).alias("a"), (F.col("b") + F.coalesce("b2", F.lit(0))).alias("b"), F.col("far").isNotNull().alias("moved"))
            hop = stored(hop)
            lone, before_, moving = hop.drop("moved"), moving, hop.filter("moved").count()
            # along a chain calls arrive one distance after the other: if none arrives in a round, those that move go round in cycles
            if moving in (0, before_):
                break
        ends = ready.select("conv_id", F.col("call_id").alias("need"), "position")
        behind = lone.join(ends, ["conv_id", "need"]).select(*KEY, F.greatest("a", F.col("b") + F.col("position")).alias("position"))
        fresh = stored(ready.union(behind))
        out = stored(out.union(fresh))
        # the edges to calls just placed are settled in the next round
        waiting = stored(waiting.join(fresh.select(*KEY), KEY, "left_anti"))
        if fresh.isEmpty() and waiting.count() == before:
            return out
        if waiting.isEmpty():
            return out


def within_cycles(edges: DataFrame) -> DataFrame:
    """Those of the edges (conv_id, call_id, need) that lie on a cycle."""
    calls = edges.select(*KEY).union(edges.select("conv_id", "need")).distinct().withColumn("position", F.lit(0).cast("long"))
    left = stored(edges)
    back = left.select("conv_id", F.col("need").alias("call_id"), F.col("call_id").alias("need"))
    for way in (left, back):
        free = placed(way, calls).select(*KEY)
        left = left.join(free, KEY, "left_anti").join(free.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti").select(*KEY, "need")
    left = stored(left)
    # what is left lies on cycles or between them: few calls, whose paths double in length each round
    paths, n = left, left.count()
    while True:
        further = paths.select("conv_id", F.col("call_id").alias("need"), F.col("need").alias("far"))
        paths = stored(paths.union(paths.join(further, ["conv_id", "need"]).select(*KEY, F.col("far").alias("need"))).distinct())
        before, n = n, paths.count()
        if n == before:
            break
    home = paths.select("conv_id", F.col("need").alias("call_id"), F.col("call_id").alias("need"))
    return left.join(home, [*KEY, "need"], "left_semi")


def components_of(needs: list[list[int]]) -> list[list[int]]:
    """The strongly connected components of a graph (for each node those that it needs), needed ones first."""
    out, stack, seen, low = [], [], [0] * len(needs), [0] * len(needs)
    on, counter = [False] * len(needs), 0
    for root in range(len(needs)):
        if seen[root]:
            continue
        path = [(root, iter(needs[root]))]
        counter += 1
        seen[root] = low[root] = counter
        stack.append(root)
        on[root] = True
        while path:
            node, rest = path[-1]
            for other in rest:
                if not seen[other]:
                    counter += 1
                    seen[other] = low[other] = counter
                    stack.append(other)
                    on[other] = True
                    path.append((other, iter(needs[other])))
                    break
                if on[other]:
                    low[node] = min(low[node], seen[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == seen[node]:
                    ring = []
                    while not ring or ring[-1] != node:
                        ring.append(stack.pop())
                        on[ring[-1]] = False
                    out.append(ring)
    return out


def _one_pass(key: tuple, calls: pd.DataFrame) -> pd.DataFrame:
    """The position of each call of a conversation, and whether it lies on a cycle."""
    at = {c: k for k, c in enumerate(calls["call_id"])}
    needs = [[at[x] for x in n if x in at] if n is not None else [] for n in calls["needs"]]
    place, cyclic = calls["position"].tolist(), [False] * len(calls)
    for ring in components_of(needs):
        own = set(ring)
        for k in ring:
            cyclic[k] = len(ring) > 1
            place[k] = max([place[k], *(place[x] + 1 for x in needs[k] if x not in own)])
    return pd.DataFrame({"conv_id": calls["conv_id"], "call_id": calls["call_id"], "position": place, "cyclic": cyclic})


def positions(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, missing, cyclic) of calls whose identifiers differ; missing counts needed calls that don't exist."""
    own = stored(calls.select(*KEY, F.col("seq").cast("long").alias("position")))
    edges = calls.select(*KEY, F.explode("after").alias("need")).distinct()
    exists = own.select("conv_id", F.col("call_id").alias("need"), F.col("position").alias("need_position"))
    met = stored(edges.join(own, KEY).join(exists, ["conv_id", "need"], "left"))
    missing = met.filter("need_position IS NULL").groupBy(*KEY).agg(F.count("*").alias("missing"))
    live = met.filter("need_position IS NOT NULL AND need <> call_id")
    cyclic = met.filter("need = call_id").select(*KEY)
    late = F.col("need_position") >= F.col("position")
    moved = stored(live.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_or(late).alias("late"), F.min(F.when(late, F.col("position"))).alias("lo"), F.max(F.when(late, F.col("need_position"))).alias("hi")).filter("late").select("conv_id", "n", "lo", "hi"))
    small, large = moved.filter(F.col("n") <= GROUP_LINKS).select("conv_id"), moved.filter(F.col("n") > GROUP_LINKS)
    rest = own.join(moved.select("conv_id"), "conv_id", "left_anti")
    needs = live.join(small, "conv_id", "left_semi").groupBy(*KEY).agg(F.collect_list("need").alias("needs"))  # a call's own list
    group = own.join(small, "conv_id", "left_semi").join(needs, KEY, "left").groupBy("conv_id").applyInPandas(_one_pass, f"conv_id {own.schema['conv_id'].dataType.simpleString()}, call_id string, position long, cyclic boolean")
    group = stored(group)
    now, cyclic = rest.unionByName(group.drop("cyclic")), cyclic.union(group.filter("cyclic").select(*KEY))
    if not large.isEmpty():
        # a cycle lies between the first call that comes too early and the last that such a call needs
        theirs = live.join(large, "conv_id")
        near = theirs.filter("position BETWEEN lo AND hi AND need_position BETWEEN lo AND hi")
        ring = stored(within_cycles(near.select(*KEY, "need")))
        cyclic = cyclic.union(ring.select(*KEY))
        now = now.unionByName(placed(theirs.select(*KEY, "need").join(ring, [*KEY, "need"], "left_anti"), own.join(large.select("conv_id"), "conv_id", "left_semi")))
    out = now.join(missing, KEY, "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
    return out.join(cyclic.distinct().withColumn("cyclic", F.lit(True)), KEY, "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def validate(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """The calls with valid: the tool is known, the arguments are an object, no required field lacks, and each field has its type (string, integer, number, boolean, array or object)."""
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))  # a tool's schema is a few fields
    parsed = calls.withColumn("args", F.try_parse_json(F.col("arguments"))).join(tools, "name", "left")
    shape = F.schema_of_variant("args")
    members = F.try_variant_get("args", "$", "map<string,variant>")

    def right(f):
        v, kind = F.try_element_at(F.col("members"), f["field"]), f["type"]
        is_ = F.schema_of_variant(v)
        whole = is_ == "BIGINT"
        ok = (
            F.when(kind == "integer", whole).when(kind == "number", whole | is_.startswith("DECIMAL") | is_.isin("DOUBLE", "FLOAT")).when(kind == "boolean", is_ == "BOOLEAN")
            .when(kind == "array", is_.startswith("ARRAY")).when(kind == "object", is_.startswith("OBJECT")).otherwise(is_ == "STRING")
        )
        return F.when(v.isNull(), ~f["required"]).otherwise(F.coalesce(ok, F.lit(False)))

    good = F.col("fields").isNotNull() & F.coalesce(shape.startswith("OBJECT"), F.lit(False)) & F.coalesce(F.forall("fields", right), F.lit(False))
    return parsed.withColumn("members", members).withColumn("valid", good).drop("members", "fields")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: conv_id, call_id, seq, position, name, valid, n_results, missing, cyclic, repeated, json."""
    rows = stored(calls.select("conv_id", "seq", "call_id", "name", "arguments", "after").withColumn("rid", F.monotonically_increasing_id()))
    first = rows.filter("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("k1"), F.col("call_id").alias("k2")).agg(F.min(F.struct("seq", "rid")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("k1")) & (F.col("call_id") == F.col("k2"))
    firsts = cut(rows.join(first, same, "left").select(*rows.columns, F.coalesce(F.col("rid") != F.col("first.rid"), F.lit(False)).alias("repeated")))
    got = results.groupBy(*KEY).agg(F.min(F.struct("seq", "content")).alias("r"), F.count("*").alias("n_results"))
    # a call without a conversation or a seq has nothing to be ordered by
    order = positions(firsts.filter("NOT repeated AND call_id IS NOT NULL AND conv_id IS NOT NULL AND seq IS NOT NULL").select(*KEY, "seq", "after"))
    order = order.withColumn("repeated", F.lit(False))
    rows = validate(firsts, schemas).join(got, KEY, "left").join(order, [*KEY, "repeated"], "left")
    body = F.concat(
        F.lit('{"arguments":'), F.when(F.col("args").isNotNull(), F.to_json("args")).otherwise(_quote("arguments")),
        F.lit(',"id":'), _quote("call_id"), F.lit(',"name":'), _quote("name"), F.lit(',"result":'), _quote("r.content"), F.lit("}"),
    )
    return rows.select("conv_id", "call_id", "seq", F.coalesce("position", "seq").alias("position"), "name", "valid", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "repeated", body.alias("json"))


def _quote(column: str):
    """A JSON string or null."""
    text = F.to_json(F.struct(F.col(column).alias("v")))
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.substring(text, 6, 2_000_000_000)).substr(F.lit(1), F.when(F.col(column).isNull(), 4).otherwise(F.length(text) - 6))


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that no call has."""
    return results.join(calls.select(*KEY).distinct(), KEY, "left_anti")
