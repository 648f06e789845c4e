"""Tool-call linking and chat formatting (operator 3).

Input: events (conv_id, turn, kind, call_id, name, arguments, content), ``kind``
one of message, call, result.  Method:

1. calls and results are joined by (conversation, call id): a shuffle hash join.
   Of calls that repeat an id the first is linked, of results too; the
   others are marked.
2. arguments are parsed as variants and checked against the tool's schema
   (fields with type and whether required); the check is an expression over the schema's
   array, so no row is multiplied.  Schemas are one row per tool, broadcast
   only after a count (``SCHEMAS``).
3. events are put in topological order.  A result depends on its call, a
   call on the calls whose ids its arguments hold as ``{"$result": id}`` references.
   The order's key is the greatest turn on any path to the event, then the
   length of the path: relaxed in rounds over the events that still wait, as many as the
   longest chain.  Events of a cycle never become ready; they are marked and
   keep their turn.
4. every event becomes canonical JSON (sorted keys, no blanks, no nulls), and events are joined to
   transcripts in parts of ``PART`` turns, so a conversation of any length is never one row.

Only DataFrame functions run.

Defined results: a null conversation id is a conversation of its own; a null turn is
turn 0; null content is an empty string; a result without a call and a call without a result are
kept and marked; arguments that are not a JSON object are invalid; a call to an unknown tool is
invalid; equal events stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armature.llm.common import shared_folder, stage

SCHEMAS = 100_000
PART = 512
FIELDS = "array<struct<field:string,type:string,required:boolean>>"
#: The JSON type of a variant's SQL type.
JSON_TYPES = {"BIGINT": "integer", "STRING": "string", "BOOLEAN": "boolean", "DOUBLE": "number", "VOID": "null"}


def schemas(spark: SparkSession, tools: dict[str, list[tuple[str, str, bool]]]) -> DataFrame:
    """One row (name, fields) per tool."""
    return spark.createDataFrame([(n, f) for n, f in tools.items()], f"name string, fields {FIELDS}")


def _json_type(v: Column) -> Column:
    sql = F.schema_of_variant(v)
    out = F.when(sql.startswith("OBJECT"), "object").when(sql.startswith("ARRAY"), "array").when(sql.startswith("DECIMAL"), "number")
    for name, kind in JSON_TYPES.items():
        out = out.when(sql == name, kind)
    return out.otherwise("other")


def _errors(parsed: Column, fields: Column) -> Column:
    """Problems of the arguments, sorted: ``missing:field``, ``type:field``, ``unknown:field``."""
    values = parsed.cast("map<string,variant>")
    def problem(f):
        value = F.try_element_at(values, f["field"])
        kind = _json_type(value)
        fits = ((kind == f["type"]) | ((f["type"] == "number") & (kind == "integer"))
                | F.to_json(value).startswith('{"$result":'))       # a reference stands for a value of any type
        return (F.when(~F.map_contains_key(values, f["field"]), F.when(f["required"], F.concat(F.lit("missing:"), f["field"])))
                .when(~fits, F.concat(F.lit("type:"), f["field"])))
    known = F.transform(fields, lambda f: f["field"])
    unknown = F.transform(F.array_except(F.map_keys(values), known), lambda n: F.concat(F.lit("unknown:"), n))
    return F.array_sort(F.concat(F.array_compact(F.transform(fields, problem)), unknown))


def link(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Events with ``state`` (linked, orphan, open, repeated; null for messages), ``errors`` and ``arguments`` as a variant."""
    e = events.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "kind", "call_id", "name",
        "role", F.try_parse_json("arguments").alias("arguments"), F.coalesce("content", F.lit("")).alias("content"))
    e = e.withColumn("place", F.struct("turn", F.xxhash64("kind", "name", "content", F.to_json("arguments"))))
    ids = (e.where("kind IN ('call', 'result') AND call_id IS NOT NULL").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
           .agg(F.min(F.when(F.col("kind") == "call", F.col("place"))).alias("first_call"),
                F.min(F.when(F.col("kind") == "result", F.col("place"))).alias("first_result")))
    joined = e.join(ids.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    own, other = (F.when(F.col("kind") == "call", F.col(a)).otherwise(F.col(b))
                  for a, b in (("first_call", "first_result"), ("first_result", "first_call")))
    state = (F.when(F.col("kind") == "message", F.lit(None).cast("string"))
             .when(F.col("place") != own, "repeated")
             .when(F.col("call_id").isNull() | other.isNull(), F.when(F.col("kind") == "call", "open").otherwise("orphan"))
             .otherwise("linked"))
    linked = joined.withColumn("state", state).drop("c", "i", "first_result", "place").withColumn(
        "call_turn", F.when((F.col("kind") == "result") & F.col("first_call").isNotNull(), F.col("first_call.turn"))).drop("first_call")
    count = tools.limit(SCHEMAS + 1).count()
    known = tools.select("name", "fields")
    if count <= SCHEMAS:
        known = F.broadcast(known)
    checked = linked.join(known, "name", "left")
    is_object = F.coalesce(F.schema_of_variant("arguments").startswith("OBJECT"), F.lit(False))
    errors = (F.when(F.col("kind") != "call", F.lit(None).cast("array<string>"))
              .when(F.col("fields").isNull(), F.array(F.lit("tool")))
              .when(~is_object, F.array(F.lit("arguments")))
              .otherwise(_errors(F.when(is_object, F.col("arguments")), F.col("fields"))))
    return checked.withColumn("errors", errors).drop("fields")


def _references(arguments: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.to_json(arguments), F.lit(r'\{"\$result":"([^"\\]+)"\}'), F.lit(1)))


def order(linked: DataFrame, folder: str) -> DataFrame:
    """Adds ``key`` (greatest turn on a path to the event), ``depth`` (its length) and ``cyclic``."""
    refs = F.when(F.col("kind") == "call", _references(F.col("arguments"))).otherwise(F.array().cast("array<string>"))
    rows = linked.withColumn("refs", refs)
    calls = stage(rows.where("kind = 'call' AND call_id IS NOT NULL").groupBy("conv_id", "call_id")
                  .agg(F.min("turn").alias("turn"), F.flatten(F.collect_set("refs")).alias("refs")), folder, "calls")
    edges = (calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).alias("a")
             .join(calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).alias("b"),
                   F.col("a.conv_id").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("i"))).select("conv_id", "call_id", "ref"))
    edges = stage(edges.distinct(), folder, "edges")
    waiting = edges.groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.count(F.lit(1)).alias("need"))
    waiting = stage(calls.select("conv_id", "call_id", "turn").join(
        waiting, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i"))).drop("c", "i"), folder, "waiting")
    ready = stage(calls.join(waiting.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i")),
                             F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left_anti")
                  .select("conv_id", "call_id", F.col("turn").alias("key"), F.lit(0).alias("depth")), folder, "ready-0")
    step = 0
    while not waiting.isEmpty():
        step += 1
        had = edges.join(ready.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "key", "depth"),
                         F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ref") == F.col("i")))
        had = had.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("got"), F.max("key").alias("k"), F.max("depth").alias("d"))
        met = waiting.alias("w").join(had.alias("h"), F.col("w.conv_id").eqNullSafe(F.col("h.conv_id")) & (F.col("w.call_id") == F.col("h.call_id")), "left")
        done = stage(met.where("got = need").select("w.conv_id", "w.call_id", F.greatest("turn", "k").alias("key"),
                                                   (F.col("d") + 2).alias("depth")), folder, f"ready-{step}")
        if done.isEmpty():
            break
        ready = ready.unionByName(done)
        waiting = stage(met.where("got IS NULL OR got < need").select("w.conv_id", "w.call_id", "turn", "need"), folder, f"waiting-{step}")
    keyed = ready.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("key").alias("k"), F.col("depth").alias("d"))
    both = rows.join(keyed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    known = F.col("k").isNotNull() & (F.col("kind") != "message")
    result = F.col("kind") == "result"
    return (both.withColumn("key", F.when(known, F.greatest("turn", "k")).when(result, F.greatest("turn", F.coalesce("call_turn", "turn"))).otherwise(F.col("turn")))
            .withColumn("depth", F.when(known & ~result, F.col("d")).when(known, F.col("d") + 1).when(result, 1).otherwise(0))
            .withColumn("cyclic", (F.col("kind") == "call") & F.col("call_id").isNotNull() & F.col("k").isNull()).drop("c", "i", "k", "d", "refs"))


def event_json(kind: str = "kind") -> Column:
    """One event as canonical JSON."""
    is_call, is_result = F.col(kind) == "call", F.col(kind) == "result"
    return F.to_json(F.struct(
        F.when(is_call, F.col("arguments")).alias("arguments"),
        F.when(~is_call, F.col("content")).alias("content"),
        F.when(F.col("cyclic"), F.lit(True)).alias("cyclic"),
        F.when(is_call & (F.size("errors") > 0), F.col("errors")).alias("errors"),
        F.when(is_call | is_result, F.col("call_id")).alias("id"),
        F.when(is_call, F.col("name")).alias("name"),
        F.when(is_call, F.lit("assistant")).when(is_result, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(is_call | is_result, F.col("state")).alias("state")))


def transcripts(events: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, part, n_events, n_linked, n_invalid, chat): canonical JSON lists of at most ``PART`` turns."""
    folder = shared_folder(events.sparkSession)
    linked = stage(link(events, tools), folder, "linked")
    placed = order(linked, folder)
    rows = placed.select("conv_id", F.floor(F.col("key") / PART).alias("part"), "kind", "state", "errors",
                         F.struct("key", "depth", "turn", event_json().alias("json")).alias("e"))
    return (rows.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if((F.col("kind") == "call") & (F.col("state") == "linked")).alias("n_linked"),
        F.count_if(F.size("errors") > 0).alias("n_invalid"),
        F.array_sort(F.collect_list("e")).alias("es"))
        .select("conv_id", "part", "n_events", "n_linked", "n_invalid",
                F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["json"]), ","), F.lit("]")).alias("chat")))


#: The tools of ``conversation_events``.
DIALOGUE_TOOLS = {"reply": [("after", "object", False), ("text", "string", True), ("turn", "integer", True)]}


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Tool events of plain conversations: a user's turn calls ``reply``, the assistant's next turn is its result.

    A call's id is its conversation and turn; it refers to the result of the conversation's turn 0 or 1,
    whichever the user opened.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    opening = F.when(F.col("turn") % 2 == 0, 0).otherwise(1)
    call_id = lambda turn: F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string"))
    is_user, is_reply = F.col("role") == "user", F.col("role") == "assistant"
    after = F.when(F.col("turn") > 1, F.struct(call_id(opening).alias("$result")))
    return c.select(
        "conv_id", "turn", F.when(is_user, "call").when(is_reply, "result").otherwise("message").alias("kind"),
        F.when(is_user, call_id(F.col("turn"))).when(is_reply, call_id(F.col("turn") - 1)).alias("call_id"),
        F.when(is_user, F.lit("reply")).alias("name"), "role",
        F.when(is_user, F.to_json(F.struct(after.alias("after"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn")))).alias("arguments"),
        F.when(~is_user, F.col("text")).alias("content"))


#: The same result in one statement, where turns are unique in a conversation.
ORACLE = """
WITH e AS (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lag(turn) OVER w AS last_turn, lag(role) OVER w AS last_role
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
j AS (SELECT conv_id, turn, role,
             role = 'user' AND next_turn = turn + 1 AND next_role = 'assistant' AS linked,
             CASE WHEN role = 'user' THEN
               '{"arguments":{' || CASE WHEN turn > 1 THEN '"after":{"$result":"c-' || conv_id || '-' || turn % 2 || '"},' ELSE '' END
               || '"text":' || CAST(to_json(coalesce("text", '')) AS VARCHAR) || ',"turn":' || turn || '},"id":"c-' || conv_id || '-' || turn
               || '","name":"reply","role":"assistant","state":"' || CASE WHEN coalesce(next_turn = turn + 1 AND next_role = 'assistant', false) THEN 'linked' ELSE 'open' END || '"}'
             WHEN role = 'assistant' THEN
               '{"content":' || CAST(to_json(coalesce("text", '')) AS VARCHAR) || ',"id":"c-' || conv_id || '-' || (turn - 1) || '","role":"tool","state":"'
               || CASE WHEN coalesce(last_turn = turn - 1 AND last_role = 'user', false) THEN 'linked' ELSE 'orphan' END || '"}'
             ELSE '{"content":' || CAST(to_json(coalesce("text", '')) AS VARCHAR) || ',"role":"' || role || '"}' END AS chat
      FROM e)
SELECT conv_id, CAST(floor(turn / 512) AS BIGINT) AS part, count(*) AS n_events, count(*) FILTER (WHERE linked) AS n_linked,
       CAST(0 AS BIGINT) AS n_invalid, '[' || string_agg(chat, ',' ORDER BY turn) || ']' AS chat
FROM j GROUP BY conv_id, 2
"""
