"""Chat formatting with tool-call linking, with DataFrame functions only.

A message is a row (conversation, turn, role, text). An assistant's text may be a JSON object with `content` and
`tool_calls` (each with id, name, arguments as an object or as its JSON text, and optionally depends_on, a list of
ids); a tool's text may be a JSON object with `tool_call_id` and `content`. Any other text is plain content.

* Calls and results are hash-joined by (conversation, id). Of calls that share an id the first one gets the results; a
  later one, and a call without an id or a conversation, is written and checked like any other and stays unanswered.
* Order is topological: a call comes after the calls it depends on (order_level), and a result that stands before its
  call is put behind it (order_turn). Sort a conversation by order_turn, order_level, turn.
* Arguments are checked against the tools' schemas: required names, unknown names, types. The schemas are a catalogue that
  is given for all conversations, or else what a conversation itself declares: a system's text may be a JSON object with
  `tools`, each with name, required and properties, these two also under `parameters` or `input_schema`, and all of it also
  under `function`. Declarations are hash-joined to calls by (conversation, name).
* A message is serialised as canonical JSON: keys sorted, no blanks. VARIANT keeps object keys sorted, at any depth.
  Its calls are checked and written inside its own row, so each is there whatever it links to.

Nothing is grouped by conversation, so one conversation may hold any share of the rows.

Defined results: null text is empty content; a null conversation links nothing and declares nothing; rows that repeat are formatted each;
arguments that are absent are {}, and text that is no JSON is kept as a JSON string, with the error `not JSON`; an absent
id is null; an entry of tool_calls that is no object is kept as it is, with the error `not an object`;
without a catalogue, calls of a conversation that declares no tools meet no schema, and in one that does a tool it doesn't name is
`unknown tool`; of declarations of one name the first counts, of parameters without a type any value will do;
a result without a call is `orphan`; calls in a circle of dependencies, and those after one, are `cycle`; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import cut, shuffle_parts


def _json_type(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(t == "BIGINT", "integer").when(t == "DOUBLE", "number").when(t.startswith("DECIMAL"), "number").when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null"))


def tool_schemas(tools: list[dict]) -> Column:
    """The catalogue (a parameter) as an array of (name, required, types)."""
    rows = [
        F.struct(
            F.lit(t["name"]).alias("name"), F.array(*map(F.lit, t.get("required", []))).cast("array<string>").alias("required"),
            F.from_json(F.lit(json.dumps({k: p.get("type", "any") for k, p in t.get("properties", {}).items()})), "map<string,string>").alias("types"))
        for t in tools
    ]
    return F.array(*rows)


def declared_tools(rows: DataFrame) -> DataFrame:
    """conv_id, name (null: the conversation declares tools at all), required, types: what system messages declare. rows: as parsed() gives them."""
    every = F.try_variant_get("v", "$.tools", "array<variant>")
    said = rows.where("role = 'system' and v is not null and conv_id is not null").select("conv_id", "turn", _key().alias("key"), every.alias("t")).where("t is not null")
    of = lambda c, path: F.try_variant_get(c, path, "variant")
    one = said.select("conv_id", "turn", "key", F.posexplode("t").alias("pos", "c")).withColumn("c", F.coalesce(of("c", "$.function"), F.col("c")))
    one = one.withColumn("s", F.coalesce(of("c", "$.parameters"), of("c", "$.input_schema"), F.col("c")))
    types = F.transform_values(F.coalesce(F.try_variant_get("s", "$.properties", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
                               lambda _, p: F.coalesce(F.try_variant_get(p, "$.type", "string"), F.lit("any")))
    required = F.coalesce(F.try_variant_get("s", "$.required", "array<string>"), F.array().cast("array<string>"))
    one = one.select("conv_id", F.try_variant_get("c", "$.name", "string").alias("name"), F.struct("turn", "pos", "key").alias("at"), F.struct(required.alias("required"), types.alias("types")).alias("schema")).where("name is not null")
    first = one.groupBy("conv_id", "name").agg(F.min_by("schema", "at").alias("schema")).select("conv_id", "name", "schema.*")
    any_ = said.select("conv_id").distinct()
    return first.unionByName(any_, allowMissingColumns=True)


def _errors(args: Column, required: Column, types: Column) -> Column:
    """What is wrong with a call's arguments, sorted; empty if nothing."""
    entries = F.try_variant_get(args, "$", "map<string,variant>")
    names = F.map_keys(entries)
    wrong = F.filter(names, lambda k: F.map_contains_key(types, k) & (types[k] != "any") & ~(
        (_json_type(entries[k]) == types[k]) | ((types[k] == "number") & (_json_type(entries[k]) == "integer"))))
    say = lambda what, list_: F.transform(list_, lambda k: F.concat(F.lit(what + ":"), k))
    found = F.concat(say("missing", F.array_except(required, names)), say("type", wrong), say("unknown", F.array_except(names, F.map_keys(types))))
    return F.when(entries.isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(found))


def _read(c: Column) -> Column:
    """One entry of tool_calls: whole (is it an object), id, name, raw (arguments), text (those given as a text), args (parsed), after."""
    raw = F.try_variant_get(c, "$.arguments", "variant")
    text = F.when(F.schema_of_variant(raw) == "STRING", F.try_variant_get(c, "$.arguments", "string"))
    return F.struct(
        F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False)).alias("whole"), F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.name", "string").alias("name"), text.alias("text"),
        F.when(text.isNotNull(), F.try_parse_json(text)).otherwise(raw).alias("args"), F.coalesce(F.try_variant_get(c, "$.depends_on", "array<string>"), F.array().cast("array<string>")).alias("after"))


def _lost(x: Column) -> Column:
    """Are the arguments a text that is no JSON?"""
    return x["text"].isNotNull() & x["args"].isNull()


def _check(x: Column, tools: list[dict] | None) -> Column:
    """What is wrong with a call that _read gave."""
    none = F.array().cast("array<string>")
    found = none
    if tools:
        tool = F.get(F.filter(tool_schemas(tools), lambda t: t["name"] == x["name"]), F.lit(0))
        found = F.when(tool.isNull(), F.array(F.lit("unknown tool"))).otherwise(_errors(x["args"], tool["required"], tool["types"]))
    return F.when(~x["whole"], F.array(F.lit("not an object"))).when(_lost(x), F.array(F.lit("not JSON"))).otherwise(found)


def _checked(found: DataFrame, tools: list[dict] | None, rows: DataFrame) -> DataFrame:
    """Calls that _calls gave, with what is wrong with each: by the catalogue, or without one by what their conversation declares."""
    x = F.col("x")
    if tools:
        return found.withColumn("errors", _check(x, tools))
    said = declared_tools(rows)
    own = said.where("name is null").select("conv_id", F.lit(True).alias("own"))
    named = found.withColumn("name", x["name"]).join(said.where("name is not null"), ["conv_id", "name"], "left").join(own, "conv_id", "left")
    plain = _check(x, None)
    errors = F.when(F.size(plain) > 0, plain).when(F.col("types").isNotNull(), _errors(x["args"], F.col("required"), F.col("types"))).when(F.col("own"), F.array(F.lit("unknown tool"))).otherwise(plain)
    return named.select(*found.columns, errors.alias("errors"))


def _quoted(c: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("s"))), r'(?s)^\{"s":(.*)\}$', 1)


def _arguments(x: Column) -> Column:
    return F.when(_lost(x), _quoted(x["text"])).otherwise(F.coalesce(F.to_json(x["args"]), F.lit("{}")))


def _written(c: Column, x: Column) -> Column:
    """A call as canonical JSON."""
    call = F.concat(F.lit('{"arguments":'), _arguments(x), F.lit(',"id":'), F.when(x["id"].isNull(), "null").otherwise(_quoted(x["id"])), F.lit(',"name":'), _quoted(x["name"]), F.lit("}"))
    return F.when(x["whole"], call).otherwise(F.coalesce(F.to_json(c), F.lit("null")))


def _key() -> Column:
    """A message in its conversation, by turn and text, so that messages of one turn stay apart."""
    return F.sha2(F.concat_ws(" ", F.col("turn").cast("string"), F.col("text")).cast("binary"), 256)


def _calls(rows: DataFrame) -> DataFrame:
    """One row per call in a conversation."""
    c = rows.where("role = 'assistant' and v is not null and conv_id is not null").select(
        "conv_id", "turn", _key().alias("key"), F.posexplode(F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("pos", "c"))
    return c.select("conv_id", "turn", "key", "pos", _read(F.col("c")).alias("x"))


def link_calls(messages: DataFrame, tools: list[dict] | None = None) -> DataFrame:
    """One row per id of a conversation, of its first call: conv_id, id, name, call_turn, pos, arguments (canonical JSON), errors,
    level (null: in a circle, or after one)."""
    rows = parsed(messages)
    return _linked(_checked(_calls(rows), tools, rows)).drop("key")


def _linked(found: DataFrame) -> DataFrame:
    x = F.col("x")
    calls = found.where("x.id is not null").groupBy("conv_id", F.col("x.id").alias("id")).agg(
        F.min_by(F.struct("turn", "pos", "key", x["name"].alias("name"), _arguments(x).alias("arguments"), "errors", x["after"].alias("after")), F.struct("turn", "pos", "key")).alias("c"))
    calls = calls.select("conv_id", "id", "c.name", F.col("c.turn").alias("call_turn"), "c.pos", "c.arguments", "c.errors", "c.key", "c.after")
    needs = calls.select("conv_id", "id", F.explode("after").alias("on")).join(
        calls.select("conv_id", F.col("id").alias("on")), ["conv_id", "on"], "left_semi").distinct()
    if not needs.limit(1).count():
        return calls.withColumn("level", F.lit(0)).drop("after")
    return calls.join(_levels(calls.select("conv_id", "id"), cut(needs)), ["conv_id", "id"], "left").drop("after")


def _levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, id, level) of each call outside circles and not after one; needs: conv_id, id, on.

    A call that needs one other call stands one behind it: such chains are folded by doubling. A round is then spent on
    each level of calls that need several, until a round adds none.
    """
    node, at = ["conv_id", "id"], ["conv_id", "on"]
    n = needs.groupBy(*node).agg(F.count("*").alias("n"))
    chain = cut(needs.join(n.where("n = 1"), node, "left_semi").select(*node, "on", F.lit(1).cast("long").alias("d")))
    reach, size = 1, chain.count()
    while reach <= size:  # a call still on the way after as many steps as there are calls is on a circle
        step = chain.select("conv_id", F.col("id").alias("on"), F.col("on").alias("far"), F.col("d").alias("more"))
        new = cut(chain.join(step, at, "left"))
        chain = new.select(*node, F.coalesce("far", "on").alias("on"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        reach *= 2
        if not new.where("far is not null").limit(1).count():
            break
    chain = cut(chain.join(chain.select("conv_id", F.col("id").alias("on")), at, "left_anti"))  # on: without needs, or with several
    ends = chain.select("conv_id", F.col("id").alias("on"), F.col("on").alias("far"), "d")
    open_ = needs.join(n.where("n > 1"), node, "left_semi").join(ends, at, "left").select(
        *node, F.coalesce("far", "on").alias("on"), (F.coalesce("d", F.lit(0)) + 1).alias("d"), F.lit(None).cast("long").alias("got"))
    new = level = cut(calls.join(needs, node, "left_anti").withColumn("level", F.lit(0).cast("long")))
    while True:
        # a call is ready when all that it needs have a level
        open_ = cut(open_.join(new.select("conv_id", F.col("id").alias("on"), "level"), at, "left").select(*node, "on", "d", F.coalesce("got", F.col("level") + F.col("d")).alias("got")))
        new = cut(open_.groupBy(*node).agg(F.max("got").alias("level"), F.every(F.col("got").isNotNull()).alias("ok")).where("ok").drop("ok"))
        if not new.limit(1).count():
            break
        level = cut(level.union(new).coalesce(shuffle_parts(calls.sparkSession)))
        open_ = open_.join(new, node, "left_anti")
    behind = chain.join(level.select("conv_id", F.col("id").alias("on"), "level"), at).select(*node, F.col("level") + F.col("d"))
    return level.union(behind).select(*node, F.col("level").cast("int").alias("level"))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    v = F.when(F.col(role).isin("assistant", "tool", "system") & body.rlike(r"^\s*\{"), F.try_parse_json(body))
    return messages.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), body.alias("text"), v.alias("v"))


def format_messages(messages: DataFrame, tools: list[dict] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, order_turn, order_level, n_calls, n_invalid, n_unanswered, status, message."""
    rows = parsed(messages).select(
        "*", F.try_variant_get("v", "$.tool_call_id", "string").alias("result_of"), F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")).alias("content"),
        F.try_variant_get("v", "$.tool_calls", "array<variant>").alias("c"))
    is_call = (F.col("role") == "assistant") & F.col("c").isNotNull()
    is_result = (F.col("role") == "tool") & F.col("result_of").isNotNull()
    found = _checked(_calls(rows), tools, rows)
    calls = _linked(found)
    answered = rows.where(is_result).select("conv_id", F.col("result_of").alias("id")).distinct().withColumn("hit", F.lit(1))
    at = ["conv_id", "key"]
    firsts = calls.join(answered.hint("shuffle_hash"), ["conv_id", "id"], "left").select(*at, "pos", "level", F.coalesce("hit", F.lit(0)).alias("hit"))
    # no call needs one of the others, so what they need themselves gives their level in one step
    others = found.select(*at, "pos", "x.after").distinct().join(firsts, [*at, "pos"], "left_anti")
    needs = others.select(*at, "pos", F.explode("after").alias("id")).join(calls.select("conv_id", "id", "level"), ["conv_id", "id"]).groupBy(*at, "pos").agg(
        F.when(F.every(F.col("level").isNotNull()), F.max("level") + 1).alias("level"), F.lit(True).alias("some"))
    others = others.join(needs, [*at, "pos"], "left").select(*at, F.when(F.col("some").isNull(), 0).otherwise(F.col("level")).alias("level"), F.lit(0).alias("hit"))
    per_message = firsts.drop("pos").unionByName(others).groupBy(*at).agg(F.sum("hit").alias("hits"), F.max(F.col("level").isNull()).alias("circle"), F.min("level").alias("level"))
    # rows that repeat have the same calls
    wrong = found.groupBy("conv_id", "key", "pos").agg(F.max(F.size("errors") > 0).alias("bad")).where("bad").groupBy("conv_id", "key").agg(F.count("*").cast("int").alias("wrong"))
    plain = rows.where(~(is_call | is_result)).select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.lit(0).alias("order_level"), F.lit(0).alias("n_calls"), F.lit(0).alias("n_invalid"), F.lit(0).alias("n_unanswered"),
        F.lit("plain").alias("status"), F.to_json(F.struct(F.col("text").alias("content"), F.coalesce("role", F.lit("")).alias("role"))).alias("message"))
    asked = rows.where(is_call).withColumn("key", _key()).join(per_message, at, "left").join(wrong, at, "left").withColumn(
        "bad", F.when(F.col("conv_id").isNull(), F.size(F.filter("c", lambda c: F.size(_check(_read(c), tools)) > 0))).otherwise(F.coalesce("wrong", F.lit(0)))).select(
        "conv_id", "turn", "role", F.col("turn").alias("order_turn"), F.coalesce("level", F.lit(0)).alias("order_level"), F.size("c").alias("n_calls"),
        F.col("bad").alias("n_invalid"), (F.size("c") - F.coalesce("hits", F.lit(0))).cast("int").alias("n_unanswered"),
        F.when(F.col("circle"), "cycle").when(F.col("bad") > 0, "invalid").otherwise("calls").alias("status"),
        F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":"assistant","tool_calls":['),
                 F.array_join(F.transform("c", lambda c: _written(c, _read(c))), ","), F.lit("]}")).alias("message"))
    by_id = calls.select("conv_id", F.col("id").alias("result_of"), "call_turn", "level", "name")
    given = rows.where(is_result).join(by_id.hint("shuffle_hash"), ["conv_id", "result_of"], "left").select(
        "conv_id", "turn", "role", F.greatest("turn", "call_turn").alias("order_turn"), (F.coalesce("level", F.lit(0)) + 1).alias("order_level"),
        F.lit(0).alias("n_calls"), F.lit(0).alias("n_invalid"), F.lit(0).alias("n_unanswered"),
        F.when(F.col("name").isNull() & F.col("call_turn").isNull(), "orphan").when(F.col("turn") < F.col("call_turn"), "moved").otherwise("linked").alias("status"),
        F.concat(F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":"tool","tool_call_id":'), _quoted(F.col("result_of")), F.lit("}")).alias("message"))
    return plain.unionByName(asked).unionByName(given)


#: For tables whose messages are all plain, as SQL can say it; linking is tested against a brute-force version.
ORACLE = """
SELECT conv_id, turn, role, turn AS order_turn, 0 AS order_level, 0 AS n_calls, 0 AS n_invalid, 0 AS n_unanswered, 'plain' AS status,
       json_object('content', coalesce(text, ''), 'role', coalesce(role, ''))::VARCHAR AS message
FROM conversations"""
