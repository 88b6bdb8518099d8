"""Chat formatting with linked tool calls.

Messages are rows (conversation, turn, role, text). An assistant text that is a JSON object with ``tool_calls``, a list
of ``{"id", "name", "arguments", "after"}``, holds calls; ``after`` names calls it has to follow. A text of role
``tool`` that is a JSON object with ``tool_call_id`` and ``content`` is a result. Everything else is a plain message.

Calls and results meet in an equi-join on (conversation, identifier), so a conversation with a third of all rows is
spread over its identifiers; no conversation is gathered into one row or task. Calls are levelled: a call is one above
the highest call it follows. Rows sorted by (conv_id, order_turn, level, kind, turn, part) are in topological order:
every call after the calls it names, every result after its call. JSON is canonical because variants keep object keys
sorted and write no spaces.

Arguments are checked against the tools' schemas. Schemas that are given hold for all conversations and are compiled into
one expression. Without them a conversation's own hold: a text of role ``system`` that is a JSON object with ``tools``, a
list of ``{"name", "parameters": {"properties": {argument: {"type"}}, "required"}}``, declares tools, of equal names the
first by turn. They meet the calls on (conversation, name). In a conversation that declares none, calls are not checked.
The declaring text is a plain message.

Status of a row: ``ok``; for calls ``no_result``, ``duplicate_id``, ``unknown_tool``, ``bad_arguments``, ``missing_call``
(it follows a call that is not there), ``cycle``; for results ``orphan`` and ``duplicate_id``. The first of several
applies in the order bad id, cycle, missing, tool, arguments, result.

Defined results: null text is empty. A null conversation or turn is kept and linked with nothing. A call without an
identifier is linked with nothing and has no result. Broken JSON is a plain message. Repeated rows are kept; of equal
identifiers in a conversation the first by turn and place counts, the others are duplicates. An empty table gives an
empty result. Further columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import only
from tripleframe.session import cut_lineage

# name -> {argument: (type, required)}; types: string integer number boolean array object
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALLS = "tool_calls array<struct<id: string, name: string, arguments: variant, after: array<string>>>"
_RESULT = "tool_call_id string, content variant"
_TOOL = "name: string, parameters: struct<properties: map<string, struct<type: string>>, required: array<string>>"
_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<.*>$",
    "object": "^OBJECT<.*>$",
}


def arguments_fit(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """True where the arguments are an object with all required keys, no unknown ones, and values of the right type."""
    fits = F.lit(False)
    for tool, keys in schemas.items():
        here = F.coalesce(F.schema_of_variant(arguments).rlike("^OBJECT<"), F.lit(False))
        given = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        here = here & (F.size(F.array_except(given, F.array(*[F.lit(k) for k in keys]).cast("array<string>"))) == 0)
        for key, (kind, required) in keys.items():
            found = F.schema_of_variant(F.try_variant_get(arguments, "$['" + key.replace("'", "\\'") + "']", "variant"))
            right = found.rlike(_TYPES[kind])
            here = here & F.when(F.array_contains(given, key), F.coalesce(right, F.lit(False))).otherwise(F.lit(not required))
        fits = F.when(name == tool, here).otherwise(fits)
    return fits


def _declared(rows: DataFrame) -> DataFrame:
    """(conv_id, name, properties, required): the tools that conversations declare."""
    tools = (
        rows.filter((F.col("role") == "system") & F.col("text").startswith("{"))
        .select("conv_id", "turn", F.explode(F.from_json("text", f"tools array<struct<{_TOOL}>>")["tools"]).alias("tool"))
        .filter(F.col("tool")["name"].isNotNull())
    )
    first = tools.groupBy("conv_id", F.col("tool")["name"].alias("name")).agg(
        F.min(F.struct("turn", F.to_json("tool").alias("json"))).alias("first")
    )
    of = F.from_json(F.col("first")["json"], f"struct<{_TOOL}>")["parameters"]
    return first.select(
        "conv_id",
        "name",
        F.coalesce(of["properties"], F.create_map().cast("map<string, struct<type: string>>")).alias("properties"),
        F.coalesce(of["required"], F.array().cast("array<string>")).alias("required"),
    )


def _fit_declared(arguments: Column, properties: Column, required: Column) -> Column:
    """As :func:`arguments_fit`, for a schema that lies in columns; types that are not known fit everything."""
    given = F.try_variant_get(arguments, "$", "map<string, variant>")
    kinds = F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])
    right = F.forall(
        F.map_entries(given),
        lambda x: F.map_contains_key(properties, x["key"])
        & F.coalesce(F.rlike(F.schema_of_variant(x["value"]), kinds[properties[x["key"]]["type"]]), kinds[properties[x["key"]]["type"]].isNull()),
    )
    return F.coalesce(right & (F.size(F.array_except(required, F.map_keys(given))) == 0), F.lit(False))


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level, order_turn) of every call that is in no cycle and follows none."""
    edges = cut_lineage(
        calls.select("conv_id", "id", "turn", F.explode("after").alias("dep"))
        .join(calls.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"])
        .distinct()
    )
    followers = edges.groupBy("conv_id", "id").agg(F.count("*").alias("n"), F.first("turn").alias("turn"))
    done = calls.join(followers.select("conv_id", "id"), ["conv_id", "id"], "left_anti").select(
        "conv_id", "id", F.lit(0).alias("level"), F.col("turn").alias("order_turn")
    )
    if edges.isEmpty():
        return done
    done = cut_lineage(done)
    while True:
        before = done.select("conv_id", F.col("id").alias("dep"), "level", "order_turn")
        ready = (
            edges.join(done.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
            .join(before, ["conv_id", "dep"])
            .groupBy("conv_id", "id")
            .agg(F.count("*").alias("met"), F.max("level").alias("high"), F.max("order_turn").alias("late"))
            .join(followers, ["conv_id", "id"])
            .filter("met = n")
            .select("conv_id", "id", (F.col("high") + 1).alias("level"), F.greatest("late", "turn").alias("order_turn"))
        )
        ready = cut_lineage(ready)
        if ready.isEmpty():
            return done
        done = cut_lineage(done.union(ready))


def format_chats(
    messages: DataFrame,
    schemas: Schemas | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row for each plain message, call and result.

    (conv_id, turn, part, role, kind, call_id, level, order_turn, linked_turn, status, json); kind is 0 for messages, 1
    for calls, 2 for results, part the place of a call in its message, linked_turn the turn of the result or the call.
    """
    rows = only(messages, conv_id=conv_id, turn=turn, role=role, text=text).withColumn(
        "text", F.coalesce("text", F.lit(""))
    )
    is_json = F.col("text").startswith("{")
    rows = rows.withColumn(
        "calls", F.when((F.col("role") == "assistant") & is_json, F.from_json("text", _CALLS)["tool_calls"])
    ).withColumn("result", F.when((F.col("role") == "tool") & is_json, F.from_json("text", _RESULT)))
    has_calls = F.coalesce(F.size("calls") > 0, F.lit(False))
    has_result = F.col("result")["tool_call_id"].isNotNull()

    plain = rows.filter(~has_calls & ~has_result).select(
        "conv_id",
        "turn",
        F.lit(0).alias("part"),
        "role",
        F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(0).alias("level"),
        F.col("turn").alias("order_turn"),
        F.lit(None).cast(messages.schema[turn].dataType).alias("linked_turn"),
        F.lit("ok").alias("status"),
        F.to_json(F.struct(F.col("text").alias("content"), "role")).alias("json"),
    )

    every_call = rows.filter(has_calls).select("conv_id", "turn", "role", F.posexplode("calls").alias("part", "call"))
    every_call = every_call.select(
        "conv_id", "turn", "role", "part", F.col("call")["id"].alias("id"), F.col("call")["name"].alias("name"),
        F.col("call")["arguments"].alias("arguments"), F.col("call")["after"].alias("after"),
        F.monotonically_increasing_id().alias("row"),
    )
    every_call = cut_lineage(
        every_call.select(
            "conv_id", "turn", "role", "part", "id", "name", "row",
            F.coalesce("after", F.array().cast("array<string>")).alias("after"),
            (F.lit(True) if schemas is None else arguments_fit(F.col("name"), F.col("arguments"), schemas)).alias("fits"),
            F.coalesce(F.to_json("arguments"), F.lit("null")).alias("arguments"),
        )
    )
    every_result = cut_lineage(
        rows.filter(has_result).select(
            "conv_id", "turn", "role", F.col("result")["tool_call_id"].alias("id"),
            F.coalesce(F.to_json(F.col("result")["content"]), F.lit("null")).alias("content"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    first_call = every_call.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "part", "row")).alias("first"))
    first_result = every_result.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("first"))
    firsts = every_call.join(
        first_call.select(F.col("first")["row"].alias("row")), "row", "left_semi"
    ).filter(F.col("id").isNotNull() & F.col("conv_id").isNotNull())
    levels = _levels(firsts.select("conv_id", "id", "turn", "after"))
    wanted = firsts.select("conv_id", "id", F.explode(F.array_distinct("after")).alias("dep"))
    missing = wanted.join(
        firsts.select("conv_id", F.col("id").alias("dep")), ["conv_id", "dep"], "left_anti"
    ).select("conv_id", "id", F.lit(True).alias("missing")).distinct()

    answer = first_result.select("conv_id", "id", F.col("first")["turn"].alias("result_turn"), F.lit(True).alias("answered"))
    linked = (
        every_call.join(first_call.select("conv_id", "id", F.col("first")["row"].alias("first_row")), ["conv_id", "id"], "left")
        .join(levels, ["conv_id", "id"], "left")
        .join(missing, ["conv_id", "id"], "left")
        .join(answer, ["conv_id", "id"], "left")
    )
    if schemas is None:
        tools = _declared(rows)
        declaring = tools.select("conv_id", F.lit(True).alias("declares")).distinct()
        linked = linked.join(declaring, "conv_id", "left").join(tools, ["conv_id", "name"], "left")
        unknown = F.col("declares").isNotNull() & F.col("required").isNull()
        fits = F.col("required").isNull() | _fit_declared(F.try_parse_json("arguments"), F.col("properties"), F.col("required"))
    else:
        unknown, fits = ~F.coalesce(F.col("name").isin(list(schemas)), F.lit(False)), F.col("fits")
    status = (
        F.when(F.coalesce(F.col("row") != F.col("first_row"), F.lit(False)), "duplicate_id")
        .when(F.col("id").isNotNull() & F.col("conv_id").isNotNull() & F.col("level").isNull(), "cycle")
        .when(F.coalesce("missing", F.lit(False)), "missing_call")
        .when(unknown, "unknown_tool")
        .when(~fits, "bad_arguments")
        .when(F.col("answered").isNull(), "no_result")
        .otherwise("ok")
    )
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)
    calls = linked.select(
        "conv_id", "turn", "part", "role", F.lit(1).alias("kind"), F.col("id").alias("call_id"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("order_turn", "turn").alias("order_turn"),
        F.col("result_turn").alias("linked_turn"), status.alias("status"),
        F.concat(
            F.lit('{"arguments":'), "arguments", F.lit(',"id":'), quote(F.coalesce("id", F.lit(""))), F.lit(',"name":'),
            quote(F.coalesce("name", F.lit(""))), F.lit(',"role":"assistant"}'),
        ).alias("json"),
    )
    called = first_call.join(levels, ["conv_id", "id"], "left").select(
        "conv_id", "id", F.col("first")["turn"].alias("call_turn"), "level", F.coalesce("order_turn", F.col("first")["turn"]).alias("order_turn")
    )
    results = (
        every_result.join(first_result.select("conv_id", "id", F.col("first")["row"].alias("first_row")), ["conv_id", "id"], "left")
        .join(called, ["conv_id", "id"], "left")
        .select(
            "conv_id", "turn", F.lit(0).alias("part"), "role", F.lit(2).alias("kind"), F.col("id").alias("call_id"),
            F.coalesce("level", F.lit(0)).alias("level"), F.greatest("turn", "order_turn").alias("order_turn"),
            F.col("call_turn").alias("linked_turn"),
            F.when(F.coalesce(F.col("row") != F.col("first_row"), F.lit(False)), "duplicate_id")
            .when(F.col("call_turn").isNull(), "orphan").otherwise("ok").alias("status"),
            F.concat(
                F.lit('{"content":'), "content", F.lit(',"role":"tool","tool_call_id":'), quote(F.col("id")), F.lit("}")
            ).alias("json"),
        )
    )
    return plain.unionByName(calls).unionByName(results)
