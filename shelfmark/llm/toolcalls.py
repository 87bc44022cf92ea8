"""Chat formatting: tool calls linked to their results, in DataFrame operations only.

Calls and results meet in a hash join by identifier within their conversation.
Arguments are parsed as JSON and checked against the schema of their tool, calls
are put into topological order by the calls they need, and every linked call is
written as canonical JSON: sorted keys, no blanks, every number and string in one form.

No conversation is gathered in one task: links are joins, the order is a level per
call found by peeling (level 0 needs nothing, the next level only what is below),
with one stored table and one job per level.  Sort by level, turn and id to write
a conversation out.

Defined results: one row per call and one per result without a call.  Of several
calls with one id the first turn counts and later ones are ``duplicate_id``; of
several results the first turn (then the smaller text) counts.  Null ids link to
nothing.  Null names are unknown tools, null or unreadable arguments are
``not_an_object``.  Calls in a circle, and those behind one, have a null level.
Rows repeated with the same turn get the same result.  Empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.functions.lineage import cut

#: What the types of a schema are called by the JSON parser.
TYPES = {
    "string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN",
    "object": "OBJECT.*", "array": "ARRAY.*", "null": "VOID",
}


def _key(call_id: Column) -> Column:
    """An identifier within its conversation; null for a null id."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), call_id.cast("string"))


def json_text(value: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def tool_schemas(schemas: DataFrame) -> DataFrame:
    """One row per tool with its parameters; ``schemas`` has name, parameter, type, required."""
    pattern = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return (
        schemas.filter("name IS NOT NULL AND parameter IS NOT NULL")
        .groupBy("name", "parameter").agg(
            F.max(F.coalesce(pattern[F.col("type")], F.lit(".*"))).alias("pattern"),
            F.max(F.coalesce(F.col("required"), F.lit(False))).alias("required"))
        .groupBy("name").agg(F.array_sort(F.collect_list(F.struct("parameter", "pattern", "required"))).alias("_parameters"))
    )


def _problems(arguments: Column, parameters: Column) -> Column:
    """What the arguments lack, have in another type, or have without being asked for."""
    has = lambda p: F.map_contains_key(arguments, p["parameter"])
    lacks = F.filter(parameters, lambda p: p["required"] & ~has(p))
    wrong = F.filter(parameters, lambda p: has(p) & ~F.coalesce(
        F.rlike(F.schema_of_variant(F.element_at(arguments, p["parameter"])), F.concat(F.lit("^"), p["pattern"], F.lit("$"))), F.lit(False)))
    more = F.array_except(F.map_keys(arguments), F.transform(parameters, lambda p: p["parameter"]))
    return F.concat(
        F.transform(lacks, lambda p: F.concat(F.lit("missing "), p["parameter"])),
        F.transform(wrong, lambda p: F.concat(F.lit("type of "), p["parameter"])),
        F.transform(F.array_sort(more), lambda k: F.concat(F.lit("unknown "), k)))


def levels(edges: DataFrame) -> DataFrame:
    """_key and level (null behind a circle) of every call that needs another; ``edges`` has _key and _need."""
    left, found, level = cut(edges.distinct()), [], 0
    n = left.count()
    while n:
        level += 1
        waiting = left.select(F.col("_key").alias("_need")).distinct()
        rest = cut(left.join(waiting, "_need", "left_semi").select("_key", "_need"))
        remaining = rest.count()
        done = left.select("_key").distinct().join(rest.select("_key").distinct(), "_key", "left_anti" if remaining < n else "inner")
        found.append(done.select("_key", F.lit(level if remaining < n else None).cast("int").alias("level")))
        if remaining == n:
            break
        left, n = rest, remaining
    out = edges.select("_key", F.lit(0).alias("level")).limit(0)
    for rows in found:
        out = out.unionByName(rows)
    return out


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, call_id, name, level, status, problems, json.

    ``calls`` has conv_id, turn, call_id, name, arguments (JSON text) and needs
    (array of call ids), ``results`` has conv_id, turn, call_id, content.
    """
    asked = calls.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("call_id").cast("string").alias("call_id"), F.col("name").cast("string").alias("name"),
        F.col("arguments").cast("string").alias("arguments"), F.col("needs").cast("array<string>").alias("needs"),
    ).withColumn("_key", _key(F.col("call_id")))
    answers = results.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("call_id").cast("string").alias("call_id"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"),
    ).withColumn("_key", _key(F.col("call_id")))

    firsts = asked.filter("_key IS NOT NULL").groupBy("_key").agg(F.min("turn").alias("_first"))
    chosen = (
        answers.filter("_key IS NOT NULL").groupBy("_key", "conv_id", "call_id")
        .agg(F.min(F.struct("turn", "content")).alias("_answer"))
    )
    needs = asked.filter("_key IS NOT NULL").join(firsts, "_key").filter("turn <=> _first").select(
        "_key", F.explode("needs").alias("_id"), "conv_id")
    pairs = needs.filter("_id IS NOT NULL").select("_key", _key(F.col("_id")).alias("_need")).distinct()
    known = firsts.select(F.col("_key").alias("_need"), F.lit(True).alias("_known"))
    wanted = cut(pairs.join(known, "_need", "left"))
    order = levels(wanted.filter("_known").select("_key", "_need"))
    lacking = wanted.filter("_known IS NULL").select("_key").distinct().withColumn("_lacking", F.lit(True))
    behind = order.withColumn("_ordered", F.lit(True))

    variant = F.try_parse_json("arguments")
    rows = (
        asked.join(firsts, "_key", "left")
        .join(chosen.select("_key", "_answer").hint("shuffle_hash"), "_key", "left")
        .join(behind, "_key", "left").join(lacking, "_key", "left")
        .join(tool_schemas(schemas), "name", "left")
        .withColumn("_arguments", F.try_variant_get(variant, "$", "map<string,variant>"))
        .withColumn("_problems", F.when(
            F.col("_parameters").isNotNull() & F.col("_arguments").isNotNull(), _problems(F.col("_arguments"), F.col("_parameters"))))
    )
    level = F.when(F.col("_ordered"), F.col("level")).otherwise(F.lit(0))
    status = (
        F.when(F.col("_key").isNull(), "no_id")
        .when(F.col("turn") > F.col("_first"), "duplicate_id")
        .when(F.col("_parameters").isNull(), "unknown_tool")
        .when(F.col("_arguments").isNull(), "not_an_object")
        .when(F.size("_problems") > 0, "bad_arguments")
        .when(F.col("_lacking"), "missing_need")
        .when(level.isNull(), "circle")
        .when(F.col("_answer").isNull(), "no_result")
        .otherwise("ok")
    )
    canonical = F.when(F.col("_arguments").isNull(), F.lit("null")).otherwise(F.to_json(variant))

    def line(arguments: Column, name: Column, content: Column) -> Column:
        return F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(F.col("call_id")), F.lit(',"name":'),
                        json_text(name), F.lit(',"result":'), json_text(content), F.lit("}"))

    linked = rows.select(
        "conv_id", "turn", "call_id", "name", level.alias("level"), status.alias("status"),
        F.coalesce(F.array_join("_problems", ", "), F.lit("")).alias("problems"),
        line(canonical, F.col("name"), F.col("_answer.content")).alias("json"))
    nobody = F.lit(None).cast("string")
    orphans = chosen.join(firsts, "_key", "left_anti").select("conv_id", "call_id", "_answer").unionByName(
        answers.filter("_key IS NULL").select("conv_id", "call_id", F.struct("turn", "content").alias("_answer")))
    return linked.unionByName(orphans.select(
        "conv_id", F.col("_answer.turn").alias("turn"), "call_id", nobody.alias("name"), F.lit(None).cast("int").alias("level"),
        F.lit("orphan_result").alias("status"), F.lit("").alias("problems"),
        line(F.lit("null"), nobody, F.col("_answer.content")).alias("json")))
