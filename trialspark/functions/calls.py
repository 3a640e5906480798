"""Tool calls of a model reply: the native field, or JSON objects written in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

_NATIVE = "array<struct<id string, function struct<name string, arguments variant>>>"


def _object_or_empty(args: Column) -> Column:
    """JSON text of an object; anything else becomes {}."""
    return F.when(F.schema_of_variant(args).startswith("OBJECT"), F.to_json(args)).otherwise("{}")


def native_calls(messages: DataFrame) -> DataFrame:
    """One row per entry of `tool_calls` (JSON text): call number, id, name and argument object."""
    each = (messages.where(F.col("tool_calls").isNotNull())
            .select("*", F.posexplode(F.from_json("tool_calls", _NATIVE)).alias("_i", "_c")))
    raw = F.col("_c.function.arguments")
    # Arguments come as an object, or as JSON text that may be blank or broken.
    is_text = F.schema_of_variant(raw) == "STRING"
    args = F.when(is_text, _object_or_empty(F.try_parse_json(F.try_variant_get(raw, "$", "string")))
                  ).otherwise(_object_or_empty(raw))
    name = F.coalesce(F.col("_c.function.name"), F.lit(""))
    call_id = F.coalesce(F.nullif(F.col("_c.id"), F.lit("")), F.concat(F.lit("call_"), F.col("_i")))
    return each.select(*messages.columns, F.col("_i").alias("call"), call_id.alias("call_id"),
                       name.alias("name"), F.coalesce(args, F.lit("{}")).alias("args"))


_STRING = r'"(?:[^"\\]|\\.)*+"'
#: JSON text falls into strings, braces, and stretches of anything else.
_TOKEN = _STRING + r'|[{}]|[^"{}]++|"'


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _balanced(text: Column) -> Column:
    """A text from its first character, a brace, to the brace that closes it; empty if none does. Braces in strings do not count."""
    def step(at: Column, token: Column) -> Column:
        depth = at["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        size = at["size"] + F.length(token)
        return F.when(at["end"] > 0, at).otherwise(F.struct(depth.alias("depth"), size.alias("size"), F.when(depth == 0, size).otherwise(0).alias("end")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(0).alias("end"))
    return text.substr(F.lit(1), F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step)["end"])


def _parsed(span: Column) -> Column:
    """The object a span says, or null. Numbers that JSON does not know (NaN, Infinity) are null in it."""
    marked = F.regexp_replace(span, f"({_STRING})|(NaN|-?Infinity)", "$1\u0001$2")
    known = F.replace(F.regexp_replace(marked, "\u0001(NaN|-?Infinity)", "null"), F.lit("\u0001"), F.lit(""))
    return F.coalesce(F.try_parse_json(span), F.try_parse_json(known))


def _objects(text: Column) -> Column:
    """JSON texts of the objects in a text that lie in no other one, in order.

    A fold over the text's opening braces: a brace whose balanced stretch is JSON is an object, and the braces in it
    are passed over; any other brace is left, and the next one is looked at. The cost is that of reading the rest of the text once per brace left.
    """
    count = lambda part: F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit("")))
    braces = count(text)

    def step(at: Column, left: Column) -> Column:
        # The text from the brace that has `left` braces from itself to the end.
        rest = F.concat(F.lit("{"), F.call_function("substring_index", text, F.lit("{"), -left))
        found = lambda span: F.when(
            _parsed(span).isNotNull(), F.struct((count(span) - 1).alias("skip"), F.concat(at["spans"], F.array(span)).alias("spans"))
        ).otherwise(F.struct(F.lit(0).alias("skip"), at["spans"].alias("spans")))
        return F.when(at["skip"] > 0, F.struct((at["skip"] - 1).alias("skip"), at["spans"].alias("spans"))).otherwise(_let(rest, lambda r: _let(_balanced(r), found)))

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("spans"))
    return F.when(braces > 0, F.aggregate(F.sequence(braces, F.lit(1), F.lit(-1)), start, step)["spans"])


def text_calls(messages: DataFrame) -> DataFrame:
    """One row per call written as JSON in `content`: the objects in it that name a tool, numbered in order.

    The arguments are those of `arguments`, or of `parameters` where that is missing or empty; {} if they are no object.
    """
    likely = messages.where(F.contains(F.col("content"), F.lit("{")))
    objects = F.transform(_objects(F.col("content")), lambda s: F.struct(_parsed(s).alias("v")))
    member = lambda v, key: F.try_variant_get(v, f"$.{key}", "variant")
    named = lambda o: (F.schema_of_variant(member(o["v"], "name")) == "STRING") & F.try_variant_get(o["v"], "$.name", "string").isin(*C.TOOL_NAMES)
    given = lambda v: F.when(~F.to_json(v).rlike(r'^(null|false|-?0(\.0+)?(E-?\d+)?|""|\[\]|\{\})$'), v)
    each = likely.select("*", F.posexplode(F.filter(objects, lambda o: F.coalesce(named(o), F.lit(False)))).alias("call", "_o"))
    args = F.coalesce(given(member(F.col("_o.v"), "arguments")), given(member(F.col("_o.v"), "parameters")))
    return each.select(*messages.columns, "call", F.concat(F.lit("text_call_"), F.col("call")).alias("call_id"),
                       F.try_variant_get("_o.v", "$.name", "string").alias("name"), F.coalesce(_object_or_empty(args), F.lit("{}")).alias("args"))


def tool_calls(messages: DataFrame) -> DataFrame:
    """All calls; a message with native calls is not searched for written ones."""
    has_native = F.coalesce(F.size(F.from_json("tool_calls", _NATIVE)), F.lit(0)) > 0
    return (native_calls(messages).withColumn("native", F.lit(True))
            .unionByName(text_calls(messages.where(~has_native)).withColumn("native", F.lit(False))))


def command_of(args: Column) -> Column:
    """The command text of a call; null unless it is a JSON string."""
    value = F.try_parse_json(args)
    at = F.try_variant_get(value, "$.command", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, "$.command", "string"))
