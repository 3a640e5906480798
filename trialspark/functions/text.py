"""Text and number formats, as column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def strip(text: Column) -> Column:
    """Remove all white space around a text (SQL trim removes blanks only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def truncate_middle(text: Column, limit: int = C.OUTPUT_CHARS) -> Column:
    """Keep head and tail of a long text and say how much is missing. `limit` is at least 2."""
    if limit < 2:
        raise ValueError("limit must be at least 2")
    half, size = limit // 2, F.length(text)
    cut = F.concat(F.substring(text, 1, half), F.lit("\n...["), (size - limit).cast("string"),
                   F.lit(" characters truncated]...\n"), F.substring(text, -half, half))
    return F.when(size > limit, cut).otherwise(text)


def model_slug(model: Column) -> Column:
    return F.regexp_replace(model, "[^A-Za-z0-9._-]+", "_")


def run_dir_name(started: Column, model: Column) -> Column:
    return F.concat(F.date_format(started, "yyyyMMdd-HHmmss"), F.lit("-"), model_slug(model))


def short_id(*parts: Column) -> Column:
    """12 hex digits from the row's own key, so a retried task yields the same id."""
    return F.substring(F.sha2(F.concat_ws("/", *[p.cast("string") for p in parts]), 256), 1, 12)


def percent_halfup(part: Column, total: Column) -> Column:
    """Whole percent, halves up; a dash when there is nothing to divide by."""
    return (F.when(total != 0, F.concat(F.floor(part * F.lit(100.0) / total + 0.5).cast("string"), F.lit("%")))
            .otherwise("—"))


def percent_half_even(share: Column) -> Column:
    return F.call_function("format_number", share, F.lit("0%"))


def fixed(number: Column, places: int) -> Column:
    """Fixed places, halves of the exact double to even."""
    return F.call_function("format_number", number, F.lit("0." + "0" * places if places else "0"))


def round_dp(number: Column, places: int) -> Column:
    return fixed(number, places).cast("double")


def seconds_text(value: Column) -> Column:
    """'12.3s' below a minute, then '2m 5s'. Exact halves go up, as the dashboard shows them."""
    quarters = value * 4
    tie = (quarters == F.floor(quarters)) & (F.pmod(F.floor(quarters), F.lit(2)) == 1)
    tenths = F.when(tie, fixed(F.floor(value * 10 + 0.5) / 10, 1)).otherwise(fixed(value, 1))
    minutes = F.concat(F.floor(value / 60).cast("string"), F.lit("m "),
                       F.floor(value % 60 + 0.5).cast("string"), F.lit("s"))
    return (F.when(value.isNull(), "—").when(value < 60, F.concat(tenths, F.lit("s"))).otherwise(minutes))


def time_ago(at_micros: Column, now_micros: Column) -> Column:
    """Age in words; from a day on the ISO date."""
    age = F.floor((now_micros - at_micros) / 1_000_000 + 0.5)
    date = F.date_format(F.timestamp_micros(at_micros), "yyyy-MM-dd")
    return (F.when(age < 60, "just now")
            .when(age < 3600, F.concat(F.floor(age / 60).cast("string"), F.lit("m ago")))
            .when(age < 86400, F.concat(F.floor(age / 3600).cast("string"), F.lit("h ago")))
            .otherwise(date))


def iso_timestamp(at_micros: Column) -> Column:
    """ISO text in UTC; the fraction is left out when it is zero."""
    stamp = F.timestamp_micros(at_micros)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.when(at_micros % 1_000_000 == 0, "").otherwise(F.date_format(stamp, ".SSSSSS"))
    return F.concat(whole, part, F.lit("+00:00"))


def jsonable(value: Column, kind: T.DataType) -> Column:
    """`value` with every timestamp and date in it as ISO text, at any depth of structs, arrays and map values.

    All else stays as it is, nulls included; a value without times is passed on untouched. A timestamp without a zone has no offset.
    """
    if not _holds_time(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[jsonable(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: jsonable(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: jsonable(v, kind.valueType))
    if isinstance(kind, T.DateType):
        return F.date_format(value, "yyyy-MM-dd")
    text = iso_timestamp(F.unix_micros(value.cast("timestamp")))
    return F.substring_index(text, "+", 1) if isinstance(kind, T.TimestampNTZType) else text


def _holds_time(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_time(f.dataType) for f in kind.fields)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return _holds_time(kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def jsonable_rows(rows: DataFrame) -> DataFrame:
    """`rows` with the times of all columns as text; names and everything else unchanged."""
    return rows.select(*[jsonable(rows[f"`{f.name}`"], f.dataType).alias(f.name) for f in rows.schema.fields])


def bytes_to_mb(size: Column) -> Column:
    return size / F.lit(1048576.0)


def line_count(text: Column) -> Column:
    """Newlines in a text; a last line without one is not counted."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
