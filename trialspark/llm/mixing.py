"""Mixing sources to target weights, by whole documents repeated at a rate per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import positions
from .common import NOT_SPACE, aside, prepare, restored, written

WEIGHTS = (1, 2, 3)
#: No target is above this many times its source's size.
MOST = 3
SEED = "mix"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the parts: 52 bits of their MD5."""
    joined = F.concat_ws("\x1f", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / (1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, size) rows -> (source, source_size, target), one per source.

    Weights repeat over the sources by code point, null last. All sizes together are shared by weight; a target stops at
    `most` times its source's size and the excess is shared anew. That ends where every target is the lesser of its limit
    and weight times one level, so the level is found in one pass: sources by limit / weight, those below it are full.
    Numbering and running sums go over sorted partitions, so many sources are no matter.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = positions(by_source, [F.col("source").asc_nulls_last()], "_n")
    weighed = numbered.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_n") - 1) % len(weights) + 1).cast("int")).cast("long"))
    # Limits in order of limit / weight; running sums per sorted partition, and one row per partition for what lies before.
    ranked = positions(weighed, [(F.col("source_size") / F.col("_w")).asc(), F.col("_n").asc()], "_r")
    block = F.floor((F.col("_r") - 1) / 10_000).alias("_block")
    blocks = (ranked.groupBy(block).agg(F.sum("source_size").alias("_s"), F.sum("_w").alias("_ws"))
              .select("_block", *[F.coalesce(F.sum(c).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b" + c) for c in ("_s", "_ws")]))
    total = ranked.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_all_w"))
    within = Window.partitionBy("_block").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    run = (ranked.withColumn("_block", block)
           .select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias("_i" + c) for c in ("source_size", "_w")])
           .join(blocks, "_block").join(F.broadcast(total)))  # one row
    left = F.col("_all") - most * (F.col("_b_s") + F.col("_isource_size"))
    open_w = F.col("_all_w") - F.col("_b_ws") - F.col("_i_w")
    level = run.withColumn("_level", left.cast("double") / open_w)
    # The level is right where the source itself is not full; before that it is too low or too high, never in between.
    fits = F.col("_level") * F.col("_w") <= most * F.col("source_size")
    found = level.where(fits).agg(F.min(F.struct("_r", "_level")).alias("_f")).select(F.col("_f._level").alias("_found"))
    return (ranked.join(F.broadcast(found))  # one row
            .select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("_w") * F.col("_found")).alias("target")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies) per row of `docs`.

    The rate of a source is target / size. Each document is taken floor(rate) times, and once more if its draw (of id and
    text) is below the rest: reruns agree, and no document is taken more than `most` times. Null and blank texts have size
    0; a source of such texts only has target and rate 0. Null sources are one source. Repeated rows draw alike. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    sizes = written(docs.select(F.col(id_col).alias("_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
                                draw(F.col(id_col), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_draw")), "mix-sizes")
    wanted = written(targets(sizes.select("source", "size"), weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = (F.floor(rate) + (F.col("_draw") < rate - F.floor(rate)).cast("int")).cast("int")
    met = sizes.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    return met.select(F.col("_id").alias(id_col), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` as the mix takes them: each row as often as its copies say, all columns kept."""
    prepare(docs.sparkSession)
    rows, named = aside(docs)
    own, body, whose = (F.col(named[c]) for c in (id_col, text, source))
    sizes = written(rows.select(whose.alias("source"), size_of(body).alias("size")), "mix-sizes")
    wanted = written(targets(sizes), "mix-targets").select(F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_size") > 0, F.col("_target") / F.col("_size")).otherwise(0.0)
    drawn = draw(own, F.md5(F.coalesce(body, F.lit(""))))
    copies = (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("int")).cast("int")
    met = rows.join(wanted, whose.eqNullSafe(F.col("_source")))
    return restored(met.select(*named.values(), F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")), named, [])
