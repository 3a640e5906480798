"""Sharding by minimax contiguous partition of ordered atomic groups.

Equal texts are one group; groups lie in CELLS cells by hash, and the cells, in order, are the atomic sizes that are cut:
their number is fixed, so they fit one row whatever the corpus. A binary search finds the smallest capacity for
which greedy filling needs no more than the wanted shards; shards are then cut there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, let, prepare, restored, written

SHARDS = 16
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: Rows of one cell that one task numbers; a cell with more (a hot text) is numbered in several parts.
PART_ROWS = 100_000


def needed(sizes: Column, capacity: Column) -> Column:
    """Shards that greedy filling takes when none may pass `capacity`."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("load"))

    def put(acc: Column, size: Column) -> Column:
        new = acc["load"].isNull() | (acc["load"] + size > capacity)
        return F.struct((acc["n"] + new.cast("int")).alias("n"), F.when(new, size).otherwise(acc["load"] + size).alias("load"))

    return F.aggregate(sizes, start, put)["n"]


def smallest_capacity(sizes: Column, shards: int) -> Column:
    """Binary search between the largest size (or the mean load) and all sizes together."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    low = F.greatest(F.array_max(sizes), F.ceil(total / shards).cast("long"))
    # Greedy filling never needs more than the mean load plus the largest size.
    high = F.ceil(total / shards).cast("long") + F.array_max(sizes)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("long")
        return F.when(acc["low"] >= acc["high"], acc).otherwise(
            F.when(needed(sizes, middle) <= shards, F.struct(acc["low"].alias("low"), middle.alias("high")))
            .otherwise(F.struct((middle + 1).alias("low"), acc["high"].alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(low.alias("low"), high.alias("high")), halve)["high"]


def cut_cells(cells: Column, shards: int, capacity: Column, even: bool) -> Column:
    """Struct of the first cells of shards 1, 2, ... and the largest load, filling greedily under `capacity`.

    With `even`, a shard is also closed where its even share of what is left is reached.
    """
    total = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["size"])
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("load"), total.alias("rest"), F.lit(0).cast("long").alias("most"),
                     F.array().cast("array<int>").alias("starts"))

    def put(acc: Column, c: Column) -> Column:
        full = acc["load"] + c["size"] > capacity
        if even:
            full = full | ((2 * acc["load"] + c["size"]) * (shards - acc["n"]) > 2 * (acc["load"] + acc["rest"]))
        new = (acc["load"] > 0) & (acc["n"] < shards - 1) & full
        load = F.when(new, c["size"]).otherwise(acc["load"] + c["size"])
        return F.struct((acc["n"] + new.cast("int")).alias("n"), load.alias("load"), (acc["rest"] - c["size"]).alias("rest"), F.greatest(acc["most"], load).alias("most"),
                        F.when(new, F.array_append(acc["starts"], c["cell"])).otherwise(acc["starts"]).alias("starts"))

    return F.aggregate(cells, start, put)


def shard_starts(cells: Column, shards: int) -> Column:
    """First cells of shards 1, 2, ...: even cuts where they keep to the smallest capacity, greedy ones else.

    Both have the smallest possible largest load; even cuts spread the other shards when one huge group sets it.
    """
    return let(smallest_capacity(F.transform(cells, lambda c: c["size"]), shards),
               lambda capacity: let(cut_cells(cells, shards, capacity, True),
                                    lambda e: F.when(e["most"] <= capacity, e["starts"]).otherwise(cut_cells(cells, shards, capacity, False)["starts"])))


def sharded(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = SHARDS, carry: bool = False, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row, or with `carry` all columns and those four.

    size is the text's UTF-8 bytes plus 1; a null text counts as empty and shares its group. Equal texts share a shard; slots run
    from 0 without gaps in each shard, cell by cell. Within a cell of at most `part_rows` rows they go by id and text; a larger
    one goes by parts, that many rows each, dealt by a hash of the id. With `carry`, columns of `docs` that bear the names of results are replaced. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    new = ["size", "text_crc32", "shard", "slot"]
    rows, named = aside(docs)
    keep = {c: n for c, n in named.items() if (c not in new if carry else c == id_col)}
    own, t = F.col(named[id_col]), F.coalesce(F.col(named[text]), F.lit(""))
    base = rows.select(*keep.values(), (F.octet_length(t).cast("long") + 1).alias("size"), F.crc32(t).alias("text_crc32"),
                       F.shiftrightunsigned(F.xxhash64(t), 64 - CELL_BITS).cast("int").alias("_cell"))
    if not carry:
        base = written(base, "shard-sizes")
    # At most CELLS rows, so one row can hold them.
    cells = base.groupBy("_cell").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    row = cells.agg(F.sort_array(F.collect_list(F.struct(F.col("_cell").alias("cell"), "size", "n"))).alias("cells")).where(F.size("cells") > 0)
    planned = (row.select("cells", shard_starts(F.col("cells"), shards).alias("starts")).select("starts", F.explode("cells").alias("c"))
               .select(F.col("c.cell").alias("_cell"), F.col("c.n").alias("_n"), F.size(F.filter("starts", lambda s: s <= F.col("c.cell"))).alias("shard")))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    planned = written(planned.select("_cell", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                                     F.ceil(F.col("_n") / part_rows).cast("int").alias("_parts")), "shard-plan")
    tagged = base.join(F.broadcast(planned), "_cell").withColumn("_part", F.pmod(F.xxhash64(own), F.col("_parts")).cast("int"))
    earlier = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (tagged.where("_parts > 1").groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_rows"))
              .select("_cell", "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")))
    order = Window.partitionBy("_cell", "_part").orderBy(own, "text_crc32", "size")
    slot = F.col("_offset") + F.coalesce("_start", F.lit(0)) + F.row_number().over(order) - 1
    told = tagged.join(starts, ["_cell", "_part"], "left").select(*keep.values(), "size", "text_crc32", "shard", slot.cast("long").alias("slot"))
    return restored(told, keep, new)
