"""Deep merge of layered JSON documents as joins over (document, path) rows.

Objects merge by key; lists and scalars replace; a later layer wins; a change of kind
replaces the whole subtree. Documents are opened level by level as variants, all documents at
once; the merge itself is grouping and joining on (document, path), so one document with very
many layers is spread over its paths.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

#: Levels of objects that are opened at first; where a document goes deeper all are opened again with twice as many.
LEVELS = 4
_STRING = r'"(?:[^"\\]|\\.)*+"'


def _spaced(value: Column) -> Column:
    """JSON text with a blank after each comma and colon between values. Control characters are escaped in JSON, so one can mark places."""
    marked = F.regexp_replace(value, f"({_STRING}|[^\",:]++)([,:]?)", "$1$2\u0001")
    return F.replace(F.regexp_replace(marked, "([,:])\u0001", "$1 "), F.lit("\u0001"), F.lit(""))


def unreadable(layers: DataFrame) -> DataFrame:
    """(config_id, layer, doc) of the documents that are not JSON; the merge goes on without them."""
    return layers.select("config_id", "layer", "doc").where(F.col("doc").isNotNull() & F.try_parse_json("doc").isNull())


def opened(layers: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(config_id, layer, doc) to one row per leaf: path, value (JSON text). A leaf is anything but an object with keys.

    Objects more than `levels` deep are not opened. Null and unreadable documents give no row; of a key that occurs twice in an
    object the last counts.
    """
    rows = layers.select("config_id", "layer", F.array().cast("array<string>").alias("path"), F.try_parse_json("doc").alias("v"))
    for _ in range(levels):
        keys = F.try_variant_get("v", "$", "map<string,variant>")
        rows = (rows.select("config_id", "layer", "path", "v", F.explode_outer(keys).alias("_key", "_below"))
                .select("config_id", "layer", F.when(F.col("_key").isNull(), F.col("path")).otherwise(F.concat("path", F.array("_key"))).alias("path"),
                        F.coalesce("_below", "v").alias("v")))
    return rows.select("config_id", "layer", "path", F.to_json("v").alias("value")).where(F.col("value").isNotNull())


def stated(layers: DataFrame) -> DataFrame:
    """Per (config_id, path): the latest statement `r`, its layer, and the latest layers that made it a leaf and an object.

    A leaf states itself, and an object at every path above it. Kept in the shared folder, so that documents are opened
    once and joins start from a scan.
    """
    spark = layers.sparkSession
    levels = LEVELS
    while True:
        above = F.when(F.size("path") > 0, F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n)))
        leaf = opened(layers, levels).withColumn("is_object", F.col("value") == "{}")
        # Objects above are brought down to one row each before they meet the leaves.
        objects = (leaf.select("config_id", "layer", F.explode(above).alias("path")).groupBy("config_id", "path").agg(F.max("layer").alias("layer"))
                   .select("config_id", "layer", "path", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_object")))
        said = leaf.select(*objects.columns).unionByName(objects).groupBy("config_id", "path").agg(
            F.max_by(F.struct("is_object", "value"), "layer").alias("r"), F.max("layer").alias("layer"),
            F.max(F.when(~F.col("is_object"), F.col("layer"))).alias("leaf_layer"), F.max(F.when(F.col("is_object"), F.col("layer"))).alias("object_layer"),
            F.coalesce(F.bool_or(F.col("value").startswith('{"')), F.lit(False)).alias("closed"))
        at = scratch(spark, "paths")
        said.write.parquet(at)
        latest = spark.read.schema(said.schema).parquet(at)
        if latest.where("closed").isEmpty():
            return latest
        levels *= 2


def config_merge(layers: DataFrame) -> DataFrame:
    """Surviving leaves (and objects left empty) of the merged document: (config_id, path, value)."""
    latest = stated(layers)
    # A later leaf at a path above replaces everything beneath it. A path with something beneath it was an object once, so
    # only paths that were both need a look.
    both = latest.where(F.col("leaf_layer").isNotNull() & F.col("object_layer").isNotNull()).select(
        "config_id", F.col("path").alias("dir"), F.col("leaf_layer").alias("replaced_at"))
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    under = latest.where(F.size("path") > 0).select("config_id", "path", "layer", F.explode(above).alias("dir"))
    replaced = under.join(both, ["config_id", "dir"]).where(F.col("replaced_at") > F.col("layer")).select("config_id", "path")
    alive = latest.select("config_id", "path", "r").join(replaced, ["config_id", "path"], "left_anti")
    # Each survivor also tells its parent that it is there: an object is listed only without children.
    parent = F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.size("path") - 1))
    told = F.array_compact(F.array(F.struct("path", F.col("r").alias("own"), F.lit(0).alias("child")),
                                   F.when(parent.isNotNull(), F.struct(parent.alias("path"), F.lit(None).cast(latest.schema["r"].dataType).alias("own"),
                                                                       F.lit(1).alias("child")))))
    return (alive.select("config_id", F.explode(told).alias("t"))
            .groupBy("config_id", F.col("t.path").alias("path"))
            .agg(F.max("t.own").alias("own"), F.max("t.child").alias("children"))
            .where(F.col("own").isNotNull() & ~(F.col("own.is_object") & (F.col("children") == 1)))
            .select("config_id", "path", F.when(F.col("own.is_object"), "{}").otherwise(F.col("own.value")).alias("value"))
            .withColumn("value", F.when(F.col("value").startswith("["), _spaced(F.col("value"))).otherwise(F.col("value"))))


def _builder():
    def build(rows) -> str:
        root: object = {}
        for row in sorted(rows, key=lambda r: list(r["path"])):
            path, value = list(row["path"]), json.loads(row["value"])
            if not path:
                root = value
                continue
            at = root
            for key in path[:-1]:
                at = at.setdefault(key, {})
            at[path[-1]] = value
        return json.dumps(root, ensure_ascii=False)

    def build_texts(groups: pd.Series) -> pd.Series:
        return groups.map(build)

    return F.pandas_udf(build_texts, "string")


def merged_documents(layers: DataFrame) -> DataFrame:
    """The merged documents as JSON text. A group is the leaves of one merged document."""
    return (config_merge(layers).groupBy("config_id")
            .agg(F.collect_list(F.struct("path", "value")).alias("rows"))
            .select("config_id", _builder()("rows").alias("doc")))
