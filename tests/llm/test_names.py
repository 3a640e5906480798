"""Extra columns that bear names the operators use inside do not disturb them, alone or in the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trialspark.llm import decontaminate, mixing, quality, secrets, sharding, simhash, substrings, toxicity
from trialspark.llm.common import written

NAMES = ["_n", "_spans", "_items", "_places", "_cell", "_offset", "_parts", "_part", "_start", "_q", "_rules", "stratum", "_stratum", "_size", "_target", "_copy", "_source",
         "_id", "_row", "_c0", "_c1", "fp", "key", "part", "score", "rank", "a.b"]


@pytest.fixture(scope="module")
def crowded(corpus):
    frame, _ = corpus
    docs = frame.where("doc_id is not null").dropDuplicates(["doc_id"])
    return written(docs.select(*docs.columns, *[F.lit(f"x{i}").alias(n) for i, n in enumerate(NAMES)]), "crowded")


@pytest.fixture(scope="module")
def around(spark, crowded):
    labels = crowded.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    items = spark.createDataFrame([(1, "w1 w2 w3"), (2, "ha " * 12)], "item_id long, text string")
    return labels, items


OPERATORS = {
    "quality": lambda d, labels, items: quality.judged(d, labels, carry=True),
    "decontaminate": lambda d, labels, items: decontaminate.contamination(d, items),
    "mixing": lambda d, labels, items: mixing.repeated(d),
    "mixed": lambda d, labels, items: mixing.mixed(d),
    "sharding": lambda d, labels, items: sharding.sharded(d, carry=True, part_rows=5),
    "simhash": lambda d, labels, items: simhash.one_of_each(d),
    "substrings": lambda d, labels, items: substrings.deduplicated(d),
    "secrets": lambda d, labels, items: secrets.scanned(d),
    "toxicity": lambda d, labels, items: toxicity.toxicity(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hidden_names(crowded, around, name):
    """The result is that without the extra columns, which are passed on as they were or not at all."""
    plain = crowded.drop(*[f"`{n}`" if "." in n else n for n in NAMES])
    plain = crowded.select(*[c for c in crowded.columns if c not in NAMES])
    got, want = OPERATORS[name](crowded, *around), OPERATORS[name](plain, *around)
    mine = [c for c in want.columns if c != "slot"]
    cells = lambda df: sorted(map(repr, df.select(*[F.col(f"`{c}`") for c in mine]).collect()))
    assert cells(got) == cells(want)
    carried = [n for n in NAMES if n in got.columns and n not in want.columns]
    assert all(got.select(F.col(f"`{n}`").alias("v")).where(F.col("v") != f"x{NAMES.index(n)}").isEmpty() for n in carried[:4])


def test_whole_pipeline_with_hidden_names(spark, crowded, around, tmp_path):
    labels, items = around
    crowded.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert set(NAMES) <= set(got.columns) and got.count() > 10
