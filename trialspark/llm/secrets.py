"""Secret scans by an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a Parquet folder, has a row for each blob and
rule version that was scanned, with what was found. A scan looks only at distinct blobs without such a row, appends
its findings, and joins the ledger back to all paths.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from . import kernels
from .common import prepare, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES_VERSION = "1"
KINDS = ("assign", "access", "hex")
LEDGER = "blob binary, rules string, spans array<struct<kind:string,start:long,end:long>>"
# The patterns of the rules. ASCII letters of the names stand in either case.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
SHORTEST_VALUE, SHORTEST_HEX = 6, 24


def scanner():
    """text -> [(kind, start, end)] in code points, by start, then by kind as listed."""
    import re

    assign, access, hexes = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS), re.compile(HEX)

    def scan(text: str, names: bool, has_hex: bool) -> list[tuple[str, int, int]]:
        found = []
        if names:  # short values take up their place, then drop out
            found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= SHORTEST_VALUE]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text)]
        if has_hex:
            found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]

    return scan


def scan_blobs(blobs: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """(blob, text) -> ledger rows. Names and long runs of hex digits are looked for in bytes first, so clean texts cost little."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        scan = scanner()
        digit = np.zeros(256, bool)
        digit[list(b"0123456789abcdef")] = True
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            texts, out = kernels.encoded(batch.column("text")), []
            for _, data, start, _ in kernels.groups(texts):
                a, b = kernels.edges(digit[np.frombuffer(data, np.uint8)])
                long_ = np.zeros(len(start), bool)
                long_[np.searchsorted(start, a[b - a >= SHORTEST_HEX], "right") - 1] = True
                out.append(long_)
            long_ = np.concatenate(out) if out else []
            spans = []
            for text, has_hex in zip(texts, long_, strict=True):
                low = text.lower()
                names = any(n in low for n in NAMES)
                hit = scan(text.decode(), names, bool(has_hex)) if names or has_hex or b"AKIA" in text else []
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in hit])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array([version] * len(texts), pa.string()), pa.array(spans, pa.list_(kind))], names=["blob", "rules", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def blob_of(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger so far; a folder that does not exist yet is an empty ledger."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def scanned(versions: DataFrame, ledger: str | None = None, text: str = "text", version: str = RULES_VERSION) -> DataFrame:
    """`versions` without its text, with blob and spans (kind, start, end: code points, end exclusive).

    ledger: folder kept between runs; without one a new folder in the shared folder is used. A null text counts as the empty
    blob. Equal texts are scanned once, whatever their paths; repeated rows repeat. A ledger row written twice (by runs at the
    same time) counts once. Columns named blob or spans are replaced. Empty in, empty out.
    """
    spark = prepare(versions.sparkSession)
    ledger = ledger or scratch(spark, "secret-ledger")
    # Equal texts meet map-side first, so a hot blob leaves each task once.
    blobs = (versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text")))
    known = read_ledger(spark, ledger).where(F.col("rules") == version)
    scan_blobs(blobs.join(known.select("blob"), "blob", "left_anti"), version).write.mode("append").parquet(ledger)
    # Written first: a join with an aggregate could not be split where a blob has very many paths.
    found = written(spark.read.schema(LEDGER).parquet(ledger).where((F.col("rules") == version) & (F.size("spans") > 0))
                    .groupBy("blob").agg(F.first("spans").alias("spans")), "secret-findings")
    keep = [F.col(f"`{c}`") for c in versions.columns if c not in (text, "blob", "spans")]
    return (versions.select(*keep, blob_of(F.col(text)).alias("blob")).join(found, "blob", "left")
            .select(*keep, "blob", F.coalesce("spans", F.array().cast("array<struct<kind:string,start:long,end:long>>")).alias("spans")))
