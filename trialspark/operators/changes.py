"""File-change lists of trials: leaves of the directory tree, tampering, baselines.

Tests like "is any other path below this one" become equality joins on the directories above
each path, so no trial's list is ever compared pairwise. The directories above are made distinct first: a
directory of many files would else meet each of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


def directories_above(path: Column) -> Column:
    """Every directory above a path, without trailing slash; the root is ''."""
    parts = F.split(path, "/")
    # Only one entry: the path holds no slash.
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                                                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def bare(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "")


def path_under(path: Column, prefix: Column) -> Column:
    """The prefix itself, or anything below it."""
    base = bare(prefix)
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def directly_in(path: Column, folder: str, pattern: str) -> Column:
    """Files of a folder, not of its sub-folders, whose name matches a pattern with * and ?."""
    shape = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\Q" + c + "\\E") for c in pattern)
    return path.rlike("^\\Q" + folder.rstrip("/") + "\\E/" + shape + "$")


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """'K path' lines to kind and path; anything else is left out."""
    shape = "(?s)^([ACD]) (.+)$"
    return (lines.where(F.col(line).rlike(shape))
            .withColumn("kind", F.regexp_extract(line, shape, 1))
            .withColumn("path", F.regexp_extract(line, shape, 2)))


def without_harness_files(changes: DataFrame, marker: str) -> DataFrame:
    """Drop files the recording harness itself left behind, known by their path prefix."""
    return changes.where(~F.startswith(F.col("path"), F.lit(marker)))


def leaf_changes(changes: DataFrame, marker: str, trial: str = "trial_id") -> DataFrame:
    """Drop harness files, and changed directories that only hold other changes.

    Harness files still count as content of their directory. Only 'C' rows need the join.
    """
    above = (changes.select(trial, F.explode(directories_above(F.col("path"))).alias("_dir")).distinct())
    dirs = changes.where(F.col("kind") == "C").withColumn("_dir", bare(F.col("path")))
    leaf_dirs = dirs.join(above, [trial, "_dir"], "left_anti").select(*changes.columns)
    return without_harness_files(changes.where(F.col("kind") != "C").unionByName(leaf_dirs), marker)


def tampering(changes: DataFrame, marker: str, protected: tuple[str, ...] = C.PROTECTED_PATHS,
              allowed: DataFrame | None = None, trial: str = "trial_id") -> DataFrame:
    """Leaf changes under protected paths, as `entry` 'K path', keeping `ord`.

    `allowed`: rows (trial, prefix) of paths that a trial's task may change.
    """
    path = F.col("path")
    # Protected paths start in one of few places: this cuts the list before anything is joined.
    guarded = [path_under(path, F.lit(p)) for p in protected]
    any_guarded = guarded[0]
    for g in guarded[1:]:
        any_guarded = any_guarded | g
    flagged = (leaf_changes(changes, marker, trial)
               .where(~path.contains("__pycache__") & ~path.endswith(".pyc")).where(any_guarded))
    if allowed is not None:
        # The path itself or one of its directories equals an allowed prefix.
        own = F.concat(directories_above(path), F.array(path))
        rules = allowed.select(F.col(trial), bare(F.col("prefix")).alias("_dir"))
        excused = (flagged.withColumn("_dir", F.explode(own))
                   .join(rules, [trial, "_dir"], "left_semi").select(trial, "ord").distinct())
        flagged = flagged.join(excused, [trial, "ord"], "left_anti")
    return flagged.withColumn("entry", F.concat("kind", F.lit(" "), "path"))


def minus_baseline(changes: DataFrame, baseline: DataFrame, trial: str = "trial_id") -> DataFrame:
    """Drop changes that were already there when the trial began; duplicates and order stay."""
    return changes.join(baseline.select(trial, "kind", "path"), [trial, "kind", "path"], "left_anti")


def recorded_changes(leaves: DataFrame, limit: int = C.CHANGES_RECORDED, trial: str = "trial_id") -> DataFrame:
    """The first `limit` leaf changes of each trial. The rank filter runs before the shuffle too."""
    first = Window.partitionBy(trial).orderBy("ord")
    return leaves.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit).drop("_rank")
