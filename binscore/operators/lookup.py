"""Resolving a (project, path) pair to a source file's text (A4 helpers,
B3-B5, C4, B16).

The reference looks every file up on disk, one row at a time.  Here the
whole lookup is relational: project names are resolved once per distinct
name (a small table), paths are normalised with native expressions, and
the text arrives through one equi-join on (project directory, path).  The
join key is unique per file, so no key is hot even when one project holds
a third of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binscore.functions.text import first_lower, first_upper, map_with_default, normalise_path
from binscore.operators.joins import bounded_broadcast

# ---- fixed values: project names whose directory is spelled differently ----
PROJECT_ALIASES = {
    "Openolat": "OpenOLAT",
    "Exoplayer": "ExoPlayer",
}
# failure texts written to ``errors`` when a file cannot be read
ZERO_SHOT_MISSING = "File not found"
FEW_SHOT_MISSING = "Failed to read or File not found"
# ---------------------------------------------------------------------------


def alias_project(col) -> Column:
    """Replace a known misspelt project name by its directory name."""
    return map_with_default(col, PROJECT_ALIASES)


def resolve_project_dirs(names: DataFrame, dirs: DataFrame, name: str = "project_name",
                         out: str = "project_dir") -> DataFrame:
    """B4 + K4: for each distinct ``name``, the existing directory: the name
    itself, else with its first letter lowered, else raised; NULL if none
    exists.  ``dirs`` has one column ``project`` (may repeat).

    Works on distinct names only, so its size is the number of projects."""
    distinct = names.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    cands = F.explode(F.array(
        F.struct(F.lit(0).alias("prio"), F.col("_name").alias("cand")),
        F.struct(F.lit(1).alias("prio"), first_lower("_name").alias("cand")),
        F.struct(F.lit(2).alias("prio"), first_upper("_name").alias("cand")),
    ))
    tried = distinct.select("_name", cands.alias("c")).select("_name", "c.prio", "c.cand")
    existing = dirs.select(F.col("project").alias("cand")).distinct()
    hits = tried.join(existing, "cand", "inner")
    best = hits.groupBy("_name").agg(F.min(F.struct("prio", "cand")).alias("_b"))
    return (distinct.join(best, "_name", "left")
                    .select(F.col("_name").alias(name), F.col("_b.cand").alias(out)))


def file_key(path) -> Column:
    """B5 applied to a repository path: leading '/' stripped, '.', '//' and
    '..' collapsed; NULL when it climbs above the project root."""
    return normalise_path(path)


def lookup_text(df: DataFrame, files: DataFrame, path_col: str, out: str,
                project: str = "project_name", dirs: DataFrame | None = None) -> DataFrame:
    """C4: left lookup of the text of ``path_col`` in ``files``
    (project, path, text) through the alias (B3), the directory case
    variants (B4) and the path normalisation (B5).  ``out`` is NULL when
    the file is missing.

    The files are first reduced by the looked-up keys, broadcast if their size
    allows it, so the texts of files that nobody asked for are not shuffled;
    beyond that size the reduction and the lookup share one exchange."""
    aliased = df.withColumn("_proj", alias_project(project))
    dir_map = resolve_project_dirs(aliased, dirs if dirs is not None else files.select("project"),
                                   "_proj", "_dir")
    # one row per distinct project name: broadcast (size-checked), so the
    # rows of a hot project are never shuffled on the project key
    keyed = (aliased.join(bounded_broadcast(dir_map, materialize=True), "_proj", "left")
                    .withColumn("_key", file_key(path_col)))
    right = files.select(F.col("project").alias("_dir"), F.col("path").alias("_key"),
                         F.col("text").alias(out))
    wanted = keyed.select("_dir", "_key").distinct()
    right = right.join(bounded_broadcast(wanted, materialize=True), ["_dir", "_key"], "left_semi")
    return keyed.join(right, ["_dir", "_key"], "left").drop("_proj", "_dir", "_key")


def status_of(*text_cols: str) -> Column:
    """1 when every looked-up text is present, else -1 (the reader's
    status)."""
    ok = F.lit(True)
    for c in text_cols:
        ok = ok & F.col(c).isNotNull()
    return F.when(ok, F.lit(1)).otherwise(F.lit(-1))


def failure_text(status: Column, few_shot: bool) -> Column:
    """The error written for a row whose file(s) could not be read."""
    msg = FEW_SHOT_MISSING if few_shot else ZERO_SHOT_MISSING
    return F.when(status == -1, F.lit(msg)).otherwise(F.lit(None).cast("string"))
