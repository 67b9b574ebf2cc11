"""File sources and sinks.

* CSV tables are read with an explicit schema (no inference pass) and the
  missing-value tokens pandas recognises become SQL NULL.
* Per-configuration run files are read in one scan of the folder; the
  configuration comes from each row's ``_metadata.file_name``.
* Source trees are read with the ``binaryFile`` source; bytes are decoded
  as UTF-8 when valid, else as Latin-1.
* Sinks write through the DataFrame writer, so a failed task is retried
  and only committed files become visible.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from binscore.session import scratch_dir
from binscore.sources.csv_blocks import read_csv_records

# ---- fixed values ------------------------------------------------------------
# Strings that pandas' read_csv turns into a missing value by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Run files are accepted when their name starts with one of these models.
MODEL_PREFIXES = ("artigenz", "codellama", "qwen")
COMMENTS_MARK = "withComments"
ZERO_SHOT_MARK = "zeroShot"
FEW_SHOT_MARK = "fewShot"
# ------------------------------------------------------------------------------

CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def na_to_null(df: DataFrame, columns=None) -> DataFrame:
    """pandas missing-value tokens in string columns -> NULL."""
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(F.col(c).isin(*NA_TOKENS), F.lit(None).cast("string"))
                              .otherwise(F.col(c)) for c in cols})


def read_csv_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A1: header CSV with an explicit schema; NA tokens -> NULL.  String
    columns are read as text first so that a token like ``NA`` in a numeric
    column also becomes NULL instead of failing the cast.  A large file is read
    by many tasks (``csv_blocks``)."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = read_csv_records(spark, path, target.names, CSV_OPTIONS)
    cleaned = na_to_null(raw, [f.name for f in target.fields])
    return cleaned.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def write_csv_table(df: DataFrame, path: str) -> None:
    """A6 (CSV): header CSV, NULL written as an empty field."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("nullValue", "").csv(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> None:
    """Write a result table (overwrite)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


def sink_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line (e.g. the skipped projects)."""
    df.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def combine_batches(spark: SparkSession, paths: list[str], fmt: str = "parquet",
                    schema: StructType | str | None = None) -> DataFrame | None:
    """All batch outputs as one table, columns united by name;
    ``None`` when there are no batches (nothing to combine)."""
    if not paths:
        return None
    if fmt == "csv":
        frames = [read_csv_table(spark, p, schema) for p in paths]
    else:
        frames = [spark.read.format(fmt).load(p) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_file_name(model: str, comments: bool, prompting: str | None) -> str:
    """``<model>_<with|without>Comments_<prompting>.csv`` as the inference writes it."""
    middle = "withComments" if comments else "withoutComments"
    return f"{model}_{middle}_{prompting}.csv" if prompting else f"{model}_{middle}.csv"


def config_from_file_name(name: Column) -> list[Column]:
    """A3: model = text before the first ``_``; comments = name contains
    ``withComments``; prompting = zeroShot / fewShot / NULL."""
    return [
        F.split(name, "_").getItem(0).alias("model"),
        name.contains(COMMENTS_MARK).alias("comments_included"),
        F.when(name.contains(ZERO_SHOT_MARK), F.lit("zeroShot"))
         .when(name.contains(FEW_SHOT_MARK), F.lit("fewShot"))
         .otherwise(F.lit(None).cast("string")).alias("prompting"),
    ]


def scan_runs_dir(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """A3 + G1: every ``*.csv`` entry of ``folder`` whose name starts with a
    model prefix, in one scan, with the configuration columns first.  An
    entry is a CSV file or a folder of CSV parts (as Spark writes them); its
    name is the first path component below ``folder``.  All entries share
    one schema, so columns missing from a file (zero-shot runs have no
    exemplar columns) read as NULL."""
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    raw = read_csv_records(spark, folder, target.names, CSV_OPTIONS, recursiveFileLookup="true", pathGlobFilter="*.csv")
    base = _regex_quote(folder.rstrip("/").replace("file:", "") + "/")
    rel = F.regexp_replace(F.regexp_replace(F.col("_file"), r"^file:(//)?", ""), "^" + base, "")
    entry = F.regexp_extract(rel, r"^([^/]+)", 1)
    prefix_ok = reduce(lambda a, b: a | b, [entry.startswith(p) for p in MODEL_PREFIXES])
    kept = na_to_null(raw.where(prefix_ok & entry.endswith(".csv")), [f.name for f in target.fields])
    return kept.select(*config_from_file_name(entry),
                       *[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields])


def decode_text(content: Column) -> Column:
    """A4: bytes -> text, UTF-8 when valid, else Latin-1 (never fails); line
    ends ``\\r\\n`` and ``\\r`` become ``\\n``, as in a file opened as text."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1"))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def arrow_store(root: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "/", root))


#: Tasks of a level of the walk at most; each lists its folders one by one.
WALK_TASKS = 10_000


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``), ``size`` of every file, level by level: the
    folders of a level are rows dealt to tasks, what they hold is written to the
    shared folder and its folders are the next level.  So a large project is
    spread like any other, and the driver only counts the folders of a level."""
    def listed(batches):
        import pyarrow as pa
        from pyarrow import fs
        store, base = arrow_store(root)
        base = base.rstrip("/")
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                infos = store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                infos = [i for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.path[len(base) + 1:] for i in infos], pa.string()),
                     pa.array([None if i.type == fs.FileType.Directory else i.size for i in infos], pa.int64())], names=["path", "size"])

    schema = "path string, size long"
    levels, frontier, n = [], spark.createDataFrame([("",)], "folder string"), 1
    while n:
        at = scratch_dir(spark, f"walk-{len(levels)}")
        frontier.repartition(min(n, WALK_TASKS)).mapInArrow(listed, schema).write.parquet(at)
        level = spark.read.schema(schema).parquet(at)
        levels.append(level.where("size IS NOT NULL"))
        frontier = level.where("size IS NULL").select(F.col("path").alias("folder"))
        n = frontier.count()
    return reduce(DataFrame.unionByName, levels)


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(project, path) of the files of length 0, which Spark's file sources
    leave out."""
    empty = walk(spark, root).where((F.col("size") == 0) & F.col("path").contains("/"))
    return empty.select(F.substring_index("path", "/", 1).alias("project"), F.regexp_replace("path", "^[^/]+/", "").alias("path"))


def read_source_tree(spark: SparkSession, root: str, empty_files: bool = True) -> DataFrame:
    """A4: every file under ``root/<project>/<path>`` as (project, path,
    text).  Files are read by the ``binaryFile`` source, split across
    tasks; nothing passes through the driver.  That source skips empty files;
    they are found by a walk beside it, through Arrow, unless ``empty_files`` is
    off (for file systems that only Spark knows)."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
           .where("length > 0").select("path", "content"))
    base = root.rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^file:(//)?", ""),
                           "^" + _regex_quote(base.replace("file:", "")), "")
    found = raw.select(
        F.regexp_extract(rel, r"^([^/]+)/", 1).alias("project"),
        F.regexp_replace(rel, r"^[^/]+/", "").alias("path"),
        decode_text(F.col("content")).alias("text"))
    if not empty_files:
        return found
    return found.unionByName(_empty_files(spark, root).withColumn("text", F.lit("")))


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\/" else ch for ch in s)


def write_source_tree(df: DataFrame, root: str, encoding_col: str | None = None) -> DataFrame:
    """Lay out (project, path, text[, encoding]) as files ``root/project/path``
    (a staging step, the inverse of A4).  ``root`` is a path or a URI of any
    file system that Arrow knows (``file:``, ``hdfs:``, object stores) and that
    all executors reach.  Each task writes its own rows, every file under a
    passing name first, so a repeated task replaces whole files; the returned
    DataFrame has one row per written file."""
    cols = ["project", "path", "text"] + ([encoding_col] if encoding_col else [])

    def write(batches):
        import pandas as pd
        store, base = arrow_store(root)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                project, path, text = row[0], row[1], row[2]
                enc = row[3] if encoding_col else "utf-8"
                target = f"{base.rstrip('/')}/{project}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                passing = f"{target}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(passing) as fh:
                    fh.write(text.encode(enc or "utf-8", errors="replace"))
                store.move(passing, target)
                out.append((project, path))
            yield pd.DataFrame(out, columns=["project", "path"])

    return df.select(*cols).mapInPandas(write, "project string, path string")
