"""Bindings of the evaluation relations to the driver's parquet tables.

The evaluation works on labelled files (``samples``), their text
(``source_files``), per-configuration model answers (``runs``), per-file
features (``features``) and per-algorithm scores (``predictions``).  Here they
are derived, row for row, from ``documents`` and ``labels`` with the recipe
of FIXTURES.md section 2, so every plan's work grows with those tables.

k = doc_id div 20 is the "file group"; the split and all residues derive
from it so that a project (= ``source``) has train and test files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binscore.functions.text import clean_response, has_error, parse_yes_no
from binscore.sources.tables import read_table

# ---- fixed values of the binding (FIXTURES.md section 2) -------------------
MODELS = ("artigenz", "codellama", "qwen")
ALGORITHMS = ("CNB", "LR", "DT", "MLP", "SVM", "RF")
# answer text by residue h = 0..9 (leading space deliberate; 9 = no answer)
RESPONSES = (
    "performance bug: YES",
    "performance bug: YES",
    " Performance bug: no",
    " Performance bug: no",
    "performance bug: NO",
    "[INST] no [/INST] yes",
    "There is a potential issue",
    "The code looks fine",
    "No, or maybe yes",
    None,
)
OOM_ERROR = "Out of Memory"
BLANK_ERROR = "  "
# features treated as the ablatable ("anti-pattern") set
ABLATABLE_FEATURES = ("f_commas", "f_periods", "f_no")
FEATURE_COLUMNS = ("f_chars", "f_words", "f_lines", "f_commas", "f_periods",
                   "f_upper_the", "f_no", "f_const", "f_dup")
# ---------------------------------------------------------------------------

SAMPLE_COLUMNS = ("project_name", "file", "github_path", "label", "token_size", "split",
                  "file_available")
RUN_COLUMNS = ("project_name", "file", "github_path", "label", "model", "comments_included",
               "prompting", "response", "prediction", "errors")


def _k(doc_id: Column) -> Column:
    return F.call_function("div", doc_id.cast("bigint"), F.lit(20)).cast("bigint")


def _path(prefix: str, doc_id: Column) -> Column:
    return F.concat(F.lit(prefix), doc_id.cast("string"), F.lit(".txt"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled files: documents joined with labels (doc_id kept as key)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    doc_id = F.col("doc_id")
    return docs.join(labels, "doc_id").select(
        doc_id,
        F.col("source").alias("project_name"),
        _path("doc_", doc_id).alias("file"),
        _path("/src/doc_", doc_id).alias("github_path"),
        F.col("toxic").alias("label"),
        F.col("n_chars").alias("token_size"),
        F.when(_k(doc_id) % 10 < 6, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        F.when(doc_id % 41 == 0, F.lit(0)).otherwise(F.lit(1)).alias("file_available"),
    )


def split_of(samples_df: DataFrame, split: str) -> DataFrame:
    return samples_df.where(F.col("split") == F.lit(split))


def without_first_line(text: Column) -> Column:
    """Text of the comment-free variant: everything after the first newline
    (unchanged when there is none)."""
    pos = F.instr(text, "\n")
    return F.when(pos > 0, F.substr(text, pos + F.lit(1))).otherwise(text)


def source_files(spark: SparkSession, sf_dir: str, variant: str | None = None) -> DataFrame:
    """(doc_id, variant, project, path, text); files with doc_id % 43 = 0 are
    missing.  ``variant`` ('with' / 'without' comments) builds only that
    tree, as a scan of a ``variant=``-partitioned source tree would prune
    to one partition (A5)."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]).where(
        F.col("doc_id") % 43 != 0)
    base = [F.col("doc_id")]
    tail = [F.col("source").alias("project"), _path("src/doc_", F.col("doc_id")).alias("path")]
    if variant is not None:
        text = F.col("text") if variant == "with" else without_first_line(F.col("text"))
        return docs.select(*base, F.lit(variant).alias("variant"), *tail, text.alias("text"))
    variants = F.explode(F.array(
        F.struct(F.lit("with").alias("variant"), F.col("text").alias("content")),
        F.struct(F.lit("without").alias("variant"), without_first_line(F.col("text")).alias("content")),
    ))
    return docs.select(*base, *tail, variants.alias("v")).select(
        "doc_id", "v.variant", "project", "path", F.col("v.content").alias("text"))


def _config_array() -> Column:
    rows = []
    for mi, model in enumerate(MODELS):
        for ci in (0, 1):
            for pi in (0, 1):
                rows.append(F.struct(F.lit(model).alias("model"), F.lit(mi).alias("mi"),
                                     F.lit(ci).alias("ci"), F.lit(pi).alias("pi")))
    return F.array(*rows)


def runs(spark: SparkSession, sf_dir: str, samples_df: DataFrame | None = None) -> DataFrame:
    """Answers of 3 models x {with, without} comments x {zero, few}-shot for
    every test file (the merged run table, before cleaning)."""
    s = samples_df if samples_df is not None else samples(spark, sf_dir)
    test = split_of(s, "test").select(
        "doc_id", "project_name", "file", "github_path", "label",
        F.explode(_config_array()).alias("cfg"))
    doc_id = F.col("doc_id")
    k = _k(doc_id)
    h = ((k * 7 + (doc_id % 20) * 3 + F.col("cfg.mi") * 3 + F.col("cfg.ci") * 2
          + F.col("cfg.pi") * 5 + F.col("label") * 2) % 10)
    answers = F.array(*[F.lit(r).cast("string") for r in RESPONSES])
    errors = (F.when((k % 53 == 7) & (F.col("cfg.mi") == 0), F.lit(OOM_ERROR))
               .when(k % 11 == 3, F.lit(BLANK_ERROR))
               .otherwise(F.lit(None).cast("string")))
    staged = test.select(
        "doc_id", "project_name", "file", "github_path", "label",
        F.col("cfg.model").alias("model"),
        (F.col("cfg.ci") == 1).alias("comments_included"),
        F.when(F.col("cfg.pi") == 1, F.lit("fewShot")).otherwise(F.lit("zeroShot")).alias("prompting"),
        F.element_at(answers, (h + 1).cast("int")).alias("response"),
        errors.alias("errors"),
    )
    # A scorer that failed returns no prediction; otherwise the answer is parsed.
    prediction = (F.when(has_error("errors"), F.lit(None).cast("int"))
                   .otherwise(parse_yes_no(clean_response("response"))))
    return staged.select(*RUN_COLUMNS[:-2], prediction.alias("prediction"), "errors", "doc_id")


def _occurrences(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("double")


def features(spark: SparkSession, sf_dir: str, samples_df: DataFrame | None = None) -> DataFrame:
    """Per-file numeric features (feature matrix) for every sample.  The text
    is counted where it is read, so only numbers meet the samples."""
    s = samples_df if samples_df is not None else samples(spark, sf_dir)
    t = F.col("text")
    counted = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        "doc_id",
        (_occurrences(t, " ") + F.lit(1.0)).alias("f_words"),
        (_occurrences(t, "\n") + F.lit(1.0)).alias("f_lines"),
        _occurrences(t, ",").alias("f_commas"),
        _occurrences(t, ".").alias("f_periods"),
        _occurrences(t, "The").alias("f_upper_the"),
        _occurrences(t, "no").alias("f_no"),
    )
    return s.join(counted, "doc_id").select(
        "doc_id", "project_name", "file", "github_path", "token_size", "file_available", "label",
        F.col("token_size").cast("double").alias("f_chars"),
        "f_words", "f_lines", "f_commas", "f_periods", "f_upper_the", "f_no",
        F.lit(1.0).alias("f_const"),
        (F.col("f_words") * F.lit(2.0)).alias("f_dup"),
    )


def _algorithm_array() -> Column:
    rows = []
    for ai, name in enumerate(ALGORITHMS):
        for arm in (0, 1):
            rows.append(F.struct(F.lit(name).alias("algorithm"), F.lit(ai).alias("ai"),
                                 F.lit(arm).alias("arm")))
    return F.array(*rows)


def predictions(spark: SparkSession, sf_dir: str, samples_df: DataFrame | None = None) -> DataFrame:
    """Scores of 6 algorithms x 2 arms for every test file (with ties)."""
    s = samples_df if samples_df is not None else samples(spark, sf_dir)
    test = split_of(s, "test").select(
        "doc_id", "project_name", "github_path", "label", F.explode(_algorithm_array()).alias("a"))
    doc_id = F.col("doc_id")
    score = ((_k(doc_id) * 37 + doc_id * 11 + F.col("a.ai") * 7 + F.col("a.arm") * 13
              + F.col("label") * 9) % 100).cast("double") / F.lit(100.0)
    return test.select(
        F.col("project_name").alias("project"), "github_path", "doc_id",
        F.col("a.algorithm").alias("algorithm"), F.col("a.arm").alias("arm"), "label",
        score.alias("score"),
    ).withColumn("prediction", (F.col("score") >= F.lit(0.5)).cast("int"))
