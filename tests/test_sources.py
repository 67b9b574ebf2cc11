"""CSV read by blocks, directory walk, run reports, prompt sizes."""

import csv
import os
import random

import pytest
from pyspark.sql import functions as F

from binscore.sources import csv_blocks, files

FIELDS = ["a", "b", "c"]


def awkward(rnd):
    kind = rnd.randrange(7)
    if kind == 0:
        return ""
    if kind == 1:
        return 'say "so", he\nsaid' + "\n" * rnd.randrange(3)
    if kind == 2:
        return "x" * rnd.randrange(1, 90) + "\n" + "é漢" * rnd.randrange(40)
    if kind == 3:
        return '"' * rnd.randrange(1, 5)
    if kind == 4:
        return "\n".join("line, " + '"' * rnd.randrange(3) for _ in range(rnd.randrange(1, 30)))
    return f"plain {rnd.random()}"


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rnd = random.Random(11)
    folder = tmp_path_factory.mktemp("csv")
    every = {}
    for name in ("one.csv", "two.csv", "head.csv"):
        rows = [[awkward(rnd) for _ in FIELDS] for _ in range(0 if name == "head.csv" else 150)]
        for r in rows:
            r[0] = r[0] or "id"  # no wholly empty record
        with open(folder / name, "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh, lineterminator="\r\n" if name == "two.csv" else "\n")
            w.writerow(FIELDS)
            w.writerows(rows)
        every[name] = rows
    return str(folder), every


@pytest.mark.parametrize("size", [37, 200, 1 << 20])
def test_blocks_of_any_size_give_the_same_records(spark, table, size):
    """Quotes and records across block edges, records longer than blocks."""
    folder, every = table
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        df = csv_blocks.read_csv_records(spark, folder, FIELDS, files.CSV_OPTIONS)
        got = sorted((os.path.basename(r._file), *[r[c] or "" for c in FIELDS]) for r in df.collect())
        tasks = spark.read.text(folder, lineSep="\n").rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((name, *r) for name, rows in every.items() for r in rows)
    assert tasks > 100 or size > 37


def test_equal_to_the_whole_file_read(spark, table):
    folder, _ = table
    schema = "a string, b string, c string"
    whole = spark.read.options(**files.CSV_OPTIONS).schema(schema).csv(folder)
    mine = files.read_csv_table(spark, folder, schema)
    key = lambda df: sorted(map(repr, files.na_to_null(df).collect()))
    assert key(whole) == key(mine)


def test_types_and_missing_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,s\n1,"a\nb"\nNA,None\n3,"x ""y"""\n\n')
    got = files.read_csv_table(spark, str(tmp_path), "n int, s string").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "a\nb"), (None, None), (3, 'x "y"')], key=repr)


def test_no_files_but_headers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,s\n")
    (tmp_path / "empty.csv").write_text("")
    assert files.read_csv_table(spark, str(tmp_path), "n int, s string").count() == 0


def test_walk_finds_every_file_level_by_level(spark, tmp_path):
    paths = ["p/a.txt", "p/empty.txt", "p/deep/er/still/e.txt", "q/x/y.txt", "top.txt", "q/x/empty too.txt"]
    for p in paths:
        at = tmp_path / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("" if "empty" in p else "text")
    (tmp_path / "none").mkdir()
    got = {r.path: r.size for r in files.walk(spark, str(tmp_path)).collect()}
    assert got == {p: 0 if "empty" in p else 4 for p in paths}
    read = {(r.project, r.path): r.text for r in files.read_source_tree(spark, str(tmp_path)).collect() if r.project}
    assert read == {tuple(p.split("/", 1)): "" if "empty" in p else "text" for p in paths if "/" in p}


def test_report_of_a_resumed_run(spark, tmp_path):
    from binscore.operators import score
    from binscore.streaming import incremental
    schema = "id int, prompt_text string"
    prompts, out, ckpt, report = (str(tmp_path / x) for x in ("prompts", "out", "ckpt", "report"))

    def add(texts, first):
        rows = [(first + i, t) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(prompts)

    def run():
        return incremental.run_incremental(spark, prompts, out, ckpt, schema, "prompt_text", ["id"], score.ThirdPredictor,
                                           max_files=2, report_dir=report)

    long = "des " * (score.CONTEXT_TOKENS + 1)
    add(["for it", long, "x", "y", long, "z"], 0)
    assert run().count() == 6
    assert run().count() == 6  # nothing new
    add(["for", long, None], 6)
    assert run().count() == 9
    rows = incremental.read_report(spark, report).orderBy("start_row").collect()
    assert len({r.run for r in rows}) == 2  # the run that found nothing left no row
    assert sum(r.rows for r in rows) == 9 and sum(r.errors for r in rows) == 3
    at = 0
    for r in rows:
        assert r.start_row == at and r.rows > 0 and 0 < r.seconds <= r.total_seconds
        at += r.rows
    assert len(rows) >= 3  # more than one batch in a run


def test_token_counter_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from binscore.operators import tokens
    texts = [None, "", "Hello  WORLD, it's\n\n  me", "<|endoftext|>a<|endoftext|><|endoftext|> b", "漢字 été 12345 " * 30, "a b a b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        got = {r.id: r.n for r in df.select("id", tokens.token_counter(tokens.LibraryTokenizer, path)("t").alias("n")).collect()}
        assert got == {i: None if t is None else len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert df.select(tokens.token_counter()("t").alias("n")).where("n = 5").count() == 1


def test_prompt_sizes_are_those_of_the_rendered_chat(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from binscore.functions.prompts import two_shot_prompt
    from binscore.operators import tokens
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([("int x;", "for(;;){}", "return 1;"), ("", "a", "b")], "c string, p string, n string")
    df = df.select(two_shot_prompt(F.col("c"), F.col("p"), F.col("n")).alias("prompt"))
    library = Tokenizer.from_file(path)
    for r in tokens.prompt_sizes(df, "prompt", tokens.CHATML, tokens.LibraryTokenizer, path).collect():
        text = "".join(f"<|im_start|>{m.role}\n{m.content}<|im_end|>\n" for m in r.prompt) + "<|im_start|>assistant\n"
        assert r.prompt_tokens == len(library.encode(text, add_special_tokens=False).ids)
