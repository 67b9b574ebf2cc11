"""The distributed exchange against the same passes over a whole bigram table."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from binscore.llm import class_lm, dictionary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(2)
    kinds = [[f"{k}{i}" for i in range(25)] for k in "nvadp"]
    out = [(i, " ".join(rnd.choice(kinds[(j * 2 + rnd.randrange(2)) % 5]) for j in range(rnd.randrange(0, 60)))) for i in range(120)]
    return [*out, (200, None), (201, ""), out[3], out[3], (202, "same same same " * 9), (None, "no id here")]


def plain(texts, n_classes_passes=class_lm.PASSES):
    """Classes of all training words, by a table of word pairs."""
    train = [WORD.findall((t or "").lower()) for i, t in texts if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    names = sorted({w for t in train for w in t})
    at = {w: i for i, w in enumerate(names)}
    end = len(names)
    b = np.zeros((end + 1, end + 1))
    for t in train:
        line = [end, *[at[w] for w in t], end]
        for x, y in zip(line, line[1:]):
            b[x, y] += 1
    h = class_lm.hashes(pa.array([w.encode() for w in names], pa.binary()))
    n = b[:, :end].sum(axis=0)
    order = sorted(range(end), key=lambda i: (-n[i], int(h.view(np.int64)[i])))[:class_lm.TOP]
    unit = np.array([class_lm.ending(w.encode()) + len(order) for w in names])
    unit[order] = np.arange(len(order))
    last = len(order) + class_lm.ENDINGS
    units = np.append(unit, last)
    table = np.zeros((last + 1, last + 1), np.int64)
    np.add.at(table, (units[:, None], units[None, :]), b.astype(np.int64))
    first = class_lm.exchange(table, last)
    cls = first[units]
    width = int(first[last]) + 1

    def cells():
        out = np.zeros((width, width))
        np.add.at(out, (cls[:, None], cls[None, :]), b)
        return out

    best = None
    for k in range(n_classes_passes + 1):
        table = cells()
        if best is None or class_lm.likelihood(table) > class_lm.likelihood(best[1]):
            best = cls.copy(), table
        if k < n_classes_passes:
            mine = np.flatnonzero((h & np.uint64(1)) == k % 2)
            right, left = (np.stack([np.bincount(cls, x[w], width) for w in mine]) for x in (b, b.T))
            cls[mine] = class_lm.best_classes(table, cls[mine], right, left, b[mine, mine], width - 1)
    return {int(x): int(c) for x, c in zip(h.view(np.int64), best[0])}, best[1]


def test_the_exchange_equals_that_over_a_table_of_word_pairs(spark, corpus):
    from pyspark.sql import functions as F

    from binscore.llm.common import fold, prepare
    prepare(spark)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5).withColumn(
        "weight", (fold(F.col("doc_id")) != 1).cast("byte"))
    model, found = class_lm.train(docs, dictionary.deal(docs, class_lm.lower_words, stage=True))
    want, table = plain(corpus)
    assert {r.word: r.cls for r in found.collect()} == want
    assert model.total == table.sum() and (model.size == table.sum(axis=0)).all()


def test_probabilities_of_a_class_model_sum_to_one(spark, corpus):
    from pyspark.sql import functions as F

    from binscore.llm.common import fold, prepare
    prepare(spark)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").withColumn("weight", (fold(F.col("doc_id")) != 1).cast("byte"))
    model, _ = class_lm.train(docs, dictionary.deal(docs, class_lm.lower_words, stage=True))
    assert np.allclose((10 ** model.step).sum(axis=1), 1)


def test_tables_leave_the_catalog(spark, corpus):
    from binscore.llm.common import prepare
    prepare(spark)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    out = class_lm.score_documents(docs)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("class_lm_")]
    assert out.count() == len(corpus)  # the scores stay
