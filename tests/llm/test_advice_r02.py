"""What the second round's review found missing: each test failed before."""

import collections

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from binscore.llm import bpe, class_lm, simhash

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ready(spark):
    from binscore.llm.common import prepare
    prepare(spark)
    return spark


def repeated(spark, n, size, doc_id):
    """``n`` equal rows in one partition."""
    text = F.repeat(F.lit("the quick brown fox jumps over it "), size // 34)
    return spark.range(n, numPartitions=1).select(F.lit(doc_id).cast("long").alias("doc_id"), text.alias("text"))


@pytest.mark.parametrize("n,size,doc_id", [(3, 9 << 20, 7), (50, 1 << 20, 7), (50, 1 << 20, None)])
def test_chunks_of_equal_rows_stay_apart(ready, n, size, doc_id):
    docs = repeated(ready, n, size, doc_id)
    sizes = bpe.encode(docs, BPE).select(F.size("ids").alias("n")).collect()
    assert len(sizes) == n and len({r.n for r in sizes}) == 1
    assert class_lm.score_documents(docs).count() == n


def test_a_chunk_group_with_two_texts_fails(ready):
    import numpy as np
    import pyarrow as pa

    from binscore.llm import dictionary
    docs = ready.createDataFrame([(1, "a b")], "doc_id long, text string").withColumn("weight", F.lit(1).cast("byte"))
    dealt = dictionary.deal(docs, class_lm.lower_words)
    twice = dealt.union(dealt.where("bucket = -1"))
    back = dictionary.reduce_words(dealt, lambda words, counts: (np.arange(len(words) + 1), counts))
    out = dictionary.assemble(twice, back, (np.int64,), lambda ids, *_: pa.table([ids], names=["doc_id"]), "doc_id long")
    with pytest.raises(Exception, match="2 chunks under one id"):
        out.collect()


def plain(i, n=60):
    return " ".join(f"w{i * 1000 + k}" for k in range(n))


def test_keep_one_keeps_one_row_of_every_component(ready):
    rows = [(None, plain(i), "s") for i in range(30)]  # unrelated, without id
    rows += [(5, plain(100), "s"), (None, plain(100), "s")]  # a named row stands for the unnamed one
    rows += [(6, plain(200), "s"), (6, plain(201), "s"), (2, plain(201), "s")]  # two texts under one id
    rows += [(9, plain(300), "b"), (9, plain(300), "a"), (9, plain(300), None)]  # equal but for another column
    want = collections.Counter(rows[:30] + [(5, plain(100), "s"), (6, plain(200), "s"), (2, plain(201), "s"),
                                            (9, plain(300), "a")])
    for docs in (rows, rows[::-1]):
        docs = ready.createDataFrame(docs, "doc_id long, text string, source string")
        for parts in (1, 5):
            assert collections.Counter(map(tuple, simhash.keep_one(docs.repartition(parts)).collect())) == want


def test_rare_words_have_classes_of_their_own_bigrams(ready):
    """1,200 frequent words fill the table of first classes; rare words that
    share an ending but not their neighbours must not share a class."""
    common = " ".join(f"c{i}x " * 9 for i in range(1200))
    rows = [(0, common)]
    rows += [(5 * i, f"left ra{i}zzz right " * 3 + f"up rb{i}zzz down " * 3) for i in range(1, 60)]
    docs = ready.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit(1).cast("byte"))
    from binscore.llm import dictionary
    dealt = dictionary.deal(docs, class_lm.lower_words, stage=True)
    _, found = class_lm.train(docs, dealt)
    cls = {r.word: r.cls for r in found.collect()}
    import numpy as np
    import pyarrow as pa

    def of(kind):
        names = pa.array([f"r{kind}{i}zzz".encode() for i in range(1, 60)], pa.binary())
        return collections.Counter(cls[w] for w in class_lm.hashes(names).view(np.int64).tolist())
    assert len(cls) == 1200 + 4 + 2 * 59
    assert not set(of("a")) & set(of("b"))


def test_best_classes_are_the_likeliest():
    import numpy as np
    rng = np.random.default_rng(3)
    b = rng.integers(0, 4, (12, 12)) * rng.integers(0, 2, (12, 12)).astype(float)
    cls = np.array([i % 4 for i in range(11)] + [4])

    def table(c):
        out = np.zeros((5, 5))
        np.add.at(out, (c[:, None], c[None, :]), b)
        return out
    n = np.arange(11)
    right = np.array([np.bincount(cls, b[u], 5) for u in n])
    left = np.array([np.bincount(cls, b[:, u], 5) for u in n])
    best = class_lm.best_classes(table(cls), cls[:11], right, left, b[n, n], 4)
    for u in range(11):
        every = []
        for k in range(4):
            other = cls.copy()
            other[u] = k
            every.append(class_lm.likelihood(table(other)))
        assert abs(every[best[u]] - max(every)) < 1e-6
