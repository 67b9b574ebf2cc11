"""Periodic runs, token counts and centroid clusters against brute force, the
tokenizer library and plain Lloyd rounds; odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from binscore.llm import centroids, periodic, token_counts
from binscore.llm.queries import QUERIES
from llm.test_edges import docs, empty  # noqa: F401  (fixtures)

SF_SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
JSON = public_tokenizers.path("byte_bpe_50k.json")


# --- periodic runs ------------------------------------------------------------

def plain_runs(text):
    w = WORD.findall(text or "")
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))
    drop = {k for s, n_, q in runs for k in range(s + q, s + n_)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in drop)


def repetitive(rng):
    out = []
    while len(out) < rng.randrange(40, 600):
        kind = rng.randrange(4)
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 60))]
        if kind == 0:
            out += unit
        elif kind == 1:
            out += unit * rng.randrange(1, 8) + unit[:rng.randrange(len(unit))]
        elif kind == 2:
            out += (unit[:3] * rng.randrange(1, 9) + ["z"]) * rng.randrange(1, 7)
        else:
            out += ["z"] * rng.randrange(1, 50)
    return " ".join(out)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "a b " * 4, "a " * 700 + "b " + "a " * 900]
    texts += [repetitive(rng) for _ in range(150)]
    for p in (7, 8, 9, 15, 16, 17, 31, 32, 63, 64, 65):  # around the scales' edges, just under and at four periods
        unit = [f"w{i}" for i in range(p)]
        texts += [" ".join(["x", *(unit * 5)[:4 * p + d], "y"]) for d in (-1, 0, 1)]
    fib = ["a", "a b"]
    while len(fib[-1]) < 3000:
        fib.append(f"{fib[-1]} {fib[-2]}")
    texts.append(fib[-1])
    got = periodic.analyse(pa.array(texts, pa.string())).to_pylist()
    for text, found in zip(texts, got):
        runs, kept = plain_runs(text)
        assert [(r["start"], r["length"], r["period"]) for r in found["runs"]] == runs
        assert found["collapsed"] == kept


def test_synchronising_set_agrees_and_covers():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 1 << 62, 500)
    t = np.concatenate([word, rng.integers(0, 1 << 62, 77), word])
    h, w = periodic.mix64(t.astype(np.uint64)), 1
    while w < 16:
        h, w = periodic.doubled(h, w), 2 * w
    at = periodic.synchronising_set(h, 16, np.zeros(len(h), bool))
    inside = at[at + 32 <= 500]
    assert set(at[(at >= 577) & (at + 32 <= 1077)] - 577) == set(inside)  # equal contexts, equal choice
    assert np.diff(at).max() <= 16 and len(at) < 6 * len(t) / 16  # every 16 places have one; sparse


def test_run_digests_on_odd_rows(docs, empty):  # noqa: F811
    found = periodic.find_runs(docs)
    assert found.columns == [*docs.columns, "runs", "collapsed"]
    got = collections.Counter(tuple(r) for r in periodic.digests(found).collect())
    want = collections.Counter()
    for r in docs.collect():
        runs, kept = plain_runs(r.text[:4000] if r.text and len(r.text) > 10**5 else r.text)
        if r.text and len(r.text) > 10**5:  # one period of 12 words, four thousand times
            n = len(WORD.findall(r.text)) // 12 * 12
            runs, kept = [(0, n, 12)], " ".join(WORD.findall(r.text)[:12] + WORD.findall(r.text)[n:])
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        want[(r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
              hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
              hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert got == want
    assert periodic.find_runs(empty).count() == 0


def test_query_plants_its_periods(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, SF_SMOKE).collect()}
    texts = spark.read.parquet(f"{SF_SMOKE}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in texts:
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs, kept = plain_runs(" ".join(w))
        assert rows[r.doc_id].n_runs == len(runs)
        assert rows[r.doc_id].collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5


# --- token counts -------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def test_counts_equal_the_library(library):
    rng = random.Random(7)
    texts = ["x<|endoftext|>y<|endoftext|><|endoftext|> z", "<|endoftext|>", "", "<|endoftext|", " \n\n a  b", "don't we'll I'd'S"]
    texts += ["".join(rng.choice("the ainor's  \n<|endoftext|>é漢") for _ in range(rng.randrange(150))) for _ in range(400)]
    texts += ["a" * n for n in (511, 512, 513, 3001)] + ["xa" + "a" * 1200 + "b" + "a" * 900 + "ah", "=" * 700 + "-" * 801, " " * 1300 + "x"]
    # long texts without spaces merge by windows
    texts += ["".join(rng.choice(s) for _ in range(n)) for s in ("ab", "aab", "etaoinshrdlu", "thequick") for n in (600, 5000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0xA0, 0xD800), rng.randrange(0xE000, 0x110000)]))
                      for _ in range(200)) for _ in range(50)]
    got = token_counts.counts(token_counts.Merges(JSON), pa.array(texts))
    assert got.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_code_point_classes_are_the_library_s(library):
    """Each code point beside a letter, a digit and a mark, as the library cuts it."""
    from binscore.llm.bpe import BLANK, LETTER, NUMBER, OTHER, classes
    from tokenizers import Regex, pre_tokenizers
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    want = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        match = np.ones(0x110000, bool)
        match[0xD800:0xE000] = False
        for piece, _ in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(every):
            match[ord(piece[0]):ord(piece[-1]) + 1] = False
        want[match] = kind
    assert (classes() == want).all()


def test_window_minimum():
    x = np.random.default_rng(3).integers(0, 99, 50).astype(np.int32)
    assert token_counts.window_minimum(x, 4).tolist() == [int(x[max(0, i - 4):i + 5].min()) for i in range(50)]


def test_token_counts_on_odd_rows(docs, empty, library):  # noqa: F811
    got = collections.Counter(tuple(r) for r in token_counts.count_tokens(docs, JSON).collect())
    want = collections.Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert token_counts.count_tokens(empty, JSON).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Merges(public_tokenizers.path("word_bpe_49k.json"))


# --- centroid clusters ----------------------------------------------------------

def plain_clusters(rows, k, rounds, dims, scale=256):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], dtype=object)
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"2:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    c = [list(x[i]) for i in order[:k]]
    for t in range(rounds + 1):
        near = [min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j)) for v in x]
        if t < rounds:
            for j in range(len(c)):
                own = [v for v, n in zip(x, near) if n == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, n, sum((a - b) ** 2 for a, b in zip(v, c[n]))) for (i, v), n in zip(kept, near)], c


@pytest.mark.parametrize("scale_up", [1.0, 3000.0])
def test_clusters_equal_plain_rounds(spark, scale_up):
    rng = np.random.default_rng(4)
    rows = [(i, (scale_up * (rng.normal(0, 0.1, 5) + (i % 4))).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)] + [rows[1], rows[1], (None, rows[2][1])]  # one common vector, repeated rows
    rows += [(2000, None), (2001, [1.0] * 4), (2002, [1.0, None, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] * 5), (2005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(4)
    got, facts, computed = centroids.ns_cluster(df, k=12, rounds=4, dims=5)
    want, c = plain_clusters(rows, 12, 4, 5)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    assert [f["centroid"] for f in facts] == c
    assert sum(f["inertia"] for f in facts) == sum(d for _, _, d in want)
    assert computed[0] == 12 * len(want) and min(computed[1:]) < computed[0] / 2  # bounds spare most distances
    assert centroids.with_inertia(got, facts).count() == len(want)


def test_few_vectors_and_none(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, facts, _ = centroids.ns_cluster(df, k=40, rounds=2, dims=2)
    assert len(facts) == 3 and all(r.distance == 0 for r in got.collect())
    got, facts, computed = centroids.ns_cluster(df.limit(0), k=40, rounds=2, dims=2)
    assert got.count() == 0 and facts == [] and computed == []
    assert centroids.with_inertia(got, facts).count() == 0


def test_displacement_is_total_not_summed():
    history = np.array([[[0, 0]], [[30, 40]], [[0, 0]]])
    moved = centroids.displacements(history)
    assert moved[0, 0] == 0 and abs(moved[1, 0] - 50) < 1e-3 and moved[2, 0] == 0


def test_components_beyond_the_limit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="2\\^27"):
        centroids.ns_cluster(df, k=2, rounds=1, dims=2)
