"""Every operator and stage on odd rows and on an empty table, held against
plain brute-force versions where they are short."""

import collections
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from binscore.llm import (bpe, class_lm, licences, mixing, pii, quality_model, quality_rules, simhash, sketches,
                          toxicity)

SF_SMOKE = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                       T.StructField("taken", T.StringType()), T.StructField("fp", T.StringType()),
                       T.StructField("size", T.StringType())])
LONG = "the quick brown fox jumps over the lazy dog and runs away " * 4000


def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and further columns whose names the operators use."""
    texts = [None, "", " \n\t", "one", "a b c d e", "A b C d e", LONG, LONG + "end", "Ünïcödé  l'été 漢字 don't\n\n x"]
    texts += ["mail a@b.example.com or +1 (248) 555-6359, 10.0.0.1 and 4111 1111 1111 1111"] * 3
    texts += [" ".join(f"w{i * 7 + k}" for k in range(60)) for i in range(40)]
    out = [(i, t, ("en", "de", None)[i % 3], ("x", "y", None, "é")[i % 4], None if t is None else len(t), "s", "t", "f", "z")
           for i, t in enumerate(texts)]
    out += [out[8], out[8], (None, "no id", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    from binscore.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(50)] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")


def key(x):
    return tuple((v is not None, v) for v in x)


def test_mix_takes_the_exact_budget(docs, empty):
    found = mixing.mix_sources(docs).collect()
    assert len(found) == docs.count()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in found:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.source_size is not None
    assert math.isclose(sum(target.values()), sum(size.values()))
    for s in size:
        assert target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 3
    assert sorted(map(key, found)) == sorted(map(key, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(empty).count() == 0


def test_bpe_equals_the_library_and_round_trips(docs, empty):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Ranks(BPE).ranks, special_tokens={})
    want = sorted((r.doc_id is not None, r.doc_id or 0, enc.encode_ordinary(r.text or "")) for r in docs.collect())
    encoded = bpe.encode(docs, BPE)
    assert sorted((r.doc_id is not None, r.doc_id or 0, list(r.ids)) for r in encoded.collect()) == want
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
    assert sorted(r.decoded_sha256 for r in bpe.digests(encoded, BPE).collect()) == texts
    assert bpe.encode(empty, BPE).count() == 0


def test_toxicity_and_quality_score_every_row(docs, empty, labels):
    for found in (toxicity.score_documents(docs, labels), quality_model.score_documents(docs, labels),
                  toxicity.score_documents(docs, labels.limit(0)), quality_model.score_documents(docs, labels.limit(0))):
        got = found.select("doc_id", "held_out", "score").collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert toxicity.score_documents(empty, labels).count() == 0
    assert quality_model.score_documents(empty, labels).count() == 0


def test_segments_are_the_maximal_ones():
    # 4 -5 3 -3 1 2 -2 2 -2 1 5: the maximal segments are [4], [3], [1 2 -2 2 -2 1 5]
    import numpy as np
    s = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert toxicity.segments(np.arange(11), s, 0.0) == [(0, 0, 4.0), (2, 2, 3.0), (4, 10, 7.0)]


def test_class_lm_counts(docs, empty):
    texts = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + [None]) for r in docs.collect()]
    fold = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 for i, _ in texts}
    c = collections.Counter(w for i, t in texts if fold[i] != 1 for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((fold[i] == 1, len(t), sum(c[w] > 0 for w in t), n,
                   round(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t), 4)) for i, t in texts)
    got = class_lm.score_documents(docs).collect()
    assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert class_lm.score_documents(empty).count() == 0


def test_personal_data_equals_the_patterns(docs, empty):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for text in ("a@b.c.@d.e x@y 1.2.3.4.5.6.7.8 999.1.1.1 a@b@c.d", "", "..@@..", "+12345678901 (2)", "4111-1111 1111 1111"):
        got = [(a, b, k) for a, b, k in pii.find(text) if k in plain]
        want = sorted((m.start(), m.end(), k) for k, p in plain.items() for m in re.finditer(p, text)
                      if k != "ip" or all(int(x) <= 255 for x in m[0].split(".")))
        assert got == want
    assert pii.redact_text("x a@b.cd, token = '0123456789abcdef0'") == "x <EMAIL>, token = '<SECRET>'"
    assert pii.find("account IBAN DE89 3704 0044 0532 0130 00 THEN")[-1][2] == "account"
    found = pii.digests(pii.personal_data(docs)).collect()
    assert len(found) == docs.count() and sum(r.n_card for r in found) == 3 and sum(r.n_phone for r in found) == 3
    assert pii.redacted(docs).columns == docs.columns and pii.redacted(empty).count() == 0


def test_quality_rules(docs, empty):
    got = collections.Counter()
    want = collections.Counter()
    for r in quality_rules.judge(docs).collect():
        got[(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] += 1
        assert not (r.kept and r.base_failed)
    for r in docs.collect():
        text = r.text or ""
        w = WORD.findall(text)
        windows = list(zip(w, w[1:], w[2:]))
        often = collections.Counter(windows)
        inside = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
              len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w))] += 1
    assert got == want
    assert quality_rules.judge(empty).count() == 0


def test_licences(spark, docs, empty):
    files = spark.createDataFrame(
        [(1, "a/LICENSE", "Released under the MIT License.\n"), (2, "a/b/x.c", "no notice"), (3, None, None), (4, "x", ""),
         (5, "c/d/y.c", "code\nLicensed under the Apache License, Version 2.0.\ncode"), (6, "c/z.c", "code"),
         (7, "c/d/e/f.c", "code"), (7, "c/d/e/f.c", "code"), (8, "cc/d/q", "our license is silent on this")],
        "doc_id long, path string, text string")
    got = {(r.doc_id, r.own_licence, r.licence, r.licence_dir) for r in licences.scan(files).collect()}
    assert got == {(1, "MIT", "MIT", None), (2, None, "MIT", "a"), (3, None, None, None), (4, None, None, None),
                   (5, "Apache-2.0", "Apache-2.0", None), (6, None, None, None), (7, None, "Apache-2.0", "c/d"),
                   (8, None, None, None)}
    assert licences.scan(licences.document_paths(docs)).count() == docs.count()
    assert licences.scan(licences.document_paths(empty)).count() == 0


def test_sketches(docs, empty):
    found = sketches.fingerprints(docs)
    got = found.select("doc_id", "n_chars", "edited", "kept", "near_edited", "near_next").collect()
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), (r.text or "").encode()))
    texts = [r.text or "" for r in order]
    want = collections.Counter((r.doc_id, len(t), t[:len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][:len(t) // 2])
                               for i, (r, t) in enumerate(zip(order, texts)))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sketches.fingerprints(empty).count() == 0
    a, b = "w " * 3 + "x y z " * 9, "p q r s t u v w x y z " * 5
    row = docs.limit(1).select(
        sketches.merge(sketches.sketch(F.lit(a)), sketches.sketch(F.lit(b))).alias("m"),
        sketches.sketch(F.lit(a)).alias("a"), sketches.sketch(F.lit(b)).alias("b")).first()
    assert set(row.m) <= set(row.a) | set(row.b)


def test_simhash_against_all_pairs(docs, empty):
    def fingerprint(text):
        w = WORD.findall((text or "").translate(LOWER))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    prints = sorted({f for _, f in rows})
    root = {f: f for f in prints}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                root[top(b)] = top(a)
    least = {}
    for i, f in rows:
        if i is not None:
            least[top(f)] = min(i, least.get(top(f), i))
    want = collections.Counter((i, f, least.get(top(f))) for i, f in rows)
    got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({top(f) for _, f in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("radius,blocks", [(4, 6), (3, 5)])
def test_bucket_comparison_loses_no_link(radius, blocks):
    import numpy as np
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]]))
    rng.shuffle(f)
    bucket = np.sort(rng.integers(0, 5, len(f)))
    a, b = simhash.link_buckets(bucket, f, radius)
    name = {int(x): int(x) for x in f}
    for x, y in zip(a.tolist(), b.tolist()):
        name[x] = y
    for k in range(5):
        own = f[bucket == k]
        near = {int(x): {int(y) for y in own if int(x ^ y).bit_count() <= radius} for x in own}
        for x in own.tolist():
            seen, todo = {x}, [x]
            while todo:
                for y in near[todo.pop()] - seen:
                    seen.add(y)
                    todo.append(y)
            assert len({name[y] for y in seen}) == 1


def test_stages_on_odd_rows(spark, docs, empty):
    columns = docs.columns
    for table in (docs, empty):
        now = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, SF_SMOKE)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == columns
                now = out
            assert out.count() <= 3 * max(table.count(), 1)


def test_pipeline_on_the_small_table(spark):
    out = corpus_pipeline.run(spark, SF_SMOKE)
    assert out.count() > 0 and out.where("n_tokens <> size(ids)").count() == 0
