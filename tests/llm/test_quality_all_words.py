"""The order of words is measured by the pairs of all words, not only of the
frequent ones."""

import collections
import math
import random
import re

import pytest

from binscore.llm import quality_rules as q
from binscore.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = None


def plain_gains(texts):
    """``word_gain`` of a language's texts, from the definition."""
    lines = [[END, *(w.encode() for w in WORD.findall((t or "").lower())), END] for t in texts]
    count = collections.Counter(w for x in lines for w in x[1:-1])
    frequent = {w: i for i, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:q.FREQUENT])}

    def symbol(w):
        return q.END if w is END else frequent[w] if w in frequent else q.ending(w)

    def rare(w):
        return w is not END and w not in frequent
    pairs = [list(zip(x, x[1:])) for x in lines]
    symbols = [[(symbol(a), symbol(b)) for a, b in x] for x in pairs]
    every = collections.Counter(s for x in symbols for s in x)
    n = [max(sum(c == k for c in every.values()), 1) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [0, *[min(max(x, 0.1), k) for k, x in enumerate([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]], 1)]]
    total, left, alone = collections.Counter(), collections.Counter(), collections.Counter()
    for (a, b), c in every.items():
        total[a] += c
        left[a] += d[min(c, 3)]
        alone[b] += c
    mass = sum(alone.values()) + 0.5 * q.SYMBOLS

    after, ahead = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    before, first_alone = collections.Counter(), 0.5 * (q.FREQUENT + 1)
    for x in pairs:
        for a, b in x:
            if rare(a):
                after[a][b] += 1
            else:
                ahead[b][a] += 1
                before[symbol(b)] += 1
                first_alone += 1

    def share(counts, mine, event, lower):
        others = counts - mine
        size = sum(others.values())
        rest = (sum(c == 1 for c in others.values()) + 1) / (size + 1)
        return (1 - rest) * others[event] / max(size, 1) + rest * lower
    out = []
    for x, s in zip(pairs, symbols):
        own, first, here = collections.Counter(s), collections.Counter(a for a, _ in s), collections.Counter(x)
        sum_ = 0
        for (a, b), (sa, sb) in zip(x, s):
            c, t, p1 = every[sa, sb] - own[sa, sb], total[sa] - first[sa], (alone[sb] + 0.5) / mass
            p = max(c - d[min(c, 3)], 0) / max(t, 1) + (min(left[sa] / t, 1) if t else 1) * p1
            sum_ += math.log10(p1) - math.log10(p)
            if rare(a):
                lower = p * (count[b] / alone[sb] if rare(b) else 1)
                mine = collections.Counter({w: n for (v, w), n in here.items() if v == a})
                sum_ -= math.log10(share(after[a], mine, b, lower) / lower)
            elif rare(b):
                size = before[sb] - sum(n for (v, w), n in here.items() if not rare(v) and symbol(w) == sb)
                lower = (c + (total[sa] + 0.5) / first_alone) / (size + 1)
                mine = collections.Counter({v: n for (v, w), n in here.items() if w == b and not rare(v)})
                sum_ -= math.log10(share(ahead[b], mine, a, lower) / lower)
        out.append(sum_ / len(x) if len(x) > 1 else None)
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    common = [f"c{i}" for i in range(q.FREQUENT - 3)]
    rare = [f"r{i}{e}" for i in range(40) for e in ("ab", "cd")]
    known = [" ".join(rnd.sample(common, len(common))) for _ in range(12)]  # each 12 times: these are the frequent ones
    phrases = [" ".join(rnd.sample(rare, 3)) for _ in range(12)]
    odd = []
    for i in range(30):
        line = [rnd.choice(phrases) if rnd.random() < 0.3 else rnd.choice(common + ["c1"] * 400) for _ in range(25)]
        odd.append(" ".join(line + rnd.sample(rare, 1)))
    return [*known, *odd, "r1ab", "R1AB r1ab", "", None, " \n"]


def test_gain_of_all_words_equals_its_definition(spark, texts):
    prepare(spark)
    rows = [(None if i == 3 else i // 2, lang, t) for lang in ("xx", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4)
    def ordered(rows):
        return sorted((-1 if i is None else i, lang or "", -9.0 if gain is None else gain) for i, lang, gain in rows)
    got = ordered(q.measured(docs).select("doc_id", "lang", "word_gain").collect())
    want = ordered((i, lang, gain) for (i, lang, _), gain in zip(rows, 2 * plain_gains(texts)))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-5)


def test_order_of_rare_words_counts(spark):
    """Words beyond the most frequent ones, all of one ending, in the order that
    other texts have them or in none."""
    prepare(spark)
    rnd = random.Random(9)
    common = [f"c{i}" for i in range(q.FREQUENT)]
    rare = [f"w{i}ab" for i in range(200)]
    follow = dict(zip(rare, rnd.sample(rare, len(rare))))

    def line(n):
        w = rnd.choice(rare)
        for _ in range(n):
            yield w
            w = follow[w]
    rows = [(i, "xx", " ".join(rnd.sample(common, len(common)))) for i in range(60)]
    rows += [(100 + i, "xx", " ".join(line(60))) for i in range(40)]
    rows += [(1000 + i, "xx", " ".join(rnd.choices(rare, k=60))) for i in range(10)]
    found = {r.doc_id: r.word_gain for r in q.measured(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    ordered, mixed = [found[i] for i in range(100, 140)], [found[i] for i in range(1000, 1010)]
    assert max(ordered) < min(mixed) - 0.5
