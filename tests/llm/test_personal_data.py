"""All base kinds against their patterns, with the digest, on random texts."""

import hashlib
import random
import re

from binscore.llm import pii

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "")
                  if valid(kind, m[0]))


def with_check_digit(rnd, n):
    body = "".join(rnd.choice("0123456789") for _ in range(n - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_base_kinds_equal_their_patterns(spark):
    from binscore.llm.common import prepare
    prepare(spark)
    rnd = random.Random(8)
    texts = [None, "", "4111 1111 1111 1111", "+1 (248) 555-6359", "é 4111-1111-1111-1111 漢+12345678901"]
    for _ in range(600):
        parts = []
        for _ in range(rnd.randrange(1, 9)):
            kind = rnd.randrange(6)
            if kind == 0:
                card = with_check_digit(rnd, rnd.randrange(11, 21))
                parts.append(re.sub(r"(\d{4})(?=\d)", lambda m: m[1] + rnd.choice(["", " ", "-"]), card))
            elif kind == 1:
                parts.append("+" + "".join(rnd.choice("0123456789 ().-") for _ in range(rnd.randrange(3, 22))))
            elif kind == 2:
                parts.append(".".join(str(rnd.randrange(300)) for _ in range(rnd.randrange(2, 7))))
            elif kind == 3:
                parts.append("".join(rnd.choice("ab.@-_%é") for _ in range(rnd.randrange(3, 15))))
            elif kind == 4:
                parts.append("".join(rnd.choice("0123456789- .+") for _ in range(rnd.randrange(1, 40))))
            else:
                parts.append(rnd.choice(["word", "ünï", "", "\n"]))
        texts.append(rnd.choice(["", " ", "x"]).join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in pii.digests(pii.personal_data(df)).collect():
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[1] == i for w in want) for i in range(4)], texts[r.doc_id]
        line = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), texts[r.doc_id]
        assert set(line.split(",")) - {""} <= set((r.spans or "").split(","))
