"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, dotted, paired and
signed digits, schemes and identifier cues.  A deterministic parser at each
anchor expands to the left and right, finds the boundaries and validates.  All
parsers read a run of characters a bounded number of times.

Kinds, leftmost and not overlapping within a kind: ``email``, ``ip`` (four
parts up to 255), ``card`` (12 to 19 digits passing Luhn), ``phone`` (9 to 15
digits); and beyond these ``login`` (user and password in an address with a
scheme), ``account`` (an IBAN after its cue, checked modulo 97), ``key`` (a
cloud access key id) and ``secret`` (a quoted value of 16 or more characters
after a cue such as ``token`` or ``password``).

Offsets are code points, ends exclusive.  Defined results: a null text counts
as empty and stays null when redacted; repeated rows give equal results; an
empty table gives no rows; whole texts are read whatever their length; other
columns are carried along when redacting, and not read else.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account", "key", "secret")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://[^\s/:@]+:[^\s/@]+@(?=[A-Za-z0-9\[])")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
ACCOUNT = re.compile(r"[\x20:=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}([\"'])([^\s\"']{16,})\1")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")


@functools.cache
def anchors() -> ahocorasick.Automaton:
    """The automaton; a hit's value is the parser and the anchor's length."""
    found = ahocorasick.Automaton()
    for a in "0123456789":
        found.add_word("+" + a, ("phone", 2))
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 3))
            for between in ("", " ", "-"):
                found.add_word(f"{a}{between}{b}", ("card", 2 + len(between)))
    for text, kind in (("@", "email"), ("://", "login"), ("IBAN", "account"), ("AKIA", "key")):
        found.add_word(text, (kind, len(text)))
    for cue in CUES:
        for text in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(text, ("secret", len(text)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


# Each parser gets the text, the anchor's place and the end of what its kind
# has read; it returns its spans and how far it has read.

def _email(text: str, at: int, done: int):
    start = at
    while start > done and text[start - 1] in LOCAL:
        start -= 1
    m = DOMAIN.match(text, at + 1) if start < at else None
    return ([(start, m.end())], m.end()) if m else ([], done)


def _ip(text: str, at: int, done: int):
    if at < done:
        return [], done
    start, end = at, at
    while start > done and (text[start - 1] in DIGITS or text[start - 1] == "."):
        start -= 1
    while end < len(text) and (text[end] in DIGITS or text[end] == "."):
        end += 1
    return [(m.start(), m.end()) for m in IP.finditer(text, start, end)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))], end


def _card(text: str, at: int, done: int):
    if at < done:
        return [], done
    start = at
    while start > done:
        if text[start - 1] in DIGITS:
            start -= 1
        elif text[start - 1] in " -" and start - 2 >= done and text[start - 2] in DIGITS:
            start -= 2
        else:
            break
    m = CARD.match(text, start)
    digits = m[0].replace(" ", "").replace("-", "")
    return ([(start, m.end())] if 12 <= len(digits) <= 19 and luhn(digits) else []), m.end()


def _phone(text: str, at: int, done: int):
    m = PHONE.match(text, at)
    if not m:
        return [], done
    return ([m.span()] if 9 <= sum(c in DIGITS for c in m[0]) <= 15 else []), m.end()


def _login(text: str, at: int, done: int):
    m = LOGIN.match(text, at) if at >= done else None
    if not m:
        return [], done
    start = at
    while start > done and start > at - 20 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
        start -= 1
    return ([(at + 3, m.end() - 1)], m.end()) if SCHEME.fullmatch(text, start, at) else ([], done)


def _account(text: str, at: int, done: int):
    m = ACCOUNT.match(text, at + 4) if at >= done else None
    while m and m.end(1) - m.start(1) >= 15 and not iban(m[1]):
        cut = m[1].rfind(" ")  # a following word in capitals may have been read along
        m = ACCOUNT.match(text[:m.start(1) + cut], at + 4) if cut > 0 else None
    return ([m.span(1)], m.end()) if m else ([], done)


def _key(text: str, at: int, done: int):
    m = KEY.match(text, at) if at >= done else None
    return ([m.span()], m.end()) if m else ([], done)


def _secret(text: str, at: int, done: int, length: int = 0):
    m = SECRET.match(text, at + length) if at >= done else None
    return ([m.span(2)], m.end()) if m else ([], done)


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "account": _account, "key": _key}


def find(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of all spans, by start and then kind as listed."""
    done = dict.fromkeys(KINDS, 0)
    out = []
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "secret":
            spans, done[kind] = _secret(text, at, done[kind], length)
        else:
            spans, done[kind] = PARSERS[kind](text, at, done[kind])
        out += [(a, b, kind) for a, b in spans]
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], rank[x[2]]))


def redact_text(text: str) -> str:
    """The text with a mark such as ``<EMAIL>`` for each span; overlapping
    spans become one mark of the first."""
    out, at = [], 0
    spans = find(text)
    i = 0
    while i < len(spans):
        start, end, kind = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][1])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]]) if out else text


@functools.cache
def spans_udf():
    @F.arrow_udf("array<struct<begin:int,end:int,kind:string>>")
    def spans(text: pa.Array) -> pa.Array:
        item = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        return pa.array([[{"begin": a, "end": b, "kind": k} for a, b, k in find(t.as_py() or "")] for t in text],
                        pa.list_(item))
    return spans


@functools.cache
def redact_udf():
    @F.arrow_udf("string")
    def redact(text: pa.Array) -> pa.Array:
        return pa.array([None if (t := x.as_py()) is None else redact_text(t) for x in text], pa.string())
    return redact


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row."""
    return docs.select("doc_id", spans_udf()(F.col("text")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with redacted text, all columns kept; ``n_chars``, if there,
    follows the new text."""
    out = docs.withColumn("text", redact_udf()(docs["text"]))
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE)
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
