"""Counts of a text that quality rules and quality models use, for all texts of
an Arrow batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from binscore.llm.common import WHITE, owner, packed, per_text, runs, steps, text_buffer

#: Symbols of the quality rules.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
LETTER[128:] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True

FIELDS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct",
          "n_top", "n_short", "n_no_letter", "n_upper", "n_letter", "n_digit", "n_stop", "n_bang", "n_bar")


def _sums(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def _within(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return total[ends] - total[starts]


def repeated_windows(codes: np.ndarray, first: np.ndarray, n_codes: int, size: int = 3) -> np.ndarray:
    """Whether each word lies in a window of ``size`` words that is found twice
    or more in its text."""
    covered = np.zeros(len(codes), bool)
    text = owner(first)
    at = np.flatnonzero(np.arange(len(codes)) + size <= first[text + 1]) if len(codes) else np.zeros(0, np.int64)
    if not len(at):
        return covered
    key, span = codes[at].astype(np.int64), n_codes
    for k in range(1, size):
        if span * n_codes >= 1 << 62:  # make the numbers dense before they overflow
            seen, key = np.unique(key, return_inverse=True)
            span = len(seen)
        key = key * n_codes + codes[at + k]
        span *= n_codes
    if span * len(first) >= 1 << 62:
        seen, key = np.unique(key, return_inverse=True)
        span = len(seen)
    key = key + text[at] * span
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(at), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    for k in range(size):
        covered[at[hit] + k] = True
    return covered


def text_stats(texts: pa.Array) -> dict[str, np.ndarray]:
    """``FIELDS`` of each text: counts of code points, words
    ``[^\\x20\\x09-\\x0D]+``, code points in words, symbols, lines with a word,
    those equal to an earlier one, words in repeated 3-word windows, distinct
    words, the most frequent word's count, words of up to three bytes, words
    without a letter, capitals A-Z, letters, digits, points and commas,
    exclamation marks and bars (bytes of other alphabets count as letters)."""
    parts = {f: [np.zeros(0, np.int64)] for f in FIELDS}
    for piece in steps(texts, 1 << 20):
        data, offs = text_buffer(piece)
        inside = ~WHITE[data]
        lead = (data & 0xC0) != 0x80
        starts, ends, first = runs(inside, offs)
        n = len(offs) - 1
        got = {"n_chars": _sums(lead, offs), "n_words": np.diff(first), "word_chars": _sums(lead & inside, offs),
               "n_symbols": _sums(SYMBOL[data], offs), "n_upper": _sums(UPPER[data], offs),
               "n_letter": _sums(LETTER[data] & lead, offs), "n_digit": _sums(DIGIT[data], offs),
               "n_stop": _sums((data == 0x2E) | (data == 0x2C), offs), "n_bang": _sums(data == 0x21, offs),
               "n_bar": _sums(data == 0x7C, offs)}
        got["n_short"] = per_text(ends - starts <= 3, first)
        letters = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int64)])
        got["n_no_letter"] = per_text(_within(letters, starts, ends) == 0, first)
        coded = packed(data, inside, ends - starts).dictionary_encode()
        codes, n_codes = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        got["n_repeat_words"] = per_text(repeated_windows(codes, first, n_codes), first)
        pair, times = np.unique(owner(first) * n_codes + codes, return_counts=True)
        text = pair // n_codes
        got["n_distinct"] = np.bincount(text, minlength=n)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, text, times)
        got["n_top"] = top
        line = data != 0x0A
        starts, ends, first = runs(line, offs)
        words_in = _within(np.concatenate([[0], np.cumsum(inside, dtype=np.int64)]), starts, ends) > 0
        coded = packed(data, line, ends - starts).dictionary_encode()
        n_codes = max(len(coded.dictionary), 1)
        key = (owner(first) * n_codes + coded.indices.to_numpy())[words_in]
        got["n_lines"] = per_text(words_in, first)
        got["n_dup_lines"] = got["n_lines"] - np.bincount(np.unique(key) // n_codes, minlength=n)
        for f in FIELDS:
            parts[f].append(got[f].astype(np.int64))
    return {f: np.concatenate(v) for f, v in parts.items()}
