"""The size of a rendered prompt in a tokenizer's tokens.

A tokenizer is plugged in as a factory; what it makes cuts a text into pieces
that are tokenised by themselves (``pieces``) and tells the tokens of a piece
(``size``).  It is made once per Python worker.  A batch is walked in stretches of
at most ``HELD_BYTES`` of text, whatever its rows, and each distinct piece of a
stretch is tokenised once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """How a chat model's prompt is written: ``before role after_role content
    end`` for each message, then ``ask`` for the answer."""
    before: str
    after_role: str
    end: str
    ask: str

    def render(self, messages) -> Column:
        m = F.col(messages) if isinstance(messages, str) else messages
        turns = F.transform(m, lambda t: F.concat(F.lit(self.before), t["role"], F.lit(self.after_role), t["content"], F.lit(self.end)))
        return F.concat(F.array_join(turns, ""), F.lit(self.ask))


# ---- fixed values: a widely used chat format -----------------------------------
CHATML = ChatTemplate("<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n")
# ----------------------------------------------------------------------------------


#: Bytes of the texts whose pieces a worker holds at once (one text at least).
HELD_BYTES = 1 << 18


class WhitespaceTokenizer:
    """White-space separated words, one token each."""

    def pieces(self, text: str) -> list[str]:
        return re.findall(r"[^ \t\n\r\f]+", text)

    def size(self, piece: str) -> int:
        return 1


class LibraryTokenizer:
    """A tokenizer file of the ``tokenizers`` library, without the tokens that it
    would put around a text.  Its added tokens count one each where they occur."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]
        self.added = set(added)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def pieces(self, text: str) -> list[str]:
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append(part)
                continue
            if self.library.normalizer is not None:
                part = self.library.normalizer.normalize_str(part)
            out += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def size(self, piece: str) -> int:
        return 1 if piece in self.added else len(self.library.model.tokenize(piece))


_MADE: dict = {}


def _tokenizer(factory: Callable, args: tuple):
    if (factory, args) not in _MADE:
        _MADE[factory, args] = factory(*args)
    return _MADE[factory, args]


def stretches(text: pa.Array):
    """``text`` in slices of at most ``HELD_BYTES``, one text at least."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(text):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_BYTES, side="right")))
        yield text.slice(at, until - at)
        at = until


def count_tokens(made, text: pa.Array) -> pa.Array:
    """Tokens of each text by the tokenizer ``made`` (NULL for NULL)."""
    sizes = [np.zeros(0, np.int64)]
    for part in stretches(text):
        found = [made.pieces(t or "") for t in part.to_pylist()]
        coded = pa.array([p for pieces in found for p in pieces], pa.string()).dictionary_encode()
        each = np.array([made.size(p) for p in coded.dictionary.to_pylist()], np.int64)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in found])]).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64))])
        sizes.append(total[ends[1:]] - total[ends[:-1]])
    return pa.array(np.concatenate(sizes), pa.int64(), mask=np.asarray(text.is_null()))


def token_counter(factory: Callable = WhitespaceTokenizer, *args):
    """An Arrow function of a text column: tokens of each text (NULL for NULL).
    ``factory(*args)`` makes the tokenizer in the worker."""
    @F.arrow_udf("bigint")
    def n_tokens(text: pa.Array) -> pa.Array:
        return count_tokens(_tokenizer(factory, args), text)
    return n_tokens


def prompt_sizes(df: DataFrame, prompt: str, template: ChatTemplate, factory: Callable, *args, out: str = "prompt_tokens") -> DataFrame:
    """``df`` with the number of tokens of its ``prompt`` (messages) as ``template``
    writes it."""
    return df.withColumn(out, token_counter(factory, *args)(template.render(prompt)))
