"""K1: batch scoring of prompts by a pluggable predictor.

Scoring is the one step that needs Python: the prompts go to the
predictor in Arrow batches through ``mapInPandas`` and come back as
(response, error, token_size).  The predictor is built once per Python
worker (a module-level cache) and called on a whole batch; if the batch
call fails, each row is retried alone so that one bad row only fills that
row's ``error`` and never fails the job.  Parsing the response into a
label stays in the JVM (B10, B11) after the batch comes back.

The shipped predictor is deterministic (a keyword rule), so results are
repeatable and checkable in SQL; a real model is supplied as another
factory with the same call signature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from binscore.functions.patterns import R_WS_RUN
from binscore.functions.text import clean_response, parse_yes_no

# ---- fixed values of the keyword predictor ---------------------------------
KEYWORDS = ("while", "for", "loop")
SECOND_KEYWORDS = ("then", "thing", "loop")
THIRD_KEYWORDS = ("des", "thin", "un")
ANSWER_YES = "performance bug: YES"
ANSWER_NO = "performance bug: NO"
# ---- limits of the predictors that have one -----------------------------------
MIN_TOKENS, MAX_TOKENS = 150, 600
TOO_LONG = "Prompt too long"
CONTEXT_TOKENS = 2000
# ---------------------------------------------------------------------------

SCORE_FIELDS = [StructField("response", StringType()), StructField("score_error", StringType()),
                StructField("token_size", LongType())]


def keyword_pattern(keywords=KEYWORDS) -> str:
    """Whole-word, case-sensitive alternation of ``keywords`` (same boundary
    classes as the yes/no patterns, valid in Java, RE2 and ``regex``)."""
    alt = "|".join(keywords)
    return rf"(^|[^\p{{L}}\p{{N}}_])({alt})($|[^\p{{L}}\p{{N}}_])"


class KeywordPredictor:
    """Answers YES when the prompt contains one of the keywords as a word."""

    def __init__(self, keywords=KEYWORDS):
        import regex
        self._re = regex.compile(keyword_pattern(keywords))
        self._ws = regex.compile(R_WS_RUN)

    def token_size(self, prompt: str) -> int:
        return sum(1 for t in self._ws.split(prompt) if t)

    def __call__(self, prompts: list[str]) -> list[tuple[str, int]]:
        return [(ANSWER_YES if self._re.search(p) else ANSWER_NO, self.token_size(p)) for p in prompts]


class LimitedPredictor(KeywordPredictor):
    """A keyword predictor with limits: a batch with a prompt above
    ``MAX_TOKENS`` fails as a whole, prompts below ``MIN_TOKENS`` get no
    answer, so a batch may come back with too few."""

    def __call__(self, prompts: list[str]) -> list[tuple[str, int]]:
        sizes = [self.token_size(p) for p in prompts]
        if max(sizes, default=0) > MAX_TOKENS:
            raise ValueError(TOO_LONG)
        return super().__call__([p for p, n in zip(prompts, sizes) if n >= MIN_TOKENS])


class SecondPredictor(KeywordPredictor):
    def __init__(self):
        super().__init__(SECOND_KEYWORDS)


class ThirdPredictor(KeywordPredictor):
    """Refuses a batch with a prompt above ``CONTEXT_TOKENS``."""

    def __init__(self):
        super().__init__(THIRD_KEYWORDS)

    def __call__(self, prompts: list[str]) -> list[tuple[str, int]]:
        if any(self.token_size(p) > CONTEXT_TOKENS for p in prompts):
            raise ValueError(TOO_LONG)
        return super().__call__(prompts)


_PREDICTORS: dict = {}


def _predictor(factory: Callable):
    p = _PREDICTORS.get(factory)
    if p is None:
        p = _PREDICTORS[factory] = factory()
    return p


def _answers(predictor: Callable, texts: pd.Series) -> tuple[list, list, list]:
    """Response, error and token size of each text (all None without one).  A
    failing batch is halved until the failing rows stand alone, so one of n rows
    costs about 2 log2(n) further calls."""
    resp, err, size = ([None] * len(texts) for _ in range(3))
    todo = [[i for i, t in enumerate(texts) if isinstance(t, str)]]
    while todo:
        part = todo.pop()
        try:
            outs = list(predictor([texts.iloc[i] for i in part]))
            if len(outs) != len(part):
                raise ValueError(f"{len(outs)} answers to {len(part)} prompt{'s' * (len(part) != 1)}")
            for i, (r, n) in zip(part, outs):
                resp[i], size[i] = r, n
        except Exception as e:  # noqa: BLE001 - a failed row keeps its error text
            if len(part) > 1:
                todo += [part[len(part) // 2:], part[:len(part) // 2]]
            elif part:
                err[part[0]] = str(e) or type(e).__name__
    return resp, err, size


def _score_frames(factories: dict[str | None, Callable], text_col: str, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, factory in factories.items():
                resp, err, size = _answers(_predictor(factory), pdf[text_col])
                out = pdf[keys].copy()
                if model is not None:
                    out["model"] = model
                out["response"] = pd.Series(resp, dtype="object")
                out["score_error"] = pd.Series(err, dtype="object")
                out["token_size"] = pd.Series(size, dtype="Int64")
                yield out
    return run


def score_prompts(df: DataFrame, text_col: str = "prompt_text", factory: Callable = KeywordPredictor,
                  keys: list[str] | None = None) -> DataFrame:
    """Score every row with a non-NULL ``text_col``; rows without a prompt
    (failed lookups) pass through with NULL response and token size.
    Returns ``keys`` + response, score_error, token_size, prediction."""
    keys = list(keys or [c for c in df.columns if c != text_col])
    in_schema = df.select(*keys).schema
    schema = StructType(list(in_schema.fields) + SCORE_FIELDS)
    scored = df.select(*keys, text_col).mapInPandas(_score_frames({None: factory}, text_col, keys), schema)
    return scored.withColumn("prediction", parse_yes_no(clean_response("response")))


def score_models(df: DataFrame, factories: dict[str, Callable], text_col: str = "prompt_text",
                 keys: list[str] | None = None) -> DataFrame:
    """``score_prompts`` for several models: one row per prompt and model,
    with its ``model``.  A prompt goes to Python once, whatever the number of
    models."""
    keys = list(keys or [c for c in df.columns if c != text_col])
    schema = StructType([*df.select(*keys).schema.fields, StructField("model", StringType()), *SCORE_FIELDS])
    scored = df.select(*keys, text_col).mapInPandas(_score_frames(dict(factories), text_col, keys), schema)
    return scored.withColumn("prediction", parse_yes_no(clean_response("response")))


def merge_errors(failure_col: str = "failure", score_error_col: str = "score_error"):
    """The ``errors`` column of the raw output: a lookup failure, else the
    scorer's error, else NULL."""
    return F.coalesce(F.col(failure_col), F.col(score_error_col))
