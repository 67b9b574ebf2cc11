"""Column expressions for keys, paths and free-text answers.

All of these are native Catalyst expressions (no Python UDF), so they run
inside whole-stage code generation next to the scan that feeds them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from binscore.functions.patterns import R_BUG, R_INST_END, R_NO, R_WS_RUN, R_YES, TRIMMED


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """str.strip(): remove leading and trailing whitespace (``trim`` only
    removes spaces)."""
    return F.btrim(_c(col), F.lit(TRIMMED))


def normalise_key(col) -> Column:
    """``.str.strip().str.lower()`` on a project or path key."""
    return F.lower(strip_ws(col))


def clean_response(col) -> Column:
    """Strip + lower, then keep the text after the last ``[/inst]``."""
    lowered = F.lower(strip_ws(col))
    return strip_ws(F.element_at(F.split(lowered, R_INST_END), -1))


def parse_yes_no(col) -> Column:
    """1 if the answer holds the word yes, else 0 if it holds no, else
    NULL.  Yes wins when both are present."""
    c = _c(col)
    return (F.when(c.rlike(R_YES), F.lit(1))
             .when(c.rlike(R_NO), F.lit(0))
             .otherwise(F.lit(None).cast("int")))


def interpret_response(col) -> Column:
    """1 if the lower-cased answer contains any bug phrase, else 0.
    A missing answer is 0."""
    return F.coalesce(F.lower(_c(col)), F.lit("")).rlike(R_BUG).cast("int")


def has_error(errors="errors") -> Column:
    """An error text is present and not blank."""
    e = _c(errors)
    return e.isNotNull() & (strip_ws(e) != F.lit(""))


def interpreted(errors="errors", prediction="prediction", response="response") -> Column:
    """Heuristic label only where there is no error text at all (blank
    error texts also suppress it) and the answer did not parse."""
    return (F.when(_c(errors).isNull() & _c(prediction).isNull(), interpret_response(response))
             .otherwise(F.lit(None).cast("int")))


def fill_prediction(prediction="prediction", heuristic="interpreted") -> Column:
    """Parsed prediction, else the heuristic one."""
    return F.coalesce(_c(prediction), _c(heuristic))


def whitespace_token_count(col) -> Column:
    """Number of whitespace-separated tokens (NULL text -> NULL)."""
    parts = F.split(_c(col), R_WS_RUN)
    return F.size(F.filter(parts, lambda p: p != F.lit(""))).cast("bigint")


def normalise_path(col) -> Column:
    """Strip leading '/', collapse '//' and '.', resolve '..'.

    A path that climbs above its root resolves to NULL (rejected)."""
    parts = F.split(F.regexp_replace(_c(col), r"^/+", ""), "/")

    def step(acc, part):
        return (F.when(acc.isNull(), acc)
                 .when((part == "") | (part == "."), acc)
                 .when(part == "..",
                       F.when(acc == "", F.lit(None).cast("string"))
                        .otherwise(F.regexp_replace(acc, r"/?[^/]*$", "")))
                 .when(acc == "", part)
                 .otherwise(F.concat(acc, F.lit("/"), part)))

    return F.when(_c(col).isNull(), F.lit(None).cast("string")).otherwise(
        F.aggregate(parts, F.lit(""), step))


def first_upper(col) -> Column:
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def first_lower(col) -> Column:
    c = _c(col)
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def algorithm_short_name(col) -> Column:
    """``"DT with anti-pattern metrics"`` -> ``"DT"``; other names
    unchanged."""
    c = _c(col)
    return F.when(c.contains("with anti-pattern metrics"), F.split(c, " ").getItem(0)).otherwise(c)


def map_with_default(col, mapping: dict) -> Column:
    """Look a value up in a literal map, keep it when absent."""
    c = _c(col)
    if not mapping:
        return c
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def mask_significance(p_col, cles_col, alpha: float = 0.05) -> Column:
    """CLES shown only when the rounded p-value is significant; a NULL
    p keeps the CLES (a comparison with NULL is not true)."""
    p, cles = _c(p_col), _c(cles_col)
    return F.when(p > F.lit(alpha), F.lit("--")).otherwise(format_number_plain(cles))


def format_number_plain(col) -> Column:
    """Python ``str(float)`` for values already rounded to <= 3 decimals:
    ``0.35`` -> '0.35', ``0.4`` -> '0.4', ``1.0`` -> '1.0', NULL -> 'nan'."""
    c = _c(col)
    as_dec = F.format_string("%.3f", c)
    trimmed = F.regexp_replace(as_dec, r"0+$", "")
    return (F.when(c.isNull(), F.lit("nan"))
             .otherwise(F.regexp_replace(trimmed, r"\.$", ".0")))


def format_cell(p_col, cles_text_col) -> Column:
    """``"p (cles)"``; p = 0 prints ``0``."""
    p = _c(p_col)
    p_text = F.when(p == 0, F.lit("0")).otherwise(format_number_plain(p))
    return F.concat(p_text, F.lit(" ("), _c(cles_text_col), F.lit(")"))


def as_bool(col) -> Column:
    """Truthiness of a 0/1 or boolean value."""
    return _c(col).cast("boolean")
