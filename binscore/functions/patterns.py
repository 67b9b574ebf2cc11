"""Regular expressions shared by the Spark expressions and the SQL oracle.

Each pattern is valid both as a Java regex (Spark ``rlike`` /
``regexp_replace``) and as RE2 (DuckDB), and both engines agree on it.
Word boundaries are spelled out with Unicode letter/number classes because
``\\b`` is Unicode-aware in Spark but ASCII-only in DuckDB.
"""

# ---- fixed values: must equal the reference behaviour ---------------------
# Characters trimmed from both ends (str.strip() of Unicode text).
TRIMMED = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
           "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Whole-word "yes" / "no" (re.search(r'\byes\b') / r'\bno\b').
R_YES = r"(^|[^\p{L}\p{N}_])yes($|[^\p{L}\p{N}_])"
R_NO = r"(^|[^\p{L}\p{N}_])no($|[^\p{L}\p{N}_])"
# Substrings that mark a free-text answer as "has a bug", in this order:
# potential, contains, possible, has a few, several, small performance,
# minor issues, there are a few, there is a
BUG_PHRASES = (
    "potential",
    "contains",
    "possible",
    "has a few",
    "several",
    "small performance",
    "minor issues",
    "there are a few",
    "there is a",
)
R_BUG = "|".join(BUG_PHRASES)
# Marker after which a decoded answer starts (chat-template echo).
INST_END = "[/inst]"
R_INST_END = r"\[/inst\]"
# ---------------------------------------------------------------------------

# Whitespace run used for the whitespace token count (explicit class so that
# Java and RE2 agree; ``\s`` differs on vertical tab).
R_WS_RUN = r"[ \t\n\r\f]+"
