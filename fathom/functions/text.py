"""Text expressions: normalisation and tokens, all as JVM-side regex and
higher-order functions (plus the same rules in plain Python for programs run
through ``mapInPandas``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The normalisation and token rules of the reference scorer.
# Whitespace for the regexes is the ASCII set [ \t\n\v\f\r]; splitting into
# tokens uses every character Python's str.split() treats as whitespace.
WS = r" \t\n\x0B\f\r"
SPLIT_WS = r" \t\n\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
URL_PATTERN = rf"((http://[^{WS}]+)|(www\.[^{WS}]+)|(https?://[^{WS}]+))"  # non-blanks after www., where the scorer has blanks
USER_PATTERN = rf"@[^{WS}]+"
SPACE_PATTERN = rf"[{WS}]+"
HASHTAG_PATTERN = rf"#([^{WS}]+)"
EDGE_QUOTES = "'\""
TOKEN_EDGE = "'\"?,."
WORDLIKE = r"^[a-zA-Z][a-zA-Z0-9]*[a-zA-Z]+[a-zA-Z0-9]*$"
REPEAT_PATTERN = r"(?s)(.)\1+"
RESERVED_STOPWORDS = ("USER", "URL")


def _strip_chars(col: Column, chars: str) -> Column:
    """Remove any of ``chars`` from both ends (native ``btrim``, no regex)."""
    return F.btrim(col, F.lit(chars))


def normalize(col) -> Column:
    """lower-case; urls -> URL; @name -> USER; whitespace runs -> one blank;
    #word -> word; quotes stripped from both ends (in that order)."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(c)
    c = F.regexp_replace(c, URL_PATTERN, "URL")
    c = F.regexp_replace(c, USER_PATTERN, "USER")
    c = F.regexp_replace(c, SPACE_PATTERN, " ")
    c = F.regexp_replace(c, HASHTAG_PATTERN, "$1")
    return _strip_chars(c, EDGE_QUOTES)


def tokens(norm_col, stopwords=()) -> Column:
    """Split on whitespace; collapse a run of one character to two; strip
    ``' " ? , .`` from both ends; drop a token only when it is word-like and a
    stop word (``USER`` and ``URL`` are stop words whenever a list is given)."""
    c = F.col(norm_col) if isinstance(norm_col, str) else norm_col
    # a run of one character never spans a token edge (whitespace is not part
    # of a token and whitespace runs do not change the split), so the run
    # collapse is applied once to the whole text instead of per token
    c = F.regexp_replace(c, REPEAT_PATTERN, "$1$1")
    parts = F.filter(F.split(c, f"[{SPLIT_WS}]+"), lambda t: t != "")
    parts = F.transform(parts, lambda t: _strip_chars(t, TOKEN_EDGE))
    stop = list(dict.fromkeys([*stopwords, *RESERVED_STOPWORDS])) if stopwords else []
    if not stop:
        return parts
    arr = F.array(*[F.lit(s) for s in stop])
    # the list first: the pattern backtracks over long tokens, and only words of the list reach it
    return F.filter(parts, lambda t: ~(F.array_contains(arr, t) & t.rlike(WORDLIKE)))


# --- the same rules for per-record Python programs ---------------------------

_py_url = re.compile(URL_PATTERN)
_py_user = re.compile(USER_PATTERN)
_py_space = re.compile(SPACE_PATTERN)
_py_tag = re.compile(HASHTAG_PATTERN)


def normalize_py(text: str) -> str:
    t = text.lower()
    t = _py_url.sub("URL", t)
    t = _py_user.sub("USER", t)
    t = _py_space.sub(" ", t)
    t = _py_tag.sub(r"\1", t)
    return t.strip(EDGE_QUOTES)
