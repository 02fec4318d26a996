"""Text analysis as native Spark expressions (no UDF).

Tokens are Unicode word runs, lower-cased, no stop words; positions count
from 0; a token longer than ``MAX_TOKEN_LENGTH`` is cut into chunks of that
length, each taking its own position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define the analyser.
MAX_TOKEN_LENGTH = 255
# Letters, marks, decimal digits and the connector punctuation.
PORTABLE_PATTERN = r"[\p{L}\p{M}\p{Nd}_]+"
# Closer to Unicode word breaking: words joined by an apostrophe, full stop,
# middle dot or colon (don't, U.S.A) and numbers joined by a full stop or
# comma (3.14, 1,000) stay whole, and every Han ideograph or Hiragana
# character is a token of its own (one regex pass; `&&` is Java class
# intersection).
_WORD = r"[\p{L}\p{M}\p{Nd}_&&[^\p{IsHan}\p{IsHiragana}]]"
WORD_BREAK_PATTERN = (r"[\p{IsHan}\p{IsHiragana}]|" + _WORD + r"+"
                      r"(?:['’.·:]" + _WORD + r"+|[.,']\p{Nd}+)*")
DEFAULT_PATTERN = WORD_BREAK_PATTERN


def raw_tokens(text: Column, pattern: str = DEFAULT_PATTERN) -> Column:
    """All matches of the token pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def split_long(tokens: Column, max_len: int = MAX_TOKEN_LENGTH) -> Column:
    """Cut every token longer than ``max_len`` into ``max_len`` pieces."""
    def pieces(t):
        n = F.floor((F.length(t) - 1) / max_len)
        return F.transform(F.sequence(F.lit(0), n.cast("int")),
                           lambda i: F.substring(t, i * max_len + 1, max_len))
    def cut(ts):
        return F.flatten(F.transform(ts, lambda t: F.when(F.length(t) <= max_len, F.array(t)).otherwise(pieces(t))))
    # Most texts have no such token. The array of one names the tokens, which are computed once.
    return F.get(F.transform(F.array(tokens), lambda ts: F.when(
        F.exists(ts, lambda t: F.length(t) > max_len), cut(ts)).otherwise(ts)), F.lit(0))


def tokens(text: Column, pattern: str = DEFAULT_PATTERN) -> Column:
    """ARRAY<STRING> of the analysed tokens of ``text``, in order."""
    return split_long(raw_tokens(text, pattern))


def analyze(df, text_col: str, id_col: str, pattern: str = DEFAULT_PATTERN):
    """One row per token: (id, position, term). Positions start at 0."""
    return (df.select(F.col(id_col), F.posexplode(tokens(F.col(text_col), pattern)))
              .withColumnRenamed("pos", "position").withColumnRenamed("col", "term"))


def token_count(text: Column, pattern: str = DEFAULT_PATTERN) -> Column:
    return F.size(tokens(text, pattern))
