"""Text Column expressions (F4, T1, word splitting, 13a tokenisation).

Everything here is a JVM-side expression except NFKC, which Spark lacks; it
runs as an Arrow-batched function and only receives non-ASCII values.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.config import USER_SPECIALS, WORD_MARK

# Unicode-aware whitespace, as Python's str.split() uses.
WS = r"(?U)\s+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_newlines(col) -> Column:
    """newline to space (tokenizer training text, hypothesis files)."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def split_words(col) -> Column:
    """Whitespace words; empty text gives ``[]``; NULL stays NULL."""
    return F.filter(F.split(_c(col), WS), lambda w: w != F.lit(""))


def n_words(col) -> Column:
    return F.size(split_words(col))


def strip_ws(col) -> Column:
    return F.regexp_replace(_c(col), r"^(?U)\s+|(?U)\s+$", "")


# The Unicode White_Space characters -- what the Java pattern
# (?U)\s matches.  Python's str.split() also splits on U+001C-U+001F, so
# Python-side splitting uses this set instead.
WHITE_SPACE_RE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_white_space(t: str) -> list:
    """Python-side word split that agrees with :func:`split_words`."""
    return [w for w in WHITE_SPACE_RE.split(t) if w]


def _nfkc_one(v):
    return None if v is None else unicodedata.normalize("NFKC", v)


@F.pandas_udf(StringType())
def _nfkc_batch(s):  # pragma: no cover - runs in the Python worker
    return s.map(_nfkc_one)


def nfkc(col) -> Column:
    """NFKC normalisation; ASCII text (already NFKC) never leaves the JVM."""
    c = _c(col)
    ascii_only = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(ascii_only, c).otherwise(
        _nfkc_batch(F.when(~ascii_only, c))
    )


def normalize(col, apply_nfkc: bool = True) -> Column:
    """NFKC, trim, collapse whitespace runs, mark every word start with ``▁``.

    ``"  a  b "`` gives ``"▁a▁b"``; empty or blank text gives ``""``.
    """
    c = nfkc(col) if apply_nfkc else _c(col)
    t = strip_ws(c)
    return F.when(t == F.lit(""), F.lit("")).otherwise(
        F.concat(F.lit(WORD_MARK), F.regexp_replace(t, WS, WORD_MARK))
    )


def marked_words(col, apply_nfkc: bool = True) -> Column:
    """Words of the normalised text, each with its ``▁`` prefix."""
    c = nfkc(col) if apply_nfkc else _c(col)
    return F.transform(split_words(c), lambda w: F.concat(F.lit(WORD_MARK), w))


def chars(col) -> Column:
    """Characters of a string as an array (empty string gives ``[]``)."""
    c = _c(col)
    return F.when(c == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(c, ""))


def has_literal_special(col) -> Column:
    """Q2 predicate: the text holds one of the special pieces literally."""
    c = _c(col)
    cond = F.lit(False)
    for s in USER_SPECIALS:
        cond = cond | F.coalesce(c.contains(s), F.lit(False))
    return cond


# ---------------------------------------------------------------------------
# The "13a" tokenizer of the public BLEU scorer, applied in order.
#   1. drop "<skipped>", join "-\n" hyphenations, newline to space
#   2. unescape &quot; &amp; &lt; &gt;
#   3. pad the symbols  { | } ~ [ \ ] ^ _ ` space ! " # $ % & ( ) * + : ; < = > ? @ /
#   4. split "." and "," unless preceded by a digit
#   5. split "." and "," unless followed by a digit
#   6. split "-" when preceded by a digit
#   7. collapse whitespace, trim
# ---------------------------------------------------------------------------
_13A_SYMBOLS = r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"


def tokenize_13a(col) -> Column:
    c = _c(col)
    c = F.replace(c, F.lit("<skipped>"), F.lit(""))
    c = F.replace(c, F.lit("-\n"), F.lit(""))
    c = F.replace(c, F.lit("\n"), F.lit(" "))
    c = F.replace(c, F.lit("&quot;"), F.lit('"'))
    c = F.replace(c, F.lit("&amp;"), F.lit("&"))
    c = F.replace(c, F.lit("&lt;"), F.lit("<"))
    c = F.replace(c, F.lit("&gt;"), F.lit(">"))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    c = F.regexp_replace(c, _13A_SYMBOLS, " $1 ")
    c = F.regexp_replace(c, r"([^0-9])([\.,])", "$1 $2 ")
    c = F.regexp_replace(c, r"([\.,])([^0-9])", " $1 $2")
    c = F.regexp_replace(c, r"([0-9])(-)", "$1 $2 ")
    return F.regexp_replace(strip_ws(c), WS, " ")
