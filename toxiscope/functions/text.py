"""Text columns: cleaners, tokens, n-grams, labels.

Every function maps Column -> Column and uses built-in expressions only, so
the whole chain stays inside whole-stage codegen (no Python UDF).

Java's ``\\s`` and ``\\w`` are ASCII-only, while the semantics we reproduce
(Python ``re`` on ``str``) are Unicode-aware; the classes below spell the
Unicode sets out explicitly.  The same class text is valid RE2, so SQL
oracles can reuse it verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour):
#   whitespace = Python str.isspace(): ASCII \t \n \v \f \r space, the
#                information separators U+001C..U+001F, U+0085 and every
#                Unicode separator (categories Zs, Zl, Zp);
#   word char  = Python Unicode \w: letters, numbers and underscore;
#   URL rule   = "http" or "www." followed by non-whitespace;
#   tag rule   = "<" ... ">" without a ">" inside;
#   blank verdict = an em dash with probability 0.0; otherwise "TOXIC" /
#                "NOT TOXIC" at prob >= threshold;
#   slug       = drop "TF-IDF + ", drop "(", ")", "%", space -> "_".
# ---------------------------------------------------------------------------
SPACE_CHARS = "\\t\\n\\x0B\\f\\r \\x1C-\\x1F\\x85\\p{Z}"
WHITESPACE = f"[{SPACE_CHARS}]"
NON_WHITESPACE = f"[^{SPACE_CHARS}]"
WORD_CHAR = "[\\p{L}\\p{N}_]"
URL_PATTERN = f"http{NON_WHITESPACE}+|www\\.{NON_WHITESPACE}+"
TAG_PATTERN = "<[^>]+>"
NOT_ASCII_WORD = "[^a-z0-9]+"
BLANK_VERDICT = "—"
TOXIC_VERDICT = "TOXIC"
CLEAN_VERDICT = "NOT TOXIC"
MODEL_PREFIX = "TF-IDF + "


def _text(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(""))


def no_clean(c: Column | str) -> Column:
    """Missing text becomes '' and nothing else changes."""
    return _text(c)


def aggressive_clean(c: Column | str) -> Column:
    """Lower-case, drop URLs and tags, keep only [a-z0-9] words.

    The reference's last two rules (non-[a-z0-9 whitespace] -> space, collapse
    whitespace) fuse into one replacement of any non-[a-z0-9] run by a space.
    """
    t = F.lower(_text(c))
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, TAG_PATTERN, "")
    t = F.regexp_replace(t, NOT_ASCII_WORD, " ")
    return F.trim(t)


def light_clean(c: Column | str) -> Column:
    """Drop URLs and tags, collapse Unicode whitespace, strip; keeps case and accents."""
    t = F.regexp_replace(_text(c), URL_PATTERN, "")
    t = F.regexp_replace(t, TAG_PATTERN, "")
    t = F.regexp_replace(t, WHITESPACE + "+", " ")
    return F.trim(t)


CLEANERS = {
    "aggressive": aggressive_clean,
    "light": light_clean,
    "none": no_clean,
}


def text_length(c: Column | str) -> Column:
    """Length in code points (missing text -> NULL, like pandas str.len)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.char_length(col)


def clip_length(c: Column | str, upper: int = 2000) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.least(col, F.lit(upper))


def word_tokens(c: Column | str) -> Column:
    """All runs of Unicode word characters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_text(c)), F.lit(WORD_CHAR + "+"), 0)


def vector_tokens(c: Column | str) -> Column:
    """Word runs of length >= 2 (the default vectorizer token rule)."""
    return F.filter(word_tokens(c), lambda t: F.char_length(t) >= 2)


def clean_tokens(clean: Column | str) -> Column:
    """``vector_tokens`` for text that already went through ``aggressive_clean``.

    Such text is single-space separated [a-z0-9] words, so a split is enough
    and much cheaper than a regex scan.
    """
    col = F.col(clean) if isinstance(clean, str) else clean
    return F.filter(F.split(col, " "), lambda t: F.char_length(t) >= 2)


def word_ngrams(tokens: Column | str) -> Column:
    """Unigrams followed by adjacent-pair bigrams ("a b").

    Built from two slices zipped together: every array is evaluated once per
    row (indexing a computed array inside a lambda would re-evaluate it per
    element).
    """
    tok = F.col(tokens) if isinstance(tokens, str) else tokens
    pairs = F.greatest(F.size(tok) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(tok, 1, pairs), F.slice(tok, 2, pairs),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tok, bigrams)


def is_blank(text: Column | str) -> Column:
    """Missing, empty or only (Unicode) whitespace."""
    return _text(text).rlike(f"^{WHITESPACE}*$")


def verdict(text: Column | str, prob: Column | str, threshold: Column | float) -> Column:
    """Label of the interactive checker: blank text short-circuits."""
    p = F.col(prob) if isinstance(prob, str) else prob
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when(is_blank(text), F.lit(BLANK_VERDICT))
            .when(p >= thr, F.lit(TOXIC_VERDICT))
            .otherwise(F.lit(CLEAN_VERDICT)))


def verdict_prob(text: Column | str, prob: Column | str) -> Column:
    """The probability shown next to the verdict: 0.0 for blank text."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(is_blank(text), F.lit(0.0)).otherwise(p)


def slug(label: Column | str) -> Column:
    """Model / split label -> file tag."""
    col = F.col(label) if isinstance(label, str) else label
    return F.translate(F.replace(col, F.lit(MODEL_PREFIX), F.lit("")), " ()%", "_")


def split_to_lang(split: Column | str) -> Column:
    """'English Test (20%)' -> 'en', 'Val-<lang>' -> '<lang>', others NULL."""
    col = F.col(split) if isinstance(split, str) else split
    return (F.when(col == "English Test (20%)", F.lit("en"))
            .when(col.startswith("Val-"), F.substring(col, 5, 1 << 20))
            .otherwise(F.lit(None).cast("string")))
