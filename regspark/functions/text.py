"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import functions as F

#: The stop words of the standard English analyzer.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def tokens(col, stop: bool = True):
    """Lower-cased runs of letters and digits, without stop words if asked (RET-1)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop else found


def substring_count(text, term):
    """Non-overlapping, case-insensitive occurrences; an empty term occurs 0 times."""
    low, t = F.lower(F.coalesce(text, F.lit(""))), F.lower(term)
    hits = (F.char_length(low) - F.char_length(F.replace(low, t, F.lit("")))) / F.char_length(t)
    return F.when(F.char_length(t) > 0, hits.cast("long")).otherwise(F.lit(0).cast("long"))


def safe_str(col):
    """Trimmed text, or null for null, blanks and the word null (EXT-5)."""
    text = F.trim(col)
    return F.when((text != "") & (F.lower(text) != "null"), text)


def safe_date(col):
    """An ISO date, or null (EXT-4)."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col, "yyyy-MM-dd"))


def first_number(col):
    """The first number in a text, commas removed, or null."""
    return F.expr("try_cast(null as double)") if col is None else F.replace(F.regexp_extract(col, r"([\d,]*\d[\d,]*\.?\d*)", 1), F.lit(","), F.lit("")).try_cast("double")


def match_tier(score, strong: float = 0.05, moderate: float = 0.02):
    """strong, moderate or weak; null counts as 0 (RET-10)."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= strong, "strong").when(s >= moderate, "moderate").otherwise("weak")


def slug(col, fallback: str = "board"):
    """Letters and digits joined by hyphens, lower-cased (LNK-7)."""
    made = F.lower(F.regexp_replace(F.regexp_replace(col, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(F.coalesce(made, F.lit("")) == "", F.lit(fallback)).otherwise(made)


def dot(a, b):
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(dot(a, a))
