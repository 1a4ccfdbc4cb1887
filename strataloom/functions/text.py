"""Column functions over text, identifiers and hashes. All are built-ins, so they stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about what a file or question is about.
STOPWORDS = (
    "the and for with from this that into are was not you your its has have will can how what when where which who why does did use used using get set new "
    "all any but one two our out via per may should would could about after before then than them they their there these those also more most other some such"
).split()


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_hash(c: str | Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of a text's UTF-8 bytes; null for null."""
    return F.substring(F.sha2(_c(c).cast("binary"), 256), 1, length)


def line_array(c: str | Column) -> Column:
    """Lines of a text, split at LF, without the empty one after a last LF; an empty text has none."""
    x = _c(c)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, r"\n\z", ""), "\n", -1))


def line_count(c: str | Column) -> Column:
    x = _c(c)
    return F.when(x == "", 0).otherwise(F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit(""))) + F.when(x.endswith("\n"), 0).otherwise(1)).cast("int")


def token_set(c: str | Column, least: int = 3) -> Column:
    """Distinct lower-case tokens of at least `least` letters, outer '_', '-' and '+' dropped, stop words left out, in order of first appearance."""
    raw = F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([a-z0-9_+\-]+)"), 1)
    clean = F.transform(raw, lambda t: F.regexp_replace(t, r"^[_\-+]+|[_\-+]+$", ""))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_distinct(F.filter(clean, lambda t: (F.char_length(t) >= least) & ~F.array_contains(stop, t)))


def terms(c: str | Column, least: int = 2) -> Column:
    """Every lower-case run of letters or digits of at least `least` characters, repeats kept."""
    return F.filter(F.regexp_extract_all(F.lower(_c(c)), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda t: F.char_length(t) >= least)


def slug(c: str | Column, length: int = 64) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, length)


def camel_words(c: str | Column) -> Column:
    """Words of an identifier, split at '_', '.', '-' and capitals."""
    x = F.regexp_replace(F.regexp_replace(_c(c), r"([a-z0-9])([A-Z])", "$1 $2"), r"[_.\-/]+", " ")
    return F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != "")


def token_estimate(c: str | Column) -> Column:
    """A third of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(_c(c)) / 3)).cast("int")


def line_of_offset(text: str | Column, offset: Column) -> Column:
    """Line, from 1, of a character offset, from 0."""
    head = F.substring(_c(text), F.lit(1), offset)
    return (F.char_length(head) - F.char_length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def strip_front_matter(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), r"(?s)\A---\r?\n.*?\n---\r?\n", "")


def strip_code_noise(c: str | Column) -> Column:
    """A line of code without string contents and comments."""
    x = F.regexp_replace(_c(c), r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"", '""')
    x = F.regexp_replace(x, r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'", "''")
    return F.regexp_replace(x, r"(?m)(?://|#).*$", "")


def evidence_ids(c: str | Column) -> Column:
    """Distinct [E1]-like citations in order."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"\[(E\d+)\]"), 1))


def file_references(c: str | Column) -> Column:
    """Distinct `dir/name.ext` or `dir/name.ext:12` in backticks, without the line."""
    return F.array_distinct(F.regexp_extract_all(_c(c), F.lit(r"`([\w./\-]+\.[A-Za-z0-9]+)(?::\d+)?`"), 1))


def jaccard(a: str | Column, b: str | Column, both_empty: float | None = 1.0) -> Column:
    """Shared over all elements. Both empty: `both_empty` (None: null); one empty: 0."""
    x, y = _c(a), _c(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(x, y)) / union)


def fraction(c: str | Column) -> Column:
    """A share between 0 and 1 from text: true or false, 0-1, 0-100; anything else 0."""
    x = F.lower(F.trim(_c(c).cast("string")))
    n = x.try_cast("double")
    return F.when(x == "true", 1.0).when(x == "false", 0.0).when(n.isNull() | F.isnan(n) | (n < 0), 0.0).when(n <= 1, n).when(n <= 100, n / 100).otherwise(1.0)


def version_array(c: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(_c(c), F.lit(r"(\d+)"), 1), lambda x: x.cast("int"))


def int_or(c: str | Column, default: int) -> Column:
    return F.coalesce(F.trim(_c(c)).try_cast("int"), F.lit(default))
