"""Text helpers with the whitespace and emptiness rules the operators share."""

from pyspark.sql import functions as F

from faultline.fixed_values import WHITESPACE, WHITESPACE_CHARACTERS


def strip(text):
    """Trim every kind of whitespace (Spark's own ``trim`` drops only blanks)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def words(text):
    return F.split(text, f"[{WHITESPACE}]+")


def empty_to_null(text):
    return F.nullif(text, F.lit(""))


def or_empty(items):
    """A null array becomes an empty one."""
    return F.coalesce(items, F.array().cast("array<string>"))


def is_given(text):
    """Neither null nor empty; never null itself."""
    return F.coalesce(text != "", F.lit(False))


def non_empty(texts):
    return F.filter(or_empty(texts), is_given)


def join_texts(texts, separator):
    """Concatenate the non-empty texts; nothing left means null."""
    return empty_to_null(F.array_join(non_empty(texts), separator))


def leading_int(text):
    """The integer a text starts with, else null (also when it overflows)."""
    digits = F.regexp_extract(text, rf"^[{WHITESPACE}]*([+-]?[0-9]+)", 1)
    return empty_to_null(digits).try_cast("int")


def grouped_number(text):
    """Number text in Czech grouping: no-break space groups, decimal comma."""
    number = text.try_cast("decimal(30,3)")
    shown = F.translate(
        F.call_function("format_number", number, F.lit("#,##0.###")), ",.", "\u00a0,"
    )
    return F.coalesce(shown, F.lit("NaN"))


def first_words(text, count):
    """The first blank-separated pieces; a run of blanks keeps its empty pieces."""
    return F.array_join(F.slice(F.split(text, " "), 1, count), " ")


def short_id():
    """Eight random hex characters."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(8))
