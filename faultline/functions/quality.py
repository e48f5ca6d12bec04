"""Verdict expressions: each returns a reason code, null meaning accepted."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.text import is_given, or_empty, strip

#: Any run that ``REPEATED_CHARACTER`` could find; its plain dot is several times faster.
_REPEATED_ANY = r"(?s)(.)\1{6}"


def resolution_reason(text):
    """First failing rule for a resolution text."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    size = F.length(trimmed)
    # split at each blank: the empty pieces between blanks are no long words
    blanks = " " * len(fv.WHITESPACE_CHARACTERS)
    pieces = F.split(F.translate(F.lower(trimmed), fv.WHITESPACE_CHARACTERS, blanks), " ")
    long_words = F.filter(pieces, lambda w: F.length(w) > 2)
    return (
        F.when(size == 0, "missing")
        .when(size < fv.RESOLUTION_MIN, "too_short")
        .when(size > fv.RESOLUTION_MAX, "too_long")
        .when(
            trimmed.rlike(_REPEATED_ANY) & trimmed.rlike(fv.REPEATED_CHARACTER), "repeated_character"
        )
        .when(F.size(F.array_distinct(long_words)) < fv.MIN_DISTINCT_WORDS, "too_few_words")
    )


def first_bad_code(codes, pattern=fv.CODE_PATTERN):
    """The first code that does not match the pattern, else null."""
    bad = F.filter(or_empty(codes), lambda c: ~F.coalesce(c.rlike(pattern), F.lit(False)))
    return F.try_element_at(bad, F.lit(1))


def case_reason(resolution, symptoms, codes, text, model, pattern=fv.CODE_PATTERN):
    """Resolution rules, then signal, code format and model."""
    codes, symptoms = or_empty(codes), or_empty(symptoms)
    described = F.length(strip(F.coalesce(text, F.lit("")))) >= fv.DESCRIPTION_MIN
    return F.coalesce(
        resolution_reason(resolution),
        F.when((F.size(codes) == 0) & (F.size(symptoms) == 0) & ~described, "no_signal")
        .when(F.exists(codes, lambda c: ~F.coalesce(c.rlike(pattern), F.lit(False))), "bad_code")
        .when(~is_given(model), "no_model"),
    )


def reason_text(reason, resolution=None, bad_code=None):
    """The message shown to a user for a reason code."""
    values = {
        "too_short": F.length(strip(resolution)) if resolution is not None else None,
        "too_long": F.length(strip(resolution)) if resolution is not None else None,
        "bad_code": bad_code,
    }
    chain = None
    for code, template in fv.REASON_TEXT.items():
        value = values.get(code)
        text = F.lit(template) if value is None else F.format_string(template, value)
        chain = F.when(reason == code, text) if chain is None else chain.when(reason == code, text)
    return chain


def constraint_flags(resolution, symptoms, codes, description, model):
    """The row-level table constraints, one boolean each, never null.

    Only blanks are trimmed from the model, as in SQL.
    """
    size = F.length(resolution)
    return {
        "resolution_length_ok": F.coalesce(
            size.between(fv.RESOLUTION_MIN, fv.RESOLUTION_MAX), F.lit(False)
        ),
        "signal_ok": (F.size(or_empty(codes)) > 0)
        | (F.size(or_empty(symptoms)) > 0)
        | F.coalesce(F.length(description) >= fv.DESCRIPTION_MIN, F.lit(False)),
        "model_ok": F.coalesce(F.length(F.trim(model)) > 0, F.lit(False)),
    }


def _bounded(inner):
    return rf"(?i)(?<![A-Za-z0-9_])(?:{inner})(?![A-Za-z0-9_])"


def topic_ok(text, terms=tuple(fv.TOPIC_TERMS), units=tuple(fv.TOPIC_UNITS)):
    """Short texts pass; long ones need a code, a domain term or a measured value."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    measured = rf"(?i)[0-9]+[{fv.WHITESPACE}]*(?:{'|'.join(units)})|{fv.TOPIC_DEGREES}"
    return (
        (F.length(trimmed) <= fv.TOPIC_FREE_LENGTH)
        | trimmed.rlike(_bounded(fv.TOPIC_CODE))
        | trimmed.rlike(_bounded("|".join(terms)))
        | trimmed.rlike(measured)
    )


def extract_codes(text, existing, pattern=fv.CODE_PATTERN):
    """Codes typed into a free field, merged behind the ones already chosen."""
    pieces = F.split(F.upper(F.coalesce(text, F.lit(""))), f"[{fv.WHITESPACE},;]+")
    return F.array_union(or_empty(existing), F.filter(pieces, lambda p: p.rlike(pattern)))
