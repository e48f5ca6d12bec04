"""Weighted similarity of a corpus case to a query, in tenths of a point."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.text import is_given, or_empty, words


def case_text(symptoms, codes, description):
    """Everything searchable about a case, lower-cased."""
    parts = F.concat(
        or_empty(symptoms), or_empty(codes), F.array(F.coalesce(description, F.lit("")))
    )
    return F.lower(F.array_join(parts, " ", ""))


def lowered(items):
    return F.transform(or_empty(items), F.lower)


def query_words(text):
    """The query words that can score; repeated words stay repeated."""
    return F.filter(
        words(F.lower(F.coalesce(text, F.lit("")))),
        lambda w: F.length(w) >= fv.MIN_WORD_LENGTH,
    )


def _found(needles, text):
    return F.size(F.filter(needles, lambda needle: F.contains(text, needle)))


def _same(asked, held):
    return is_given(asked) & F.coalesce(asked == held, F.lit(False))


def attribute_tenths(asked_model, model, asked_power, power):
    return F.when(_same(asked_model, model), fv.MODEL_TENTHS).otherwise(0) + F.when(
        _same(asked_power, power), fv.POWER_TENTHS
    ).otherwise(0)


def code_tenths(codes, text):
    return _found(codes, text) * fv.CODE_TENTHS


def symptom_tenths(symptoms, text):
    return _found(symptoms, text) * fv.SYMPTOM_TENTHS


def word_tenths(query_terms, text):
    return F.least(_found(query_terms, text) * fv.WORD_TENTHS, F.lit(fv.WORD_TENTHS_MAX))


def base_tenths(codes, symptoms, text, attributes):
    """All parts but the words; the lists are lower-cased already."""
    return attributes + code_tenths(codes, text) + symptom_tenths(symptoms, text)


def similarity_tenths(codes, symptoms, terms, text, attributes):
    """Sum of all parts; the lists are lower-cased already."""
    return base_tenths(codes, symptoms, text, attributes) + word_tenths(terms, text)
