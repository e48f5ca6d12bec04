"""Signals held in a case's message array."""

from pyspark.sql import functions as F

from faultline.fixed_values import INPUT
from faultline.functions.text import empty_to_null, join_texts, or_empty


def messages_of(messages, kind=INPUT):
    """The messages of one type, in place and in order."""
    return F.filter(messages, lambda m: m["type"] == kind)


def distinct_signals(messages, field):
    """Distinct values of an array field over the inputs, first occurrence first."""
    per_message = F.transform(messages_of(messages), lambda m: or_empty(m[field]))
    return or_empty(F.array_distinct(F.flatten(per_message)))


def input_texts(messages):
    return F.transform(messages_of(messages), lambda m: m["text"])


def joined_text(messages, separator):
    return join_texts(input_texts(messages), separator)


def vehicle_field(vehicle, field):
    """A vehicle attribute with the empty string read as missing."""
    return empty_to_null(vehicle[field])
