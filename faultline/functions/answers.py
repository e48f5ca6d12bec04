"""Parsing and repair of structured answers that may be cut short."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.schemas import ANSWER

# An escape pair, one structural character, a run of plain text or a lone backslash
TOKEN = r'(?s)(\\.|["{}\[\]]|[^\\"{}\[\]]++|\\)'


def join_blocks(content):
    """All text blocks of an answer, in order; a missing text counts as empty."""
    return F.array_join(F.transform(content, lambda b: F.coalesce(b["text"], F.lit(""))), "")


def from_first_brace(raw):
    """The text from the first opening brace on, null when there is none."""
    at = F.instr(raw, "{")
    return F.when(at > 0, F.substring(raw, at, F.length(raw)))


def is_json(text):
    """Whether the text is one complete JSON value with nothing behind it.

    Spark's parser stops after the first value.  Inside brackets only text that
    starts with ``]`` or ``,`` could follow unnoticed, inside an object only
    ``}`` or a further field, so passing both leaves nothing.  An object may repeat a
    key; the last value counts.
    """
    strict = {"allowSingleQuotes": "false"}
    in_list = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    in_object = F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string", strict)
    return F.coalesce(F.get(in_list, F.lit(0)).isNotNull() & in_object["x"].isNotNull(), F.lit(False))


def complete_length(text):
    """Length of the text up to the last brace that closes a list element, else 0."""
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("quoted"),
        F.lit(0).alias("complete"),
    )

    def step(state, token):
        # Outside strings a backslash means nothing, so only its partner counts.
        char = F.when(state["quoted"], token).otherwise(F.right(token, F.lit(1)))
        plain = F.length(token) - F.when(token.startswith("\\"), 1).otherwise(0) > 1
        char = F.when(plain, "").otherwise(char)
        bare = ~state["quoted"]
        at = state["at"] + F.length(token)
        depth = (
            state["depth"]
            + (bare & char.isin("{", "[")).cast("int")
            - (bare & char.isin("}", "]")).cast("int")
        )
        return F.struct(
            at.alias("at"),
            depth.alias("depth"),
            (state["quoted"] != (char == '"')).alias("quoted"),
            F.when(bare & (char == "}") & (depth == 2), at)
            .otherwise(state["complete"])
            .alias("complete"),
        )

    return F.aggregate(
        F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), start, step, lambda s: s["complete"]
    )


def repaired(text):
    """The complete part closed with the fixed tail; null when nothing is complete."""
    length = complete_length(text)
    return F.when(length > 1, F.concat(F.left(text, length), F.lit(fv.REPAIR_TAIL)))


def to_answer(text):
    return F.from_json(text, ANSWER)


def urgency_level(urgency):
    return (
        F.when(urgency == "kritická", "critical")
        .when(urgency == "vysoká", "high")
        .when(urgency == "střední", "medium")
        .otherwise("low")
    )


def probability_band(probability):
    return (
        F.when(probability > 70, "high").when(probability > 40, "medium").otherwise("low")
    )
