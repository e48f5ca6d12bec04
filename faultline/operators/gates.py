"""Gates that split rows into accepted and quarantined ones."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import quality
from faultline.functions.once import once
from faultline.functions.signals import distinct_signals, joined_text
from faultline.functions.text import is_given, or_empty, strip
from faultline.operators.limits import tokens_before


def judge_cases(cases):
    """Add the first failing reason and the first malformed code of each case."""
    messages = F.col("messages")
    signals = cases.select(
        "*",
        once(
            _symptoms=distinct_signals(messages, "symptoms"),
            _codes=distinct_signals(messages, "obdCodes"),
            _text=joined_text(messages, " "),
        ),
    )
    reason = quality.case_reason(
        F.col("resolution"), F.col("_symptoms"), F.col("_codes"), F.col("_text"), F.col("vehicle.model")
    )
    return signals.select(
        *cases.columns, once(reason=reason), quality.first_bad_code(F.col("_codes")).alias("bad_code")
    ).withColumn("bad_code", F.when(F.col("reason") == "bad_code", F.col("bad_code")))


def check_constraints(rows):
    """Add one flag per table constraint and their conjunction."""
    flags = quality.constraint_flags(
        *[F.col(c) for c in ("resolution", "symptoms", "obd_codes", "description", "vehicle_model")]
    )
    verdict = flags["resolution_length_ok"] & flags["signal_ok"] & flags["model_ok"]
    return rows.withColumns({**flags, "valid": verdict})


def off_topic(text, symptoms, codes, terms=tuple(fv.TOPIC_TERMS)):
    """Whether an input is free text alone that has nothing to do with vehicles."""
    alone = (F.size(or_empty(symptoms)) == 0) & (F.size(or_empty(codes)) == 0)
    return is_given(strip(text)) & alone & ~quality.topic_ok(text, terms)


def admit_inputs(
    messages, case, position, tokens, budget=fv.TOKENS_PER_CASE, terms=tuple(fv.TOPIC_TERMS)
):
    """Reason why an input message is turned away, null when admitted.

    The token budget comes first; the topic rule applies to free text alone.
    """
    unrelated = off_topic(F.col("text"), F.col("symptoms"), F.col("obdCodes"), terms)
    judged = tokens_before(messages, case, position, tokens)
    return judged.filter(F.col("type") == fv.INPUT).withColumn(
        "reason",
        F.when(F.col("used_before") >= budget, "token_budget").when(unrelated, "off_topic"),
    )


def own_rows(rows, user, column="user_id"):
    """Rows of one user (a predicate, not access control)."""
    return rows.filter(F.col(column) == user)
