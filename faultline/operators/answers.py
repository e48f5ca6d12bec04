"""Answer ingestion: text to parsed results, faults and quality flags."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import answers as fn
from faultline.functions.once import once
from faultline.functions.text import empty_to_null


def parse_answers(rows, raw="raw"):
    """Add ``result`` and ``status`` (ok, repaired or failed).

    The repair runs only for rows whose text is not valid JSON.
    """
    text, whole = fn.from_first_brace(F.col(raw)), F.col("_whole")
    judged = rows.select("*", once(_ok=F.coalesce(fn.is_json(text), F.lit(False))))
    fixed = judged.select(
        "*", once(_whole=F.when(F.col("_ok"), text).otherwise(fn.repaired(text)))
    )
    usable = F.col("_ok") | F.coalesce(fn.is_json(whole), F.lit(False))
    return fixed.select(
        *rows.columns,
        once(
            result=fn.to_answer(F.when(usable, whole)),
            status=F.when(F.col("_ok"), "ok").when(usable, "repaired").otherwise("failed"),
        ),
    )


def has_faults(result):
    return F.coalesce(F.size(result["závady"]) > 0, F.lit(False))


def explode_faults(answers, keep, result="result"):
    """One row per fault; answers without faults are rejected by this gate."""
    accepted = answers.filter(has_faults(F.col(result)))
    fault = F.col("fault")
    return accepted.select(
        *keep, F.posexplode(F.col(result)["závady"]).alias("position", "fault")
    ).select(
        *keep,
        "position",
        (F.col("position") == 0).alias("is_primary"),
        fault["název"].alias("fault_name"),
        fault["pravděpodobnost"].alias("probability"),
        fault["popis"].alias("description"),
        fault["příznaky_shoda"].alias("matched_symptoms"),
        fault["obd_kódy"].alias("codes"),
        fault["díly"].alias("parts"),
        fault["postup"].alias("steps"),
        fault["naléhavost"].alias("urgency"),
        fault["poznámka"].alias("note"),
    )


def fault_bands(faults):
    """Urgency level and probability band of each fault."""
    return faults.withColumns(
        {
            "urgency_level": fn.urgency_level(F.col("urgency")),
            "probability_band": fn.probability_band(F.col("probability")),
        }
    )


def top_fault(result):
    """The first fault of an answer; the list is ordered by probability."""
    return F.try_element_at(result["závady"], F.lit(1))


def answer_meta(answers, result="result"):
    """Info text without the cut marker, and whether anything beside faults exists."""
    parsed = F.col(result)
    info = F.nullif(parsed["další_info"], F.lit(fv.INFO_CUT_MARKER))
    return answers.withColumns(
        {
            "info": info,
            "has_meta": F.coalesce(F.size(parsed["doporučené_testy"]) > 0, F.lit(False))
            | empty_to_null(parsed["varování"]).isNotNull()
            | empty_to_null(info).isNotNull(),
        }
    )


def is_off_topic(result):
    """The agreed marker fault with probability 0."""
    return F.coalesce(
        F.exists(
            result["závady"],
            lambda f: (f["název"] == fv.OFF_TOPIC_FAULT) & (f["pravděpodobnost"] == 0),
        ),
        F.lit(False),
    )


def off_topic_rate(answers, by, result="result"):
    return answers.groupBy(*by).agg(
        F.count("*").alias("n_answers"),
        F.count_if(is_off_topic(F.col(result))).alias("n_off_topic"),
    )
