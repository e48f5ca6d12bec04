"""Projections between case documents, flat corpus rows and search queries."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.once import once
from faultline.functions.signals import (
    distinct_signals,
    input_texts,
    joined_text,
    messages_of,
    vehicle_field,
)
from faultline.functions.text import (
    empty_to_null,
    first_words,
    grouped_number,
    is_given,
    leading_int,
    non_empty,
    or_empty,
    strip,
)
from faultline.schemas import ANSWER


def explode_messages(cases, kind=None, case="id"):
    """One row per message with its position in the case."""
    rows = cases.select(case, F.posexplode("messages").alias("position", "message"))
    if kind is not None:
        rows = rows.filter(F.col("message.type") == kind)
    return rows.select(case, "position", "message.*")


def with_signals(cases):
    """Distinct symptoms and codes over all inputs, in first-occurrence order."""
    return cases.select(
        "*",
        once(
            symptoms=distinct_signals(F.col("messages"), "symptoms"),
            obd_codes=distinct_signals(F.col("messages"), "obdCodes"),
        ),
    )


def case_to_row(cases, installation=None, separator="\n", now=None):
    """Case document to flat corpus row.

    The desktop joins texts with a newline, the web form with a blank.
    """
    vehicle = F.col("vehicle")
    closed = F.col("closedAt").try_cast("timestamp")
    return with_signals(cases).select(
        F.col("id").alias("local_id"),
        (F.col("installationId") if installation is None else installation).alias(
            "installation_id"
        ),
        vehicle_field(vehicle, "brand").alias("vehicle_brand"),
        vehicle_field(vehicle, "model").alias("vehicle_model"),
        leading_int(vehicle["mileage"]).alias("mileage"),
        vehicle_field(vehicle, "enginePower").alias("engine_power"),
        "symptoms",
        "obd_codes",
        joined_text(F.col("messages"), separator).alias("description"),
        "resolution",
        # now only where the time is missing; an unreadable one stays null for the gates
        F.when(F.col("closedAt").isNull(), now if now is not None else F.current_timestamp())
        .otherwise(closed)
        .alias("closed_at"),
    )


def row_to_case(rows):
    """Corpus row to case document with one synthetic input message."""

    def text(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(""))

    brand = F.when(is_given(F.col("vehicle_brand")), F.concat("vehicle_brand", F.lit(" ")))
    model = F.coalesce(empty_to_null(F.col("vehicle_model")), F.lit(fv.UNKNOWN_MODEL))
    name = F.concat(
        F.lit(fv.CLOUD_PREFIX),
        F.coalesce(brand, F.lit("")),
        model,
        F.lit(" | "),
        F.left(F.col("resolution"), F.lit(40)),
    )
    message = F.struct(
        F.concat(F.col("id"), F.lit("_input")).alias("id"),
        F.lit(fv.INPUT).alias("type"),
        or_empty(F.col("symptoms")).alias("symptoms"),
        or_empty(F.col("obd_codes")).alias("obdCodes"),
        text("description").alias("text"),
        F.col("created_at").alias("timestamp"),
    )
    return rows.select(
        "id",
        F.col("local_id").alias("localId"),
        name.alias("name"),
        F.lit(fv.STATUS_CLOSED).alias("status"),
        F.col("created_at").alias("createdAt"),
        F.col("closed_at").alias("closedAt"),
        "resolution",
        F.lit(True).alias("fromCloud"),
        F.col("installation_id").alias("installationId"),
        F.struct(
            text("vehicle_brand").alias("brand"),
            text("vehicle_model").alias("model"),
            text("mileage").alias("mileage"),
            text("engine_power").alias("enginePower"),
        ).alias("vehicle"),
        F.array(message).alias("messages"),
    )


def case_title(vehicle):
    """Title of a new case from its vehicle."""
    power = F.split(vehicle["enginePower"], " ")[0]
    title = F.concat(
        first_words(vehicle["model"], 3),
        F.when(
            is_given(vehicle["enginePower"]), F.concat(F.lit(" · "), power, F.lit(" kW"))
        ).otherwise(""),
        F.when(
            is_given(vehicle["mileage"]),
            F.concat(F.lit(" · "), grouped_number(vehicle["mileage"]), F.lit(" km")),
        ).otherwise(""),
    )
    return F.when(is_given(vehicle["model"]), title).otherwise(fv.DEFAULT_TITLE)


def diagnosis_title(vehicle, fault_name):
    """Title a case takes from its first diagnosis."""
    subject = F.coalesce(
        empty_to_null(first_words(vehicle["model"], 3)),
        empty_to_null(vehicle["brand"]),
        F.lit(fv.DEFAULT_VEHICLE),
    )
    return F.concat(subject, F.lit(" | "), fault_name)


def retitle_on_first_diagnosis(cases):
    """Rename each case after its first diagnosis; without a fault it keeps its name."""
    first = F.try_element_at(messages_of(F.col("messages"), fv.DIAGNOSIS), F.lit(1))
    fault = F.try_element_at(F.from_json(first["result"], ANSWER)["závady"], F.lit(1))
    retitled = diagnosis_title(F.col("vehicle"), F.coalesce(fault["název"], F.lit("undefined")))
    return cases.withColumn(
        "name", F.when(fault.isNotNull(), retitled).otherwise(F.col("name"))
    )


def search_inputs(cases):
    """The search query of each open case: vehicle, distinct signals, joined text."""
    return with_signals(cases).select(
        F.col("id").alias("query_id"),
        F.col("installationId").alias("installation_id"),
        "vehicle",
        "symptoms",
        F.col("obd_codes").alias("obdCodes"),
        F.coalesce(joined_text(F.col("messages"), " "), F.lit("")).alias("text"),
    )


def user_prompt(cases):
    """The prompt lines of each case; blank parts are skipped."""
    vehicle = F.col("vehicle")
    texts = non_empty(input_texts(F.col("messages")))
    named = F.array_join(
        non_empty(F.array(vehicle["brand"], vehicle["model"], vehicle["enginePower"])), " "
    )

    def listed(label, items):
        return F.when(
            F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", ", ""))
        )

    def described(text, index):
        number = F.when(
            F.size(texts) > 1, F.concat(F.lit(" "), (index + 1).cast("string"))
        ).otherwise("")
        return F.concat(F.lit("Popis mechanika"), number, F.lit(":\n"), text)

    lines = F.concat(
        F.array(
            F.when(
                is_given(vehicle["brand"]) | is_given(vehicle["model"]),
                F.concat(F.lit("Vozidlo: "), named),
            ),
            F.when(
                is_given(vehicle["mileage"]),
                F.concat(F.lit("Nájezd: "), vehicle["mileage"], F.lit(" km")),
            ),
            listed("Příznaky", F.col("symptoms")),
            listed("OBD kódy", F.col("obd_codes")),
        ),
        F.transform(texts, described),
    )
    return with_signals(cases).select("id", F.array_join(lines, "\n").alias("user_prompt"))


def signal_counts(submission):
    """Sizes of the lists a submission holds, by column name; null counts as 0."""
    return {f"n_{name}": F.size(or_empty(items)) for name, items in submission.items()}


def submission_size(symptoms, codes, text):
    """How many signals a submission carries; 0 means nothing to submit."""
    typed = is_given(strip(text)).cast("int")
    return F.size(or_empty(symptoms)) + F.size(or_empty(codes)) + typed


def merge_code_lists(*lists):
    """Ordered union of code lists, first occurrence first."""
    merged = or_empty(lists[0])
    for items in lists[1:]:
        merged = F.array_union(merged, or_empty(items))
    return F.array_distinct(merged)


def new_pending_codes(pending, stored):
    """Pending codes that are not stored yet; duplicates among them stay."""
    stored = or_empty(stored)
    return F.filter(or_empty(pending), lambda code: ~F.array_contains(stored, code))
