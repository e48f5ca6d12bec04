"""Domain-shaped views over the shared benchmark tables.

Each view covers its whole tables.  ``oracle_views`` in ``oracle.py`` states the
same definitions in SQL.
"""

from pyspark.sql import functions as F

from faultline import fixed_values as fv

SENDER = "corpus"
#: Parts, about 100 bytes each, that are broadcast to the order lines.
BROADCAST_PARTS = 2_000_000


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows):
    """Deal out a table that is stored in fewer pieces than there are cores.

    Work that is heavy per row would otherwise leave cores idle; a table of many
    pieces is left as it is, so nothing is shuffled at scale.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def text_id(column):
    return F.col(column).cast("string")


def order_parts(lines, parts, most=BROADCAST_PARTS):
    """Order lines with their parts, dealt out by order.

    Few parts (counted) are broadcast, so that two numbers a line travel; of many, the lines
    meet them by a shuffle first.
    """
    same = F.col("l_partkey") == F.col("p_partkey")
    if parts.limit(most + 1).count() <= most:
        return lines.repartition("l_orderkey").join(F.broadcast(parts), same)
    return lines.join(parts, same).drop("l_partkey", "p_partkey").repartition("l_orderkey")


def case_rows(spark, sf_dir):
    """One flat case per order that has lines.

    The arrays hold distinct values of few lines each, so combining them before the shuffle
    would cost more than it saves.  Orders meet their customers first, so that the arrays
    do not travel.
    """
    lines = order_parts(
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"),
        table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_name"),
    )
    signals = lines.groupBy("l_orderkey").agg(
        *[
            F.sort_array(F.collect_set(source)).alias(name)
            for source, name in [("p_type", "types"), ("p_brand", "brands"), ("p_name", "names")]
        ]
    )
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    joined = signals.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    price, balance = F.col("o_totalprice"), F.col("c_acctbal")
    described = F.array_join("names", " ")
    return joined.select(
        text_id("o_orderkey").alias("id"),
        text_id("o_orderkey").alias("local_id"),
        text_id("o_custkey").alias("installation_id"),
        F.when(balance >= -500, F.col("c_mktsegment")).alias("vehicle_brand"),
        F.when(balance <= 9500, F.col("n_name")).alias("vehicle_model"),
        F.floor(price).cast("int").alias("mileage"),
        F.col("o_orderpriority").alias("engine_power"),
        F.col("types").alias("symptoms"),
        F.when(price >= 5000, F.col("brands"))
        .otherwise(F.array().cast("array<string>"))
        .alias("obd_codes"),
        described.alias("description"),
        described.alias("resolution"),
        F.when(price < 495000, F.col("o_orderdate")).alias("closed_at"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )


def closed(rows):
    return rows.filter("status = 'F'")


def as_queries(rows):
    """Open cases as flat search queries."""
    return rows.filter("status = 'O'").select(
        F.col("id").alias("query_id"),
        "installation_id",
        F.col("vehicle_brand").alias("brand"),
        F.col("vehicle_model").alias("model"),
        F.col("engine_power").alias("power"),
        "symptoms",
        F.col("obd_codes").alias("codes"),
        F.col("description").alias("text"),
    )


def case_corpus(spark, sf_dir):
    """All closed cases."""
    return closed(case_rows(spark, sf_dir))


def case_queries(spark, sf_dir):
    """All open cases, as flat search queries."""
    return as_queries(case_rows(spark, sf_dir))


def _message(kind, suffix, symptoms, codes, text, result=None, tokens=None):
    nothing = F.lit(None)
    return F.struct(
        F.concat(F.col("id"), F.lit(suffix)).alias("id"),
        F.lit(kind).alias("type"),
        symptoms.alias("symptoms"),
        codes.alias("obdCodes"),
        text.alias("text"),
        F.col("created_at").cast("string").alias("timestamp"),
        (nothing if result is None else result).cast("string").alias("result"),
        nothing.cast("array<string>").alias("ragMatchIds"),
        (nothing if tokens is None else tokens).cast("bigint").alias("tokensUsed"),
    )


def case_documents(spark, sf_dir):
    """Nested case documents: two inputs around a diagnosis whose signals must not count.

    Two-digit brands give well-formed codes, one-digit brands malformed ones.
    """
    codes = F.transform(
        "obd_codes", lambda c: F.concat(F.lit("P00"), F.replace(c, F.lit("Brand#"), F.lit("")))
    )
    power = F.col("engine_power")
    fault = F.concat(
        F.lit('{"shrnutí":"s","závady":[{"název":"'),
        F.col("symptoms")[0],
        F.lit('","pravděpodobnost":80}]}'),
    )
    messages = F.array(
        _message(fv.INPUT, "-1", F.col("symptoms"), codes, F.col("description")),
        _message(
            fv.DIAGNOSIS,
            "-2",
            F.array(F.col("local_id")),
            F.array(F.lit("P0000")),
            F.lit("ignored"),
            F.when(F.col("status") != "P", fault).otherwise('{"závady":[]}'),
            F.col("mileage"),
        ),
        _message(
            fv.INPUT,
            "-3",
            F.concat(F.array(power), F.reverse("symptoms")),
            F.when(F.col("status") != "P", F.reverse(codes)),
            F.when(F.col("status") != "O", power).otherwise(""),
        ),
    )
    return case_rows(spark, sf_dir).select(
        "id",
        F.concat(F.lit("case "), "id").alias("name"),
        F.when(F.col("status") == "F", fv.STATUS_CLOSED).otherwise(fv.STATUS_OPEN).alias("status"),
        F.col("created_at").cast("string").alias("createdAt"),
        F.col("closed_at").cast("string").alias("closedAt"),
        F.struct(
            F.coalesce("vehicle_brand", F.lit("")).alias("brand"),
            F.coalesce("vehicle_model", F.lit("")).alias("model"),
            F.when(F.col("status") == "P", "abc")
            .otherwise(F.concat(F.col("mileage").cast("string"), F.lit(" km")))
            .alias("mileage"),
            power.alias("enginePower"),
        ).alias("vehicle"),
        messages.alias("messages"),
        "resolution",
        F.col("mileage").cast("bigint").alias("tokenCount"),
        F.col("installation_id").alias("installationId"),
    )


def open_rounds(spark, sf_dir):
    """Open cases with a newest input of text alone; undiagnosed where the status is P."""
    documents = case_documents(spark, sf_dir).filter(F.col("status") != fv.STATUS_CLOSED)
    nothing = F.lit(None).cast("array<string>")
    newest = F.col("messages")[0]
    for field, value in [("id", F.concat("id", F.lit("-4"))), ("symptoms", nothing), ("obdCodes", nothing)]:
        newest = newest.withField(field, value)
    fresh = F.col("vehicle.mileage") == "abc"
    kept = F.when(fresh, F.filter("messages", lambda m: m["type"] == fv.INPUT)).otherwise(F.col("messages"))
    return documents.withColumn("messages", F.concat(kept, F.array(newest)))


def round_answers(rounds):
    """Answers to the rounds by engine power: whole, none at all, without faults, cut, missing."""
    power = F.col("vehicle.enginePower")
    fault = F.lit('{"závady":[{"název":"pump","pravděpodobnost":70}')
    body = (
        F.when(power == "1-URGENT", F.concat(fault, F.lit("]}")))
        .when(power == "2-HIGH", "no object at all")
        .when(power == "3-MEDIUM", '{"závady":[]}')
        .when(power == "4-NOT SPECIFIED", F.concat(fault, F.lit(',{"název":"cut')))
    )
    return rounds.filter(body.isNotNull()).select(
        F.col("id").alias("case_id"),
        F.concat("id", F.lit("-d")).alias("diagnosis_id"),
        F.col("createdAt").alias("answered_at"),
        F.array(F.struct(body.alias("text"))).alias("content"),
        F.lit(10).cast("bigint").alias("input_tokens"),
        F.when(power == "1-URGENT", F.lit(5)).cast("bigint").alias("output_tokens"),
        F.array("id").alias("match_ids"),
    )


def case_messages(spark, sf_dir):
    """Conversation turns as case messages; tokens are words."""
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("case_id"),
        F.col("turn").alias("position"),
        F.when(F.col("role") == "user", fv.INPUT)
        .when(F.col("role") == "assistant", fv.DIAGNOSIS)
        .otherwise("system")
        .alias("type"),
        "text",
        F.size(F.split(trimmed, r"\s+")).cast("bigint").alias("tokens"),
    )


def as_versions(lines):
    """Order lines as repeated versions of a keyed row; earlier loads have status F."""
    return lines.select(
        F.col("l_orderkey").alias("installation_id"),
        F.col("l_linenumber").alias("local_id"),
        "l_linestatus",
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


def line_versions(spark, sf_dir):
    return as_versions(table(spark, sf_dir, "lineitem"))


VERSION_ORDER = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
]


def as_usage(events):
    """Events as model calls; an error event is a failed call."""
    return events.select(
        "event_id",
        text_id("user_id").alias("installation_id"),
        "ts",
        (F.col("event_type") != "error").alias("success"),
        F.col("event_type").alias("model"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
        "value",
    )


def usage_log(spark, sf_dir):
    return as_usage(table(spark, sf_dir, "events"))


def as_violations(usage):
    return usage.filter("NOT success").select(
        "event_id",
        "installation_id",
        F.col("model").alias("reason"),
        F.col("ts").alias("created_at"),
    )


def violation_log(spark, sf_dir):
    return as_violations(usage_log(spark, sf_dir))


def session_rows(spark, sf_dir):
    """Events as session rows with a JSON document."""
    return table(spark, sf_dir, "events").select(
        text_id("event_id").alias("id"),
        text_id("user_id").alias("user_id"),
        F.col("props").alias("data"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


def free_texts(spark, sf_dir):
    """Every text of the tables, whole."""
    sources = [
        ("documents", F.col("doc_id"), "text"),
        ("benchmark", F.col("item_id"), "text"),
        ("conversations", F.col("conv_id") * 1000 + F.col("turn"), "text"),
        ("part", F.col("p_partkey"), "p_name"),
        ("pages", F.col("page_id"), "url"),
        ("pages.html", F.col("page_id"), "html"),
        ("customer", F.col("c_custkey"), "c_name"),
    ]
    parts = [
        spread(
            table(spark, sf_dir, name.split(".")[0]).select(
                F.lit(name).alias("source"),
                key.cast("bigint").alias("text_id"),
                F.col(column).alias("text"),
            )
        )
        for name, key, column in sources
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def hex4(column):
    """The low 16 bits as four hex digits."""
    return F.right(F.lpad(F.hex(column), 8, "0"), F.lit(4))


def raw_scans(spark, sf_dir):
    """Two-line responses with a repeated code, one per order line."""
    part, supplier = hex4(F.col("l_partkey")), hex4(F.col("l_suppkey"))
    raw = F.concat(
        F.lit("43 02 "), part, F.lit(" "), supplier,
        F.lit("\r\n43 01 "), part, F.lit(" 00 00 12\r>"),
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return spread(table(spark, sf_dir, "lineitem").select(*keys)).select(
        F.col("l_orderkey").alias("scan_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.lit("03").alias("mode"),
        raw.alias("raw"),
    )


def order_scans(spark, sf_dir):
    """One stored-code and one pending-code response per order, some of them failing."""
    orders = spread(table(spark, sf_dir, "orders"))
    customer, order = hex4(F.col("o_custkey")), hex4(F.col("o_orderkey"))
    price = hex4(F.floor("o_totalprice"))
    urgent = F.col("o_orderpriority")
    stored = (
        F.when(urgent == "1-URGENT", "CAN ERROR\r>")
        .when(urgent == "5-LOW", "NO DATA\r>")
        .when(urgent == "2-HIGH", "UNABLE TO CONNECT\r>")
        .otherwise(F.concat(F.lit("ATE0\rOK\r43 02 "), customer, F.lit(" "), price, F.lit("\r>")))
    )
    pending = F.when(F.col("o_orderstatus") == "P", "BUS BUSY\r>").otherwise(
        F.concat(F.lit("47 02 "), customer, F.lit(" "), order, F.lit("\r>"))
    )
    responses = F.array(
        F.struct(F.lit("03").alias("mode"), stored.alias("raw")),
        F.struct(F.lit("07").alias("mode"), pending.alias("raw")),
    )
    return orders.select(F.col("o_orderkey").alias("scan_id"), F.explode(responses).alias("r")).select(
        "scan_id", "r.*"
    )


def catalog_items(spark, sf_dir):
    """Regions as brands, each a header followed by its nations as models."""
    region = table(spark, sf_dir, "region")
    powers = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sort_array(F.collect_set("o_orderpriority")).alias("powers"))
    )
    brand = [
        F.col("r_name").alias("brand"),
        F.col("r_regionkey").alias("brand_position"),
        F.col("r_name").startswith("A").alias("active"),
        F.concat(F.lit("expertise "), "r_name").alias("expertise"),
    ]
    headers = region.select(
        *brand,
        F.lit(0).alias("position"),
        F.concat(F.lit("models of "), "r_name").alias("group"),
        F.lit(None).cast("string").alias("label"),
        F.lit(None).cast("array<string>").alias("powers"),
    )
    models = (
        table(spark, sf_dir, "nation")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(powers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .select(
            *brand,
            (F.col("n_nationkey") + 1).alias("position"),
            F.lit(None).cast("string").alias("group"),
            F.col("n_name").alias("label"),
            F.when(F.col("n_nationkey") != 3, F.col("powers")).alias("powers"),
        )
    )
    return headers.unionByName(models)


def symptom_catalog(spark, sf_dir):
    """Part types as symptoms, sorted into categories by first letter."""
    return (
        table(spark, sf_dir, "part")
        .select(F.left(F.col("p_type"), F.lit(1)).alias("category"), F.col("p_type").alias("symptom"))
        .distinct()
    )


def as_chunks(events):
    """Events as serial chunks of a port."""
    return events.select(
        text_id("user_id").alias("port"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("chunk"),
    )


def chunks(spark, sf_dir):
    return as_chunks(table(spark, sf_dir, "events"))


CHUNK_GAP = "10 minutes"
CHUNK_LIMIT = "12 minutes"


def answers(spark, sf_dir):
    """Model answers about parts as content blocks, in six shapes by part type.

    LARGE is complete, SMALL has text before it, MEDIUM is cut inside its third
    fault, PROMO inside its first, STANDARD holds no object and ECONOMY has text
    behind it.
    """
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    kind = F.col("p_type")

    def fault(label, probability, urgency):
        return F.concat(
            F.lit('{"název":"'), label,
            F.lit('","pravděpodobnost":'), probability,
            F.lit(',"popis":"a \\"quoted\\" {brace} and ]","příznaky_shoda":["'), name,
            F.lit('"],"obd_kódy":["'), F.col("p_brand"),
            F.lit('"],"naléhavost":"'), urgency, F.lit('"}'),
        )

    urgency = F.when(F.col("p_size") > 40, "kritická").when(F.col("p_size") > 20, "vysoká").otherwise("nízká")
    off_topic = F.lit('{"název":"Nesouvisející dotaz","pravděpodobnost":0}')
    head = F.concat(F.lit('{"shrnutí":"'), name, F.lit('","závady":['))
    faults = F.when(F.col("p_size") == 50, off_topic).otherwise(
        F.concat(
            fault(name, size, urgency), F.lit(","),
            fault(F.col("p_brand"), F.lit("45"), F.lit("střední")), F.lit(","),
            fault(F.lit("third"), F.lit("71"), F.lit("vysoká")),
        )
    )
    tail = F.concat(
        F.lit('],"doporučené_testy":['),
        F.when(F.col("p_size") > 25, '"test"').otherwise(""),
        F.lit('],"varování":null,"další_info":"'),
        F.when(F.col("p_size") > 10, "Výsledek zkrácen.").otherwise("more"),
        F.lit('"}'),
    )
    two = F.concat(
        fault(name, size, urgency), F.lit(","),
        fault(F.col("p_brand"), F.lit("45"), F.lit("střední")),
        F.lit(', {"název":"cut } off ['),
    )
    body = (
        F.when(kind == "LARGE", F.concat(faults, tail))
        .when(kind == "SMALL", F.concat(faults, tail))
        .when(kind == "MEDIUM", two)
        .when(kind == "PROMO", F.lit('{"název":"only'))
        .when(kind == "STANDARD", F.lit("no object at all"))
        .otherwise(F.concat(faults, tail, F.lit(" thanks")))
    )
    opening = (
        F.when(kind == "STANDARD", "sorry, ")
        .when(kind == "SMALL", F.concat(F.lit("Answer: "), head))
        .otherwise(head)
    )
    content = F.array(
        F.struct(opening.alias("text")),
        F.struct(F.lit(None).cast("string").alias("text")),
        F.struct(body.alias("text")),
    )
    return spread(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("answer_id"), kind.alias("kind"), content.alias("content")
    )
