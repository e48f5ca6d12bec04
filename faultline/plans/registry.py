"""One runnable query per operator, over the whole benchmark tables."""

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import fixed_values as fv
from faultline.functions import quality, scan
from faultline.functions import similarity as sim
from faultline.functions.answers import join_blocks
from faultline.functions.text import join_texts
from faultline.operators import (
    admission,
    answers,
    cases,
    catalog,
    context,
    gates,
    limits,
    merges,
    monitor,
    recency,
    scanlog,
    search,
)
from faultline.operators.postings import PostingIndex
from faultline.plans import jobs, views
from faultline.session import scratch_path, shuffles_dropped, stage
from faultline.sources import readers
from faultline.sources.keyed_store import KeyedStore
from faultline.streaming import jobs as streams
from faultline.streaming.sinks import run_available

QUERIES = {}
AS_OF = "2024-01-20 00:00:00"
CORPUS_AS_OF = "2001-07-15 00:00:00"
CALL_LIMIT = 5
TOKEN_BUDGET = 300
ROUND_BUDGET = 400_000
TERMS = [*fv.TOPIC_TERMS, "die", "le"]


CASE_KEYS = StructType().add("installation_id", "string").add("local_id", "string")
QUEUE = StructType().add("id", "string").add("data", "string").add("error", "string")


def query(function):
    QUERIES[function.__name__] = function
    return function


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def text_of(items, separator="|"):
    return F.array_join(items, separator)


# --- sources and sinks ------------------------------------------------------


@query
def s1_read_cases(spark, sf_dir):
    cases_read = readers.read_cases(views.session_rows(spark, sf_dir), "k bigint")
    return cases_read.select(
        F.col("_rowId").alias("row_id"), F.col("_status").alias("row_status"), "k"
    )


@query
def s1_quarantined_cases(spark, sf_dir):
    """Sessions: errors lack their last character, views are arrays, signups have no document."""
    raw = (
        F.when(F.col("status") == "error", F.expr("substring(data, 1, length(data) - 1)"))
        .when(F.col("status") == "view", F.concat(F.lit("["), "data", F.lit("]")))
        .when(F.col("status") != "signup", F.col("data"))
    )
    sessions = views.session_rows(spark, sf_dir).withColumn("data", raw)
    readable, quarantined = readers.split_sessions(sessions, "k bigint")
    nothing = F.lit(None).cast("string")
    kept = readable.select(F.col("_rowId").alias("row_id"), "k", nothing.alias("reason"), nothing.alias("raw"))
    return kept.unionByName(
        quarantined.select(F.col("id").alias("row_id"), F.lit(None).cast("bigint").alias("k"), "reason", "raw")
    )


@query
def s2_read_corpus(spark, sf_dir):
    return views.case_corpus(spark, sf_dir).select(
        "id", "installation_id", "vehicle_brand", "vehicle_model", "mileage", "closed_at",
        text_of("symptoms").alias("symptoms"), text_of("obd_codes").alias("codes"),
    )


def _versions(spark, sf_dir):
    rows = views.line_versions(spark, sf_dir)
    return rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")


@query
def s3_insert_if_absent(spark, sf_dir):
    earlier, later = _versions(spark, sf_dir)
    order = [*views.VERSION_ORDER]
    target = merges.insert_if_absent(earlier.filter(F.lit(False)), earlier, order)
    return merges.insert_if_absent(target, later, order)


@query
def s4_upsert_last(spark, sf_dir):
    earlier, later = _versions(spark, sf_dir)
    order = [*views.VERSION_ORDER]
    target = merges.upsert_last(earlier.filter(F.lit(False)), earlier, order)
    return merges.upsert_last(target, later, order)


def _stored(spark, sf_dir, merge):
    """The order lines merged into a keyed store, slice by slice."""
    slices = version_slices(spark, sf_dir)
    store = KeyedStore(spark, scratch_path(spark, "stored"), slices[0].schema, merges.KEY)
    for version, rows in enumerate(slices, 1):
        merge(store, rows, [*views.VERSION_ORDER], version)
    return store.read()


@query
def s3_stored_insert(spark, sf_dir):
    return _stored(spark, sf_dir, KeyedStore.insert)


@query
def s4_stored_upsert(spark, sf_dir):
    return _stored(spark, sf_dir, KeyedStore.upsert)


@query
def s5_update_by_json_key(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    changes = (
        log.filter("model = 'purchase'")
        .groupBy(F.col("tokens").cast("string").alias("doc_key"))
        .agg(
            F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("last"),
            F.max("value").alias("largest"),
        )
        .filter("largest > 150")
        .select(
            "doc_key",
            F.concat(
                F.lit('{"k": '), "doc_key", F.lit(', "by": '), F.col("last.event_id"), F.lit("}")
            ).alias("new_data"),
            F.lit("closed").alias("new_status"),
            F.col("last.ts").alias("new_updated_at"),
        )
    )
    return merges.update_by_json_key(views.session_rows(spark, sf_dir), changes, "$.k")


@query
def s6_delete_by_json_key(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    gone = (
        log.filter("NOT success")
        .groupBy(F.col("tokens").cast("string").alias("doc_key"))
        .agg(F.max("value").alias("worst"))
        .filter("worst < 150")
    )
    return merges.delete_by_json_key(views.session_rows(spark, sf_dir), gone, "$.k")


@query
def s7_append_usage(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    return limits.successful_usage(
        log,
        ~F.col("success"),
        F.col("model"),
        F.col("tokens"),
        F.when(F.col("model") == "click", F.col("tokens")),
        F.col("installation_id"),
        F.col("ts"),
    )


def _push_inputs(spark, sf_dir):
    rows = views.case_corpus(spark, sf_dir)
    judged = gates.judge_cases(views.case_documents(spark, sf_dir).filter(F.col("status") == fv.STATUS_CLOSED))
    judged = judged.select("id", "reason")
    existing = rows.filter("created_at < '1998-01-01'").select("id")
    failures = rows.filter("engine_power = '5-LOW'").select("id", F.lit("timeout").alias("error"))
    return judged, existing, failures


@query
def s8_retry_dead_letters(spark, sf_dir):
    return merges.retry_dead_letters(*_push_inputs(spark, sf_dir)).select("id", "disposition")


@query
def s8_retry_counts(spark, sf_dir):
    return merges.retry_counts(merges.retry_dead_letters(*_push_inputs(spark, sf_dir)))


def _numbered_violations(spark, sf_dir):
    return limits.running_violations(
        views.violation_log(spark, sf_dir), "installation_id", "created_at", ["event_id"]
    )


@query
def s9_violation_alerts(spark, sf_dir):
    alerts = limits.alerts(_numbered_violations(spark, sf_dir), views.SENDER)
    return alerts.select("event_id", "violation_count", "blocked", "subject", "body")


@query
def s10_push_outcome(spark, sf_dir):
    outcome = merges.push_outcomes(*_push_inputs(spark, sf_dir))
    return outcome.select("id", "outcome", "ok", "validation_error", "error")


# --- projections ------------------------------------------------------------


@query
def p1_explode_messages(spark, sf_dir):
    exploded = cases.explode_messages(
        views.case_documents(spark, sf_dir).withColumnRenamed("id", "case_id"), fv.INPUT, "case_id"
    )
    return exploded.select(
        "case_id", "position", "text", F.size("symptoms").alias("n_symptoms"), F.col("id").alias("message_id")
    )


@query
def p2_collect_signals(spark, sf_dir):
    return cases.with_signals(views.case_documents(spark, sf_dir)).select(
        "id", text_of("symptoms").alias("symptoms"), text_of("obd_codes").alias("codes")
    )


@query
def p3_join_texts(spark, sf_dir):
    texts = F.array(F.col("url"), F.lit(""), F.lit(None).cast("string"), F.col("html"))
    return views.table(spark, sf_dir, "pages").select(
        "page_id",
        F.length(join_texts(texts, "\n")).cast("bigint").alias("n_chars"),
        F.md5(join_texts(texts, "\n")).alias("fingerprint"),
        join_texts(F.array(F.lit(""), F.lit(None).cast("string")), " ").alias("nothing"),
    )


@query
def p4_case_to_row(spark, sf_dir):
    rows = cases.case_to_row(
        views.case_documents(spark, sf_dir), now=F.lit("2002-01-01").cast("timestamp")
    )
    return rows.select(
        "local_id", "installation_id", "vehicle_brand", "vehicle_model", "mileage", "engine_power",
        text_of("symptoms").alias("symptoms"), text_of("obd_codes").alias("codes"),
        "description", "resolution", F.date_format("closed_at", "yyyy-MM-dd").alias("closed_on"),
    )


@query
def p5_row_to_case(spark, sf_dir):
    documents = cases.row_to_case(views.case_corpus(spark, sf_dir))
    message = F.col("messages")[0]
    return documents.select(
        "id", "name", "status", "fromCloud",
        F.col("vehicle.brand").alias("brand"), F.col("vehicle.model").alias("model"),
        F.col("vehicle.mileage").alias("mileage"),
        message["id"].alias("message_id"), text_of(message["obdCodes"]).alias("codes"),
        message["text"].alias("text"),
    )


@query
def p6_case_title(spark, sf_dir):
    return views.case_rows(spark, sf_dir).select(
        "id",
        cases.case_title(
            F.struct(
                F.col("vehicle_model").alias("model"),
                F.concat("engine_power", F.lit(" (k)")).alias("enginePower"),
                F.col("mileage").cast("string").alias("mileage"),
            )
        ).alias("title"),
    )


@query
def p7_retitle_on_first_diagnosis(spark, sf_dir):
    return cases.retitle_on_first_diagnosis(views.case_documents(spark, sf_dir)).select("id", "name")


def _open_documents(spark, sf_dir):
    return views.case_documents(spark, sf_dir).filter(F.col("status") == fv.STATUS_OPEN)


@query
def p8_build_query_input(spark, sf_dir):
    return cases.search_inputs(_open_documents(spark, sf_dir)).select(
        "query_id", "installation_id", F.col("vehicle.model").alias("model"),
        text_of("symptoms").alias("symptoms"), text_of("obdCodes").alias("codes"), "text",
    )


@query
def p9_render_user_prompt(spark, sf_dir):
    return cases.user_prompt(_open_documents(spark, sf_dir))


# --- gates ------------------------------------------------------------------


@query
def v1_validate_resolution(spark, sf_dir):
    return views.free_texts(spark, sf_dir).select(
        "source", "text_id", quality.resolution_reason(F.col("text")).alias("reason")
    )


@query
def v2_validate_case(spark, sf_dir):
    return gates.judge_cases(views.case_documents(spark, sf_dir)).select("id", "reason", "bad_code")


@query
def v3_check_constraints(spark, sf_dir):
    return gates.check_constraints(views.case_rows(spark, sf_dir)).select(
        "id", "resolution_length_ok", "signal_ok", "model_ok", "valid"
    )


@query
def v4_extract_codes(spark, sf_dir):
    typed = F.concat(F.lower(F.array_join("obd_codes", "; ")), F.lit(", p0401 x,c12FF;p04"))
    typed = F.replace(typed, F.lit("brand#"), F.lit("b00"))
    existing = F.array(F.lit("P0401"), F.lit("U0001"))
    return views.case_rows(spark, sf_dir).select(
        "id", text_of(F.array_sort(quality.extract_codes(typed, existing))).alias("codes")
    )


@query
def v5_topic_relevance(spark, sf_dir):
    return views.free_texts(spark, sf_dir).select(
        "source", "text_id", quality.topic_ok(F.col("text"), TERMS).alias("relevant")
    )


@query
def v6_admit_input(spark, sf_dir):
    nothing = F.array().cast("array<string>")
    messages = views.case_messages(spark, sf_dir).withColumns(
        {"symptoms": nothing, "obdCodes": nothing}
    )
    spent = F.when(F.col("type") == fv.DIAGNOSIS, F.col("tokens"))
    admitted = gates.admit_inputs(messages, "case_id", "position", spent, TOKEN_BUDGET, TERMS)
    return admitted.select("case_id", "position", "used_before", "reason")


@query
def v7_admit_request(spark, sf_dir):
    requests = views.usage_log(spark, sf_dir).withColumn(
        "messages", F.when(F.col("value") > 5, F.array("model"))
    )
    admitted = limits.admit_requests(
        requests, ["view", "click", "signup"], F.when(F.col("value") < 300, F.col("installation_id")),
        F.col("model"), F.col("messages"), F.when(F.col("tokens") > 20, F.col("tokens") * 100),
    )
    return admitted.select("event_id", "reason", F.col("granted_tokens").cast("bigint").alias("granted_tokens"))


@query
def v8_own_rows(spark, sf_dir):
    sessions = views.session_rows(spark, sf_dir)
    log = views.usage_log(spark, sf_dir)
    busiest = (
        log.groupBy("installation_id")
        .agg(F.count("*").alias("n"))
        .agg(F.max_by("installation_id", F.struct("n", "installation_id")))
        .scalar()
    )
    return gates.own_rows(sessions, busiest).select("id", "user_id", "status")


@query
def v9_non_empty_submission(spark, sf_dir):
    size = cases.submission_size(F.lit(None).cast("array<string>"), F.col("obd_codes"), F.col("vehicle_model"))
    return views.case_rows(spark, sf_dir).select("id", size.alias("total"), (size > 0).alias("accepted"))


@query
def v10_active_brands(spark, sf_dir):
    return catalog.active_brands(views.catalog_items(spark, sf_dir)).select(
        "brand", "expertise", "is_default"
    )


# --- search -----------------------------------------------------------------


def _search_inputs(spark, sf_dir):
    """Open and closed cases, both from one written case table.

    A search reads each side several times; building the cases takes five joins.
    """
    rows = stage(views.case_rows(spark, sf_dir), "cases")
    return views.as_queries(rows), views.closed(rows)


@query
def j1_candidate_cases(spark, sf_dir):
    found = search.candidate_cases(*_search_inputs(spark, sf_dir))
    return found.select(
        "query_id", F.size("case_ids").alias("n_candidates"), text_of("case_ids").alias("case_ids")
    )


@query
def j2_similarity_score(spark, sf_dir):
    scored = search.scored_candidates(*_search_inputs(spark, sf_dir))
    return scored.groupBy("query_id", (F.col("tenths") / 10).alias("score"), "is_own").agg(
        F.count("*").alias("n_cases")
    )


@query
def j3_search_top5(spark, sf_dir):
    return search.search(*_search_inputs(spark, sf_dir))


@query
def j3_indexed_search(spark, sf_dir):
    """The search over an index that four parts of the corpus were added to."""
    queries, corpus = _search_inputs(spark, sf_dir)
    index = PostingIndex(spark, scratch_path(spark, "index"), most_runs=2)
    for version, rows in enumerate(time_slices(corpus, "closed_at"), 1):
        index.add(rows, version)
    return search.search(queries, corpus, index=index)


@query
def j4_evidence_join(spark, sf_dir):
    diagnoses = views.case_rows(spark, sf_dir).select(
        F.col("id").alias("case_id"),
        F.array("installation_id", F.col("mileage").cast("string"), "installation_id").alias("match_ids"),
    )
    return search.evidence_counts(diagnoses, views.case_corpus(spark, sf_dir).select("id"))


@query
def j5_brand_lookup(spark, sf_dir):
    rows = views.case_rows(spark, sf_dir).select(
        "id", F.when(F.col("mileage") > 250000, "asia").otherwise(F.col("vehicle_brand")).alias("brand")
    )
    return catalog.brand_lookup(
        rows, views.catalog_items(spark, sf_dir), "brand", fv.DEFAULT_EXPERTISE
    )


@query
def j6_model_powers(spark, sf_dir):
    rows = views.case_rows(spark, sf_dir).select("id", "vehicle_model")
    found = catalog.model_powers(rows, views.catalog_items(spark, sf_dir), "vehicle_model")
    return found.select("id", "vehicle_model", text_of("powers").alias("powers"))


@query
def j7_new_pending_codes(spark, sf_dir):
    pending = F.concat(F.reverse("obd_codes"), F.col("symptoms"))
    stored = F.filter("obd_codes", lambda c: F.length(c) == 7)
    return views.case_rows(spark, sf_dir).select(
        "id", text_of(cases.new_pending_codes(pending, stored)).alias("new_codes")
    )


@query
def j8_symptom_category_counts(spark, sf_dir):
    return catalog.symptom_category_counts(
        views.case_rows(spark, sf_dir), views.symptom_catalog(spark, sf_dir)
    )


# --- aggregations -----------------------------------------------------------


@query
def a1_total_count(spark, sf_dir):
    return monitor.total_count(views.case_corpus(spark, sf_dir))


@query
def a2_top_codes(spark, sf_dir):
    return monitor.top_codes(views.case_corpus(spark, sf_dir))


@query
def a3_top_models(spark, sf_dir):
    return monitor.top_models(views.case_corpus(spark, sf_dir))


@query
def a4_recent_rows(spark, sf_dir):
    corpus = views.case_corpus(spark, sf_dir).select("id", "created_at", "vehicle_model")
    return monitor.recent_rows(corpus, "created_at", at(CORPUS_AS_OF), ["id"])


@query
def a5_status_counts(spark, sf_dir):
    return monitor.status_counts(views.case_documents(spark, sf_dir))


@query
def a5_diagnosis_counts(spark, sf_dir):
    return monitor.diagnosis_counts(views.case_messages(spark, sf_dir), "case_id", F.col("type"))


@query
def a6_case_tokens(spark, sf_dir):
    return monitor.case_tokens(
        views.usage_log(spark, sf_dir), "installation_id", F.col("tokens"),
        F.when(F.col("model") == "click", F.col("tokens")),
    )


@query
def a7_daily_count(spark, sf_dir):
    return limits.daily_count(views.usage_log(spark, sf_dir), "installation_id", "ts", at(AS_OF))


@query
def a7_daily_count_function(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    log.createOrReplaceTempView("usage_rows")
    limits.publish_daily_count(
        spark, "usage_rows", "installation_id", "ts", f"TIMESTAMP_NTZ '{AS_OF}'"
    )
    return spark.sql(
        "SELECT installation_id, daily_count(installation_id) AS n"
        " FROM (SELECT DISTINCT installation_id FROM usage_rows)"
    )


@query
def a8_violation_totals(spark, sf_dir):
    return limits.violation_totals(views.violation_log(spark, sf_dir), "installation_id")


@query
def a9_signal_counts(spark, sf_dir):
    sizes = cases.signal_counts(
        {"symptoms": F.col("symptoms"), "codes": F.col("obd_codes"), "pending": F.lit(None).cast("array<string>")}
    )
    return views.case_rows(spark, sf_dir).select("id", *[v.alias(k) for k, v in sizes.items()])


# --- windows ----------------------------------------------------------------


@query
def w1_rolling_write_limit(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    limited = limits.rolling_write_limit(log, "installation_id", "ts", ["event_id"], CALL_LIMIT)
    return limited.select("event_id", "installation_id", "prior_count", "admitted")


@query
def w2_rolling_call_limit(spark, sf_dir):
    log = views.usage_log(spark, sf_dir)
    limited = limits.rolling_call_limit(
        log, "installation_id", "ts", ["event_id"], F.col("success"), CALL_LIMIT
    )
    return limited.select("event_id", "installation_id", "prior_count", "admitted")


@query
def w3_input_round_no(spark, sf_dir):
    messages = views.case_messages(spark, sf_dir)
    rounds = limits.input_rounds(messages, "case_id", "position", F.col("type"))
    return rounds.select("case_id", "position", "round_no")


@query
def w4_token_budget(spark, sf_dir):
    messages = views.case_messages(spark, sf_dir)
    used = limits.token_budget(messages, "case_id", "position", F.col("tokens"), TOKEN_BUDGET)
    return used.select("case_id", "position", "used", "percent", "band", "label")


@query
def w5_first_diagnosis(spark, sf_dir):
    messages = views.case_messages(spark, sf_dir)
    flagged = limits.flag_first_diagnosis(messages, "case_id", "position", F.col("type"))
    return flagged.select("case_id", "position", "is_first")


@query
def w6_running_violations(spark, sf_dir):
    return _numbered_violations(spark, sf_dir).select(
        "event_id", "installation_id", "violation_count", "blocked"
    )


@query
def w7_carry_group_header(spark, sf_dir):
    return catalog.carry_group_header(views.catalog_items(spark, sf_dir)).select("brand", "label", "header")


@query
def w8_hit_rank(spark, sf_dir):
    hits = search.search(*_search_inputs(spark, sf_dir))
    return hits.groupBy("hit_rank").agg(
        F.count("*").alias("n_queries"), F.count_if("is_own").alias("n_own")
    )


# --- sorts and set operations -----------------------------------------------


@query
def o1_newest_n(spark, sf_dir):
    corpus = views.case_corpus(spark, sf_dir).select("id", "closed_at")
    return recency.newest(corpus, fv.CANDIDATE_LIMIT, [F.desc_nulls_first("closed_at"), F.asc("id")])


@query
def o2_newest_first(spark, sf_dir):
    rows = views.case_rows(spark, sf_dir).select("id", "created_at")
    return monitor.newest_first(rows, "created_at", ["id"])


@query
def o3_multi_key_topk(spark, sf_dir):
    queries, corpus = _search_inputs(spark, sf_dir)
    return search.search(queries, corpus, hits=3, own_threshold=0, other_threshold=0)


@query
def o4_top_fault(spark, sf_dir):
    fault = answers.top_fault(F.col("result"))
    return _parsed_answers(spark, sf_dir).filter(fault.isNotNull()).select(
        "answer_id", fault["název"].alias("top_fault")
    )


@query
def u1_merge_code_lists(spark, sf_dir):
    merged = cases.merge_code_lists(F.reverse("symptoms"), F.col("obd_codes"), F.col("symptoms"))
    return views.case_rows(spark, sf_dir).select("id", text_of(merged).alias("codes"))


@query
def u2_union_candidates(spark, sf_dir):
    return search.query_keys(views.case_queries(spark, sf_dir))


# --- scan log ---------------------------------------------------------------


@query
def d1_decode_dtc(spark, sf_dir):
    pair = views.hex4(F.col("o_totalprice").cast("bigint"))
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        scan.decode_code(F.substring(pair, 1, 2), F.substring(pair, 3, 2)).alias("code"),
    )


@query
def d2_clean_response(spark, sf_dir):
    return views.order_scans(spark, sf_dir).select(
        "scan_id", "mode", text_of(scan.clean_lines(F.col("raw"))).alias("lines")
    )


@query
def d3_parse_response(spark, sf_dir):
    parsed = scanlog.parse_responses(views.raw_scans(spark, sf_dir))
    return parsed.select(
        "scan_id", "l_linenumber", "l_partkey", "l_suppkey", text_of("codes").alias("codes"), "error"
    )


@query
def d3_scan_errors(spark, sf_dir):
    parsed = scanlog.parse_responses(views.order_scans(spark, sf_dir))
    return parsed.groupBy("mode", "error").agg(
        F.count("*").alias("n"), F.sum(F.size("codes")).alias("n_codes")
    )


@query
def d4_is_adapter(spark, sf_dir):
    greeting = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("elm327 v"), "o_orderpriority"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("ELM 327 "), "o_orderpriority"))
        .otherwise(F.concat(F.lit("43 01 "), "o_orderpriority"))
    )
    return views.table(spark, sf_dir, "orders").select(
        "o_orderkey", scan.is_adapter(greeting).alias("is_adapter")
    )


@query
def d4_adapter_in_texts(spark, sf_dir):
    """The greeting test over every whole url and document."""
    texts = [("pages", "page_id", "url"), ("documents", "doc_id", "text")]
    parts = [
        views.table(spark, sf_dir, name).select(
            F.lit(name).alias("origin"), F.col(key).cast("bigint").alias("item_id"),
            scan.is_adapter(F.col(text)).alias("is_adapter"),
        )
        for name, key, text in texts
    ]
    return parts[0].unionByName(parts[1])


@query
def d5_read_codes(spark, sf_dir):
    return scanlog.read_codes(views.order_scans(spark, sf_dir)).select(
        "scan_id", text_of("stored").alias("stored"), text_of("pending").alias("pending"), "error"
    )


@query
def d6_assemble_chunks(spark, sf_dir):
    return scanlog.assemble_chunks(
        views.chunks(spark, sf_dir), "port", "ts", ["seq"], "chunk",
        views.CHUNK_GAP, views.CHUNK_LIMIT,
    )


# --- answers and context ----------------------------------------------------


def _parsed_answers(spark, sf_dir):
    rows = views.answers(spark, sf_dir).withColumn("raw", join_blocks(F.col("content")))
    return answers.parse_answers(rows)


@query
def g1_parse_answer(spark, sf_dir):
    return _parsed_answers(spark, sf_dir).select(
        "answer_id", "status",
        F.coalesce(F.size(F.col("result.závady")), F.lit(0)).alias("n_faults"),
        F.col("result.shrnutí").alias("summary"),
    )


@query
def g2_join_content_blocks(spark, sf_dir):
    joined = join_blocks(F.col("content"))
    return views.answers(spark, sf_dir).select(
        "answer_id", F.length(joined).cast("bigint").alias("n_chars"), F.md5(joined).alias("fingerprint")
    )


def _faults(spark, sf_dir):
    return answers.explode_faults(_parsed_answers(spark, sf_dir), ["answer_id"])


@query
def g3_explode_faults(spark, sf_dir):
    return _faults(spark, sf_dir).select(
        "answer_id", "position", "is_primary", "fault_name", "probability",
        F.col("matched_symptoms")[0].alias("first_symptom"), "description",
    )


@query
def g4_fault_bands(spark, sf_dir):
    banded = answers.fault_bands(_faults(spark, sf_dir))
    return banded.select("answer_id", "position", "urgency_level", "probability_band")


@query
def g5_answer_meta(spark, sf_dir):
    meta = answers.answer_meta(_parsed_answers(spark, sf_dir).filter("status <> 'failed'"))
    return meta.select("answer_id", "info", "has_meta")


@query
def g6_off_topic_answers(spark, sf_dir):
    return answers.off_topic_rate(_parsed_answers(spark, sf_dir), ["kind"])


@query
def r1_match_strength(spark, sf_dir):
    hits = search.search(*_search_inputs(spark, sf_dir), own_threshold=0, other_threshold=0)
    return hits.groupBy(context.match_strength(F.col("score")).alias("strength")).agg(
        F.count("*").alias("n_hits")
    )


@query
def r2_context_block(spark, sf_dir):
    queries, corpus = _search_inputs(spark, sf_dir)
    return context.context_blocks(search.search(queries, corpus), corpus)


@query
def r3_system_prompt(spark, sf_dir):
    queries, corpus = _search_inputs(spark, sf_dir)
    blocks = context.context_blocks(search.search(queries, corpus), corpus)
    asked = queries.select(
        "query_id", F.when(F.col("power") == "1-URGENT", "africa").otherwise(F.col("brand")).alias("brand")
    )
    return context.system_prompts(asked, blocks, views.catalog_items(spark, sf_dir))


@query
def j2_self_similarity(spark, sf_dir):
    """Score of every case against its own signals: the scorer without a search."""
    rows = views.case_rows(spark, sf_dir)
    tenths = sim.similarity_tenths(
        sim.lowered(F.col("obd_codes")),
        sim.lowered(F.col("symptoms")),
        sim.query_words(F.col("description")),
        sim.case_text(F.col("symptoms"), F.col("obd_codes"), F.col("description")),
        sim.attribute_tenths(
            F.col("vehicle_model"), F.col("vehicle_model"), F.col("engine_power"), F.col("engine_power")
        ),
    )
    return rows.select("id", (tenths / 10).alias("score"))


# --- flows ------------------------------------------------------------------


def _blank_models(documents):
    """A blank model passes the case rules but not the table constraints."""
    blank = F.when(F.col("vehicle.enginePower") == "2-HIGH", F.lit(" ")).otherwise(F.col("vehicle.model"))
    return documents.withColumn("vehicle", F.col("vehicle").withField("model", blank))


CLOSE_SETTINGS = {"limit": 3, "length": "400 days"}


def _close_settings():
    now = F.lit("2002-01-01").cast("timestamp")
    return {"now": now, "as_of": at(CORPUS_AS_OF), **CLOSE_SETTINGS}


@query
def close_flow(spark, sf_dir):
    documents = stage(_blank_models(views.case_documents(spark, sf_dir)), "documents")
    _, fates, _ = jobs.close_flow(documents, views.case_corpus(spark, sf_dir), **_close_settings())
    return fates


@query
def retry_flow(spark, sf_dir):
    documents = stage(_blank_models(views.case_documents(spark, sf_dir)), "documents")
    queue = documents.select("id", F.to_json(F.struct("*")).alias("data"), F.lit("offline").alias("error"))
    _, tried, _ = jobs.retry_queue(queue, views.case_corpus(spark, sf_dir), **_close_settings())
    return tried.select("id", "disposition")


@query
def gate_rounds(spark, sf_dir):
    calls = views.usage_log(spark, sf_dir).filter("success")
    rounds = stage(views.open_rounds(spark, sf_dir), "rounds")
    gated = jobs.gate_rounds(rounds, calls, at(AS_OF), ROUND_BUDGET, CALL_LIMIT, TERMS)
    return gated.select("id", F.size("messages").alias("n_messages"), "reason")


@query
def record_diagnoses(spark, sf_dir):
    rounds = stage(views.open_rounds(spark, sf_dir), "rounds")
    recorded = jobs.record_diagnoses(rounds, views.round_answers(rounds))
    last = F.element_at("messages", -1)
    return recorded.select(
        "id", "name", F.size("messages").alias("n_messages"), "tokenCount", "error",
        last["id"].alias("last_id"), last["type"].alias("last_type"), last["result"].alias("last_result"),
    )


# --- streams ----------------------------------------------------------------


def stream_of(spark, sf_dir, name):
    """A table replayed as a stream of files."""
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def timed(rows, ts="ts"):
    """Event time as an instant, which watermarks need."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


def appended(spark, rows, name):
    """Run a stream to its end into a file table and read that back."""
    path = scratch_path(spark, name)
    writer = rows.writeStream.format("parquet").option("path", path)
    run_available(writer, f"{path}-checkpoint")
    return spark.read.schema(rows.schema).parquet(path)


#: Slices in which a table is replayed, and the least files of each.
SLICES = 4
SLICE_FILES = 8


def replayed(spark, slices, name):
    """Tables replayed one after the other, each as one micro-batch."""
    path = scratch_path(spark, name)
    files = max(SLICE_FILES, spark.sparkContext.defaultParallelism)
    for rows in slices:
        with shuffles_dropped(spark):
            rows.repartition(files).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def time_slices(rows, ts, slices=SLICES):
    """Rows cut along a time into as many tables, earliest first; missing times come first."""
    edges = rows.select(F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).approxQuantile(
        "at", [i / slices for i in range(1, slices)], 0.01
    )
    place = sum(
        F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) > edge, F.lit(False)).cast("int")
        for edge in edges
    )
    return [rows.filter(place == i) for i in range(slices)]


def version_slices(spark, sf_dir):
    """Both loads of the order lines, each in two halves by ship date."""
    return [half for load in _versions(spark, sf_dir) for half in time_slices(load, "l_shipdate", 2)]


def batches(spark, writer, path, schema):
    """Run a per-batch writer to its end and read what it wrote."""
    run_available(writer, f"{path}-checkpoint")
    return spark.read.schema(schema).parquet(path).drop("batch_id")


@query
def t1_debounced_last_write(spark, sf_dir):
    edits = timed(views.as_chunks(stream_of(spark, sf_dir, "events")))
    data = F.concat("chunk", F.lit("-"), F.col("seq").cast("string"))
    bursts = streams.debounced_last_write(
        edits.select(F.col("port").alias("case_id"), "ts", data.alias("data")),
        "case_id", "ts", "data", views.CHUNK_GAP,
    )
    return appended(spark, bursts, "edits").withColumn(
        "edited_at", F.col("edited_at").cast("timestamp_ntz")
    )


@query
def t2_idempotent_ingest(spark, sf_dir):
    rows = replayed(spark, version_slices(spark, sf_dir), "versions")
    path = scratch_path(spark, "corpus")
    writer = streams.ingest_writer(rows, path, ["l_linestatus", *views.VERSION_ORDER])
    run_available(writer, f"{path}-checkpoint")
    return streams.corpus_store(spark, path, rows.schema).read()


@query
def t2_without_recent_repeats(spark, sf_dir):
    rows = timed(views.as_versions(stream_of(spark, sf_dir, "lineitem")), "l_shipdate")
    unique = streams.without_recent_repeats(rows, "l_shipdate")
    return appended(spark, unique.select(*merges.KEY), "unique")


@query
def t3_stream_rate_limit(spark, sf_dir):
    attempts = timed(views.as_usage(stream_of(spark, sf_dir, "events")))
    judged = streams.rate_limit(attempts, "installation_id", "ts", ["event_id"], CALL_LIMIT)
    return appended(spark, judged, "admitted").select("event_id", "installation_id", "admitted")


@query
def t3_batch_admission(spark, sf_dir):
    admitted = admission.admit(
        views.usage_log(spark, sf_dir), "installation_id", "ts", ["event_id"], CALL_LIMIT, limits.DAY
    )
    return admitted.select("event_id", "installation_id", "admitted")


@query
def t4_stream_chunk_assembly(spark, sf_dir):
    chunks = timed(views.as_chunks(stream_of(spark, sf_dir, "events")))
    responses = streams.assemble_chunks(chunks, "port", "ts", ["seq"], "chunk", views.CHUNK_GAP)
    return appended(spark, responses, "responses").withColumn(
        "response_start", F.col("response_start").cast("timestamp_ntz")
    )


@query
def t5_stream_search(spark, sf_dir):
    """Closed cases arrive in two batches, then the open ones in two more."""
    rows = stage(views.case_rows(spark, sf_dir), "cases")
    closed = time_slices(views.closed(rows), "closed_at", 2)
    others = rows.filter("status <> 'F'")
    waiting = [others.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == i) for i in range(2)]
    arriving = replayed(spark, [*closed, *waiting], "cases")
    corpus_path, index_path, hits_path = (scratch_path(spark, name) for name in ("corpus", "index", "hits"))
    writer = streams.indexed_search_writer(
        arriving, views.as_queries, views.closed, corpus_path, index_path, hits_path
    )
    schema = "query_id string, hit_rank int, case_id string, score double, is_own boolean"
    return batches(spark, writer, hits_path, schema)


@query
def t6_stream_quality_gate(spark, sf_dir):
    # every slice and the bounds between them read the documents
    documents = stage(_blank_models(views.case_documents(spark, sf_dir)), "documents")
    arriving = replayed(spark, time_slices(documents, "closedAt"), "documents")
    out = {name: scratch_path(spark, name) for name in ("accepted", "rejected", "queued")}
    writer = streams.quality_gate_writer(arriving, *out.values(), now=F.lit("2002-01-01").cast("timestamp"))
    run_available(writer, f"{out['accepted']}-checkpoint")
    accepted = streams.corpus_store(spark, out["accepted"], CASE_KEYS).read()
    queued = streams.corpus_store(spark, out["queued"], QUEUE, ["id"]).read()
    rejected = spark.read.schema("id string, reason string").parquet(out["rejected"])
    none = F.lit(None).cast("string").alias("reason")
    parts = [
        (accepted.select(F.col("local_id").alias("id"), none), "accepted"),
        (rejected, "rejected"),
        (queued.select("id", none), "queued"),
    ]
    tables = [part.select("id", F.lit(fate).alias("fate"), "reason") for part, fate in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query
def t7_stream_violations(spark, sf_dir):
    log = views.as_violations(views.usage_log(spark, sf_dir))
    violations = replayed(spark, time_slices(log, "created_at"), "violations-log")
    path = scratch_path(spark, "violations")
    writer = streams.violations_writer(violations, path, f"{path}-totals", views.SENDER)
    schema = "event_id bigint, violation_count bigint, blocked boolean, subject string, body string"
    return batches(spark, writer, path, schema)
