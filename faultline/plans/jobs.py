"""End-to-end jobs: gate, diagnose and record rounds, close cases, retry the queue, decode scans."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.answers import join_blocks
from faultline.functions.once import once
from faultline.functions.signals import messages_of
from faultline.functions.text import is_given
from faultline.operators import answers as ingest
from faultline.operators import cases, context, gates, limits, merges, scanlog, search
from faultline.schemas import CASE_DOCUMENT
from faultline.session import stage


def _newest_input():
    """The message a round is about."""
    return F.try_element_at(messages_of(F.col("messages"), fv.INPUT), F.lit(-1))


def _without_newest_input(turned_away):
    newest = _newest_input()["id"]
    others = F.filter("messages", lambda m: ~m["id"].eqNullSafe(newest))
    return F.when(turned_away, others).otherwise(F.col("messages"))


def gate_rounds(
    open_cases,
    calls,
    as_of=None,
    budget=fv.TOKENS_PER_CASE,
    limit=fv.CALLS_PER_DAY,
    terms=tuple(fv.TOPIC_TERMS),
):
    """Open cases with the ``reason`` why their newest input is not to be diagnosed, else null.

    A case turned away loses that input.  ``calls`` has installation_id and ``ts`` of
    successful calls; cases of one installation get the calls it has left by their id.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    newest = _newest_input()
    unrelated = gates.off_topic(newest["text"], newest["symptoms"], newest["obdCodes"], terms)
    judged = open_cases.withColumn(
        "_own",
        F.when(F.coalesce("tokenCount", F.lit(0)) >= budget, "token_budget")
        .when(F.coalesce(unrelated, F.lit(False)), "off_topic")
        .when(~is_given(F.col("installationId")), "no_installation"),
    )
    used = limits.daily_count(calls, "installation_id", "ts", as_of, inclusive=True)
    asking = judged.filter("_own IS NULL").select(
        F.col("installationId").alias("installation_id"), "id"
    )
    quota = limits.within_quota(asking.distinct(), "installation_id", ["id"], used, limit)
    quota = quota.select(
        F.col("installation_id").alias("_installation"), F.col("id").alias("_id"), "granted"
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("installationId") == F.col("_installation"))
    reason = F.coalesce(
        "_own", F.when(~F.coalesce("granted", F.lit(False)), F.lit("rate_limit"))
    )
    gated = judged.join(quota, same, "left").withColumn("reason", reason)
    return gated.withColumn("messages", _without_newest_input(F.col("reason").isNotNull())).select(
        *open_cases.columns, "reason"
    )


def record_diagnoses(open_cases, model_answers):
    """Open cases after their answers, with the ``error`` of those that failed.

    ``model_answers`` has at most one row a case: case_id, diagnosis_id, answered_at,
    content (text blocks), input_tokens, output_tokens and match_ids.  A usable answer
    is appended as a diagnosis, raises the token count and, if it is the case's first,
    names it.  One that cannot be read or has no faults costs the case its newest
    input.  Cases without an answer stay as they are.
    """
    raw = model_answers.withColumn("_raw", join_blocks(F.col("content")))
    read = ingest.parse_answers(raw, "_raw")
    error = F.when(F.col("status") == "failed", "unreadable").when(
        ~ingest.has_faults(F.col("result")), "no_faults"
    )
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    made = read.select(
        F.col("case_id").alias("_case"),
        F.col("diagnosis_id").alias("_id"),
        F.col("answered_at").cast("string").alias("_at"),
        F.to_json("result").alias("_result"),
        ingest.top_fault(F.col("result"))["název"].alias("_fault"),
        F.col("match_ids").alias("_matches"),
        tokens.cast("bigint").alias("_tokens"),
        error.alias("error"),
    )
    values = {
        "id": F.col("_id"),
        "type": F.lit(fv.DIAGNOSIS),
        "timestamp": F.col("_at"),
        "result": F.col("_result"),
        "ragMatchIds": F.col("_matches"),
        "tokensUsed": F.col("_tokens"),
    }
    fields = open_cases.schema["messages"].dataType.elementType.fields
    message = F.struct(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )
    joined = open_cases.join(made, F.col("id") == F.col("_case"), "left")
    done = F.col("_case").isNotNull() & F.col("error").isNull()
    first = F.size(messages_of(F.col("messages"), fv.DIAGNOSIS)) == 0
    title = cases.diagnosis_title(F.col("vehicle"), F.coalesce("_fault", F.lit("undefined")))
    grown = F.coalesce("tokenCount", F.lit(0)) + F.col("_tokens")
    return joined.withColumns(
        {
            "name": F.when(done & first, title).otherwise(F.col("name")),
            "tokenCount": F.when(done, grown).otherwise(F.col("tokenCount")),
            "messages": F.when(done, F.concat("messages", F.array(message))).otherwise(
                _without_newest_input(F.col("error").isNotNull())
            ),
        }
    ).select(*open_cases.columns, "error")


def diagnose(open_cases, corpus, catalog_items):
    """Search hits, context and both prompts for every open case."""
    inputs = cases.search_inputs(open_cases)
    queries = search.query_columns(inputs)
    hits = search.search(queries, corpus)
    blocks = context.context_blocks(hits, corpus)
    prompts = context.system_prompts(queries.select("query_id", "brand"), blocks, catalog_items)
    users = cases.user_prompt(open_cases).withColumnRenamed("id", "query_id")
    matches = hits.groupBy("query_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("hit_rank", "case_id"))), lambda x: x["case_id"]
        ).alias("match_ids")
    )
    return prompts.join(users, "query_id").join(matches, "query_id", "left")


def close_cases(closed_cases, corpus, now=None):
    """Split closed cases into rows to insert and quarantined cases.

    A case passes the case rules, then its flat row the table constraints; a closing
    time that cannot be read quarantines it.
    """
    judged = gates.judge_cases(closed_cases)
    rows = cases.case_to_row(judged.filter(F.col("reason").isNull()), now=now)
    checked = gates.check_constraints(rows)
    accepted = checked.filter("valid").select(*rows.columns)
    broken = checked.filter("NOT valid").select(
        F.col("local_id").alias("id"), F.lit("constraint").alias("reason")
    )
    quarantine = judged.filter(F.col("reason").isNotNull()).select("id", "reason")
    undated = accepted.filter("closed_at IS NULL").select(
        F.col("local_id").alias("id"), F.lit("closed_at").alias("reason")
    )
    accepted = accepted.filter("closed_at IS NOT NULL")
    fresh = merges.rows_to_insert(corpus, accepted, order=["closed_at", "resolution"])
    return fresh, quarantine.unionByName(broken).unionByName(undated)


def close_flow(
    closed_cases,
    corpus,
    now=None,
    as_of=None,
    limit=fv.WRITES_PER_DAY,
    length=limits.DAY,
):
    """Closed cases to (rows to insert, fate of each case, cases to queue).

    A fate (id, installation_id, fate, reason) is ``rejected`` by the case rules,
    ``queued`` for the table constraints, an unreadable closing time or the write limit,
    ``duplicate`` of the corpus, or ``inserted``.  A key that comes twice is inserted
    once and shares its fate.  The limit counts the corpus rows of the last ``length``
    before ``as_of`` and the rows inserted here, in closing order; rows without a
    complete key are no duplicates and pass it.  The queue holds whole cases as JSON in
    ``data`` with their ``error``, once for each id.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    # read by every branch below
    judged = stage(gates.judge_cases(closed_cases), "judged-cases")
    rows = cases.case_to_row(judged.filter(F.col("reason").isNull()), now=now)
    checked = gates.check_constraints(rows).withColumn(
        "error",
        F.when(~F.col("valid"), "constraint").when(F.col("closed_at").isNull(), "closed_at"),
    )
    good = checked.filter("error IS NULL").select(*rows.columns)
    fresh = merges.rows_to_insert(corpus, good, order=["closed_at", "resolution"])
    keyed = F.col("installation_id").isNotNull() & F.col("local_id").isNotNull()
    used = limits.daily_count(corpus, "installation_id", "created_at", as_of, length)
    quota = limits.within_quota(
        fresh.filter(keyed), "installation_id", ["closed_at", "local_id"], used, limit
    )
    loose = fresh.filter(~keyed)
    to_insert = quota.filter("granted").select(*rows.columns).unionByName(loose)

    fate = (
        F.when(F.col("granted"), "inserted").when(~F.col("granted"), "queued").otherwise("duplicate")
    )
    names = [F.col("local_id").alias("id"), "installation_id"]
    known = quota.select("installation_id", "local_id", "granted")
    fates = [
        judged.filter(F.col("reason").isNotNull()).select(
            "id", F.col("installationId").alias("installation_id"), F.lit("rejected").alias("fate"), "reason"
        ),
        checked.filter("error IS NOT NULL").select(
            *names, F.lit("queued").alias("fate"), F.col("error").alias("reason")
        ),
        loose.select(*names, F.lit("inserted").alias("fate"), F.lit(None).cast("string").alias("reason")),
        good.filter(keyed)
        .join(known, ["installation_id", "local_id"], "left")
        .select(*names, fate.alias("fate"), F.when(~F.col("granted"), F.lit("rate_limit")).alias("reason")),
    ]
    fates = fates[0].unionByName(fates[1]).unionByName(fates[2]).unionByName(fates[3])
    return to_insert, fates, _queue_entries(judged.select(*closed_cases.columns), fates)


def _queue_entries(whole_cases, fates):
    waiting = fates.filter("fate = 'queued'").select(
        F.col("id").alias("_id"), F.col("installation_id").alias("_installation"), F.col("reason").alias("error")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("installationId").eqNullSafe(F.col("_installation"))
    data = F.to_json(F.struct(*whole_cases.columns)).alias("data")
    entries = whole_cases.join(waiting.distinct(), same).select("id", data, "error")
    keyed = entries.filter("id IS NOT NULL")
    first = merges.one_per_key(keyed, ["id"], ["data", "error"], "first")
    return first.unionByName(entries.filter("id IS NULL"))


def retry_queue(queue, corpus, **settings):
    """Queued cases once more through ``close_flow``: (rows, dispositions, queue left over).

    ``settings`` are those of ``close_flow``.  An entry that cannot be read holds no
    resolution and is dropped like any case that can never succeed.
    """
    read = queue.select("id", once(case=F.from_json("data", CASE_DOCUMENT)))
    fields = [f.name for f in read.schema["case"].dataType.fields if f.name != "id"]
    whole = read.select("id", *[F.col("case")[name].alias(name) for name in fields])
    rows, fates, _ = close_flow(whole, corpus, **settings)
    fates = stage(fates, "retried-fates")
    judged = fates.select("id", F.when(F.col("fate") == "rejected", F.col("reason")).alias("reason"))
    held = fates.filter("fate = 'duplicate'")
    failures = fates.filter("fate = 'queued'").select("id", F.col("reason").alias("error"))
    tried = merges.retry_dead_letters(judged, held, failures)
    left = queue.join(tried.filter("disposition = 'remaining'").select("id"), "id", "left_semi")
    return rows, tried, left


def decode_scans(chunks, scans_of):
    """Serial chunks to stored and pending codes; ``scans_of`` names the scan and mode.

    Where chunks name the ``mode`` they answer, listening stops as late as that command
    allows, and ``sent_at``, if given, starts its clock.
    """
    cap = scanlog.command_cap(F.col("mode")) if "mode" in chunks.columns else fv.CHUNK_CAP
    sent = "sent_at" if "sent_at" in chunks.columns else None
    responses = scanlog.assemble_chunks(
        chunks, "port", "ts", ["seq"], "chunk", cap=cap, sent_at=sent
    )
    return scanlog.read_codes(scans_of(responses))
