"""The time-driven behaviours as streaming jobs."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from faultline import fixed_values as fv
from faultline.operators import cases, gates, limits, merges, search
from faultline.operators.admission import judge, length_micros
from faultline.operators.postings import PostingIndex
from faultline.session import Scope
from faultline.sources.keyed_store import KeyedStore
from faultline.streaming.sinks import write_batch

EDIT_DELAY = "1 minute"
INGEST_DELAY = "24 hours"
#: Spark's mark on the event time of a plan, and an event time that is never late.
WATERMARK = "spark.watermarkDelayMs"
NEVER_LATE = "2260-01-01 00:00:00"


def debounced_last_write(edits, case, ts, data, silence=fv.EDIT_SILENCE, delay=EDIT_DELAY):
    """The last of each burst of edits to a case."""
    return (
        edits.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, silence).alias("burst"), case)
        .agg(
            F.max_by(data, ts).alias(data),
            F.max(ts).alias("edited_at"),
            F.count("*").alias("n_edits"),
        )
        .drop("burst")
    )


def assemble_chunks(chunks, port, ts, order, chunk, silence=fv.CHUNK_SILENCE, delay=EDIT_DELAY):
    """Serial chunks joined until the port stays silent."""
    pieces = F.sort_array(F.collect_list(F.struct(ts, *order, F.col(chunk).alias("piece"))))
    return (
        chunks.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, silence).alias("response"), port)
        .agg(
            F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("raw"),
            F.min(ts).alias("response_start"),
            F.count("*").alias("n_chunks"),
        )
        .drop("response")
    )


def rate_limit(attempts, key, ts, order, limit, length=limits.DAY, inclusive=False):
    """Admit or deny each attempt; the state of a key is its admitted times.

    The state never holds more than ``limit`` times and is dropped once the
    watermark has passed the last of them by ``length``.  A row that is late by up
    to ``length`` is judged against the state at arrival and takes its place among the
    times.  An older one, for which the state may be gone, is denied and counts for
    nothing, as is one without a time.  Every row gets a verdict: Spark would drop rows
    behind the watermark, so the fold's event time is a column that is never late,
    while the query's watermark is still taken from ``ts``.
    """
    window = length_micros(length)
    columns = [key, ts, *order]
    schema = StructType([attempts.schema[c] for c in columns]).add("admitted", "boolean")

    def fold(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_at", *order])
        mark = state.getCurrentWatermarkMs() * 1000
        verdicts = [
            not (pd.isna(at) or 0 < mark and at < mark)
            and judge(held, int(at), limit, window, inclusive)
            for at in rows["_at"]
        ]
        if held or state.exists:
            state.update((held,))
        if held:
            expiry = int(held[-1] + window) // 1000 + 1
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield rows[columns].assign(admitted=verdicts)

    return (
        attempts.select(*columns, F.unix_micros(ts).alias("_at"))
        .withWatermark(ts, length)
        .select(
            *[F.col(c).alias(c, metadata={}) for c in (*columns, "_at")],
            F.lit(NEVER_LATE).cast("timestamp").alias("_never_late", metadata={WATERMARK: window // 1000}),
        )
        .groupBy(key)
        .applyInPandasWithState(
            fold, schema, "admitted array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )


def without_recent_repeats(rows, ts, keys=merges.KEY, delay=INGEST_DELAY):
    """Drop repeats of a key that arrive close together; rows without a key stay."""
    keyed = rows.withWatermark(ts, delay)
    complete = F.lit(True)
    for name in keys:
        complete = complete & F.col(name).isNotNull()
    unique = keyed.filter(complete).dropDuplicatesWithinWatermark(list(keys))
    return unique.unionByName(keyed.filter(~complete))


def corpus_store(spark, path, schema, keys=merges.KEY):
    """The table that the writers below share; micro-batch n writes its version n + 1."""
    return KeyedStore(spark, path, schema, keys)


def ingest_writer(rows, path, order, keys=merges.KEY):
    """Insert rows whose key the corpus does not hold yet, first one wins.

    A batch reads and writes the buckets of its own keys only.
    """
    schema = rows.schema

    def insert(batch, batch_id):
        corpus_store(batch.sparkSession, path, schema, keys).insert(batch, order, batch_id + 1)

    return rows.writeStream.foreachBatch(insert)


def search_writer(queries, corpus_of, path):
    """Search every new query against the corpus as it is when the batch runs."""

    def find(batch, batch_id):
        held = batch.persist()
        write_batch(search.search(held, corpus_of(batch.sparkSession)), path, batch_id)
        held.unpersist()

    return queries.writeStream.foreachBatch(find)


def indexed_search_writer(rows, queries_of, closed_of, corpus_path, index_path, path):
    """Add the closed cases of each batch to corpus and index, then search its open ones.

    A batch indexes its own cases and reads the lists of its own queries; nothing is
    built from the whole corpus.  ``rows`` are case rows with an ``id``.
    """

    def advance(batch, batch_id):
        spark, version = batch.sparkSession, batch_id + 1
        corpus = corpus_store(spark, corpus_path, rows.schema, ["id"])
        index = PostingIndex(spark, index_path)
        corpus.insert(closed_of(batch), ["closed_at"], version)
        # what the corpus took from the batch
        index.add(corpus.added(version).drop("bucket"), version)
        hits = search.search(queries_of(batch), corpus.read(), index=index)
        write_batch(hits, path, batch_id)

    return rows.writeStream.foreachBatch(advance)


def quality_gate_writer(documents, corpus_path, rejected_path, queue_path, now=None):
    """Closed cases to corpus, rejects or queue.

    A case failing its own rules can never succeed and is rejected; one that the
    table constraints turn away, or whose closing time cannot be read, failed while being
    written and is queued, whole (as JSON in ``data``) and with its ``error``, once for
    each id.  Corpus and queue are keyed stores, of which a batch touches its own buckets only.
    """

    def gate(batch, batch_id):
        spark, version = batch.sparkSession, batch_id + 1
        with Scope() as scope:
            judged = scope.stage(gates.judge_cases(batch), "gate-judged")
            rows = cases.case_to_row(judged.filter(F.col("reason").isNull()), now=now)
            error = F.when(~F.col("valid"), "constraint").when(F.col("closed_at").isNull(), "closed_at")
            checked = scope.stage(gates.check_constraints(rows).withColumn("error", error), "gate-checked")
            corpus = corpus_store(spark, corpus_path, rows.schema)
            corpus.insert(checked.filter("error IS NULL"), ["closed_at", "resolution"], version)
            write_batch(
                judged.filter(F.col("reason").isNotNull()).select("id", "reason"), rejected_path, batch_id
            )
            failed = checked.filter("error IS NOT NULL").groupBy(F.col("local_id").alias("failed_id"))
            whole = judged.select("id", F.to_json(F.struct(*batch.columns)).alias("data"))
            entries = whole.join(
                failed.agg(F.min("error").alias("error")), F.col("id").eqNullSafe(F.col("failed_id"))
            ).drop("failed_id")
            corpus_store(spark, queue_path, entries.schema, ["id"]).insert(entries, ["data"], version)

    return documents.writeStream.foreachBatch(gate)


def violations_writer(violations, path, totals_path, sender, key="installation_id"):
    """Number violations across batches and add their alert texts.

    A batch adds what it counts, one row an installation, to a keyed store and looks up
    the counts before it, from the buckets of its own installations; installations it does
    not meet are neither read nor written.  Rows without an installation are one.
    """
    named = StructType().add("name", "string").add("added", "long")

    def summed(rows):
        return rows.groupBy("name").agg(F.sum("added").alias("added"))

    def number(batch, batch_id):
        spark, version = batch.sparkSession, batch_id + 1
        totals = KeyedStore(spark, totals_path, named, ["name"])
        # a name for every key, the missing one included
        name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("missing"))
        with Scope() as scope:
            numbered = limits.running_violations(batch, key, "created_at", ["event_id"])
            numbered = scope.stage(numbered.withColumn("name", name), "violations-numbered")
            added = numbered.groupBy("name").agg(F.count("*").alias("added"))
            before = summed(totals.lookup(added, before=version)).withColumnRenamed("added", "before")
            numbered = (
                numbered.join(before, "name", "left")
                .withColumn("violation_count", F.col("violation_count") + F.coalesce("before", F.lit(0)))
                .withColumn("blocked", F.col("violation_count") >= fv.BLOCK_AFTER_VIOLATIONS)
                .drop("before", "name")
            )
            write_batch(limits.alerts(numbered, sender), path, batch_id)
            totals.append(added, version, summed)

    return violations.writeStream.foreachBatch(number)
