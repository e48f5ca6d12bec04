"""Keyed merges between a target table and incoming rows.

Each returns the new state or the rows to write.  Incoming rows are reduced to
one per key with a combining aggregate, so a key sent very often never gathers
in one task, and rows without a key take part in no join at all.
"""

from functools import reduce

from pyspark.sql import functions as F

from faultline.operators.skew import join_spreading_hot_keys

KEY = ("installation_id", "local_id")


def _keyed(keys):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def one_per_key(rows, keys, order, keep):
    """The first or last row per key in ``order``; the other columns decide between equals.

    Each column travels once: a row that starts with its order needs no copy of that.
    """
    pick = F.min if keep == "first" else F.max
    whole = F.struct(*order, *[c for c in rows.columns if c not in order])
    return (
        rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(pick(whole).alias("row"))
        .select(*[F.col("row")[c].alias(c) for c in rows.columns])
    )


def rows_to_insert(target, incoming, order, keys=KEY):
    """Incoming rows that are new; the first of several wins.

    Rows with a null key are never duplicates.
    """
    keyed, loose = incoming.filter(_keyed(keys)), incoming.filter(~_keyed(keys))
    fresh = one_per_key(keyed, keys, order, "first").join(
        target.filter(_keyed(keys)).select(*keys), list(keys), "left_anti"
    )
    return fresh.select(*incoming.columns).unionByName(loose)


def insert_if_absent(target, incoming, order, keys=KEY):
    """Target state after the insert; existing rows stay as they are."""
    return target.unionByName(rows_to_insert(target, incoming, order, keys))


def upsert_last(target, incoming, order, keys=KEY):
    """Target state after an upsert; the last incoming row of a key replaces it."""
    keyed, loose = incoming.filter(_keyed(keys)), incoming.filter(~_keyed(keys))
    latest = one_per_key(keyed, keys, order, "last")
    replaced = latest.select(*keys)
    kept = target.filter(_keyed(keys)).join(replaced, list(keys), "left_anti")
    return (
        kept.select(*target.columns)
        .unionByName(target.filter(~_keyed(keys)))
        .unionByName(latest)
        .unionByName(loose)
    )


def update_by_json_key(sessions, changes, path="$.id", data="data"):
    """Replace document, status and update time of the rows whose document has the key.

    ``changes`` has one row per ``doc_key`` with ``new_data``, ``new_status`` and
    ``new_updated_at``.
    """
    keyed = sessions.withColumn("doc_key", F.get_json_object(data, path))
    return join_spreading_hot_keys(keyed, changes, ["doc_key"], "id", "left").select(
        *[c for c in sessions.columns if c not in (data, "status", "updated_at")],
        F.coalesce("new_data", data).alias(data),
        F.coalesce("new_status", "status").alias("status"),
        F.coalesce("new_updated_at", "updated_at").alias("updated_at"),
    )


def delete_by_json_key(sessions, doc_keys, path="$.id", data="data"):
    """Drop the rows whose document has one of the keys; rows without a key stay."""
    keyed = sessions.withColumn("doc_key", F.get_json_object(data, path))
    gone = doc_keys.select("doc_key").distinct()
    return join_spreading_hot_keys(keyed, gone, ["doc_key"], "id", "left_anti").select(
        *sessions.columns
    )


def push_outcomes(judged, existing_keys, failures, case_key="id"):
    """Outcome of pushing each judged case.

    ``existing_keys`` lists keys the corpus already holds, ``failures`` has one
    row per key whose write failed with its ``error``.
    """
    held = existing_keys.select(F.col(case_key), F.lit(True).alias("held")).distinct()
    return (
        judged.join(held, case_key, "left")
        .join(failures.select(case_key, "error"), case_key, "left")
        .withColumn(
            "outcome",
            F.when(F.col("reason").isNotNull(), "validation_error")
            .when(F.col("error").isNotNull(), "failed")
            .when(F.col("held"), "duplicate")
            .otherwise("inserted"),
        )
        .select(
            *judged.columns,
            "outcome",
            F.col("outcome").isin("duplicate", "inserted").alias("ok"),
            (F.col("outcome") == "validation_error").alias("validation_error"),
            F.coalesce("reason", "error").alias("error"),
        )
    )


def enqueue(queue, failed, order, case_key="id"):
    """Dead-letter queue after adding failed cases; a queued id keeps its first entry."""
    return insert_if_absent(queue, failed, order, (case_key,))


def retry_dead_letters(judged_queue, existing_keys, failures, case_key="id"):
    """Disposition of each queued case: sent, dropped (can never succeed) or remaining."""
    tried = push_outcomes(judged_queue, existing_keys, failures, case_key)
    return tried.withColumn(
        "disposition",
        F.when(F.col("ok"), "sent").when(F.col("validation_error"), "dropped").otherwise("remaining"),
    )


def retry_counts(retried):
    """How many of the queued cases left the queue."""
    return retried.agg(
        F.count("*").alias("queued"),
        F.count_if(F.col("disposition") != "remaining").alias("left_queue"),
        F.count_if(F.col("disposition") == "sent").alias("sent"),
    )
