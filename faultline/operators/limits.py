"""Rolling limits, token budgets, violations and usage counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.operators.recency import newest_per_key
from faultline.operators.running import first_position, rolling_count, running
from faultline.operators.skew import join_spreading_hot_keys

DAY = "24 hours"


def rolling_write_limit(writes, key, ts, order, limit=fv.WRITES_PER_DAY, length=DAY):
    """Naive replay: a write passes while earlier attempts younger than a day are few."""
    counted = rolling_count(writes, key, ts, order, length, "prior_count")
    return counted.withColumn("admitted", F.col("prior_count") < limit)


def rolling_call_limit(
    calls, key, ts, order, success, limit=fv.CALLS_PER_DAY, length=DAY, count_failed=None
):
    """A call is denied at ``limit`` earlier successes, edge included.

    ``count_failed`` marks calls whose count could not be read; they pass.
    """
    counted = rolling_count(
        calls, key, ts, order, length, "prior_count", counted=success, inclusive=True
    )
    passes = F.col("prior_count") < limit
    if count_failed is not None:
        passes = passes | count_failed
    return counted.withColumn("admitted", passes)


def input_rounds(messages, case, position, kind):
    """Running number of input messages up to and including each message."""
    return running(
        messages,
        [case],
        [position],
        sums={"round_no": (kind == fv.INPUT).cast("int")},
    )


def token_budget(messages, case, position, tokens, budget=fv.TOKENS_PER_CASE):
    """Running tokens of a case with the share of the budget, its band and label."""
    used = running(
        messages,
        [case],
        [position],
        sums={"used": F.coalesce(tokens, F.lit(0))},
    )
    percent = F.least(F.lit(100), F.round(F.col("used") / budget * 100).cast("int"))
    return (
        used.withColumn("percent", percent)
        .withColumn(
            "band",
            F.when(F.col("percent") >= 90, "critical")
            .when(F.col("percent") >= 70, "warning")
            .otherwise("normal"),
        )
        .withColumn(
            "label",
            F.when(F.col("percent") >= 5, F.concat(F.col("percent").cast("string"), F.lit("%")))
            .otherwise("<1%"),
        )
    )


def tokens_before(messages, case, position, tokens):
    """Tokens a case had used before each message."""
    return running(
        messages,
        [case],
        [position],
        sums={"used_before": F.coalesce(tokens, F.lit(0))},
        before=True,
    )


def flag_first_diagnosis(messages, case, position, kind):
    """Mark each case's first diagnosis."""
    firsts = first_position(messages, [case], position, kind == fv.DIAGNOSIS)
    return join_spreading_hot_keys(messages, firsts, [case], position, "left").select(
        *messages.columns,
        F.coalesce(F.col(position) == F.col("first_position"), F.lit(False)).alias("is_first"),
    )


def running_violations(violations, key, ts, order, block_after=fv.BLOCK_AFTER_VIOLATIONS):
    """n-th violation of each installation; blocked from the third on."""
    numbered = running(
        violations,
        [key],
        [ts, *order],
        sums={"violation_count": F.lit(1)},
    )
    return numbered.withColumn("blocked", F.col("violation_count") >= block_after)


def violation_totals(violations, key, block_after=fv.BLOCK_AFTER_VIOLATIONS):
    return (
        violations.groupBy(key)
        .agg(F.count("*").alias("violations"))
        .withColumn("blocked", F.col("violations") >= block_after)
    )


def daily_count(rows, key, ts, as_of, length=DAY, inclusive=False):
    """Rows per installation in the last day before ``as_of`` (edge excluded by default)."""
    edge = as_of - F.expr(f"INTERVAL '{length}'")
    recent = (F.col(ts) >= edge if inclusive else F.col(ts) > edge) & (F.col(ts) <= as_of)
    return rows.filter(recent).groupBy(key).agg(F.count("*").alias("n"))


def within_quota(rows, key, order, used, limit):
    """Add ``granted``: whether a row is among the first of its key that fit beside the used.

    ``used`` has the key and ``n``.  Only the first ``limit`` rows of a key can fit, and
    they are cut before they meet, so no task holds a whole key.  ``order`` tells the rows of
    a key apart; rows without a key are not granted.
    """
    first = newest_per_key(rows.select(key, *order), [key], order, limit, order[-1])
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    fits = (
        first.withColumn("_place", place)
        .join(used.select(key, F.col("n").alias("_used")), key, "left")
        .filter(F.col("_place") + F.coalesce("_used", F.lit(0)) <= limit)
        .select(key, *order, F.lit(True).alias("_fits"))
    )
    return rows.join(fits, [key, *order], "left").select(
        *rows.columns, F.coalesce("_fits", F.lit(False)).alias("granted")
    )


def publish_daily_count(spark, view, key, ts, as_of_sql, name="daily_count"):
    """Publish the count as a SQL function of the installation."""
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(inst STRING) RETURNS INT RETURN ("
        f"SELECT CAST(COUNT(*) AS INT) FROM {view} WHERE {view}.{key} = inst"
        f" AND {view}.{ts} > {as_of_sql} - INTERVAL 24 HOURS AND {view}.{ts} <= {as_of_sql})"
    )


def alerts(violations, sender, reason="reason", key="installation_id", ts="created_at"):
    """Subject and HTML body per violation row (delivery is not part of this)."""
    count = F.col("violation_count").cast("int")
    shown = [
        F.col(key).cast("string"),
        F.col(reason),
        count.cast("string"),
        F.when(F.col("blocked"), fv.ALERT_BLOCKED_YES).otherwise(fv.ALERT_BLOCKED_NO),
        F.col(ts).cast("string"),
    ]
    cells = [
        F.format_string(fv.ALERT_CELL, F.lit(label), value)
        for label, value in zip(fv.ALERT_LABELS, shown)
    ]
    subject = F.when(
        F.col("blocked"), F.format_string(fv.ALERT_SUBJECT_BLOCKED, F.lit(sender), count)
    ).otherwise(F.format_string(fv.ALERT_SUBJECT_WARNING, F.lit(sender), count))
    body = F.concat(
        F.lit(fv.ALERT_HEADING % sender), F.lit(fv.ALERT_TABLE), *cells, F.lit("</table>")
    )
    return violations.withColumns({"subject": subject, "body": body})


def successful_usage(calls, failed, model, input_tokens, output_tokens, key, ts):
    """Usage rows of the calls that did not fail; missing token counts are 0."""
    return calls.filter(~F.coalesce(failed, F.lit(False))).select(
        key.alias("installation_id"),
        model.alias("model"),
        F.coalesce(input_tokens, F.lit(0)).cast("bigint").alias("input_tokens"),
        F.coalesce(output_tokens, F.lit(0)).cast("bigint").alias("output_tokens"),
        ts.alias("created_at"),
    )


def admit_requests(requests, allowed_models, key, model, messages, max_tokens):
    """First failing request rule as a reason, and the capped token limit."""
    reason = (
        F.when(F.coalesce(key, F.lit("")) == "", "no_installation")
        .when(~F.coalesce(model.isin(*allowed_models), F.lit(False)), "model_not_allowed")
        .when(F.coalesce(F.size(messages), F.lit(0)) <= 0, "no_messages")
    )
    granted = F.least(
        F.coalesce(max_tokens, F.lit(fv.MAX_TOKENS_DEFAULT)), F.lit(fv.MAX_TOKENS_CAP)
    )
    return requests.withColumns({"reason": reason, "granted_tokens": granted})
