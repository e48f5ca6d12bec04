"""Corpus monitoring queries."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv


def total_count(rows):
    return rows.agg(F.count("*").alias("n"))


def top_codes(corpus, limit=20, codes="obd_codes"):
    """Most frequent codes; ties by code."""
    return (
        corpus.select(F.explode(codes).alias("code"))
        .groupBy("code")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "code")
        .limit(limit)
    )


def top_models(corpus, model="vehicle_model"):
    """Known models by frequency."""
    return (
        corpus.filter(F.col(model).isNotNull())
        .groupBy(model)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), model)
    )


def recent_rows(rows, ts, as_of, order, days=30):
    """Rows of the last days before ``as_of``, newest first."""
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return rows.filter((F.col(ts) > since) & (F.col(ts) <= as_of)).orderBy(F.desc(ts), *order)


def newest_first(rows, ts, order):
    return rows.orderBy(F.desc_nulls_first(ts), *order)


def status_counts(cases, status="status", closed=fv.STATUS_CLOSED):
    return cases.agg(
        F.count("*").alias("n_cases"), F.count_if(F.col(status) == closed).alias("n_closed")
    )


def diagnosis_counts(messages, case, kind):
    return messages.groupBy(case).agg(F.count_if(kind == fv.DIAGNOSIS).alias("n_diagnoses"))


def case_tokens(usage, case, input_tokens, output_tokens):
    """Tokens spent per case; missing counts are 0."""
    spent = F.coalesce(input_tokens, F.lit(0)) + F.coalesce(output_tokens, F.lit(0))
    return usage.groupBy(case).agg(F.sum(spent).cast("bigint").alias("tokens"))
