"""Retrieval context and prompts assembled from search hits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions.text import non_empty, or_empty
from faultline.operators.catalog import brand_lookup
from faultline.session import stage

#: Cited cases, some 500 bytes each, whose texts every task may hold.
MAX_CITED = 100_000


def match_strength(score):
    """Label of a score; a missing score counts as 0."""
    known = F.coalesce(score, F.lit(0.0))
    return (
        F.when(known >= fv.OTHER_THRESHOLD, fv.STRENGTH_HIGH)
        .when(known >= fv.OWN_THRESHOLD, fv.STRENGTH_MEDIUM)
        .otherwise(fv.STRENGTH_PARTIAL)
    )


def _listed(items):
    joined = F.array_join(F.array_distinct(or_empty(items)), ", ", "")
    return F.when(joined == "", "—").otherwise(joined)


def _hit_opening(rank, score):
    return F.format_string(
        "[%d] %s (skóre: %.1f) | ", rank, match_strength(score), F.coalesce(score, F.lit(0.0))
    )


def _case_part(vehicle_parts, symptoms, codes, resolution):
    vehicle = F.array_join(non_empty(F.array(*vehicle_parts)), " ")
    return F.concat(
        F.when(vehicle == "", "?").otherwise(vehicle),
        F.lit("\n   Příznaky: "),
        _listed(symptoms),
        F.lit("\n   OBD: "),
        _listed(codes),
        F.lit("\n   ✅ Ověřené řešení: "),
        F.coalesce(resolution, F.lit("—")),
    )


def hit_entry(rank, score, vehicle_parts, symptoms, codes, resolution):
    """The text of one hit."""
    return F.concat(_hit_opening(rank, score), _case_part(vehicle_parts, symptoms, codes, resolution))


def _cited(hits, cases, most):
    """The cases that the hits cite, numbered in the order of their parts; None where they are many."""
    ids = hits.select("case_id").distinct()
    if ids.limit(most + 1).count() > most:
        return None
    known = cases.join(F.broadcast(ids), "case_id", "left_semi")
    known = stage(known, "cited")
    if known.limit(most + 1).count() > most:
        return None
    return known.withColumn("number", F.row_number().over(Window.orderBy("part")) - 1)


def context_blocks(hits, corpus, most=MAX_CITED):
    """One context text per query that has hits (at most a handful each).

    The texts of few cited cases (counted) are one value in every task and meet a query's
    hits when these are together; of many they travel with each hit.
    """
    hits = stage(hits, "hits")
    vehicle = [F.col("vehicle_brand"), F.col("vehicle_model"), F.col("engine_power")]
    part = _case_part(vehicle, F.col("symptoms"), F.col("obd_codes"), F.col("resolution"))
    cases = corpus.select(F.col("id").alias("case_id"), part.alias("part"))
    opened = hits.select("query_id", "hit_rank", "case_id", _hit_opening(F.col("hit_rank"), F.col("score")).alias("opening"))
    known = _cited(hits, cases, most)
    last = "part" if known is None else "number"
    met = opened.join(cases, "case_id") if known is None else opened.join(F.broadcast(known.select("case_id", last)), "case_id")
    items = F.sort_array(F.collect_list(F.struct("hit_rank", "opening", last)))
    grouped = met.groupBy("query_id").agg(items.alias("items"))
    if known is not None:
        texts = known.agg(F.sort_array(F.collect_list(F.struct("number", "part"))).alias("texts"))
        grouped = grouped.withColumn("texts", texts.scalar())

    def entry(item):
        text = item["part"] if known is None else F.get(F.col("texts"), item["number"])["part"]
        return F.concat(item["opening"], text)

    entries = F.array_join(F.transform("items", entry), "\n\n")
    return grouped.select(
        "query_id", F.concat(F.lit(fv.CONTEXT_HEADER), entries, F.lit(fv.CONTEXT_FOOTER)).alias("context")
    )


def system_prompts(queries, blocks, catalog_items, brand="brand"):
    """One prompt per query: expertise of its brand, context of its hits, rules."""
    known = brand_lookup(queries, catalog_items, brand, fv.DEFAULT_EXPERTISE)
    return known.join(blocks, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit(fv.PROMPT_OPENING),
            "expertise",
            F.lit("."),
            F.coalesce("context", F.lit("")),
            F.lit(fv.PROMPT_RULES),
        ).alias("system_prompt"),
    )
