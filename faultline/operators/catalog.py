"""Lookups in the vehicle and symptom catalogs.

A catalog travels in long form: one row per list item, with the brand's place
(``brand_position``), the item's place (``position``) and either a ``group``
header or a model ``label`` with its ``powers``.
"""

from pyspark.sql import functions as F

from faultline.functions.text import or_empty
from faultline.operators.running import running
from faultline.operators.skew import join_spreading_hot_keys

#: Entries of a catalog, some 100 bytes each, that are broadcast; a longer one is spread.
SMALL_CATALOG = 20_000


def catalog_items(catalog):
    """Long form of a catalog with one nested model list per brand."""
    return catalog.select(
        "brand",
        F.col("position").alias("brand_position"),
        "active",
        "expertise",
        F.posexplode_outer("models").alias("position", "model"),
    ).select("brand", "brand_position", "active", "expertise", "position", "model.*")


def brands(items):
    """One row per brand of a long-form catalog."""
    return items.groupBy("brand", "brand_position").agg(
        F.first("active").alias("active"), F.first("expertise").alias("expertise")
    )


def active_brands(items):
    """Active brands; the first of them is the default."""
    active = brands(items).filter("active")
    first = active.agg(F.min("brand_position").alias("first_position"))
    return active.join(first, F.col("brand_position") == F.col("first_position"), "left").select(
        "brand",
        "brand_position",
        "expertise",
        F.col("first_position").isNotNull().alias("is_default"),
    )


def brand_lookup(rows, items, brand, default_expertise):
    """Case-insensitive brand to its expertise text; the earliest entry wins.

    Hot brands are spread by the first column of ``rows``.
    """
    entries = (
        brands(items)
        .groupBy(F.lower("brand").alias("_brand"))
        .agg(
            F.min_by("brand", "brand_position").alias("catalog_brand"),
            F.min_by("expertise", "brand_position").alias("expertise"),
        )
    )
    named = rows.withColumn("_brand", F.lower(F.col(brand)))
    return join_spreading_hot_keys(
        named, entries, ["_brand"], rows.columns[0], "left", small=SMALL_CATALOG
    ).select(
        *rows.columns,
        "catalog_brand",
        F.coalesce("expertise", F.lit(default_expertise)).alias("expertise"),
    )


def model_powers(rows, items, model):
    """Power options of a model: the first brand whose entry lists powers, else none.

    Hot models are spread by the first column of ``rows``.
    """
    entries = (
        items.filter(F.col("label").isNotNull())
        .groupBy("label", "brand_position")
        .agg(F.min_by("powers", "position").alias("powers"))
        .filter(F.col("powers").isNotNull())
        .groupBy(F.col("label").alias(model))
        .agg(F.min_by("powers", "brand_position").alias("powers"))
    )
    found = join_spreading_hot_keys(
        rows, entries, [model], rows.columns[0], "left", small=SMALL_CATALOG
    )
    return found.select(*rows.columns, or_empty(F.col("powers")).alias("powers"))


def carry_group_header(items):
    """Each model of the active brands with the last header above it.

    With several active brands the brand itself is the first header of its list.
    """
    active = items.filter("active")
    several = (
        active.select("brand").distinct().agg((F.count("*") > 1).alias("several")).scalar()
    )
    header = F.when(
        F.col("group").isNotNull(),
        F.struct(F.col("position").cast("bigint").alias("at"), F.col("group").alias("header")),
    )
    carried = running(
        active.filter(F.col("position").isNotNull()),
        ["brand"],
        ["position"],
        maxes={"last_header": header},
    )
    return carried.filter(F.col("label").isNotNull()).select(
        "brand",
        "brand_position",
        "position",
        "label",
        F.coalesce(F.col("last_header.header"), F.when(several, F.col("brand"))).alias("header"),
    )


def symptom_categories(catalog):
    """(category, symptom) rows of a map-valued symptom catalog."""
    return catalog.select(F.explode("categories").alias("category", "symptoms")).select(
        "category", F.explode("symptoms").alias("symptom")
    )


def symptom_category_counts(selected, categories, case="id"):
    """How many selected symptoms of a case fall into each category."""
    chosen = selected.select(case, F.explode("symptoms").alias("symptom"))
    return (
        join_spreading_hot_keys(
            chosen, categories, ["symptom"], case, small=SMALL_CATALOG
        )
        .groupBy(case, "category")
        .agg(F.count("*").alias("n_selected"))
    )
