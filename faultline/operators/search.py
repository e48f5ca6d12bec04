"""Bulk similarity search of many queries against a corpus of closed cases.

The candidates of a query are the newest ``limit`` cases that share its brand
(when given) and one of its codes, or its model when it has no codes.  Any
newest-``limit`` cut of a union is contained in the union of the members' own
newest-``limit`` cuts, so each posting list can be cut *before* it meets a
query.  The join therefore moves at most ``limit`` entries per query code, no
matter how many cases share that code, and no pair is built only to be thrown
away.

Where the queries read few lists (counted), the cut lists and the cases in them, at most
``MAX_SHARED_ENTRIES``, are one small value that every task holds.  A query then meets
its cases where it was read (``scoring.py``), and only its id travels, to see whether
other rows have it too.  Rows that share an id meet the lists of all of them; their keys
and features travel.  Beyond, lists and cases meet the queries by joins.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import fixed_values as fv
from faultline.functions import similarity as sim
from faultline.functions.once import once
from faultline.functions.text import empty_to_null, or_empty
from faultline.operators.recency import newest_per_key, recency_key
from faultline.operators.scoring import scorer
from faultline.operators.skew import join_spreading_hot_keys

#: Distinct query keys, about 50 bytes each, that are broadcast to prune the corpus.
MAX_PRUNING_KEYS = 200_000
#: List entries, with their cases some 500 bytes each, that every task may hold.
MAX_SHARED_ENTRIES = 200_000
#: Ids of several query rows that are broadcast; beyond, all rows meet by their ids.
MAX_REPEATED_IDS = 200_000
POSTING_KEY = ["shape", "brand", "term"]


def query_columns(queries):
    """Flat query columns from a query table with a nested vehicle."""
    return queries.select(
        "query_id",
        "installation_id",
        empty_to_null(F.col("vehicle.brand")).alias("brand"),
        empty_to_null(F.col("vehicle.model")).alias("model"),
        empty_to_null(F.col("vehicle.enginePower")).alias("power"),
        or_empty(F.col("symptoms")).alias("symptoms"),
        or_empty(F.col("obdCodes")).alias("codes"),
        "text",
    )


def _key(shape, brand=None, term=None):
    def or_blank(value):
        return F.lit("") if value is None else F.coalesce(value, F.lit(""))

    return F.struct(
        F.lit(shape).alias("shape"), or_blank(brand).alias("brand"), or_blank(term).alias("term")
    )


def _query_key_array():
    """The posting lists a query reads: its codes, else model, brand or all."""
    codes = F.array_distinct(F.array_compact(F.col("codes")))
    brand, model = F.col("brand"), F.col("model")
    return (
        F.when(
            F.size("codes") > 0,
            F.when(
                brand.isNotNull(), F.transform(codes, lambda c: _key("brand+code", brand, c))
            ).otherwise(F.transform(codes, lambda c: _key("code", None, c))),
        )
        .when(
            model.isNotNull(),
            F.array(
                F.when(brand.isNotNull(), _key("brand+model", brand, model)).otherwise(
                    _key("model", None, model)
                )
            ),
        )
        .when(brand.isNotNull(), F.array(_key("brand", brand, None)))
        .otherwise(F.array(_key("all", None, None)))
    )


def query_keys(queries):
    """One row per posting list a query reads."""
    return queries.select("query_id", F.explode(_query_key_array()).alias("key")).select(
        "query_id", "key.*"
    )


def _key_name(key):
    """One string for a key; no two keys share it."""
    brand = key["brand"]
    return F.concat(key["shape"], F.lit(":"), F.char_length(brand), F.lit(":"), brand, key["term"])


def corpus_keys(corpus, id_col="id"):
    """Every posting list a case belongs to, without its wide columns."""
    codes = F.array_distinct(F.array_compact(or_empty(F.col("obd_codes"))))
    brand, model = F.col("vehicle_brand"), F.col("vehicle_model")
    nothing = F.array().cast("array<struct<shape:string,brand:string,term:string>>")

    def only_if(condition, keys):
        return F.when(condition, keys).otherwise(nothing)

    keys = F.concat(
        only_if(brand.isNotNull(), F.transform(codes, lambda c: _key("brand+code", brand, c))),
        F.transform(codes, lambda c: _key("code", None, c)),
        only_if(
            brand.isNotNull() & model.isNotNull(), F.array(_key("brand+model", brand, model))
        ),
        only_if(model.isNotNull(), F.array(_key("model", None, model))),
        only_if(brand.isNotNull(), F.array(_key("brand", brand, None))),
        F.array(_key("all", None, None)),
    )
    recency = recency_key(corpus, "closed_at")
    return corpus.select(
        recency.alias("recency"), F.col(id_col).alias("case_id"), F.explode(keys).alias("key")
    ).select("key.*", "recency", "case_id")


def cut_lists(members, limit=fv.CANDIDATE_LIMIT):
    """Newest ``limit`` case ids per key, as one short array per key."""
    newest = newest_per_key(members, POSTING_KEY, ["recency", "case_id"], limit, "case_id")
    return newest.groupBy(*POSTING_KEY).agg(
        F.collect_list(F.struct("recency", "case_id")).alias("posting")
    )


def merge_lists(lists, limit=fv.CANDIDATE_LIMIT):
    """One list per key out of several cut ones: the newest of a union are among their newest."""
    together = F.sort_array(F.array_distinct(F.flatten(F.collect_list("posting"))))
    return lists.groupBy(*POSTING_KEY).agg(F.slice(together, 1, limit).alias("posting"))


def _distinct_keys(query_keys_df):
    """How many lists the queries read, counted up to ``MAX_PRUNING_KEYS`` and one."""
    return query_keys_df.select(*POSTING_KEY).distinct().limit(MAX_PRUNING_KEYS + 1).count()


def posting_lists(corpus, query_keys_df, limit=fv.CANDIDATE_LIMIT, n_keys=None):
    """The cut lists that some query reads.

    Few distinct query keys are broadcast to the corpus; of many (counted, unless given) only
    the shapes are, of which there are six.
    """
    wanted = query_keys_df.select(*POSTING_KEY).distinct()
    if (_distinct_keys(query_keys_df) if n_keys is None else n_keys) <= MAX_PRUNING_KEYS:
        members = corpus_keys(corpus).join(F.broadcast(wanted), POSTING_KEY, "left_semi")
    else:
        shapes = wanted.select("shape").distinct()
        members = corpus_keys(corpus).join(F.broadcast(shapes), "shape", "left_semi")
    return cut_lists(members, limit)


def _let(value, use):
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _with_shared(rows, lists, corpus, name, use):
    """``rows`` with a column ``use(shared)`` called ``name``.

    The subquery leaves its column in one place, so the optimizer puts it there and no
    row carries a copy.
    """
    held = rows.withColumn("shared", _shared_lists(lists, corpus).scalar())
    made = held.select("query_id", _let(F.col("shared"), use).alias(name))
    return made.select("query_id", once(**{name: F.col(name)}))


def _shared_lists(lists, corpus):
    """Lists, their entries and the cases of these as a frame of one row with one struct.

    Entries are numbered newest first.  ``lists`` maps a key's name to its entries; an
    entry has its ``id``, the ``first`` entry of that id and the ``places`` of its cases;
    cases lie in the order that decides between equal scores.  Without a corpus there
    are no cases.
    """
    order = Window.orderBy("recency", "case_id")
    name = _key_name({column: F.col(column) for column in POSTING_KEY})
    numbered = (
        lists.select(name.alias("name"), F.inline("posting"))
        .withColumn("entry", F.dense_rank().over(order) - 1)
        .withColumn("first", F.min("entry").over(Window.partitionBy("case_id")))
    )
    named = numbered.groupBy("name").agg(F.collect_set("entry").alias("entries"))
    entries = numbered.select("entry", F.col("case_id").alias("id"), "first").distinct()
    parts = [named.select(F.struct("name", "entries").alias("list"))]
    if corpus is None:
        parts.append(entries.select(F.struct("entry", "id", "first").alias("entry")))
    else:
        wanted = F.broadcast(entries.select("id").distinct())
        place = F.row_number().over(Window.orderBy(F.desc_nulls_first("closed_at"), F.asc("id"))) - 1
        found = corpus.join(wanted, "id", "left_semi").withColumn("place", place)
        places = found.groupBy("id").agg(F.collect_list("place").alias("places"))
        placed = entries.join(places, "id", "left")
        parts.append(placed.select(F.struct("entry", "id", "first", "places").alias("entry")))
        text = sim.case_text(F.col("symptoms"), F.col("obd_codes"), F.col("description"))
        held = ["place", "id", "installation_id", "vehicle_model", "engine_power", "closed_at"]
        parts.append(found.select(F.struct(*held, text.alias("text")).alias("case")))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    values = [
        F.map_from_entries(F.collect_list("list")).alias("lists"),
        F.sort_array(F.collect_list("entry")).alias("entries"),
    ]
    if corpus is not None:
        values.append(F.sort_array(F.collect_list("case")).alias("cases"))
    return together.agg(F.struct(*values).alias("shared"))


def _candidate_entries(shared, names, limit):
    """The first entries of a query's newest ``limit`` cases, newest first."""
    lists = F.transform(names, lambda name: F.try_element_at(shared["lists"], name))
    entries = F.flatten(F.filter(lists, lambda entries: entries.isNotNull()))
    newest = F.sort_array(F.array_distinct(entries))
    firsts = F.transform(newest, lambda entry: F.get(shared["entries"], entry)["first"])
    return F.slice(F.array_distinct(firsts), 1, limit)


def _dealt(queries):
    """Queries dealt out by id.  They are small, but not their work: without a number of
    partitions they would be gathered into fewer than there are cores."""
    partitions = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return queries.repartition(max(partitions, cores), "query_id")


def _enough_tasks(queries):
    """Queries as they are read; dealt out only where they are fewer pieces than cores."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return queries if queries.rdd.getNumPartitions() >= cores else _dealt(queries)


def _names():
    """The names of the lists a query row reads."""
    return F.transform(_query_key_array(), _key_name)


def _names_per_query(queries):
    """The names of the lists a query reads; rows of one id read the lists of all."""
    every = F.array_distinct(F.flatten(F.collect_list("names")))
    return queries.select("query_id", _names().alias("names")).groupBy("query_id").agg(
        every.alias("names")
    )


def _by_repeated_id(queries):
    """(rows with an id of their own, rows that share one), None where there are none.

    Few shared ids are broadcast; where they are many, all rows count as sharing.
    """
    counts = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.count("*").alias("rows"))
    repeated = counts.filter("rows > 1").select("query_id")
    n_repeated = repeated.limit(MAX_REPEATED_IDS + 1).count()
    if n_repeated > MAX_REPEATED_IDS:
        return None, queries
    known = queries.filter("query_id IS NOT NULL")
    if not n_repeated:
        return known, None
    few = F.broadcast(repeated)
    return known.join(few, "query_id", "left_anti"), known.join(few, "query_id", "left_semi")


def _lists(queries, corpus, limit, index):
    """The cut lists of all queries, and whether every task may hold them."""
    keys = query_keys(queries)
    n_keys = _distinct_keys(keys)
    if index is None:
        lists, longest = posting_lists(corpus, keys, limit, n_keys), limit
    else:
        lists, longest = index.lists(keys), index.limit
    return lists, n_keys * longest <= MAX_SHARED_ENTRIES


def candidate_cases(queries, corpus, limit=fv.CANDIDATE_LIMIT, index=None):
    """(query_id, case_id) candidates; ``queries`` as given by ``query_columns``.

    With an index (``postings.PostingIndex``) the lists are looked up instead of built.
    """
    lists, small = _lists(queries, corpus, limit, index)
    if not small:
        return _joined_candidates(queries, lists, limit)

    def ids(shared):
        return F.transform(
            _candidate_entries(shared, F.col("names"), limit),
            lambda entry: F.get(shared["entries"], entry)["id"],
        )

    found = _with_shared(_names_per_query(_dealt(queries)), lists, None, "case_ids", ids)
    return found.filter(F.size("case_ids") > 0)


def _joined_candidates(queries, lists, limit):
    merged = F.sort_array(F.flatten(F.collect_list("posting")))
    return (
        join_spreading_hot_keys(query_keys(queries), lists, POSTING_KEY, "query_id")
        .groupBy("query_id")
        .agg(merged.alias("merged"))
        .select(
            "query_id",
            F.slice(F.array_distinct(F.col("merged.case_id")), 1, limit).alias("case_ids"),
        )
    )


def _feature_columns():
    return {
        "asking_installation": F.col("installation_id"),
        "asked_model": F.col("model"),
        "asked_power": F.col("power"),
        "q_codes": sim.lowered(F.col("codes")),
        "q_symptoms": sim.lowered(F.col("symptoms")),
        "q_words": sim.query_words(F.col("text")),
    }


def _features(queries):
    return queries.select("query_id", *[value.alias(name) for name, value in _feature_columns().items()])


def _is_own(installation_id):
    return F.coalesce(installation_id == F.col("asking_installation"), F.lit(False))


def _base(model, power, text):
    attributes = sim.attribute_tenths(F.col("asked_model"), model, F.col("asked_power"), power)
    return sim.base_tenths(F.col("q_codes"), F.col("q_symptoms"), text, attributes)


def _scored_rows(rows, lists, corpus, limit, needed, most):
    """The scored pairs of each row of names and features, best first, or the best ``most``.

    Lists and cases go to a task's scorer once, with its first row.
    """
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    given = F.when(first, _shared_lists(lists, corpus).scalar())
    shape = (
        T.StructType()
        .add("query_id", rows.schema["query_id"].dataType)
        .add("hit_rank", "integer")
        .add("case_id", corpus.schema["id"].dataType)
        .add("closed_at", corpus.schema["closed_at"].dataType)
        .add("is_own", "boolean")
        .add("tenths", "integer")
    )
    return rows.withColumn("given", given).mapInArrow(scorer(limit, needed, most), shape)


def _shared_hits(queries, lists, corpus, limit, needed, most=None):
    """The scored pairs of each row, best first with their ``hit_rank``, or the best ``most``.

    Of queries that meet the shared lists, in two frames as by ``_by_repeated_id``.
    """
    alone, sharing = _by_repeated_id(queries)
    if alone is not None:
        rows = _enough_tasks(alone).select("query_id", once(names=_names(), **_feature_columns()))
        alone = _scored_rows(rows, lists, corpus, limit, needed, most)
    if sharing is not None:
        dealt = _dealt(sharing)
        rows = _names_per_query(dealt).join(_features(dealt), "query_id")
        sharing = _scored_rows(rows, lists, corpus, limit, needed, most)
    return alone, sharing


def _union(*frames):
    """The union of the frames that there are."""
    return reduce(lambda one, two: one.unionByName(two), [frame for frame in frames if frame is not None])


def scored_candidates(queries, corpus, limit=fv.CANDIDATE_LIMIT, needed=None, index=None):
    """Every candidate pair with its score in tenths and its ownership.

    ``needed`` are the tenths that a query's own cases and others must reach: pairs below
    are left out.
    """
    lists, small = _lists(queries, corpus, limit, index)
    if small:
        found = _union(*_shared_hits(queries, lists, corpus, limit, needed))
        return found.drop("hit_rank")
    return _joined_scores(queries, lists, corpus, limit, needed)


def _joined_scores(queries, lists, corpus, limit, needed):
    pairs = (
        _joined_candidates(queries, lists, limit)
        .join(_features(queries), "query_id")
        .withColumn("case_id", F.explode("case_ids"))
        .drop("case_ids")
    )
    cases = corpus.select(
        F.col("id").alias("case_id"),
        "installation_id",
        "vehicle_model",
        "engine_power",
        "closed_at",
        sim.case_text(F.col("symptoms"), F.col("obd_codes"), F.col("description")).alias("text"),
    )
    base = _base(F.col("vehicle_model"), F.col("engine_power"), F.col("text"))
    based = pairs.join(cases, "case_id").select(
        "query_id",
        "case_id",
        "closed_at",
        "q_words",
        "text",
        once(base=base, is_own=_is_own(F.col("installation_id"))),
    )
    # pairs that no word can lift so far are spared the word test
    least = None if needed is None else F.when(F.col("is_own"), needed[0]).otherwise(needed[1])
    if least is not None:
        based = based.filter(F.col("base") + fv.WORD_TENTHS_MAX >= least)
    tenths = F.col("base") + sim.word_tenths(F.col("q_words"), F.col("text"))
    scored = based.select("query_id", "case_id", "closed_at", "is_own", once(tenths=tenths))
    return scored if least is None else scored.filter(F.col("tenths") >= least)


def search(
    queries,
    corpus,
    hits=fv.HIT_LIMIT,
    limit=fv.CANDIDATE_LIMIT,
    own_threshold=fv.OWN_THRESHOLD,
    other_threshold=fv.OTHER_THRESHOLD,
    index=None,
):
    """Best hits per query: score, then own cases, then newest, then id."""

    needed = own_threshold * 10, other_threshold * 10

    def ranked(passing):
        best = Window.partitionBy("query_id").orderBy(
            F.desc("tenths"), F.desc("is_own"), F.desc_nulls_first("closed_at"), F.asc("case_id")
        )
        return passing.withColumn("hit_rank", F.row_number().over(best)).filter(F.col("hit_rank") <= hits)

    lists, small = _lists(queries, corpus, limit, index)
    if small:
        alone, sharing = _shared_hits(queries, lists, corpus, limit, needed, hits)
        if sharing is not None:
            # the best of a query's rows are among the best of each
            sharing = ranked(sharing)
        found = _union(alone, sharing)
    else:
        found = ranked(_joined_scores(queries, lists, corpus, limit, needed))
    return found.select(
        "query_id", "hit_rank", "case_id", (F.col("tenths") / 10).alias("score"), "is_own"
    )


def evidence(diagnoses, corpus, id_col="case_id", matches="match_ids"):
    """Corpus cases a diagnosis cites; an id cited twice counts once."""
    cited = diagnoses.select(
        id_col, F.explode(F.array_distinct(or_empty(F.col(matches)))).alias("matched_id")
    )
    return cited.join(corpus.withColumnRenamed("id", "matched_id"), "matched_id")


def evidence_counts(diagnoses, corpus, id_col="case_id", matches="match_ids"):
    """How many cited cases exist, and how many were cited."""
    cited = diagnoses.select(
        id_col, F.explode_outer(F.array_distinct(or_empty(F.col(matches)))).alias("matched_id")
    )
    known = corpus.select(F.col("id").alias("matched_id"), F.lit(1).alias("known"))
    return (
        cited.join(known, "matched_id", "left")
        .groupBy(id_col)
        .agg(F.count("matched_id").alias("n_cited"), F.count("known").alias("n_found"))
    )
