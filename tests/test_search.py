"""The bulk search against a plain pair-by-pair restatement."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from faultline.operators import recency, search, skew
from faultline.plans import views

QUERY = (
    "query_id string, installation_id string, brand string, model string, power string,"
    " symptoms array<string>, codes array<string>, text string"
)
CASE = (
    "id string, installation_id string, vehicle_brand string, vehicle_model string, engine_power string,"
    " symptoms array<string>, obd_codes array<string>, description string, closed_at timestamp"
)


def plain_search(queries, corpus, limit, hits=5):
    """One query at a time, one case at a time."""
    old = datetime.datetime(1, 1, 1)
    found, kept = [], {}
    for qid, inst, brand, model, power, symptoms, codes, text in queries:
        pool = [c for c in corpus if brand is None or c[2] == brand]
        if codes:
            pool = [c for c in pool if set(c[6] or []) & {x for x in codes if x is not None}]
        elif model is not None:
            pool = [c for c in pool if c[3] == model]
        pool.sort(key=lambda c: c[0])
        pool.sort(key=lambda c: (c[8] is None, c[8] or old), reverse=True)
        # A stable sort in reverse keeps equal times in id order.
        pool = pool[:limit]
        kept[qid] = [c[0] for c in pool]
        scored = []
        for place, c in enumerate(pool):
            hay = " ".join([*(c[5] or []), *(c[6] or []), c[7] or ""]).lower()
            tenths = (30 if model and c[3] == model else 0) + (20 if power and c[4] == power else 0)
            tenths += sum(40 for x in codes or [] if x.lower() in hay)
            tenths += sum(15 for x in symptoms or [] if x.lower() in hay)
            tenths += min(20, sum(3 for w in (text or "").lower().split() if len(w) > 4 and w in hay))
            own = c[1] == inst
            if tenths >= (50 if own else 80):
                scored.append((-tenths, not own, place, c[0]))
        for rank, (negative, other, _, cid) in enumerate(sorted(scored)[:hits], 1):
            found.append((qid, rank, cid, -negative / 10, not other))
    return sorted(found), kept


def random_world(seed, n_queries=60, n_cases=400):
    pick = random.Random(seed)

    def some(pool, most):
        return pick.sample(pool, pick.randint(0, most))

    def maybe(pool):
        return pick.choice([None, *pool])

    codes = [f"P{i:04d}" for i in range(12)]
    words = ["turbo", "hadice", "praskla", "ventil", "únik", "oleje", "P0003", "čidlo"]
    day = datetime.datetime(2024, 1, 1)

    def body():
        return some(["Kouř", "hluk", "vibrace"], 3), some(codes, 4), " ".join(some(words, 6))

    corpus = [
        (f"c{i}", f"i{pick.randint(0, 5)}", maybe(["A", "B"]), maybe(["M1", "M2"]), maybe(["1", "2"]), *body(),
         pick.choice([None, *[day + datetime.timedelta(hours=pick.randint(0, 90))] * 9]))
        for i in range(n_cases)
    ]
    queries = [
        (f"q{i}", f"i{pick.randint(0, 5)}", maybe(["A", "B"]), maybe(["M1", "M2"]), maybe(["1", "2"]), *body())
        for i in range(n_queries)
    ]
    corpus.append(("cn", "i1", "A", "M1", "1", None, None, None, None))
    queries.append(("qn", "i1", None, None, None, None, [], None))
    return queries, corpus


def result(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("limit", [7, 50, 10_000])
def test_search_equals_plain_search(table, limit):
    queries, corpus = random_world(limit)
    expected, kept = plain_search(queries, corpus, limit)
    q, c = table(queries, QUERY), table(corpus, CASE)
    assert {r["query_id"]: r["case_ids"] for r in search.candidate_cases(q, c, limit).collect()} == {
        k: v for k, v in kept.items() if v
    }
    assert result(search.search(q, c, limit=limit)) == expected


def test_hot_keys_are_spread_without_changing_results(table, monkeypatch):
    queries, corpus = random_world(3)
    # Half of all queries and cases share one code.
    queries = [(*q[:6], ["P0001"], q[7]) if i % 2 else q for i, q in enumerate(queries)]
    corpus = [(*c[:6], ["P0001"], *c[7:]) if i % 2 else c for i, c in enumerate(corpus)]
    monkeypatch.setattr(skew.join_spreading_hot_keys, "__defaults__", ("inner", 10_000, 3))
    expected, _ = plain_search(queries, corpus, 20)
    q, c = table(queries, QUERY), table(corpus, CASE)
    hot = skew.hot_keys(search.query_keys(q), search.POSTING_KEY, min_rows=3).collect()
    assert hot and max(r["_splits"] for r in hot) > 1
    assert result(search.search(q, c, limit=20)) == expected


def test_hot_keys_are_few_by_definition(table):
    rows = table([(i % 50,) for i in range(5000)], "k int")
    assert skew.hot_keys(rows, ["k"], max_hot=10, min_rows=1).count() < 10
    assert skew.hot_keys(rows, ["k"], max_hot=100, min_rows=1).count() == 50


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join_equals_join(table, how):
    rows = [(["hot", "warm", None, f"k{i % 9}"][i % 4], i) for i in range(400)]
    big = table(rows, "k string, n int")
    keyed = table([("hot", 1), ("warm", 2), ("k0", 3), ("zz", 4), (None, 5)], "k string, v int")
    got = skew.join_spreading_hot_keys(big, keyed, ["k"], "n", how, min_rows=20)
    plain = big.join(keyed, "k", how)
    assert got.count() == plain.count()
    assert got.select(plain.columns).exceptAll(plain).count() == 0


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plan_has_no_pair_products_and_cuts_early(spark, tmp_path):
    rows = views.case_rows(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "cases"))
    stored = spark.read.parquet(str(tmp_path / "cases"))
    plan = plan_of(search.search(views.as_queries(stored), views.closed(stored)))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("WindowGroupLimit") >= 4
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,F)]" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_score_is_computed_once(spark):
    rows = views.case_rows(spark, "/root/testdata/sf0.001")
    plan = plan_of(search.search(views.as_queries(rows), views.closed(rows)))
    assert plan.count("q_words") and plan.count("Contains(") <= 3


def test_evidence(table):
    diagnoses = table([("d1", ["a", "b", "a"]), ("d2", None), ("d3", ["zz"])], "case_id string, match_ids array<string>")
    corpus = table([("a", 1), ("b", 2)], "id string, x int")
    found = search.evidence(diagnoses, corpus)
    assert sorted((r["case_id"], r["matched_id"]) for r in found.collect()) == [("d1", "a"), ("d1", "b")]
    counts = {r["case_id"]: (r["n_cited"], r["n_found"]) for r in search.evidence_counts(diagnoses, corpus).collect()}
    assert counts == {"d1": (2, 2), "d2": (0, 0), "d3": (1, 0)}


def test_flat_query_columns(table):
    from faultline import schemas

    row = ("q", "i", ("", "M", "1", None), ["s"], None, "t")
    flat = search.query_columns(table([row], schemas.SEARCH_QUERY)).first()
    assert (flat["brand"], flat["model"], flat["power"], flat["codes"]) == (None, "M", None, [])


def test_pairs_do_not_travel(spark, table, monkeypatch):
    queries, corpus = random_world(5)
    q, c = table(queries, QUERY), table(corpus, CASE)
    plan = plan_of(search.search(q, c, limit=20))
    # only keys and features are shuffled by query, and no row carries the shared cases
    assert "SortMergeJoin [case_id" not in plan and "explode(case_ids" not in plan
    assert plan.count("AS shared#") == plan.count("struct(lists, ")
    shared = result(search.search(q, c, limit=20))
    kept = result(search.candidate_cases(q, c, 20))
    monkeypatch.setattr(search, "MAX_SHARED_ENTRIES", 0)
    assert "case_id" in plan_of(search.search(q, c, limit=20))
    assert result(search.search(q, c, limit=20)) == shared
    assert result(search.candidate_cases(q, c, 20)) == kept


def test_repeated_rows_meet_shared_lists_like_joined_ones(table, monkeypatch):
    queries, corpus = random_world(8)
    queries += [*queries[:9], (queries[0][0], *queries[1][1:]), (None, *queries[2][1:])]
    corpus += [*corpus[:40], *[(corpus[0][0], *row[1:]) for row in corpus[40:50]], (None, *corpus[3][1:])]
    q, c = table(queries, QUERY), table(corpus, CASE)

    def all_of():
        return [
            sorted(map(repr, frame.collect()))
            for frame in (search.candidate_cases(q, c, 30), search.scored_candidates(q, c, 30), search.search(q, c, limit=30))
        ]

    shared = all_of()
    monkeypatch.setattr(search, "MAX_SHARED_ENTRIES", 0)
    assert all_of() == shared


def test_queries_of_an_id_of_their_own_do_not_travel(spark, table):
    queries, corpus = random_world(6)
    q, c = table(queries, QUERY), table(corpus, CASE)
    alone, sharing = search._by_repeated_id(q)
    assert sharing is None and alone.count() == len(queries)
    plan = plan_of(search.search(q.coalesce(1), c, limit=20))
    assert "REPARTITION" in plan  # fewer pieces than cores
    plan = plan_of(search.search(q, c, limit=20))
    assert "hashpartitioning(query_id" not in plan and "REPARTITION" not in plan
    assert result(search.search(q, c, limit=20)) == plain_search(queries, corpus, 20)[0]


def test_many_shared_ids_meet_like_few(table, monkeypatch):
    queries, corpus = random_world(9)
    queries += queries[:7]
    q, c = table(queries, QUERY), table(corpus, CASE)
    few = result(search.search(q, c, limit=20))
    alone, sharing = search._by_repeated_id(q)
    assert (alone.count(), sharing.count()) == (len(queries) - 14, 14)
    monkeypatch.setattr(search, "MAX_REPEATED_IDS", 2)
    assert search._by_repeated_id(q)[0] is None
    assert result(search.search(q, c, limit=20)) == few


def test_newest_per_key_is_cut_in_the_task_that_reads(spark):
    rows = spark.range(0, 8000, 1, 4).select((F.col("id") % 3).alias("k"), "id")
    newest = recency.newest_per_key(rows, ["k"], ["id"], 5, "id")
    # rows of one key are not told apart before the cut, and travel once
    assert "_salt" not in plan_of(newest) and plan_of(newest).count("Exchange hashpartitioning(k") == 1
    assert sorted(r["id"] for r in newest.collect()) == list(range(15))
    many = recency.newest_per_key(rows, ["k"], ["id"], 1001, "id")
    assert "_salt" in plan_of(many) and many.count() == 3003


def test_order_parts_of_few_and_many_parts(spark, table):
    lines = table([(1, 10), (1, 11), (1, 10), (2, 12), (None, 10), (3, None), (3, 99)], "l_orderkey long, l_partkey long")
    parts = table([(10, "a", "b", "c"), (10, "a2", "b", "c"), (11, None, "b", "d"), (12, "e", "f", None), (None, "x", "y", "z")],
                  "p_partkey long, p_type string, p_brand string, p_name string")
    few, many = views.order_parts(lines, parts), views.order_parts(lines, parts, most=0)
    names = ["l_orderkey", "p_type", "p_brand", "p_name"]
    rows = [sorted(map(repr, x.select(names).collect())) for x in (few, many)]
    assert rows[0] == rows[1] and len(rows[0]) == 8
    plan = plan_of(views.case_rows(spark, "/root/testdata/sf0.001"))
    # arrays are made where the lines of an order lie, not before they travel
    assert "partial_collect_set" in plan and "REPARTITION_BY_COL" in plan
    assert plan.index("partial_collect_set") < plan.index("REPARTITION_BY_COL")
