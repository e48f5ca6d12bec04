"""Context blocks of few cited cases, whose texts are shared, against those whose texts travel."""

from faultline.operators import context

HIT = "query_id string, hit_rank int, case_id string, score double, is_own boolean"
CASE = (
    "id string, vehicle_brand string, vehicle_model string, engine_power string,"
    " symptoms array<string>, obd_codes array<string>, resolution string"
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def world(table):
    hits = [(f"q{i}", rank, f"c{(i * rank) % 7}", 12.0 - rank if i % 3 else None, False) for i in range(9) for rank in (1, 2, 3)]
    hits += [(None, 1, "c1", 9.0, True), ("q0", 4, "missing", 5.0, False), ("q1", 4, None, 5.0, False)]
    # an id of three cases, one of them twice, and a case without an id
    corpus = [(f"c{i}", "A", f"M{i}", None, ["hluk", None], [f"P000{i}"], f"fix {i}") for i in range(7)]
    corpus += [("c1", None, "", None, None, [], None), ("c2", "B", "M", "1", ["x"], ["y"], "z"), ("c2", "B", "M", "1", ["x"], ["y"], "z")]
    corpus += [(None, "A", "M", "1", [], [], "none")]
    return table(hits, HIT), table(corpus, CASE)


def test_shared_texts_give_the_blocks_of_travelling_ones(table):
    hits, corpus = world(table)
    few, many = (sorted(map(repr, context.context_blocks(hits, corpus, most).collect())) for most in (100, 0))
    assert few == many and len(few) == 10
    block = {r["query_id"]: r["context"] for r in context.context_blocks(hits, corpus).collect()}["q1"]
    # rank 1 cites c1, of which there are two; rank 2 cites c2, of which there are three
    assert [block.count(f"[{rank}] ") for rank in (1, 2, 3, 4)] == [2, 3, 1, 0]
    # more cases than ids: they count, not the ids
    assert sorted(map(repr, context.context_blocks(hits, corpus, 8).collect())) == few


def test_texts_of_few_cases_do_not_travel(table):
    hits, corpus = world(table)
    plan = plan_of(context.context_blocks(hits, corpus)).split("Subqueries")[0]
    assert "number" in plan and "SortMergeJoin" not in plan
    grouped = [line for line in plan.splitlines() if "collect_list" in line and "opening" in line]
    assert grouped and not any("part#" in line for line in grouped)
