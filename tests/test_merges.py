"""Keyed merges, catalog lookups, answers and context."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import answers, catalog, context, merges

ROW = "installation_id string, local_id string, n int, body string"


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("keep, wins", [("first", "a"), ("last", "c")])
def test_other_columns_decide_between_rows_of_equal_order(table, keep, wins):
    rows = [("i", "k", 1, body) for body in ("b", "a", "c", "b")]
    got = merges.one_per_key(table(rows, ROW).coalesce(1), ["installation_id", "local_id"], ["n"], keep)
    assert got.columns == ["installation_id", "local_id", "n", "body"]
    assert result(got) == [("i", "k", 1, wins)]


TARGET = [("i", "a", 0, "old"), ("i", None, 0, "loose")]
INCOMING = [
    ("i", "a", 1, "new"), ("i", "b", 3, "later"), ("i", "b", 2, "first"),
    ("i", None, 4, "loose"), ("i", None, 4, "loose"), (None, "a", 5, "no owner"),
]


def test_insert_keeps_first_and_never_merges_missing_keys(table):
    got = merges.insert_if_absent(table(TARGET, ROW), table(INCOMING, ROW), ["n"])
    assert result(got) == sorted(TARGET + [INCOMING[2]] + INCOMING[3:], key=repr)


def test_insert_twice_changes_nothing(table):
    keyed = [r for r in INCOMING if r[0] and r[1]]
    once = merges.insert_if_absent(table(TARGET, ROW), table(keyed, ROW), ["n"])
    assert result(merges.insert_if_absent(once, table(keyed, ROW), ["n"])) == result(once)


def test_upsert_replaces_with_last(table):
    got = merges.upsert_last(table(TARGET, ROW), table(INCOMING, ROW), ["n"])
    assert result(got) == sorted([TARGET[1], INCOMING[0], INCOMING[1]] + INCOMING[3:], key=repr)


SESSION = "id string, data string, status string, updated_at string"
SESSIONS = [("1", '{"id":"a"}', "open", "t0"), ("2", '{"id":"b"}', "open", "t0"), ("3", "{}", "open", "t0")]


def test_update_and_delete_by_document_key(table):
    sessions = table(SESSIONS, SESSION)
    changes = table([("a", '{"id":"a","x":1}', None, "t1")], "doc_key string, new_data string, new_status string, new_updated_at string")
    got = merges.update_by_json_key(sessions, changes)
    assert result(got.select("id", "data", "status", "updated_at")) == [
        ("1", '{"id":"a","x":1}', "open", "t1"), SESSIONS[1], SESSIONS[2],
    ]
    assert result(merges.delete_by_json_key(sessions, table([("a",)], "doc_key string"))) == SESSIONS[1:]


def test_outcomes_queue_and_retry(table):
    judged = table([("a", None), ("b", "too_short"), ("c", None), ("d", None)], "id string, reason string")
    held = table([("c",), ("c",)], "id string")
    failed = table([("d", "timeout")], "id string, error string")
    got = {r["id"]: (r["outcome"], r["ok"], r["error"]) for r in merges.push_outcomes(judged, held, failed).collect()}
    assert got == {
        "a": ("inserted", True, None), "b": ("validation_error", False, "too_short"),
        "c": ("duplicate", True, None), "d": ("failed", False, "timeout"),
    }
    retried = merges.retry_dead_letters(judged, held, failed)
    assert {r["id"]: r["disposition"] for r in retried.collect()} == {
        "a": "sent", "b": "dropped", "c": "sent", "d": "remaining",
    }
    assert tuple(merges.retry_counts(retried).first()) == (4, 3, 2)
    queue = table([("d", 1)], "id string, n int")
    assert result(merges.enqueue(queue, table([("d", 2), ("e", 4), ("e", 3)], "id string, n int"), ["n"])) == [("d", 1), ("e", 3)]


MODEL = "struct<group string, label string, powers array<string>>"
CATALOG = f"brand string, position int, active boolean, expertise string, models array<{MODEL}>"


@pytest.fixture
def items(table):
    def build(second_active):
        return catalog.catalog_items(
            table(
                [
                    ("Ford", 0, True, "F", [(None, "Early", None), ("G1", None, None), (None, "M1", ["1", "2"]), (None, "M2", None), ("G2", None, None), (None, "M3", [])]),
                    ("ford", 1, second_active, "f2", [(None, "M2", ["9"]), (None, "M1", ["8"])]),
                ],
                CATALOG,
            )
        )

    return build


def test_headers(items):
    one = {r["label"]: r["header"] for r in catalog.carry_group_header(items(False)).collect()}
    assert one == {"Early": None, "M1": "G1", "M2": "G1", "M3": "G2"}
    two = {(r["brand"], r["label"]): r["header"] for r in catalog.carry_group_header(items(True)).collect()}
    assert two[("Ford", "Early")] == "Ford" and two[("ford", "M1")] == "ford" and two[("Ford", "M3")] == "G2"


def test_lookups(items, table):
    rows = table([("FORD", "M1"), ("Audi", "M2"), (None, "M3"), ("Ford", None)], "b string, m string")
    found = catalog.brand_lookup(rows, items(True), "b", "default")
    assert sorted((r["b"] or "", r["expertise"]) for r in found.collect()) == [
        ("", "default"), ("Audi", "default"), ("FORD", "F"), ("Ford", "F"),
    ]
    powers = catalog.model_powers(rows, items(True), "m")
    assert {r["m"]: r["powers"] for r in powers.collect()} == {"M1": ["1", "2"], "M2": ["9"], "M3": [], None: []}
    active = catalog.active_brands(items(True)).collect()
    assert sorted((r["brand"], r["is_default"]) for r in active) == [("Ford", True), ("ford", False)]


def test_symptom_counts(table):
    wide = table([({"Motor": ["a", "b"], "Brzdy": ["c", "a"]},)], "categories map<string,array<string>>")
    chosen = table([("x", ["a", "b", "zz"]), ("y", [])], "id string, symptoms array<string>")
    got = catalog.symptom_category_counts(chosen, catalog.symptom_categories(wide))
    assert result(got) == [("x", "Brzdy", 1), ("x", "Motor", 2)]


FAULTS = '{"shrnutí":"s","závady":[{"název":"A","pravděpodobnost":85,"popis":"x } ] \\" {"},{"název":"B","pravděpodobnost":10}'
DONE = FAULTS + '],"doporučené_testy":["t"],"varování":"v","další_info":"Výsledek zkrácen."}'


@pytest.mark.parametrize(
    "raw, status, faults",
    [
        (DONE, "ok", 2),
        ("```json\n" + DONE, "ok", 2),
        (DONE + "\n```", "repaired", 2),
        (FAULTS + ',{"název":"C","popis":"cut', "repaired", 2),
        (FAULTS, "repaired", 2),
        ('{"závady":[{"název":"A","díly":["x","y', "failed", None),
        ("no object", "failed", None),
        ("", "failed", None),
        (None, "failed", None),
        ('{"závady":[]}', "ok", 0),
        ('{"shrnutí":"only"}', "ok", None),
    ],
)
def test_parse_answers(table, raw, status, faults):
    row = answers.parse_answers(table([(raw,)], "raw string")).first()
    assert row["status"] == status
    found = row["result"]["závady"] if row["result"] else None
    assert (None if found is None else len(found)) == faults


def test_faults_meta_and_topic(table):
    off = '{"závady":[{"název":"Nesouvisející dotaz","pravděpodobnost":0}]}'
    rows = table([("1", DONE), ("2", off), ("3", '{"závady":[]}'), ("4", "x")], "id string, raw string")
    parsed = answers.parse_answers(rows)
    faults = answers.fault_bands(answers.explode_faults(parsed, ["id"])).orderBy("id", "position").collect()
    assert [(r["id"], r["fault_name"], r["is_primary"], r["probability_band"]) for r in faults] == [
        ("1", "A", True, "high"), ("1", "B", False, "low"), ("2", "Nesouvisející dotaz", True, "low"),
    ]
    meta = {r["id"]: (r["info"], r["has_meta"]) for r in answers.answer_meta(parsed.filter("id < '3'")).collect()}
    assert meta == {"1": (None, True), "2": (None, False)}
    assert tuple(answers.off_topic_rate(parsed.withColumn("all", F.lit(1)), ["all"]).first())[1:] == (4, 1)


def test_context_block(table):
    hits = table([("q", 1, "a", 9.5, True), ("q", 2, "b", 5.0, True)], "query_id string, hit_rank int, case_id string, score double, is_own boolean")
    corpus = table(
        [("a", "Ford", "M1", None, ["s1", "s2"], ["P0401"], "fixed a"), ("b", None, "", None, [], None, "fixed b")],
        "id string, vehicle_brand string, vehicle_model string, engine_power string, symptoms array<string>, obd_codes array<string>, resolution string",
    )
    block = context.context_blocks(hits, corpus).first()["context"]
    assert "[1] 🔴 VYSOKÁ SHODA (skóre: 9.5) | Ford M1\n   Příznaky: s1, s2\n   OBD: P0401\n   ✅ Ověřené řešení: fixed a\n\n" in block
    assert "[2] 🟡 STŘEDNÍ SHODA (skóre: 5.0) | ?\n   Příznaky: —\n   OBD: —\n   ✅ Ověřené řešení: fixed b\n\n" in block
    assert block.startswith("\n\nOVĚŘENÉ OPRAVY")


def test_match_strength(value):
    shown = [value(context.match_strength(F.lit(s).cast("double"))) for s in (8, 7.9, 5, 4.9, None)]
    assert [s.split()[1] for s in shown] == ["VYSOKÁ", "STŘEDNÍ", "STŘEDNÍ", "ČÁSTEČNÁ", "ČÁSTEČNÁ"]
