"""Case documents, rows and titles."""

import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import cases, gates


def message(kind, symptoms=None, codes=None, text=None, result=None):
    return (None, kind, symptoms, codes, text, None, result, None, None)


def document(id="c1", vehicle=("Ford", "Transit MK7 2.2 TDCi", "185000", "96 kW (130 k)"), messages=(),
             resolution="replaced pump", closed="2024-03-01 10:00:00", name="old"):
    return (id, name, "uzavřený", None, closed, vehicle, list(messages), resolution, 0, "inst")


@pytest.fixture
def documents(table):
    return lambda *rows: table(list(rows), schemas.CASE_DOCUMENT)


FULL = [
    message("input", ["a", "b"], ["P0401"], "first"),
    message("diagnosis", ["ignored"], ["U0001"], "ignored", '{"závady":[{"název":"EGR"}]}'),
    message("input", ["b", "c"], ["P0401", "P0403"], ""),
    message("input", None, None, "second"),
]


def test_signals_keep_first_occurrence(documents):
    row = cases.with_signals(documents(document(messages=FULL))).first()
    assert row["symptoms"] == ["a", "b", "c"]
    assert row["obd_codes"] == ["P0401", "P0403"]


def test_no_messages(documents):
    row = cases.with_signals(documents(document(messages=[]))).first()
    assert row["symptoms"] == [] and row["obd_codes"] == []


def test_case_to_row(documents):
    now = F.lit("2025-01-01").cast("timestamp")
    rows = documents(
        document(messages=FULL),
        document("c2", ("", "", "abc", ""), [], closed=None),
        document("c3", None, []),
    )
    desktop = {r["local_id"]: r for r in cases.case_to_row(rows, now=now).collect()}
    assert desktop["c1"]["description"] == "first\nsecond"
    assert desktop["c1"]["mileage"] == 185000
    assert desktop["c1"]["closed_at"] == datetime.datetime(2024, 3, 1, 10)
    empty = desktop["c2"]
    assert [empty[c] for c in ("vehicle_brand", "vehicle_model", "mileage", "engine_power")] == [None] * 4
    assert empty["symptoms"] == [] and empty["description"] is None
    assert empty["closed_at"] == datetime.datetime(2025, 1, 1)
    assert desktop["c3"]["vehicle_model"] is None
    assert "id" not in cases.case_to_row(rows).columns
    web = cases.case_to_row(rows, separator=" ").filter("local_id = 'c1'").first()
    assert web["description"] == "first second"


CORPUS = schemas.CORPUS_ROW
AT = datetime.datetime(2024, 1, 1)


def test_row_to_case(table):
    rows = table(
        [
            ("r1", "l1", "i", None, "Ford", "Transit", 5, "96 kW", ["s"], ["P0401"], "d", "x" * 50, AT, AT),
            ("r2", None, "i", None, None, None, None, None, None, None, None, "fixed it", None, AT),
        ],
        CORPUS,
    )
    found = {r["id"]: r for r in cases.row_to_case(rows).collect()}
    assert found["r1"]["name"] == "[Cloud] Ford Transit | " + "x" * 40
    assert found["r2"]["name"] == "[Cloud] Neznámý model | fixed it"
    assert found["r2"]["vehicle"].asDict() == dict(brand="", model="", mileage="", enginePower="")
    only = found["r2"]["messages"][0]
    assert (only["id"], only["symptoms"], only["obdCodes"], only["text"]) == ("r2_input", [], [], "")
    assert found["r1"]["fromCloud"] and found["r1"]["status"] == "uzavřený"


def test_round_trip(table):
    row = ("r1", "l1", "i", None, "Ford", "Transit", 5, "96 kW", ["s"], ["P0401"], "d", "fixed it", AT, AT)
    documents = cases.row_to_case(table([row], CORPUS))
    back = cases.case_to_row(documents).first()
    assert (back["vehicle_brand"], back["mileage"], back["symptoms"], back["obd_codes"]) == (
        "Ford", 5, ["s"], ["P0401"],
    )
    assert (back["description"], back["resolution"], back["closed_at"]) == ("d", "fixed it", AT)


def test_titles(documents):
    title = cases.case_title(F.col("vehicle"))
    rows = documents(
        document("a"), document("b", ("Ford", "", "1", "")), document("c", ("F", "One", "", "")), document("d", None)
    )
    got = {r["id"]: r["t"] for r in rows.select("id", title.alias("t")).collect()}
    assert got == {
        "a": "Transit MK7 2.2 · 96 kW · 185 000 km",
        "b": "Nový případ",
        "c": "One",
        "d": "Nový případ",
    }


def test_retitle(documents):
    later = [message("diagnosis", result='{"závady":[{"název":"Pump"}]}')]
    rows = documents(
        document("a", messages=FULL + later),
        document("b", ("Ford", "", "", ""), messages=later),
        document("c", None, messages=later),
        document("d", messages=[message("diagnosis", result='{"závady":[]}')] + later),
        document("e"),
    )
    got = {r["id"]: r["name"] for r in cases.retitle_on_first_diagnosis(rows).collect()}
    assert got == {
        "a": "Transit MK7 2.2 | EGR", "b": "Ford | Pump", "c": "Vozidlo | Pump", "d": "old", "e": "old",
    }


def test_user_prompt(documents):
    one = document("a", ("Ford", "", "", "96 kW"), [message("input", ["s1", "s2"], None, "text")])
    two = document("b", None, [message("input", None, ["P0401"], "x"), message("input", None, None, "y")])
    got = {r["id"]: r["user_prompt"] for r in cases.user_prompt(documents(one, two)).collect()}
    assert got["a"] == "Vozidlo: Ford 96 kW\nPříznaky: s1, s2\nPopis mechanika:\ntext"
    assert got["b"] == "OBD kódy: P0401\nPopis mechanika 1:\nx\nPopis mechanika 2:\ny"


def test_explode_keeps_positions(documents):
    rows = cases.explode_messages(
        documents(document(messages=FULL)).withColumnRenamed("id", "case_id"), "input", "case_id"
    )
    assert sorted(r["position"] for r in rows.collect()) == [0, 2, 3]


def test_judge_cases_names_first_bad_code(documents):
    bad = document(messages=[message("input", ["s"], ["P0401", "P04", "X1"])])
    judged = gates.judge_cases(documents(bad, document("c2", None, [message("input", ["s"])]))).collect()
    assert [(r["reason"], r["bad_code"]) for r in judged] == [("bad_code", "P04"), ("no_model", None)]


def test_constraints_are_never_null(table):
    rows = table(
        [(None, None, None, None, None), ("replaced pump", [], ["P1"], None, " "), ("x" * 201, ["s"], [], "", "M")],
        "resolution string, symptoms array<string>, obd_codes array<string>, description string, vehicle_model string",
    )
    got = [tuple(r)[5:] for r in gates.check_constraints(rows).collect()]
    assert got == [(False,) * 4, (True, True, False, False), (False, True, True, False)]


def test_code_lists(value):
    row = (["a", "b", "a"], ["b", "c"], ["c", "d", "d"])
    schema = "x array<string>, y array<string>, z array<string>"
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    assert value(cases.merge_code_lists(x, y, z), schema, row) == ["a", "b", "c", "d"]
    assert value(cases.new_pending_codes(z, y), schema, row) == ["d", "d"]
    assert value(cases.new_pending_codes(z, F.lit(None).cast("array<string>")), schema, row) == ["c", "d", "d"]
    assert value(cases.submission_size(x, y, F.lit("  ")), schema, row) == 5
    assert value(cases.submission_size(x, y, F.lit(" t ")), schema, row) == 6
