"""Golden values of the column functions."""

import pytest
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import answers, quality, scan, text
from faultline.functions import similarity as sim
from faultline.operators.scanlog import parse_responses


@pytest.mark.parametrize(
    "high, low, code",
    [
        ("01", "33", "P0133"),
        ("04", "01", "P0401"),
        ("22", "63", "P2263"),
        ("00", "87", "P0087"),
        ("40", "35", "C0035"),
        ("80", "00", "B0000"),
        ("90", "00", "B1000"),
        ("C0", "01", "U0001"),
        ("24", "2F", "P242F"),
        ("24", "6c", "P246C"),
        ("00", "00", None),
        ("zz", "01", None),
        ("0A", "01", "P0A01"),
    ],
)
def test_decode_code(value, high, low, code):
    assert value(scan.decode_code(F.lit(high), F.lit(low))) == code


@pytest.mark.parametrize(
    "raw, lines",
    [
        ("43 01 03", ["430103"]),
        ("", []),
        ("\r\n>\r\n", []),
        ("ATE0\rOK\r43 01\r>", ["4301"]),
        ("43 0a\tff", ["430AFF"]),
    ],
)
def test_clean_lines(value, raw, lines):
    assert value(scan.clean_lines(F.lit(raw))) == lines


@pytest.mark.parametrize(
    "raw, mode, codes, error",
    [
        ("43 02 04 01 22 63 00 00", "03", ["P0401", "P2263"], None),
        ("43 03 00 87 01 91 C0 01", "03", ["P0087", "P0191", "U0001"], None),
        ("43 01 04 01\r43 01 04 01\r>", "03", ["P0401"], None),
        ("47 01 04 01", "07", ["P0401"], None),
        ("47 01 04 01", "03", [], None),
        ("43 01 04 01 22", "03", ["P0401"], None),
        ("NO DATA", "03", [], None),
        ("", "03", [], None),
        ("CAN ERROR", "03", [], "can_error"),
        ("BUS INIT: ERROR", "03", [], "can_error"),
        ("BUS BUSY", "03", [], "bus_busy"),
        ("UNABLE TO CONNECT", "03", [], "no_connection"),
        ("STOPPED", "03", [], "stopped"),
        ("NO DATA\rERROR", "03", [], None),
    ],
)
def test_parse_response(table, raw, mode, codes, error):
    row = parse_responses(table([(raw, mode)], "raw string, mode string")).first()
    assert (row["codes"], row["error"]) == (codes, error)


@pytest.mark.parametrize(
    "raw, expected",
    [("ELM327 v2.1", True), ("elm 327 v1.5", True), ("OBDII ready", True), ("43 01 04 01", False)],
)
def test_is_adapter(value, raw, expected):
    assert value(scan.is_adapter(F.lit(raw))) is expected


@pytest.mark.parametrize(
    "resolution, reason",
    [
        (None, "missing"),
        ("", "missing"),
        ("  \t\n ", "missing"),
        (" ﻿", "missing"),
        ("123456789", "too_short"),
        ("x" * 201, "too_long"),
        ("replaced aaaaaaa pump", "repeated_character"),
        ("replaced aaaaaa pump", None),
        ("replaced \U0001f600" + "\U0001f600" * 6 + " pump", "repeated_character"),
        ("replacedpump", "too_few_words"),
        ("ab cd ef gh ij", "too_few_words"),
        ("Pump pump PUMP", "too_few_words"),
        ("Motor opra", None),
        ("ab " * 66 + "pumpy hose"[:2], "too_few_words"),
        (("pump hose " * 20)[:200].strip() + "s", None),
        ("\t\nreplaced pump\n\t", None),
    ],
)
def test_resolution_reason(value, resolution, reason):
    assert value(quality.resolution_reason(F.lit(resolution).cast("string"))) == reason


def test_cheap_run_test_misses_no_repeated_character(spark):
    made = [f"{a}{c * n}{b}" for c in "a.\n\u2028\U0001f600" for n in (5, 6, 7, 9) for a in ("", "xy") for b in ("", "z\n")]
    texts = spark.createDataFrame([(t,) for t in made], "t string")
    found = texts.select(
        F.col("t").rlike(quality._REPEATED_ANY).alias("any"), F.col("t").rlike(fv.REPEATED_CHARACTER).alias("exact")
    ).collect()
    assert sum(r["exact"] for r in found) == 24 and all(r["any"] for r in found if r["exact"])
    assert any(r["any"] and not r["exact"] for r in found)


def test_long_words_are_parted_by_every_whitespace(value):
    text = F.lit("pump" + fv.WHITESPACE_CHARACTERS + "hose\u00a0\u00a0belt")
    assert value(quality.resolution_reason(text)) is None


CASE = "resolution string, symptoms array<string>, codes array<string>, text string, model string"


@pytest.mark.parametrize(
    "row, reason",
    [
        (("replaced pump", ["s"], ["P0401"], "", "M"), None),
        (("replaced pump", [], ["P0401"], None, "M"), None),
        (("replaced pump", ["s"], None, None, "M"), None),
        (("replaced pump", [], [], "x" * 20, "M"), None),
        (("replaced pump", [], [], "  " + "x" * 19 + "  ", "M"), "no_signal"),
        (("replaced pump", None, None, None, "M"), "no_signal"),
        (("replaced pump", [], ["P0401", "P04"], "", "M"), "bad_code"),
        (("replaced pump", [], ["X0401"], "", "M"), "bad_code"),
        (("replaced pump", [], ["B1234", "C12FF", "U0100"], "", "M"), None),
        (("replaced pump", ["s"], [], "", ""), "no_model"),
        (("replaced pump", ["s"], [], "", None), "no_model"),
        (("replaced pump", ["s"], [], "", " "), None),
        (("short", [], [], "", ""), "too_short"),
    ],
)
def test_case_reason(value, row, reason):
    columns = [F.col(c) for c in ("resolution", "symptoms", "codes", "text", "model")]
    assert value(quality.case_reason(*columns), CASE, row) == reason


def test_reason_text(value):
    assert value(quality.reason_text(F.lit("too_short"), F.lit(" abc "))).startswith(
        "Popis opravy je příliš krátký (3 "
    )
    assert value(quality.reason_text(F.lit("bad_code"), F.lit(""), F.lit("P04"))).endswith("P04")


LONG = "slovo " * 20


@pytest.mark.parametrize(
    "written, ok",
    [
        ("krátký text", True),
        (None, True),
        (LONG, False),
        (LONG + "P0401", True),
        (LONG + "p0401", True),
        (LONG + "XP0401", False),
        (LONG + "EGR ventil", True),
        (LONG + "egrx", False),
        (LONG + "čegr", True),  # word limits are ASCII
        (LONG + "185000 km", True),
        (LONG + "92°C", True),
        (LONG + "92 °C", False),
    ],
)
def test_topic(value, written, ok):
    assert value(quality.topic_ok(F.lit(written).cast("string"))) is ok


def test_extract_codes(value):
    row = ("p0401, P04;c12ff b0001\tx1", ["U0001", "P0401"])
    got = value(quality.extract_codes(F.col("t"), F.col("e")), "t string, e array<string>", row)
    assert got == ["U0001", "P0401", "C12FF", "B0001"]


def score(value, query, case):
    """Score of a case (model, power, codes, symptoms, text) for such a query."""
    schema = ", ".join(
        f"{side}_{name} {kind}"
        for side in "qc"
        for name, kind in [
            ("model", "string"),
            ("power", "string"),
            ("codes", "array<string>"),
            ("symptoms", "array<string>"),
            ("text", "string"),
        ]
    )
    tenths = sim.similarity_tenths(
        sim.lowered(F.col("q_codes")),
        sim.lowered(F.col("q_symptoms")),
        sim.query_words(F.col("q_text")),
        sim.case_text(F.col("c_symptoms"), F.col("c_codes"), F.col("c_text")),
        sim.attribute_tenths(*[F.col(c) for c in ("q_model", "c_model", "q_power", "c_power")]),
    )
    return value(tenths / 10, schema, (*query, *case))


QUERY = ("M1", None, ["P0401"], ["Ztráta výkonu", "Černý kouř"], "")
WORDS = " ".join(f"slovo{i}" for i in range(30))


@pytest.mark.parametrize(
    "query, case, expected",
    [
        (QUERY, ("M1", None, ["P0401"], ["Ztráta výkonu", "Černý kouř"], None), 10),
        (QUERY, ("", None, ["P0401"], [], None), 4),
        (QUERY, ("M1", None, [], [], None), 3),
        (QUERY, ("", None, None, ["ZTRÁTA VÝKONU"], None), 1.5),
        (QUERY, ("M2", None, ["P0087"], ["Přehřívání"], None), 0),
        (("", None, ["P0401", "P0403"], [], ""), (None, None, ["P0401", "P0403"], [], None), 8),
        (("M1", "96 kW", [], [], ""), ("M1", "96 kW", [], [], ""), 5),
        (("M1", "96 kW", [], [], ""), ("M1", "81 kW", [], [], ""), 3),
        (("", "", [], [], ""), ("", "", [], [], ""), 0),
        (("", None, [], [], WORDS), (None, None, [], [], WORDS), 2),
        (("", None, [], [], "slovo1 slovo1 slov"), (None, None, [], [], "xslovo12"), 0.6),
        (("", None, ["P0401", "P0401"], [], ""), (None, None, [], [], "code p0401x"), 8),
        (("", None, [""], [], ""), (None, None, [], [], None), 4),
        (("", None, [], ["b c"], ""), (None, None, ["c"], ["a", "b"], None), 1.5),
    ],
)
def test_similarity(value, query, case, expected):
    assert score(value, query, case) == expected


@pytest.mark.parametrize(
    "written, number",
    [("185000", 185000), ("abc", None), ("", None), (None, None), ("  12 km", 12), ("-5", -5),
     ("12.9", 12), ("99999999999", None)],
)
def test_leading_int(value, written, number):
    assert value(text.leading_int(F.lit(written).cast("string"))) == number


@pytest.mark.parametrize(
    "number, shown", [("185000", "185 000"), ("999", "999"), ("1234.5", "1 234,5"), ("abc", "NaN")]
)
def test_grouped_number(value, number, shown):
    assert value(text.grouped_number(F.lit(number))) == shown


def test_short_id(value):
    import re

    assert re.fullmatch("[0-9a-f]{8}", value(text.short_id()))


@pytest.mark.parametrize(
    "document, expected",
    [
        ('{"a":1}', True),
        ('{"a":1} tail', False),
        ('{"a":1}}', False),
        ('{"a":1}]', False),
        ('{"a":1},{"b":2}', False),
        ('{"a":1},"b":2', False),
        ('{"a":1}\n ', True),
        ("{'a':1}", False),
        ('{"a":1', False),
        ('{"a":"x\ny"}', False),
        ('{"a":1,"a":2}', True),
        ('{"a":{"b":1,"b":[1,2]},"a":2} x', False),
        ('{"a":[1,}', False),
        ('{"a":1],[2}', False),
    ],
)
def test_is_json(value, document, expected):
    assert value(answers.is_json(F.lit(document))) is expected


def plain_cut(document):
    """Plain restatement of the cut rule, character by character."""
    depth, quoted, escaped, last = 0, False, False, -1
    for i, char in enumerate(document):
        if escaped:
            escaped = False
        elif char == "\\" and quoted:
            escaped = True
        elif char == '"':
            quoted = not quoted
        elif not quoted and char in "{[":
            depth += 1
        elif not quoted and char in "}]":
            depth -= 1
            if depth == 2 and char == "}":
                last = i
    return last + 1


def test_complete_length_against_restatement(spark):
    import random

    picker = random.Random(5)
    pool = ['{', '}', '[', ']', '"', '\\', '\\"', 'a', 'ž ', '\n', '{"x":[', '{"n":"v"}', '"]}"']
    documents = ["".join(picker.choices(pool, k=picker.randint(0, 40))) for _ in range(3000)]
    rows = spark.createDataFrame([(d,) for d in documents], "d string").repartition(8)
    got = rows.select("d", answers.complete_length(F.col("d")).alias("n")).collect()
    wrong = [(r.d, r.n, plain_cut(r.d)) for r in got if r.n != plain_cut(r.d)]
    assert not wrong, wrong[:3]
