"""Running values, rolling counts and exact admission."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.operators import admission, gates, limits, recency, running, scanlog

DAY0 = datetime.datetime(2024, 1, 1)
LOG = "k string, ts timestamp_ntz, id bigint, ok boolean"


def log_rows(seed, n=600, keys=3, hours=120, step_minutes=30):
    """Events on a coarse grid, so equal times and exact edges occur."""
    pick = random.Random(seed)
    slots = hours * 60 // step_minutes
    return [
        (
            "hot" if i % 2 else f"k{pick.randrange(keys)}",
            DAY0 + datetime.timedelta(minutes=step_minutes * pick.randrange(slots)),
            i,
            pick.random() < 0.7,
        )
        for i in range(n)
    ]


@pytest.fixture
def cut(monkeypatch):
    """Every key of more than a few rows is cut into ranges of about that many."""

    def into(rows):
        monkeypatch.setattr(running, "MIN_HOT_ROWS", rows)
        monkeypatch.setattr(running, "PER_RANGE", 2)
        monkeypatch.setattr(running, "RUN", 3)

    return into


@pytest.mark.parametrize("ranges", [None, 4, 16])
def test_running_across_ranges(table, cut, ranges):
    if ranges:
        cut(ranges)
    rows = [("a" if i % 3 else "b", i, (i * 7) % 5) for i in range(200)]
    frame = table(rows, "k string, pos int, v int")
    got = running.running(
        frame, ["k"], ["pos"],
        sums={"total": F.col("v")}, maxes={"top": F.when(F.col("v") > 2, F.col("pos"))},
    )
    before = running.running(
        frame, ["k"], ["pos"], sums={"total": F.col("v")}, maxes={"top": F.col("v")}, before=True
    )
    seen = {r["pos"]: (r["total"], r["top"]) for r in got.collect()}
    seen_before = {r["pos"]: (r["total"], r["top"]) for r in before.collect()}
    total, top, largest = {}, {}, {}
    for k, pos, v in rows:
        assert seen_before[pos] == (total.get(k, 0), largest.get(k))
        total[k] = total.get(k, 0) + v
        largest[k] = max(v, largest.get(k, v))
        if v > 2:
            top[k] = pos
        assert seen[pos] == (total[k], top.get(k))
    assert len(seen) == len(seen_before) == 200


def test_running_keeps_every_row_of_a_long_key(table):
    frame = table([("a", i) for i in range(9000)], "k string, pos int")
    got = running.running(frame, ["k"], ["pos"], sums={"n": F.lit(1)})
    assert got.filter("n <> pos + 1").count() == 0 and got.count() == 9000


def test_a_second_of_one_key_is_cut(spark):
    """A million rows of one key, all of one time, spread over ranges near the size asked for."""
    frame = spark.range(1_000_000).selectExpr(
        "CAST(NULL AS STRING) AS k", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "id"
    )
    ranged = running.in_ranges(frame, ["k"], ["ts", "id"])
    sizes = [r["count"] for r in ranged.rows.groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2 * running.MIN_HOT_ROWS and sum(sizes) == 1_000_000
    got = ranged.add(sums={"n": F.lit(1)}).rows
    assert got.filter("n <> id + 1").count() == 0 and got.count() == 1_000_000


def test_totals_run_across_ranges_of_several_keys(table, cut):
    cut(3)
    rows = [(None if i % 2 else "a", i) for i in range(100)] + [("few", 1), ("few", 2)]
    got = running.running(
        table(rows, "k string, pos int"), ["k"], ["pos"],
        sums={"n": F.lit(1)}, maxes={"last": F.when(F.col("pos") < 30, F.col("pos"))}, before=True,
    ).collect()
    for r in got:
        earlier = [pos for k, pos in rows if k == r["k"] and pos < r["pos"]]
        assert (r["n"], r["last"]) == (len(earlier), max((p for p in earlier if p < 30), default=None))
    assert len(got) == 102


def test_places_without_a_time_come_first(table, cut):
    cut(4)
    rows = [("a", None if i % 3 == 0 else i, i) for i in range(60)]
    got = running.running(table(rows, "k string, t int, id int"), ["k"], ["t", "id"], sums={"n": F.lit(1)})
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert {r["id"]: r["n"] for r in got.collect()} == {row[2]: i + 1 for i, row in enumerate(ordered)}


def test_values_of_one_object_share_a_shuffle(table):
    ranged = running.in_ranges(table([("a", i) for i in range(9)], "k string, pos int"), ["k"], ["pos"])
    both = ranged.add(maxes={"last": F.col("pos")}, before=True).add(sums={"gaps": F.col("pos") - F.col("last")}).rows
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_an_empty_table_has_no_running_values(table):
    frame = table([], "k string, pos int")
    assert running.running(frame, ["k"], ["pos"], sums={"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("ranges", [None, 20])
def test_rolling_count(table, cut, inclusive, ranges):
    if ranges:
        cut(ranges)
    rows = log_rows(1)
    got = running.rolling_count(
        table(rows, LOG), "k", "ts", ["id"], "24 hours", "n", F.col("ok"), inclusive
    )
    day = datetime.timedelta(hours=24)
    for r in got.collect():
        edge = r["ts"] - day
        expected = sum(
            1
            for k, ts, i, ok in rows
            if k == r["k"] and ok and (ts, i) < (r["ts"], r["id"]) and (ts > edge or inclusive and ts == edge)
        )
        assert r["n"] == expected


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_micros(table, kind):
    times = [DAY0, datetime.datetime(2024, 5, 6, 23, 59, 59, 999_999), datetime.datetime(1969, 12, 31, 1, 2, 3, 4), None]
    rows = table([(t,) for t in times], f"ts {kind}")
    epoch, one = datetime.datetime(1970, 1, 1), datetime.timedelta(microseconds=1)
    expected = [None if t is None else (t - epoch) // one for t in times]
    assert [r[0] for r in rows.select(recency.micros(rows, "ts")).collect()] == expected
    keys = [r[0] for r in rows.select(recency.recency_key(rows, "ts")).collect()]
    assert keys == [-(1 << 63) if e is None else -e for e in expected]


def plain_admission(rows, limit, inclusive):
    day, held, verdicts = datetime.timedelta(hours=24), {}, {}
    for k, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        times = held.setdefault(k, [])
        live = [t for t in times if t > ts - day or inclusive and t == ts - day]
        verdicts[i] = len(live) < limit
        held[k] = live + [ts] if verdicts[i] else live
    return verdicts


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("hours", [120, 3000])
def test_admission_is_exact_in_any_time_zone(table, inclusive, hours, zone, monkeypatch):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        rows = log_rows(2, n=500, hours=hours)
        rows += [(None, ts, i + 1000, ok) for k, ts, i, ok in rows if k == "hot"]
        got = admission.admit(table(rows, LOG), "k", "ts", ["id"], 3, "24 hours", inclusive)
        verdicts = {r["id"]: r["admitted"] for r in got.collect()}
    finally:
        monkeypatch.undo()
        time.tzset()
    assert verdicts == plain_admission(rows, 3, inclusive)


def test_rows_without_time_are_denied_and_count_for_nothing(table):
    rows = [("a", None, i, True) for i in range(4)] + [("a", DAY0, 9, True), (None, None, 10, True)]
    got = admission.admit(table(rows, LOG), "k", "ts", ["id"], 1, "24 hours").collect()
    assert {r["id"] for r in got if r["admitted"]} == {9}
    assert len(got) == 6


def test_hot_key_in_one_pass(table):
    rows = [("hot", DAY0 + datetime.timedelta(seconds=7 * i), i, True) for i in range(20_000)]
    got = admission.admit(table(rows, LOG), "k", "ts", ["id"], 3, "24 hours")
    verdicts = {r["id"]: r["admitted"] for r in got.collect()}
    assert verdicts == plain_admission(rows, 3, False)


def test_fold_state_stays_within_limit():
    held = []
    hour = admission.length_micros("1 hour")
    for minute in range(500):
        admission.judge(held, minute * 60_000_000, 4, hour, False)
        assert len(held) <= 4


def test_late_row_takes_its_place():
    held, hour = [], 3_600_000_000
    verdicts = [admission.judge(held, h * hour, 2, 24 * hour, False) for h in (100, 90, 115)]
    assert verdicts == [True, True, True]
    assert held == [100 * hour, 115 * hour]


def test_rows_without_key_run_together(table):
    rows = [(None, DAY0 + datetime.timedelta(hours=h), h, True) for h in range(6)]
    got = running.rolling_count(table(rows, LOG), "k", "ts", ["id"], "24 hours", "n")
    assert {r["id"]: r["n"] for r in got.collect()} == {h: h for h in range(6)}


def test_answers_are_heard_as_long_as_their_command_allows(table):
    rows = [
        (f"p{mode}", DAY0 + datetime.timedelta(milliseconds=100 * i), i, f"{i},", mode)
        for mode in ("03", "07", "01")
        for i in range(71)
    ]
    chunks = table(rows, "port string, ts timestamp_ntz, seq int, chunk string, mode string")
    got = scanlog.assemble_chunks(
        chunks, "port", "ts", ["seq"], "chunk", cap=scanlog.command_cap(F.col("mode"))
    )
    assert {r["port"]: (r["n_chunks"], r["n_late"]) for r in got.collect()} == {
        "p03": (71, 0),
        "p07": (60, 11),
        "p01": (50, 21),
    }


MESSAGES = "c string, pos int, type string, text string, symptoms array<string>, obdCodes array<string>, tokens bigint"


def test_budget_gate_comes_before_topic(table):
    off = "slovo " * 20
    rows = table(
        [
            ("c", 0, "input", off, [], [], None),
            ("c", 1, "input", off, ["s"], None, None),
            ("c", 2, "input", "  ", None, None, None),
            ("c", 3, "diagnosis", None, None, None, 40_000),
            ("c", 4, "input", off, None, None, None),
        ],
        MESSAGES,
    )
    got = {r["pos"]: r["reason"] for r in gates.admit_inputs(rows, "c", "pos", F.col("tokens")).collect()}
    assert got == {0: "off_topic", 1: None, 2: None, 4: "token_budget"}


def test_token_budget_bands(table):
    rows = table([("c", i, t) for i, t in enumerate([1_000, 26_800, 100, 8_000, 99_000])], "c string, pos int, t bigint")
    used = limits.token_budget(rows, "c", "pos", F.col("t"))
    got = [(r["percent"], r["band"], r["label"]) for r in used.orderBy("pos").collect()]
    assert got == [
        (3, "normal", "<1%"), (70, "warning", "70%"), (70, "warning", "70%"),
        (90, "critical", "90%"), (100, "critical", "100%"),
    ]


def test_first_diagnosis(table):
    rows = table([("a", 0, "input"), ("a", 1, "diagnosis"), ("a", 2, "diagnosis"), ("b", 0, "input")], "c string, pos int, type string")
    flagged = limits.flag_first_diagnosis(rows, "c", "pos", F.col("type")).filter("is_first").collect()
    assert [(r["c"], r["pos"]) for r in flagged] == [("a", 1)]


def test_alerts_and_blocking(table):
    rows = table([("i", DAY0 + datetime.timedelta(hours=h), h, "spam") for h in range(4)],
                 "installation_id string, created_at timestamp_ntz, event_id int, reason string")
    numbered = limits.running_violations(rows, "installation_id", "created_at", ["event_id"])
    got = limits.alerts(numbered, "corpus").orderBy("violation_count").collect()
    assert [r["blocked"] for r in got] == [False, False, True, True]
    assert got[0]["subject"] == "[corpus] ⚠ Porušení pravidel č. 1"
    assert got[2]["subject"] == "[corpus] ⛔ Instalace ZABLOKOVÁNA — 3. porušení"
    assert "<td>spam</td>" in got[0]["body"] and got[0]["body"].endswith("</table>")


def test_request_gate(table):
    rows = table(
        [(None, "m", ["x"], 1), ("", "m", ["x"], 1), ("i", "other", ["x"], 1), ("i", None, ["x"], 1),
         ("i", "m", [], 1), ("i", "m", None, 1), ("i", "m", ["x"], None), ("i", "m", ["x"], 9999)],
        "i string, model string, messages array<string>, max int",
    )
    got = limits.admit_requests(rows, ["m"], *[F.col(c) for c in ("i", "model", "messages", "max")]).collect()
    assert [r["reason"] for r in got] == [
        "no_installation", "no_installation", "model_not_allowed", "model_not_allowed", "no_messages",
        "no_messages", None, None,
    ]
    assert [r["granted_tokens"] for r in got[-2:]] == [4000, fv.MAX_TOKENS_CAP]


def test_call_limit_passes_when_the_count_failed(table):
    rows = table([("k", DAY0, i, True) for i in range(4)], LOG)
    limited = limits.rolling_call_limit(
        rows, "k", "ts", ["id"], F.col("ok"), limit=2, count_failed=F.col("id") == 3
    )
    assert {r["id"]: r["admitted"] for r in limited.collect()} == {0: True, 1: True, 2: False, 3: True}


def test_daily_count_edges(spark, table):
    rows = table(
        [("a", DAY0), ("a", DAY0 + datetime.timedelta(seconds=1)), ("a", DAY0 + datetime.timedelta(days=1)),
         ("a", DAY0 + datetime.timedelta(days=2)), ("b", DAY0)],
        "installation_id string, created_at timestamp_ntz",
    )
    as_of = F.lit(DAY0 + datetime.timedelta(days=1)).cast("timestamp_ntz")
    got = limits.daily_count(rows, "installation_id", "created_at", as_of).collect()
    assert [tuple(r) for r in got] == [("a", 2)]
    rows.createOrReplaceTempView("writes")
    limits.publish_daily_count(spark, "writes", "installation_id", "created_at", "TIMESTAMP_NTZ '2024-01-02'")
    assert spark.sql("SELECT daily_count('a') AS a, daily_count('b') AS b").first() == (2, 0)


CHUNKS = "port string, ts timestamp_ntz, seq int, chunk string"


def test_chunks_end_with_silence_or_cap(table):
    def at(ms):
        return DAY0.replace(hour=0, minute=59, second=59) + datetime.timedelta(milliseconds=ms)

    rows = [("p", at(0), 0, "43 "), ("p", at(150), 1, "01 "), ("p", at(301), 2, "47 "), ("q", at(10), 3, "x")]
    stream = [("r", at(100 * i), 10 + i, str(i % 10)) for i in range(60)]
    got = scanlog.assemble_chunks(table(rows + stream, CHUNKS), "port", "ts", ["seq"], "chunk")
    found = {(r["port"], r["response_start"]): (r["raw"], r["n_chunks"], r["n_late"]) for r in got.collect()}
    assert found == {
        ("p", at(0)): ("43 01 ", 2, 0),
        ("p", at(301)): ("47 ", 1, 0),
        ("q", at(10)): ("x", 1, 0),
        ("r", at(0)): ("0123456789" * 5, 50, 10),
    }


def test_read_codes_errors(table):
    rows = table(
        [
            (1, "03", "43 01 04 01"), (1, "07", "47 02 04 01 22 63"),
            (2, "03", "CAN ERROR"), (2, "07", "47 01 04 01"),
            (3, "03", "43 01 04 01"), (3, "07", "BUS BUSY"),
            (4, "03", "NO DATA"),
        ],
        "scan_id bigint, mode string, raw string",
    )
    got = {r["scan_id"]: (r["stored"], r["pending"], r["error"]) for r in scanlog.read_codes(rows).collect()}
    assert got == {
        1: (["P0401"], ["P2263"], None), 2: ([], [], "can_error"), 3: (["P0401"], [], None), 4: ([], [], None),
    }
