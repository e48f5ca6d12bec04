"""Streams over several micro-batches against their batch twins."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline import schemas
from faultline.operators import admission, limits, merges, scanlog, search
from faultline.plans import views
from faultline.sources.keyed_store import KeyedStore
from faultline.streaming import jobs
from faultline.streaming.sinks import read_before, run_available, write_batch

SMALL = "/root/testdata/sf0.001"
DAY0 = datetime.datetime(2024, 1, 1)


@pytest.fixture
def in_files(spark, tmp_path):
    """Write rows as time-ordered files and return them as a one-file-per-batch stream."""

    def build(frame, order, parts=4):
        path = str(tmp_path / "input")
        rows = frame.orderBy(order).collect()
        size = -(-len(rows) // parts)
        for i in range(parts):
            part = spark.createDataFrame(rows[i * size : (i + 1) * size], frame.schema)
            part.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return build


def appended(spark, rows, tmp_path):
    path = str(tmp_path / "output")
    run_available(rows.writeStream.format("parquet").option("path", path), str(tmp_path / "checkpoint"))
    return spark.read.schema(rows.schema).parquet(path)


def instants(frame):
    return frame.withColumn("ts", F.col("ts").cast("timestamp"))


def test_rate_limit_equals_batch(spark, in_files, tmp_path):
    log = instants(views.usage_log(spark, SMALL))
    stream = in_files(log, "ts")
    judged = appended(spark, jobs.rate_limit(stream, "installation_id", "ts", ["event_id"], 5), tmp_path)
    twin = admission.admit(log, "installation_id", "ts", ["event_id"], 5, limits.DAY)
    assert judged.count() == log.count()
    assert judged.exceptAll(twin).count() == 0 and judged.filter("NOT admitted").count() > 0


def test_rate_limit_judges_rows_behind_the_watermark(spark, table, in_files, tmp_path):
    hour = datetime.timedelta(hours=1)
    rows = [(i, f"k{i % 3}", DAY0 + i * hour) for i in range(200)]
    # arrive in the last of four files: far behind, just behind, within the window, without a time
    rows += [(200 + i, key, at) for i, (key, at) in enumerate([
        ("k0", DAY0), ("new", DAY0 + hour), ("k1", DAY0 + 124 * hour), ("new", DAY0 + 140 * hour), ("k2", None), (None, DAY0),
    ])]
    attempts = table([(*r, r[0]) for r in rows], "event_id long, installation_id string, ts timestamp, n long")
    stream = in_files(attempts, "n")
    judged = appended(spark, jobs.rate_limit(stream, "installation_id", "ts", ["event_id"], 3), tmp_path).collect()
    assert sorted(r["event_id"] for r in judged) == list(range(206))
    verdict = {r["event_id"]: r["admitted"] for r in judged}
    assert [verdict[i] for i in range(200, 206)] == [False, False, False, True, False, False]
    twin = admission.admit(attempts.filter("event_id < 200"), "installation_id", "ts", ["event_id"], 3, limits.DAY)
    assert {r["event_id"]: r["admitted"] for r in twin.collect()} == {i: verdict[i] for i in range(200)}


def test_chunks_equal_batch_once_closed(spark, in_files, tmp_path):
    chunks = instants(views.chunks(spark, SMALL))
    stream = in_files(chunks, "ts")
    got = appended(
        spark, jobs.assemble_chunks(stream, "port", "ts", ["seq"], "chunk", "10 minutes"), tmp_path
    )
    twin = scanlog.assemble_chunks(chunks, "port", "ts", ["seq"], "chunk", "10 minutes", "365 days")
    columns = ["port", "response_start", "raw", "n_chunks"]
    extra = twin.select(columns).exceptAll(got.select(columns))
    assert got.select(columns).exceptAll(twin.select(columns)).count() == 0
    assert extra.count() <= 3


def test_last_edit_of_a_burst(spark, table, in_files, tmp_path):
    def at(ms):
        return DAY0 + datetime.timedelta(milliseconds=ms)

    edits = table(
        [("a", at(0), "1"), ("a", at(300), "2"), ("a", at(700), "3"), ("a", at(1300), "4"), ("b", at(100), "x"),
         ("zz", at(600_000), "end")],
        "id string, ts timestamp, data string",
    )
    got = appended(spark, jobs.debounced_last_write(in_files(edits, "ts", 2), "id", "ts", "data"), tmp_path)
    assert sorted((r["id"], r["data"], r["n_edits"]) for r in got.collect()) == [("a", "3", 3), ("a", "4", 1), ("b", "x", 1)]


KEYED = "installation_id string, local_id string, n int, ts timestamp"


def test_ingest_is_idempotent_across_batches(spark, table, in_files, tmp_path):
    rows = [("i", str(i % 7), i, DAY0 + datetime.timedelta(minutes=i)) for i in range(40)]
    rows += [("i", None, 100 + i, DAY0 + datetime.timedelta(minutes=i)) for i in range(3)]
    stream = in_files(table(rows, KEYED), "n")
    path = str(tmp_path / "corpus")
    run_available(jobs.ingest_writer(stream, path, ["n"]), str(tmp_path / "checkpoint"))
    held = jobs.corpus_store(spark, path, stream.schema).read()
    assert sorted(r["n"] for r in held.collect()) == [0, 1, 2, 3, 4, 5, 6, 100, 101, 102]


def test_repeats_close_together_are_dropped(spark, table, in_files, tmp_path):
    rows = [("i", str(i % 3), i, DAY0 + datetime.timedelta(minutes=i)) for i in range(12)]
    rows += [(None, "1", 50, DAY0), (None, "1", 51, DAY0)]
    stream = in_files(table(rows, KEYED), "n")
    got = appended(spark, jobs.without_recent_repeats(stream, "ts"), tmp_path).collect()
    assert sorted(r["n"] for r in got) == [0, 1, 2, 50, 51]


def test_a_replayed_batch_replaces_its_own_output(spark, table, tmp_path):
    path = str(tmp_path / "sink")
    frame = table([("a", 1)], "k string, v int")
    assert read_before(spark, path, frame.schema, 0).count() == 0
    write_batch(frame, path, 0)
    write_batch(table([("b", 2)], "k string, v int"), path, 1)
    write_batch(table([("b", 3)], "k string, v int"), path, 1)
    assert [tuple(r) for r in read_before(spark, path, frame.schema, 1).collect()] == [("a", 1)]
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_violation_numbers_continue_across_batches(spark, in_files, tmp_path):
    log = views.violation_log(spark, SMALL)
    path = str(tmp_path / "violations")
    writer = jobs.violations_writer(in_files(log, "created_at"), path, path + "-totals", "corpus")
    run_available(writer, str(tmp_path / "checkpoint"))
    columns = ["event_id", "violation_count", "blocked", "subject"]
    twin = limits.alerts(
        limits.running_violations(log, "installation_id", "created_at", ["event_id"]), "corpus"
    )
    got = spark.read.parquet(path).select(columns)
    assert got.count() == log.count()
    assert got.exceptAll(twin.select(columns)).count() == 0


def test_search_per_batch_equals_one_search(spark, tmp_path):
    rows = views.case_rows(spark, SMALL)
    path = str(tmp_path / "cases")
    rows.repartition(3).write.parquet(path)
    stored = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    writer = jobs.search_writer(
        views.as_queries(stream), lambda s: views.closed(s.read.parquet(path)), str(tmp_path / "hits")
    )
    run_available(writer, str(tmp_path / "checkpoint"))
    twin = search.search(views.as_queries(stored), views.closed(stored))
    got = spark.read.parquet(str(tmp_path / "hits")).drop("batch_id")
    assert got.count() == twin.count() and got.exceptAll(twin.select(got.columns)).count() == 0


def test_quality_gate_across_batches(spark, table, tmp_path):
    def document(id, model="M", resolution="replaced pump", owner="i", closed="2024-01-01"):
        message = (None, "input", ["s"], ["P0401"], "t", None, None, None, None)
        return (id, "n", "x", None, closed, ("B", model, "1", None), [message], resolution, 0, owner)

    path = str(tmp_path / "documents")
    batches = [
        [document("1"), document("2", resolution="short"), document("3", model=" ")],
        [document("1", resolution="another pump text"), document("4"), document("4"), document("3", model=" ")],
        [document("5", closed="soon"), document("4", resolution="a late repeat of it")],
    ]
    for batch in batches:
        table(batch, schemas.CASE_DOCUMENT).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schemas.CASE_DOCUMENT).option("maxFilesPerTrigger", 1).parquet(path)
    out = [str(tmp_path / name) for name in ("accepted", "rejected", "queued")]
    run_available(jobs.quality_gate_writer(stream, *out), str(tmp_path / "checkpoint"))
    keys = StructType.fromDDL("installation_id string, local_id string, closed_at timestamp")
    accepted = jobs.corpus_store(spark, out[0], keys).read()
    assert sorted(r["local_id"] for r in accepted.collect()) == ["1", "4"]
    assert accepted.select(*merges.KEY).distinct().count() == 2 and not accepted.filter("closed_at IS NULL").count()
    assert [tuple(r)[:2] for r in spark.read.parquet(out[1]).collect()] == [("2", "too_short")]
    entry = StructType.fromDDL("id string, data string, error string")
    queued = {r["id"]: r for r in jobs.corpus_store(spark, out[2], entry, ["id"]).read().collect()}
    assert {i: r["error"] for i, r in queued.items()} == {"3": "constraint", "5": "closed_at"}
    assert json.loads(queued["3"]["data"])["resolution"] == "replaced pump"


def test_totals_written_follow_the_batch(spark, table, tmp_path):
    """Twenty batches of one installation each, of thirty known ones, the missing one among them."""
    schema, path = "event_id long, installation_id string, reason string, created_at timestamp", str(tmp_path / "in")
    owners = [None if i == 7 else f"i{i}" for i in range(30)]
    logs = [[(i, owner, "r", DAY0) for i, owner in enumerate(owners)]]
    logs += [[(100 * b + j, owners[b % 9], "r", DAY0 + datetime.timedelta(hours=b)) for j in range(3)] for b in range(1, 20)]
    for rows in logs:
        table(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, totals = str(tmp_path / "numbered"), str(tmp_path / "totals")
    run_available(jobs.violations_writer(stream, out, totals, "corpus"), str(tmp_path / "checkpoint"))
    named = StructType().add("name", "string").add("added", "long")
    store = KeyedStore(spark, totals, named, ["name"])
    assert [store.added(v).count() for v in (1, 2, 10, 20)] == [30, 1, 1, 1]
    whole = table([row for rows in logs for row in rows], schema)
    twin = limits.running_violations(whole, "installation_id", "created_at", ["event_id"]).select("event_id", "violation_count")
    got = spark.read.parquet(out).select("event_id", "violation_count")
    assert got.count() == twin.count() == 30 + 19 * 3 and got.exceptAll(twin).count() == 0
