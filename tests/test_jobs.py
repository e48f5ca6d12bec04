"""End-to-end jobs, sources, and every registered query against its SQL."""

import json
import os
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from faultline import schemas
from faultline.operators.scanlog import parse_responses
from faultline.plans import jobs, registry, views
from faultline.session import scratch_path, shared_dir, stage
from faultline.sources import readers, writers

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from compare import compare, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name, entry.oracle_sql()[name]).startswith("same")


def test_entry_has_rows(spark):
    result = entry.entry(spark)
    assert result.columns == ["query_id", "hit_rank", "case_id", "score", "is_own"]
    assert not result.isEmpty()


def test_diagnose_job(spark):
    documents = views.case_documents(spark, SMALL)
    done = jobs.diagnose(
        documents.filter(F.col("status") != "uzavřený"),
        views.case_corpus(spark, SMALL),
        views.catalog_items(spark, SMALL),
    )
    rows = done.collect()
    assert len(rows) == documents.filter(F.col("status") != "uzavřený").count()
    assert all(r["system_prompt"] and r["user_prompt"] for r in rows)


def test_close_job_splits_every_case(spark):
    documents = views.case_documents(spark, SMALL).filter(F.col("status") == "uzavřený")
    empty = spark.createDataFrame([], "installation_id string, local_id string")
    fresh, quarantine = jobs.close_cases(documents, empty, F.lit("2002-01-01").cast("timestamp"))
    assert fresh.count() + quarantine.count() == documents.count()
    again, _ = jobs.close_cases(documents, fresh, F.lit("2002-01-01").cast("timestamp"))
    assert again.count() == 0


def test_decode_job(spark, table):
    rows = [("p", f"2024-01-01 00:00:0{i}", i, c) for i, c in enumerate(["43 01 ", "04 01"])]
    chunks = table(rows, "port string, ts string, seq int, chunk string").withColumn(
        "ts", F.to_timestamp("ts") - F.expr("INTERVAL 950 milliseconds") * F.col("seq")
    )
    got = jobs.decode_scans(
        chunks, lambda r: r.select(F.col("port").alias("scan_id"), F.lit("03").alias("mode"), "raw")
    )
    assert [tuple(r) for r in got.collect()] == [("p", ["P0401"], [], None)]
    assert "codes" in parse_responses(table([("03", "NO DATA")], "mode string, raw string")).columns


def test_corpus_round_trip_and_pruning(spark, tmp_path):
    corpus = views.case_corpus(spark, SMALL).select(
        "id", "installation_id", "vehicle_brand", "vehicle_model", F.col("closed_at").cast("timestamp").alias("closed_at")
    )
    path = str(tmp_path / "corpus")
    writers.write_corpus(corpus, path)
    back = readers.read_corpus(spark, path)
    assert back.count() == corpus.count()
    one = back.filter("vehicle_brand = 'MACHINERY'")
    assert one.count() == corpus.filter("vehicle_brand = 'MACHINERY'").count()
    assert "PartitionFilters: [isnotnull(vehicle_brand" in one._jdf.queryExecution().toString()


def test_snapshots_and_archives(spark, table, tmp_path):
    path = writers.write_snapshot(table([("a",)], "k string"), str(tmp_path / "state"), 1)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):
        writers.write_snapshot(table([("b",)], "k string"), str(tmp_path / "state"), 1)
    archive = tmp_path / "cases.json"
    archive.write_text(json.dumps([{"id": "a", "messages": [{"type": "input"}]}, {"id": "b"}], indent=1))
    cases = readers.read_case_archive(spark, str(archive))
    assert cases.count() == 2 and cases.select("messages.type").first()[0] == ["input"]


def test_sessions_newest_first(spark, table):
    rows = table(
        [("1", "u", '{"id":"a"}', "open", "2024-01-01"), ("2", "u", '{"id":"b"}', "closed", "2024-01-02"), ("3", "u", "broken", "open", "2023-01-01")],
        "id string, user_id string, data string, status string, created_at string",
    ).withColumn("created_at", F.to_timestamp("created_at"))
    got = [(r["id"], r["_rowId"], r["_status"]) for r in readers.read_cases(rows, schemas.CASE_DOCUMENT).collect()]
    assert got == [("b", "2", "closed"), ("a", "1", "open"), (None, "3", "open")]


def test_scratch_follows_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == configured and scratch_path(spark, "x").startswith(configured)
    assert configured in stage(spark.range(3), "numbers").inputFiles()[0]


def test_diagnoses_are_recorded_or_cost_their_input(spark):
    rounds = stage(views.open_rounds(spark, SMALL), "rounds")
    recorded = jobs.record_diagnoses(rounds, views.round_answers(rounds).limit(0))
    assert recorded.drop("error").exceptAll(rounds).isEmpty()
    answers = views.round_answers(rounds).withColumn("input_tokens", F.lit(None).cast("bigint"))
    done = jobs.record_diagnoses(rounds, answers).filter("error IS NULL").select("id", "messages")
    tokens = {r["messages"][-1]["tokensUsed"] for r in done.collect() if r["messages"][-1]["type"] == "diagnosis"}
    assert tokens == {0, 5}


def test_queue_shrinks_to_the_cases_that_may_still_succeed(spark):
    message = (None, "input", ["s"], ["P0401"], "t", None, None, None, None)

    def case(id, resolution="replaced the pump", model="M", owner="i", closed="2024-01-01"):
        return (id, "n", "x", None, closed, ("B", model, "1", None), [message], resolution, 0, owner)

    documents = spark.createDataFrame(
        [case("1"), case("2"), case("3"), case("4", "short"), case("5", model=" "), case("6", closed="soon"),
         case("7", owner=None), case("8", owner=None)],
        schemas.CASE_DOCUMENT,
    )
    corpus = spark.createDataFrame(
        [("i", "1", None), ("i", "0", "2024-01-01 23:00:00"), ("i", "9", "2023-12-01 00:00:00")],
        "installation_id string, local_id string, created_at string",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = F.lit("2024-01-02").cast("timestamp")
    rows, fates, queue = jobs.close_flow(documents, corpus, at, at, limit=2)
    assert {(r["id"], r["fate"], r["reason"]) for r in fates.collect()} == {
        ("1", "duplicate", None), ("2", "inserted", None), ("3", "queued", "rate_limit"),
        ("4", "rejected", "too_short"), ("5", "queued", "constraint"),
        ("6", "queued", "closed_at"), ("7", "inserted", None), ("8", "inserted", None),
    }
    assert sorted(r["local_id"] for r in rows.collect()) == ["2", "7", "8"]
    assert sorted((r["id"], r["error"]) for r in queue.collect()) == [
        ("3", "rate_limit"), ("5", "constraint"), ("6", "closed_at")
    ]
    broken = queue.unionByName(spark.createDataFrame([("x", "{", "e")], queue.schema))
    later = F.lit("2024-01-03").cast("timestamp")
    rows, tried, left = jobs.retry_queue(stage(broken, "queue"), corpus, now=later, as_of=later, limit=2)
    assert [r["local_id"] for r in rows.collect()] == ["3"]
    assert {(r["id"], r["disposition"]) for r in tried.collect()} == {
        ("3", "sent"), ("5", "remaining"), ("6", "remaining"), ("x", "dropped")
    }
    assert sorted(r["id"] for r in left.collect()) == ["5", "6"]


def test_quality_gate_stream_builds_its_documents_once(spark, monkeypatch):
    class Replayed(Exception):
        pass

    def replayed(_, slices, __):
        raise Replayed([file for rows in slices for file in rows.inputFiles()])

    monkeypatch.setattr(registry, "replayed", replayed)
    with pytest.raises(Replayed) as stopped:
        registry.t6_stream_quality_gate(spark, "/root/testdata/sf0.001")
    files = stopped.value.args[0]
    assert files and not any("lineitem" in file for file in files)


def test_a_slice_is_replayed_in_no_fewer_files_than_cores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "SLICE_FILES", 2)
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: str(tmp_path / name))
    cores = spark.sparkContext.defaultParallelism
    slices = [spark.range(100).filter(f"id % 2 = {i}") for i in range(2)]
    stream = registry.replayed(spark, slices, "numbers")
    assert cores > 2 and len(list((tmp_path / "numbers").glob("part-*"))) == 2 * cores
    sizes = []
    writer = stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count()))
    registry.run_available(writer, str(tmp_path / "checkpoint"))
    assert sizes == [50, 50]
