"""The keyed store against the merges on whole tables."""

import random

import pytest

from faultline.operators import merges
from faultline.sources.keyed_store import LOOSE, KeyedStore

SHAPE = "installation_id string, local_id string, n int, text string"


def batches():
    draw = random.Random(4)
    out = []
    for b in range(5):
        rows = [(f"i{draw.randrange(5)}", str(draw.randrange(40)), 100 * b + i, draw.choice(["x", None])) for i in range(60)]
        rows += [(None, "1", 100 * b + 90, "loose"), ("i1", None, 100 * b + 91, None), (None, "1", 100 * b + 90, "loose")]
        out.append(rows)
    return [*out, [], out[0]]


def store_at(spark, path, **options):
    schema = spark.createDataFrame([], SHAPE).schema
    return KeyedStore(spark, str(path), schema, merges.KEY, **options)


def bag(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize(("merge", "twin"), [("insert", merges.insert_if_absent), ("upsert", merges.upsert_last)])
def test_merges_equal_the_whole_table(spark, table, tmp_path, merge, twin):
    store, whole = store_at(spark, tmp_path, buckets=7, most_folders=2), table([], SHAPE)
    assert not store.read().count()
    for version, rows in enumerate(batches(), 1):
        frame = table(rows, SHAPE).repartition(3)
        getattr(store, merge)(frame, ["n"], version)
        whole = twin(whole, frame, ["n"])
        if version in (1, 5, 7):
            assert bag(store.read()) == bag(whole)
    assert max(len(f) for b, f in store.folders().items() if b != LOOSE) <= 3


@pytest.mark.parametrize("merge", ["insert", "upsert"])
def test_a_merge_that_runs_again_changes_nothing(spark, table, tmp_path, merge):
    store, frames = store_at(spark, tmp_path, buckets=4), [table(rows, SHAPE) for rows in batches()[:3]]
    for version, frame in enumerate(frames, 1):
        getattr(store, merge)(frame, ["n"], version)
    after = bag(store.read())
    getattr(store, merge)(frames[2], ["n"], 3)
    assert bag(store.read()) == after
    # a merge that failed before its manifest is not seen, and its rows are replaced
    table([("i0", "new", 1, "half")], SHAPE).selectExpr("*", "0 AS bucket").write.partitionBy("bucket").parquet(
        f"{store.path}/rows/version=4"
    )
    assert bag(store.read()) == after
    getattr(store, merge)(table([("i0", "late", 1, "whole")], SHAPE), ["n"], 4)
    assert bag(store.read()) == sorted([*after, ("i0", "late", 1, "whole")], key=repr)


@pytest.mark.parametrize("merge", ["insert", "upsert"])
def test_a_merge_reads_and_writes_its_buckets_only(spark, table, tmp_path, merge, monkeypatch):
    store, read = store_at(spark, tmp_path, buckets=16), []
    store.insert(table([(f"i{i}", str(i), i, "x") for i in range(400)], SHAPE), ["n"], 1)
    before = store.folders()
    assert len(before) == 16
    real = store._read
    monkeypatch.setattr(store, "_read", lambda paths: read.extend(paths) or real(paths))
    getattr(store, merge)(table([("i3", "3", -1, "again"), ("i3", "3", -2, "y"), (None, None, 0, "z")], SHAPE), ["n"], 2)
    assert len(read) == 1 and read[0].rsplit("=", 1)[0].endswith("version=1/bucket")
    touched = int(read[0].rsplit("=", 1)[1])
    changed = {b for b, f in store.folders().items() if f != before.get(b)}
    assert changed == ({LOOSE} if merge == "insert" else {touched, LOOSE})
    assert store.added(2).count() < 100


def test_vacuum_leaves_the_newest_state(spark, table, tmp_path):
    store = store_at(spark, tmp_path, buckets=4)
    for version, rows in enumerate(batches()[:4], 1):
        store.upsert(table(rows, SHAPE), ["n"], version)
    after, folders = bag(store.read()), len(list((tmp_path / "rows").glob("*/bucket=*")))
    store.vacuum(4)
    assert bag(store.read()) == after
    assert len(list((tmp_path / "rows").glob("*/bucket=*"))) < folders
    store.upsert(table([("i9", "9", 1, "x")], SHAPE), ["n"], 5)
    assert store.read().count() == len(after) + 1
