"""The stored posting index against lists built from the whole corpus."""

import random

from pyspark.sql import functions as F

from faultline.operators import search
from faultline.operators.postings import PostingIndex
from faultline.plans import views
from faultline.streaming import jobs
from faultline.streaming.sinks import run_available

SMALL = "/root/testdata/sf0.001"


def list_bag(lists):
    shown = lists.select(*search.POSTING_KEY, F.to_json("posting").alias("posting"))
    return sorted(map(tuple, shown.collect()))


def test_lists_of_parts_equal_a_rebuild(spark, tmp_path):
    rows = views.closed(views.case_rows(spark, SMALL)).cache()
    keys = search.query_keys(views.as_queries(views.case_rows(spark, SMALL)))
    index = PostingIndex(spark, str(tmp_path / "index"), limit=7, buckets=5, most_runs=2)
    parts = [rows.filter(F.pmod(F.xxhash64("id"), F.lit(5)) == i) for i in range(5)]
    assert not index.lists(keys).count()
    for version, part in enumerate(parts, 1):
        index.add(part, version)
    # cases that are added again count once; a run that is replayed replaces itself
    index.add(parts[0], 6)
    index.add(parts[0], 6)
    whole = search.merge_lists(search.posting_lists(rows, keys, 7), 7)
    assert list_bag(index.lists(keys)) == list_bag(whole)
    assert max(len(f) for f in index.store.folders().values()) <= 3
    rows.unpersist()


def test_a_lookup_reads_the_buckets_of_its_keys(spark, tmp_path, monkeypatch):
    rows = views.closed(views.case_rows(spark, SMALL))
    index = PostingIndex(spark, str(tmp_path / "index"), buckets=32)
    index.add(rows, 1)
    read, real = [], index.store._read
    monkeypatch.setattr(index.store, "_read", lambda paths: read.extend(paths) or real(paths))
    one = search.corpus_keys(rows).filter("shape = 'brand+code'").orderBy("brand", "term").limit(1)
    assert index.lists(one).count() == 1 and len(read) == 1


def test_stream_finds_what_arrived_before(spark, tmp_path):
    draw = random.Random(5)
    rows = views.case_rows(spark, SMALL).collect()
    schema = views.case_rows(spark, SMALL).schema
    draw.shuffle(rows)
    path, third = str(tmp_path / "in"), len(rows) // 3 + 1
    parts = [rows[i : i + third] for i in range(0, len(rows), third)]
    for part in [*parts, parts[0]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = {name: str(tmp_path / name) for name in ("corpus", "index", "hits")}
    writer = jobs.indexed_search_writer(stream, views.as_queries, views.closed, *out.values())
    run_available(writer, str(tmp_path / "checkpoint"))
    found = spark.read.parquet(out["hits"])
    assert jobs.corpus_store(spark, out["corpus"], schema, ["id"]).read().count() == sum(r["status"] == "F" for r in rows)
    for batch, seen in ((1, rows[: 2 * third]), (3, rows)):
        asked = views.as_queries(spark.createDataFrame([*parts, parts[0]][batch], schema))
        twin = search.search(asked, views.closed(spark.createDataFrame(seen, schema)))
        got = found.filter(F.col("batch_id") == batch).select(twin.columns)
        assert got.count() == twin.count() > 0 and got.exceptAll(twin).count() == 0
