"""A keyed table in files whose merges read and write only the buckets of their keys.

Rows lie in ``rows/version=V/bucket=B`` by a hash of their key.  ``manifest/version=V`` names the
folders that make up every bucket, one small row a bucket.  A merge reads the newest
manifest below its own version, meets only the buckets that its incoming keys fall into, and writes its
rows, then its manifest: until that is there, readers see the state before.  So a merge that
runs again with its version, as a replayed micro-batch does, starts from the same state
and replaces what it left.

An insert adds a folder to a bucket; a bucket of ``most_folders`` is written anew as one. An upsert writes
touched buckets anew.  Files are sorted by key and carry Bloom filters of the keys, which
Spark uses for lookups by key.  Rows without a complete key are never duplicates; they
lie in a bucket of their own that no merge reads.

The number of buckets is fixed when a table is made: one bucket of one version is written by one
task, so choose it as the expected size of the table over a few hundred megabytes.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from faultline.operators.merges import KEY, one_per_key
from faultline.session import Scope, remove, shuffles_dropped

MANIFEST = "bucket int, folders array<bigint>"
#: The bucket of rows without a key, and the parts it is written in.
LOOSE = -1
LOOSE_PARTS = 64


class KeyedStore:
    def __init__(self, spark, path, schema, keys=KEY, buckets=64, most_folders=16):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets, self.most_folders = list(keys), buckets, most_folders

    def _bucket(self):
        has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        hashed = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        return F.when(has_key, hashed).otherwise(F.lit(LOOSE))

    def _bucketed(self, rows):
        shaped = [F.col(f.name).cast(f.dataType) for f in self.schema.fields]
        return rows.select(*shaped).withColumn("bucket", self._bucket())

    def folders(self, before=None):
        """{bucket: versions of its folders} of the newest manifest, or of the newest below a version."""
        stored = StructType.fromDDL(MANIFEST).add("version", "long")
        try:
            manifests = self.spark.read.schema(stored).parquet(f"{self.path}/manifest")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            manifests = manifests.filter(F.col("version") < before)
        newest = manifests.agg(F.max("version")).first()[0]
        if newest is None:
            return {}
        return {r["bucket"]: list(r["folders"]) for r in manifests.filter(F.col("version") == newest).collect()}

    def paths(self, folders, buckets=None):
        """The folders of some buckets, or of all."""
        wanted = folders if buckets is None else [b for b in buckets if b in folders]
        return [f"{self.path}/rows/version={v}/bucket={b}" for b in wanted for v in folders[b]]

    def _read(self, paths):
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, before=None):
        """All rows, as the newest merge (below a version) left them."""
        return self._read(self.paths(self.folders(before)))

    def added(self, version):
        """The rows that an insert of this version wrote."""
        stored = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(stored).parquet(f"{self.path}/rows/version={version}")

    def _dealt(self, rows):
        """Bucketed rows, one task for each bucket; those without a key in parts."""
        part = F.when(F.col("bucket") == LOOSE, F.pmod(F.xxhash64(*self.schema.names), F.lit(LOOSE_PARTS)))
        return rows.withColumn("_part", part).repartition("bucket", "_part").drop("_part")

    def _write(self, dealt, version, folders, replaced=()):
        """Write dealt rows and a manifest in which they follow, or replace, a bucket's folders."""
        ordered = dealt.sortWithinPartitions("bucket", *self.keys)
        writer = ordered.write.mode("overwrite").option("compression", "zstd")
        for key in self.keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        with shuffles_dropped(dealt.sparkSession):
            writer.partitionBy("bucket").parquet(f"{self.path}/rows/version={version}")
        written = [r["bucket"] for r in self.added(version).select("bucket").distinct().collect()]
        after = {b: [] if b in replaced else f for b, f in folders.items()}
        for bucket in written:
            after[bucket] = [*after.get(bucket, []), version]
        rows = [(b, f) for b, f in sorted(after.items()) if f]
        manifest = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def _merge(self, rows, order, version, keep, combine):
        folders = self.folders(version)
        with Scope() as scope:
            marked = self._bucketed(rows)
            one = one_per_key(marked.filter(F.col("bucket") != LOOSE), self.keys, order, keep)
            incoming = scope.stage(
                one.select(marked.columns).unionByName(marked.filter(F.col("bucket") == LOOSE)), "store-incoming"
            )
            touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect() if r["bucket"] != LOOSE]
            fresh, replaced = combine(incoming, folders, touched)
            self._write(fresh, version, folders, replaced)

    def insert(self, rows, order, version):
        """Add rows whose key is new; the first of several wins.  ``version`` is above all before."""

        def combine(incoming, folders, touched):
            held = self._read(self.paths(folders, touched)).select(*self.keys)
            fresh = incoming.join(held, self.keys, "left_anti").select(incoming.columns)
            full = [b for b in touched if len(folders.get(b, [])) >= self.most_folders]
            if full:
                fresh = fresh.unionByName(self._bucketed(self._read(self.paths(folders, full))))
            return self._dealt(fresh), full

        self._merge(rows, order, version, "first", combine)

    def upsert(self, rows, order, version):
        """The last incoming row of a key replaces it."""

        def combine(incoming, folders, touched):
            # old and new rows of a bucket meet in the task that writes it
            old = self._bucketed(self._read(self.paths(folders, touched))).withColumn("_new", F.lit(False))
            keyed = incoming.filter(F.col("bucket") != LOOSE).withColumn("_new", F.lit(True))
            newest = F.max("_new").over(Window.partitionBy("bucket", *self.keys))
            met = old.unionByName(keyed).repartition("bucket").withColumn("_newest", newest)
            kept = met.filter("_new = _newest").select(incoming.columns)
            return kept.unionByName(self._dealt(incoming.filter(F.col("bucket") == LOOSE))), touched

        self._merge(rows, order, version, "last", combine)

    def append(self, rows, version, merge):
        """Add rows beside those held under their keys; ``merge`` makes one row a key of full buckets."""
        folders = self.folders(version)
        with Scope() as scope:
            incoming = scope.stage(self._bucketed(rows), "store-incoming")
            touched = [r["bucket"] for r in incoming.select("bucket").distinct().collect()]
            full = [b for b in touched if len(folders.get(b, [])) >= self.most_folders]
            if full:
                held = incoming.filter(F.col("bucket").isin(full)).drop("bucket")
                merged = merge(held.unionByName(self._read(self.paths(folders, full))))
                incoming = incoming.filter(~F.col("bucket").isin(full)).unionByName(self._bucketed(merged))
            self._write(self._dealt(incoming), version, folders, full)

    def lookup(self, wanted, before=None, broadcast_rows=200_000):
        """The rows under the keys of ``wanted``, from the buckets of these keys, as of a version."""
        keys = wanted.select(*self.keys).distinct()
        touched = [r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect()]
        held = self._read(self.paths(self.folders(before), touched))
        few = keys.limit(broadcast_rows + 1).count() <= broadcast_rows
        return held.join(F.broadcast(keys) if few else keys, self.keys, "left_semi")

    def vacuum(self, keep):
        """Delete manifests below ``keep`` and the folders that only they name.

        Merges of version ``keep`` or below can then not run again.
        """
        stored = StructType.fromDDL(MANIFEST).add("version", "long")
        manifests = self.spark.read.schema(stored).parquet(f"{self.path}/manifest")
        # a row for each bucket and version kept, however large the table
        rows = manifests.select("version", "bucket", F.explode("folders").alias("folder")).distinct().collect()
        newest = max((r["version"] for r in rows if r["version"] <= keep), default=keep)
        old = {(r["bucket"], r["folder"]) for r in rows if r["version"] < newest}
        used = {(r["bucket"], r["folder"]) for r in rows if r["version"] >= newest}
        for version in sorted({r["version"] for r in rows if r["version"] < newest}):
            remove(self.spark, f"{self.path}/manifest/version={version}")
        for bucket, folder in sorted(old - used):
            remove(self.spark, f"{self.path}/rows/version={folder}/bucket={bucket}")
