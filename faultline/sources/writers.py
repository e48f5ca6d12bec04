"""Writers: appends and whole-snapshot replacement."""

from pyspark.sql import functions as F


def append(rows, path):
    rows.write.mode("append").parquet(path)


def write_corpus(corpus, path, mode="append"):
    """Write the corpus partitioned by brand, so a search of one brand prunes files.

    Rows are spread by brand and id, because one brand may hold much of them.
    """
    spread = corpus.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64)))
    (
        spread.repartition("vehicle_brand", "_part")
        .drop("_part")
        .write.mode(mode)
        .partitionBy("vehicle_brand")
        .parquet(path)
    )


def write_snapshot(rows, base, version):
    """Write a merged state as a new version beside the old ones.

    A plain file table cannot be changed in place while it is being read, so
    every merge goes to a fresh folder whose path is returned for later reads.
    """
    path = f"{base}/version={version}"
    rows.write.mode("errorifexists").parquet(path)
    return path
