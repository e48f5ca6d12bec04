"""Batch sinks that can be replayed.

Every micro-batch owns one folder, written in overwrite mode, so a batch that
runs again after a failure replaces its own output and nothing else.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultline.session import shuffles_dropped


def write_batch(rows, path, batch_id):
    with shuffles_dropped(rows.sparkSession):
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_before(spark, path, schema, batch_id):
    """Rows of the batches before this one; none when nothing was written yet."""
    stored = StructType([*schema.fields, StructField("batch_id", LongType())])
    try:
        rows = spark.read.schema(stored).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.filter(F.col("batch_id") < batch_id).drop("batch_id")


def run_available(writer, checkpoint):
    """Process everything that is there and stop."""
    query = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
