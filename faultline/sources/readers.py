"""Readers with explicit schemas."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from faultline import schemas

CORRUPT = "_corrupt_record"


def parse_sessions(sessions, document=schemas.CASE_DOCUMENT, data="data"):
    """Session rows to case documents, with the row's id and status beside them."""
    return sessions.withColumn("doc", F.from_json(data, document)).select(
        "doc.*",
        F.col("id").alias("_rowId"),
        F.col("status").alias("_status"),
        F.col("created_at").alias("_created_at"),
    )


def split_sessions(sessions, document=schemas.CASE_DOCUMENT, data="data"):
    """(readable cases as ``parse_sessions`` gives them, quarantined rows).

    A quarantined row keeps its id, status, time and raw text, and a reason: the document is
    ``missing``, is ``not_an_object``, or is ``unreadable``: broken JSON, or a value that
    its field cannot hold.  Each row is in one of both tables.
    """
    shape = document if isinstance(document, StructType) else StructType.fromDDL(document)
    permissive = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(data, StructType([*shape.fields, StructField(CORRUPT, StringType())]), permissive)
    reason = (
        F.when(F.col(data).isNull(), "missing")
        .when(~F.ltrim(data).startswith("{"), "not_an_object")
        .when(F.col("doc").isNull() | F.col(f"doc.{CORRUPT}").isNotNull(), "unreadable")
    )
    marked = sessions.withColumn("doc", parsed).withColumn("reason", reason)
    readable = marked.filter("reason IS NULL").select(
        *[F.col("doc").getField(f.name).alias(f.name) for f in shape.fields],
        F.col("id").alias("_rowId"),
        F.col("status").alias("_status"),
        F.col("created_at").alias("_created_at"),
    )
    quarantined = marked.filter("reason IS NOT NULL").select(
        "id", "status", "created_at", F.col(data).alias("raw"), "reason"
    )
    return readable, quarantined


def read_cases(sessions, document=schemas.CASE_DOCUMENT):
    """All cases, newest first."""
    return parse_sessions(sessions, document).orderBy(F.desc("_created_at"), "_rowId")


def read_case_archive(spark, path):
    """Cases kept as one JSON array per file, the desktop export form."""
    return spark.read.schema(schemas.CASE_DOCUMENT).option("multiLine", True).json(path)


def read_sessions(spark, path):
    return spark.read.schema(schemas.SESSION_ROW).parquet(path)


def read_corpus(spark, path):
    return spark.read.schema(schemas.CORPUS_ROW).parquet(path)


def read_catalog(spark, path):
    return spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)
