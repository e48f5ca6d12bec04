"""Scan logs: from serial chunks to decoded trouble codes."""

from pyspark.sql import functions as F

from faultline import fixed_values as fv
from faultline.functions import scan
from faultline.functions.once import once
from faultline.operators.cases import new_pending_codes
from faultline.operators.running import in_ranges


def parse_responses(scans):
    """Codes and error class of each raw response; errors and missing data leave no codes."""
    lines, joined = F.col("_lines"), F.col("_joined")
    cleaned = scans.select("*", once(_lines=scan.clean_lines(F.col("raw"))))
    classed = cleaned.select("*", once(_joined=F.array_join(lines, ""))).select(
        "*", once(error=scan.scan_error(joined))
    )
    silent = scan.has_no_data(joined) | F.col("error").isNotNull()
    codes = F.when(silent, F.array().cast("array<string>")).otherwise(
        scan.scan_codes(lines, F.col("mode"))
    )
    return classed.select(*scans.columns, codes.alias("codes"), "error")


def read_codes(scans, key="scan_id"):
    """Stored and new pending codes per scan.

    An error while reading stored codes empties both lists; an error while
    reading pending codes is ignored.  A scan has one response per mode.
    """
    parsed = parse_responses(scans)
    nothing = F.array().cast("array<string>")
    per_scan = parsed.groupBy(key).agg(
        F.first(F.when(F.col("mode") == "03", F.col("codes")), ignorenulls=True).alias("stored"),
        F.first(F.when(F.col("mode") == "07", F.col("codes")), ignorenulls=True).alias("pending"),
        F.first(F.when(F.col("mode") == "03", F.col("error")), ignorenulls=True).alias("error"),
    )
    failed = F.col("error").isNotNull()
    stored = F.coalesce("stored", nothing)
    return per_scan.select(
        key,
        F.when(failed, nothing).otherwise(stored).alias("stored"),
        F.when(failed, nothing)
        .otherwise(new_pending_codes(F.col("pending"), stored))
        .alias("pending"),
        "error",
    )


def chunk_sessions(chunks, port, ts, order, silence=fv.CHUNK_SILENCE):
    """Start time of the response each chunk belongs to.

    A response ends when the port stays silent for longer than ``silence``.
    """
    chunks = in_ranges(chunks, [port], [ts, *order])
    with_previous = chunks.add(maxes={"_previous": F.col(ts)}, before=True)
    quiet = F.col("_previous").isNull() | (
        F.col(ts) > F.col("_previous") + F.expr(f"INTERVAL '{silence}'")
    )
    started = with_previous.add(maxes={"response_start": F.when(quiet, F.col(ts))})
    return started.rows.drop("_previous", "_range")


def command_cap(mode):
    """How long the answer to a command is listened to."""
    return (
        F.when(mode == "03", F.expr(f"INTERVAL '{fv.CHUNK_CAP_STORED}'"))
        .when(mode == "07", F.expr(f"INTERVAL '{fv.CHUNK_CAP_PENDING}'"))
        .otherwise(F.expr(f"INTERVAL '{fv.CHUNK_CAP}'"))
    )


def assemble_chunks(
    chunks, port, ts, order, chunk, silence=fv.CHUNK_SILENCE, cap=fv.CHUNK_CAP, sent_at=None
):
    """One row per response: its chunks joined in time order.

    Listening stops ``cap`` after the start, so later chunks of an unbroken
    stream belong to no response; they are counted in ``n_late``.  The cap also
    bounds what one response can gather.  ``cap`` is a length or an interval column of
    the chunks; ``sent_at`` names the column with the time of the command, from which
    the cap is measured where it is known.
    """
    placed = chunk_sessions(chunks, port, ts, order, silence)
    begun = F.col("response_start")
    if sent_at:
        begun = F.coalesce(F.col(sent_at), begun)
    heard = F.col(ts) < begun + (F.expr(f"INTERVAL '{cap}'") if isinstance(cap, str) else cap)
    pieces = F.sort_array(
        F.collect_list(F.when(heard, F.struct(F.col(ts), *order, F.col(chunk).alias("piece"))))
    )
    return placed.groupBy(port, "response_start").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("raw"),
        F.count_if(heard).alias("n_chunks"),
        F.count_if(~heard).alias("n_late"),
    )
