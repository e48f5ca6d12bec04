"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and an end id, cut into pieces of at most ``size`` tokens
(full pieces first, the rest last).  Only the histogram of piece lengths, at most
``size`` numbers, reaches the driver.  Lengths are placed longest first: all pieces of
a length at once go to the packs with the most room left that can take them, splitting
a packing pattern's count where fewer pieces than packs are left, and fill new packs
where none fits.  Each piece gets its rank within its length and meets, by length and
rank, the pattern whose turn it is.  Ranks are counted within (bucket, length) and
offset by bucket totals, so no task holds all pieces of a length.

Null and empty texts are one end id.  Repeated rows and equal lengths are interchangeable:
ranks follow the bucket, doc_id and start.  An empty table gives an empty result.  Only
doc_id and text are read.
"""

import zlib

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm import vocab
from faultline.llm.base import Memo, blank_cut, stage, text_columns

SIZE = 1024
#: The same vocabulary in two forms: the ids are those of the first.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = np.array([0], "<u4").tobytes()
#: Pieces ranked together in one bucket, about.
BUCKET_ROWS = 50_000

_word_ids = {}


def _encoder(file):
    if file not in _word_ids:
        coder = vocab.ranked(file, with_end=True)
        _word_ids[file] = Memo(
            lambda word: np.array(coder.encode_ordinary(f" {word}"), "<u4").tobytes()
        )
    return vocab.ranked(file, with_end=True), _word_ids[file]


def token_ids(text, file):
    """The ids of a text as little-endian unsigned 32-bit integers, without an end id."""
    coder, words = _encoder(file)
    if vocab.END in text:
        return np.array(coder.encode(text, allowed_special="all"), "<u4").tobytes()
    first, rest = blank_cut(text)
    head = np.array(coder.encode_ordinary(first), "<u4").tobytes()
    return head + b"".join(map(words.__getitem__, rest))


def pieces(docs, size=SIZE, ranks=None):
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece."""
    file = ranks or vocab.path(RANKS)

    def cut(texts):
        rows = []
        for text in texts:
            ids = token_ids(text or "", file) + END_OF_DOCUMENT
            parts = [ids[at : at + 4 * size] for at in range(0, len(ids), 4 * size)]
            rows.append(([zlib.crc32(p) for p in parts], len(ids) // 4))
        return list(zip(*rows, strict=True)) or [[], []]

    shaped = text_columns(docs.select("doc_id", "text"), {"crcs": "array<long>", "doc_tokens": "long"}, cut)
    start = F.col("at").cast("long") * size
    return shaped.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("at", "ids_crc32")).select(
        "doc_id",
        start.alias("start"),
        F.least(F.lit(size), F.col("doc_tokens") - start).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
    )


def patterns(histogram, size=SIZE):
    """Packing patterns [count, lengths] for a {length: count} histogram."""
    open_packs = {}  # room left: patterns with that room
    full = []

    def put(room, pattern):
        (open_packs.setdefault(room, []) if room else full).append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_packs if r >= length), default=None)
            if room is None:
                # a new pack takes as many of this length as it holds
                each = min(size // length, left)
                put(size - each * length, [left // each, [length] * each])
                left %= each
                continue
            count, lengths = open_packs[room].pop()
            if not open_packs[room]:
                del open_packs[room]
            used = min(count, left)
            if used < count:
                put(room, [count - used, lengths])
            put(room - length, [used, [*lengths, length]])
            left -= used
    return full + [p for room in sorted(open_packs) for p in open_packs[room]]


def _turns(found):
    """(length, first, last, sequence, each, offset): which ranks of a length a pattern takes."""
    taken, sequence, rows = {}, 0, []
    for count, lengths in found:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            first = taken.get(length, 0)
            taken[length] = first + count * each
            rows.append((length, first, taken[length], sequence, each, offset))
            offset += each * length
        sequence += count
    return rows


def ranked(rows, size):
    """``rows`` with ``_rank``, gapless from 0 within each length."""
    n = rows.count()
    buckets = F.lit(max(8, -(-n // BUCKET_ROWS)))
    spread = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), buckets))
    inside = W.partitionBy("_bucket", "length").orderBy("doc_id", "start")
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    offsets = totals.select(
        "length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = spread.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(offsets, ["length", "_bucket"]).select(
        *rows.columns, (F.col("_before") + F.col("_local")).alias("_rank")
    )


def pack(rows, size=SIZE):
    """Pieces with sequence_id and offset.  ``rows`` needs doc_id, start, length, ids_crc32."""
    spark = rows.sparkSession
    rows = stage(rows, "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    turns = spark.createDataFrame(
        _turns(patterns(histogram, size)),
        "_length long, _first long, _last long, _sequence long, _each long, _offset long",
    )
    turn = F.col("_rank") - F.col("_first")
    mine = (F.col("length") == F.col("_length")) & (
        (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_last"))
    )
    # a pattern has at most ``size`` lengths, and lengths split few patterns: some thousand rows
    return ranked(rows, size).join(F.broadcast(turns), mine).select(
        *rows.columns,
        (F.col("_sequence") + F.floor(turn / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + turn % F.col("_each") * F.col("length")).alias("offset"),
    )
