"""Removal of lines that many documents share, by two Bloom filters.

A line's key is the line without blanks at both ends, A-Z lowered.  Each task sets the
keys of its documents (a key once a document) in a filter of once-seen hashes; a bit
that is met again is set in a second filter, of twice-seen hashes.  Filters of different tasks
meet segment by segment: a bit set in two of the first filters is twice-seen.  So every key of two documents is in the
second filter, whichever tasks held them.  Only keys that this filter takes (suspected
repeats: true ones and a few false positives) are shuffled, as 128 bits each; there the documents
of each key are counted exactly and the one that keeps the line is chosen: the first in
descending order of doc_id.

The filters follow the corpus, ``BITS_PER_KEY`` bits for each line that is long enough,
up to ``MAX_BITS``, which bounds what a task holds and what is broadcast.  Beyond that the second filter takes
more false positives, so more is shuffled, and the result stays exact.

Texts are split at newlines only.  A null or empty text is one empty line.  Rows of one
doc_id are one document for counts and for keeping a line; rows without an id are one document
behind all others, so they keep a line never.  Repeated rows get the same result, and a line that
stands several times in the keeping document stays there each time.  Lines under ``MIN_CHARS``
code points always stay.  An empty table gives an empty result.  Other columns pass
unchanged, but ``n_lines`` and ``n_dropped`` replace columns of these names.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.base import own_prefix, small_batches, stage

MIN_CHARS = 40
MIN_DOCS = 5
BITS_PER_KEY = 10
HASHES = 3
#: Bits of a filter: 64 MB at most.
MAX_BITS = 1 << 29
#: Parts in which filters are merged.
SEGMENTS = 256
#: Confirmed lines, 24 bytes each, that are joined by broadcast; beyond, by shuffle.
BROADCAST_ROWS = 500_000

BLANKS = b" \t\n\r\x0b\x0c"


def long_enough(line, least):
    """Whether a UTF-8 line has ``least`` code points."""
    return len(line) >= least and (len(line) >= 4 * least or len(line.decode()) >= least)


def keyed_lines(data, least):
    """(place, key) of the lines of a UTF-8 text whose keys are long enough."""
    for at, line in enumerate(data.lower().split(b"\n")):
        line = line.strip(BLANKS)
        if long_enough(line, least):
            yield at, line


def hashes(texts, least):
    """Distinct key hashes of each text, n x 2 words of 64 bits, and their numbers."""
    found = [{xxhash.xxh3_128_digest(key) for _, key in keyed_lines(t, least)} for t in texts]
    flat = np.frombuffer(b"".join(b"".join(keys) for keys in found), ">u8").astype(np.uint64)
    return flat.reshape(-1, 2), np.array([len(keys) for keys in found], np.int64)


def places(keys, bits):
    """Bit positions of every key, a row for each of the ``HASHES``."""
    step = keys[:, 1] | np.uint64(1)
    turns = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (keys[:, 0] + turns * step) & np.uint64(bits - 1)


def set_bits(filled, at):
    """Set sorted distinct positions of a bit array held in bytes."""
    if not len(at):
        return
    byte, mask = at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)
    starts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    filled[byte[starts]] |= np.bitwise_or.reduceat(mask, starts)


def test_bits(filled, at):
    return (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _texts(batch):
    return [(text or "").encode() for text in batch.column("text").to_pylist()]


def _fill(bits, least):
    """The segments of a task's two filters."""

    def run(batches):
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            keys, _ = hashes(_texts(batch), least)
            at, times = np.unique(places(keys, bits), return_counts=True)
            set_bits(twice, at[(times > 1) | test_bits(once, at)])
            set_bits(once, at)
        pack = zstandard.ZstdCompressor(level=1).compress
        width = len(once) // SEGMENTS
        parts = [(i, once[i * width : (i + 1) * width], twice[i * width : (i + 1) * width]) for i in range(SEGMENTS)]
        rows = [(i, pack(a.tobytes()), pack(b.tobytes())) for i, a, b in parts if a.any()]
        for i, a, b in rows:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([a]), pa.array([b])], names=["segment", "once", "twice"])

    return run


def _merge(batches):
    """The twice-seen bits of each segment, from a partition sorted by segment."""
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress

    def made(segment, twice):
        return pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([pack(twice.tobytes())])], names=["segment", "twice"])

    at = once = twice = None
    for batch in batches:
        for segment, a, b in zip(*(batch.column(n).to_pylist() for n in ("segment", "once", "twice")), strict=True):
            a, b = np.frombuffer(unpack(a), np.uint8), np.frombuffer(unpack(b), np.uint8)
            if segment == at:
                twice |= b | (once & a)
                once |= a
            else:
                if at is not None:
                    yield made(at, twice)
                at, once, twice = segment, a.copy(), b.copy()
    if at is not None:
        yield made(at, twice)


def filter_bits(docs, least, most=MAX_BITS):
    """Size of a filter for the corpus: a power of two."""
    long = F.octet_length("text") / (least + 1) + 1
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n = docs.agg(F.sum(F.least(long, lines))).first()[0] or 0
    bits = SEGMENTS * 8
    while bits < min(n * BITS_PER_KEY, most):
        bits *= 2
    return bits


def twice_seen(docs, least=MIN_CHARS, most=MAX_BITS):
    """The filter of keys seen in two documents, or more by chance, in bytes."""
    bits = filter_bits(docs, least, most)
    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_fill(bits, least), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    twice, width = np.zeros(bits // 8, np.uint8), bits // 8 // SEGMENTS
    for row in merged.collect():
        part = zstandard.ZstdDecompressor().decompress(bytes(row["twice"]))
        twice[row["segment"] * width : (row["segment"] + 1) * width] = np.frombuffer(part, np.uint8)
    return twice


def suspects(docs, least=MIN_CHARS, most=MAX_BITS):
    """doc_id, text_hash and the two words (high, low) of every key that may be a repeat."""
    twice = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, least, most))
    rest = T.StructType([docs.schema["doc_id"], T.StructField("text_hash", T.LongType())])

    def run(batches):
        for batch in batches:
            keys, n = hashes(_texts(batch), least)
            taken = test_bits(twice.value, places(keys, 8 * len(twice.value))).all(axis=0)
            rows = pa.array(np.repeat(np.arange(len(n)), n)[taken])
            words = keys[taken].view(np.int64)
            ids = [batch.column(name).take(rows) for name in rest.names]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(words[:, 0]), pa.array(words[:, 1])], names=[*rest.names, "high", "low"])

    shape = T.StructType([*rest.fields, T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, shape)


def repeats(found, min_docs=MIN_DOCS):
    """high, low, n_docs and keeper of every key that ``min_docs`` documents hold."""
    held = found.select("high", "low", "doc_id").distinct()
    many = held.groupBy("high", "low").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return many.filter(F.col("n_docs") >= min_docs)


def losses(docs, min_docs=MIN_DOCS, least=MIN_CHARS, most=MAX_BITS):
    """For each text that loses lines: the high words of their keys."""
    found = stage(suspects(docs, least, most), "line-suspects")
    many = stage(repeats(found, min_docs), "repeated-lines")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    gone = found.join(many, ["high", "low"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("high").alias("lost"))


def _drop(schema, lost_name, least):
    rest = [f.name for f in schema if f.name not in ("text", "n_lines", "n_dropped")]

    def kept(text, lost):
        data = (text or "").encode()
        if lost is None:
            return text, data.count(b"\n") + 1, 0
        lost = {high & (1 << 64) - 1 for high in lost}
        lines = data.split(b"\n")
        drop = {at for at, key in keyed_lines(data, least) if xxhash.xxh3_128_intdigest(key) >> 64 in lost}
        left = b"\n".join(line for at, line in enumerate(lines) if at not in drop)
        return left.decode(), len(lines), len(drop)

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("text").to_pylist(), batch.column(lost_name).to_pylist(), strict=True)
            made = list(zip(*(kept(*row) for row in rows), strict=True)) or [[], [], []]
            arrays = [pa.array(made[0], pa.string()), *(pa.array(c, pa.int64()) for c in made[1:])]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *arrays], names=[*rest, "text", "n_lines", "n_dropped"])

    shape = T.StructType([schema[name] for name in rest])
    return run, shape.add("text", "string").add("n_lines", "long").add("n_dropped", "long")


def deduplicate(docs, min_docs=MIN_DOCS, least=MIN_CHARS, most=MAX_BITS):
    """Every row with the text that is left, and n_lines (before) and n_dropped."""
    own = own_prefix(docs)
    lost = losses(docs, min_docs, least, most).select(
        F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}hash"), F.col("lost").alias(f"{own}lost")
    )
    same = F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64("text") == F.col(f"{own}hash"))
    joined = docs.join(lost, same, "left").select(*docs.columns, f"{own}lost")
    run, shape = _drop(docs.schema, f"{own}lost", least)
    return joined.mapInArrow(run, shape)
