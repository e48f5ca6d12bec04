"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits.  Two of them within three bits agree within one bit in
one of their two halves of 32 bits, so each fingerprint is stored in two tables under
its halves and looks up the Hamming ball of radius one (33 values) around each half;
matches are verified on all 64 bits.  Copies share a fingerprint and count once.

Lookups meet their table by a shuffle on (table, half), sorted inside the partition.
Among the members of one bucket a spanning forest of verified links is kept, never
all pairs.  A bucket of over ``BUCKET`` fingerprints is split by a second index over
the other half (two quarters, again balls of radius one); what is left below a
second-level key shares 48 bits up to two flips, which bounds it by construction.

Null and wordless texts have fingerprint zero and link like any other.  Null ids
never become a component's id while it has another; a component of null ids only has
a null id.  Repeated rows are repeated in the result.  Other columns are not read.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from faultline.llm import near_copies
from faultline.llm.base import own_prefix, stage, text_columns
from faultline.llm.components import roots

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints under one half; above, the second index splits the bucket.
BUCKET = 4096
#: Hot halves, 9 bytes each, that are broadcast; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000


def fingerprint(text, shingle=SHINGLE):
    """The unsigned SimHash of one text's word shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_texts(texts, shingle=SHINGLE):
    prints = np.array([fingerprint(text, shingle) for text in texts], np.uint64)
    return [prints.view(np.int64)]


def fingerprints(docs):
    """doc_id and fp (its 64 bits as a long) of every row."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text_columns(texts, {"fp": "long"}, _fingerprint_texts)


def _ball(value, bits):
    """The value and everything one bit away from it."""
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(bits - 1)),
        lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)),
    )
    return F.concat(F.array(value), flips)


def _half(fp, table):
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if table == 0 else F.shiftrightunsigned(fp, 32)


def _probes(prints):
    """(tab, half, fp, own): table entries and lookups of every fingerprint."""
    tables = F.array(
        *[
            F.struct(F.lit(t).alias("tab"), _half(F.col("fp"), t).alias("own_half"))
            for t in (0, 1)
        ]
    )
    return (
        prints.select("fp", F.inline(tables))
        .select("fp", "tab", "own_half", F.explode(_ball(F.col("own_half"), 32)).alias("half"))
        .select("tab", "half", "fp", (F.col("half") == F.col("own_half")).alias("own"))
    )


def _hot_halves(prints, bucket):
    """Halves that lie within one bit of a half held by more than ``bucket`` fingerprints."""
    tables = F.array(
        *[F.struct(F.lit(t).alias("tab"), _half(F.col("fp"), t).alias("half")) for t in (0, 1)]
    )
    held = prints.select(F.inline(tables)).groupBy("tab", "half").count()
    full = held.filter(F.col("count") > bucket)
    return full.select("tab", F.explode(_ball(F.col("half"), 32)).alias("half")).distinct()


def _split_hot(probes, hot):
    """Second index: rows under a hot half spread over balls around the other half's quarters."""
    other = F.when(F.col("tab") == 0, F.shiftrightunsigned("fp", 32)).otherwise(
        F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    )
    quarters = F.array(
        F.struct(F.lit(0).alias("q"), F.col("rest").bitwiseAND(F.lit(0xFFFF)).alias("own_q")),
        F.struct(F.lit(1).alias("q"), F.shiftrightunsigned("rest", 16).alias("own_q")),
    )
    marked = probes.join(hot.withColumn("hot", F.lit(True)), ["tab", "half"], "left")
    cold = marked.filter("hot IS NULL").select(
        F.xxhash64("tab", "half").alias("bucket"), "fp", "own"
    )
    spread = (
        marked.filter("hot")
        .withColumn("rest", other)
        .select("tab", "half", "fp", "own", F.inline(quarters))
        .withColumn("sub", F.explode(_ball(F.col("own_q"), 16)))
        .select(
            F.xxhash64("tab", "half", "q", "sub").alias("bucket"),
            "fp",
            (F.col("own") & (F.col("sub") == F.col("own_q"))).alias("own"),
        )
    )
    return cold.unionByName(spread)


def forest(members, max_bits=MAX_BITS):
    """Links of a spanning forest over all pairs within ``max_bits``."""
    left = np.unique(members)
    links = []
    queue = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= max_bits
        links.extend((at, other) for other in left[near])
        queue.extend(left[near])
        left = left[~near]
    return links


def _links_of(bucket, prints, own):
    """Links inside each run of a bucket that holds an entry of its own."""
    pairs = []
    if len(bucket):
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[starts[1:], len(bucket)]
        shared = (ends - starts > 1) & np.logical_or.reduceat(own, starts)
        for a, b in zip(starts[shared], ends[shared], strict=True):
            pairs.extend(forest(prints[a:b]))
    pairs = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"]
    )


def _link_runs(batches):
    """Links inside the buckets of a partition that is sorted by bucket."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (
            batch.column("bucket").to_numpy(),
            batch.column("fp").to_numpy().view(np.uint64),
            batch.column("own").to_numpy(zero_copy_only=False),
        )
        if kept is not None:
            rows = tuple(np.concatenate(x) for x in zip(kept, rows, strict=True))
        # the last bucket may go on in the next batch
        end = np.searchsorted(rows[0], rows[0][-1])
        kept = tuple(x[end:] for x in rows)
        yield _links_of(*(x[:end] for x in rows))
    if kept is not None:
        yield _links_of(*kept)


def links(prints, bucket=BUCKET):
    """Verified links (a, b) between distinct fingerprints that keep all connections."""
    probes = _probes(prints)
    hot = stage(_hot_halves(prints, bucket), "hot-halves")
    n_hot = hot.count()
    if n_hot:
        probes = _split_hot(probes, F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot)
    else:
        probes = probes.select(F.xxhash64("tab", "half").alias("bucket"), "fp", "own")
    met = probes.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(_link_runs, "a long, b long")


def classes(docs):
    """doc_id, fp and component_id of every row."""
    found = stage(fingerprints(docs), "fingerprints")
    prints = found.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = stage(links(prints.select("fp")), "fingerprint-links").distinct()
    rooted = roots(edges)
    named = prints.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = stage(named, "fingerprint-roots")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = named.join(smallest, "root").select("fp", "component_id")
    return found.join(component, "fp").select("doc_id", "fp", "component_id")


def _linked_nodes(keys):
    """Pairs of nodes of ``near_copies`` whose fingerprints (of its shingles) the index links.

    Nodes of one fingerprint hang on the smallest of them, which also stands for them in
    links between fingerprints.
    """

    def compute(texts):
        return _fingerprint_texts(texts, near_copies.SHINGLE)

    def linked(texts, found, scope):
        prints = text_columns(texts.select(*keys, "text"), {"fp": "long"}, compute)
        known = found.select(*keys, "node").distinct()
        nodes = scope.stage(prints.join(known, keys).select("fp", "node").distinct(), "near-prints")
        first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
        same = nodes.join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
        edges = scope.stage(links(first.select("fp")).distinct(), "near-links")
        ends = [first.select(F.col("fp").alias(f), F.col("first").alias(n)) for f, n in (("a", "one"), ("b", "two"))]
        between = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
        return same.unionByName(between).filter("a <> b")

    return linked


def deduplicate(docs):
    """One document of each class of ``near_copies``, the one with the smallest id; same columns.

    The multi-index links fingerprints of the stage's own shingles, and each link is
    verified on the exact sets.  No radius of fingerprints finds all pairs at the stage's
    similarity, so an exact search follows for the pairs it left out.  Of repeated rows of that document one stays; rows that share an id but not the
    text are different documents.  Rows without an id come behind all others and are
    told apart by their texts.
    """
    own = own_prefix(docs)
    key = [f"{own}known", f"{own}text"]
    behind = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    known = docs.withColumns(
        {key[0]: F.coalesce(F.col("doc_id").cast("long"), behind), key[1]: F.xxhash64("text")}
    )
    found = near_copies.classes(known.select(*key, "text"), "class", key, linked=_linked_nodes(key))
    chosen = found.groupBy("class").agg(F.min(F.struct(*key)).alias("kept")).select("kept.*")
    rows = found.groupBy(*key).agg(F.count("*").alias("n")).join(
        chosen.withColumn("stays", F.lit(True)), key, "left"
    )
    # all rows but those that stay once as they are
    other = stage(rows.filter("stays IS NULL OR n > 1"), "near-others")
    single = known.join(near_copies.broadcast_if_few(other.select(*key)), key, "left_anti")
    repeated = near_copies.broadcast_if_few(other.filter("stays").select(*key))
    once = known.join(repeated, key, "left_semi").dropDuplicates(key)
    return single.unionByName(once).select(*docs.columns)
