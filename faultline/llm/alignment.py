"""Alignment of two tokenizers' tokens by whitespace anchors.

A text is tokenised whole by both vocabularies: A (byte-level BPE) encodes the text behind
a blank, B (pieces with byte fallback) the text, to which it adds the blank itself.  A token that
begins with a blank opens a word; where such tokens of both sides begin at the same
byte, the ends before them are shared, which is verified on the byte offsets.  These
anchors cut both sequences into windows of ids, about a word each.  A window with one token
on either side is one group.  How the ids of any other fall into groups is found once for each
pair of id tuples and kept in a bounded cache in the worker; the windows of a text that the
cache lacks are grouped together, and so are those of over ``MEMO_IDS`` ids, which are not kept.

``align`` gives the ids of both sides and the sizes of their groups: a group ends where
both sides end.  ``packed`` gives the same as bytes, a mark instead of sizes for each id that
ends a group, which is much cheaper to write and read.  A link is an A and a B token that end together, so the last tokens of
each group.  ``link_counts`` counts the corpus's links.  The bytes of one linked token
are a suffix of the other's, so the table of linked id pairs is bounded by the vocabularies, whatever
the corpus: each token has no more suffixes than bytes.  That is why it may be collected and broadcast.

Null and empty texts, and texts that a side does not give back byte for byte (as the
blank mark of B in a text), have no tokens and no links.  Repeated rows repeat and their links
count again; ties for a B id's highest count are all best.  An empty table gives an empty
result.  Other columns pass unchanged, but made columns replace those of their names.
"""

import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import vocab
from faultline.llm.base import small_batches

A_RANKS = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json
B_MODEL = "piece_bpe_32k.model"
BLANK_MARK = "▁"
#: Ids of a window, both sides together, up to which its grouping is kept; longer ones hardly repeat.
MEMO_IDS = 8
#: Entries of the cache of windows.
MEMO_ENTRIES = 200_000
#: Ids of a vocabulary, at most.
MOST_IDS = 1 << 16
#: Pairs a task holds before it merges them.
HELD_PAIRS = 2_000_000
#: Columns of an alignment.
PARTS = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
#: Columns of a packed alignment: ids of 16 bits, and a byte for each id, 1 where it ends a group.
PACKED = ["a_ids", "b_ids", "a_lasts", "b_lasts"]


@lru_cache(2)
def _pieces(file):
    return sentencepiece.SentencePieceProcessor(model_file=file)


@lru_cache(2)
def piece_bytes(file):
    """The byte string of every piece."""
    model = _pieces(file)
    return [
        bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(BLANK_MARK, " ").encode()
        for i, piece in enumerate(map(model.id_to_piece, range(model.get_piece_size())))
    ]


class Strings:
    """Byte strings in one array."""

    def __init__(self, table):
        self.sizes = np.array([len(t) for t in table], np.int32)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.starts = self.sizes.cumsum(dtype=np.int32) - self.sizes

    def joined(self, ids):
        """The strings of ``ids``, one after the other."""
        sizes = self.sizes[ids]
        ends = sizes.cumsum()
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])]


class Side:
    """One vocabulary: the ids of texts, the bytes of tokens, and which begin with a blank.

    Tokens of a ``whole`` side are parts of the text in order, so those of the text's
    length are the text; of any other side the bytes are compared.
    """

    def __init__(self, table, encode, whole=False):
        self.encode, self.whole = encode, whole
        self.strings = Strings(table)
        self.marked = np.array([t[:1] == b" " for t in table])

    def ids(self, text, data):
        """The ids of a text and where each ends, or None if their bytes are not ``data``."""
        ids = np.frombuffer(array("i", self.encode(text)), np.int32)
        ends = self.strings.sizes[ids].cumsum(dtype=np.int64)
        if not len(ids) or ends[-1] != len(data):
            return None
        return (ids, ends) if self.whole or np.array_equal(self.strings.joined(ids), data) else None


@lru_cache(2)
def a_side(file):
    coder = vocab.ranked(file)
    return Side(vocab.token_bytes(file), lambda text: coder.encode_ordinary(f" {text}"), whole=True)


@lru_cache(2)
def b_side(file):
    return Side(piece_bytes(file), _pieces(file).encode)


def shared(a_ends, b_ends):
    """Indices, on both sides, of ends that both have; ends ascend."""
    if not len(b_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(b_ends, a_ends), len(b_ends) - 1)
    same = b_ends[at] == a_ends
    return np.flatnonzero(same), at[same]


def _ranges(starts, sizes):
    """All indices of ranges, one after the other."""
    return np.repeat(starts - sizes.cumsum() + sizes, sizes) + np.arange(sizes.sum())


class Aligner:
    def __init__(self, a_file, b_file):
        self.a, self.b = a_side(a_file), b_side(b_file)
        self.groups = {}
        self.patterns = {}

    def windows(self, a, b):
        """Begins of the windows among the ids of both sides (each with their ends), and the last ends."""
        begins = []
        for side, (ids, ends) in ((self.a, a), (self.b, b)):
            at = np.flatnonzero(side.marked[ids[1:]])
            begins.append((ends[at], at + 1))
        one, two = shared(begins[0][0], begins[1][0])
        return np.r_[0, begins[0][1][one], len(a[0])], np.r_[0, begins[1][1][two], len(b[0])]

    def keys(self, a_ids, b_ids, a_at, b_at, a_n, b_n):
        """The id tuples of windows as byte strings; -1, which is no id, stands between the two of a window."""
        sizes = a_n + b_n + 1
        ends = sizes.cumsum()
        tuples = np.full(ends[-1], -1, "<i4")
        tuples[_ranges(ends - sizes, a_n)] = a_ids[_ranges(a_at, a_n)]
        tuples[_ranges(ends - b_n, b_n)] = b_ids[_ranges(b_at, b_n)]
        whole = tuples.tobytes()
        return [whole[i:j] for i, j in zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True)]

    def marks(self, a_ends, b_ends, a_at, b_at, a_n, b_n):
        """Marks of the last ids of the groups of windows, for both sides, one window after the other."""
        found = shared(a_ends[_ranges(a_at, a_n)], b_ends[_ranges(b_at, b_n)])
        lasts = [np.zeros(n.sum(), np.uint8) for n in (a_n, b_n)]
        for marks, at in zip(lasts, found, strict=True):
            marks[at] = 1
        return lasts

    def group(self, a_ends, b_ends, a_at, b_at, a_n, b_n):
        """``marks`` of each window, as bytes."""
        parts = []
        for marks, n in zip(self.marks(a_ends, b_ends, a_at, b_at, a_n, b_n), (a_n, b_n), strict=True):
            whole, to = marks.tobytes(), n.cumsum()
            parts.append([whole[i:j] for i, j in zip((to - n).tolist(), to.tolist(), strict=True)])
        return list(zip(*parts, strict=True))

    def grouped(self, a, b, windows):
        """``group`` of windows (their begins and lengths on both sides), by the cache where it knows them."""
        if not len(windows[0]):
            return []
        keys = self.keys(a[0], b[0], *windows)
        found = list(map(self.groups.get, keys))
        fresh = [i for i, known in enumerate(found) if known is None]
        if fresh:
            made = self.group(a[1], b[1], *(part[fresh] for part in windows))
            if len(self.groups) + len(fresh) > MEMO_ENTRIES:
                self.groups.clear()
                self.patterns.clear()
            for i, marks in zip(fresh, made, strict=True):
                # few patterns serve most windows
                found[i] = self.groups[keys[i]] = self.patterns.setdefault(marks, marks)
        return found

    def pack(self, text):
        """The columns ``PACKED`` of a text."""
        data = np.frombuffer(f" {text}".encode() if text else b"", np.uint8)
        a = self.a.ids(text, data) if text else None
        b = self.b.ids(text, data) if a else None
        if not b:
            return b"", b"", b"", b""
        ends = self.windows(a, b)
        begins, sizes = [at[:-1] for at in ends], [np.diff(at) for at in ends]
        lasts = [np.zeros(len(side[0]), np.uint8) for side in (a, b)]
        for marks, at in zip(lasts, ends, strict=True):
            marks[at[1:] - 1] = 1
        mixed = (sizes[0] > 1) & (sizes[1] > 1)
        short = sizes[0] + sizes[1] <= MEMO_IDS
        kept, long = ([part[at] for part in (*begins, *sizes)] for at in (mixed & short, mixed & ~short))
        parts = list(zip(*self.grouped(a, b, kept), strict=True)) or [(), ()]
        parts = [np.frombuffer(b"".join(part), np.uint8) for part in parts]
        for windows, made in ((kept, parts), (long, self.marks(a[1], b[1], *long))):
            for marks, at, n, values in zip(lasts, windows[:2], windows[2:], made, strict=True):
                marks[_ranges(at, n)] = values
        return *(side[0].astype("<u2").tobytes() for side in (a, b)), *(marks.tobytes() for marks in lasts)

    def align(self, text):
        """a_ids, b_ids, a_sizes and b_sizes of a text, as bytes of 32-bit integers."""
        packed = self.pack(text)
        ids = (np.frombuffer(part, "<u2").astype("<i4").tobytes() for part in packed[:2])
        return *ids, *(_sizes(np.frombuffer(part, np.uint8)).astype("<i4").tobytes() for part in packed[2:])


def _sizes(lasts):
    """Sizes of the groups whose last ids are marked."""
    return np.diff(np.flatnonzero(lasts), prepend=-1)


@lru_cache(2)
def _aligner(a_file, b_file):
    return Aligner(a_file, b_file)


def _lists(rows):
    """A column of integer lists from the bytes of each row."""
    ends = np.cumsum([0, *(len(r) // 4 for r in rows)])
    flat = np.frombuffer(b"".join(rows), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _made(docs, names, kind, made, column, a_ranks, b_model):
    """The other columns of ``docs`` with the columns ``names`` instead of text."""
    files = a_ranks or vocab.path(A_RANKS), b_model or vocab.path(B_MODEL)
    small_batches(docs.sparkSession)
    rest = [name for name in docs.columns if name not in ("text", *PARTS, *PACKED)]

    def run(batches):
        aligner = _aligner(*files)
        for batch in batches:
            rows = [made(aligner, text) for text in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), *map(column, columns)], names=[*rest, *names])

    shape = T.StructType([docs.schema[name] for name in rest])
    for name in names:
        shape = shape.add(name, kind)
    return docs.select(*rest, "text").mapInArrow(run, shape)


def align(docs, a_ranks=None, b_model=None):
    """The other columns of ``docs`` with the columns ``PARTS`` instead of text."""
    return _made(docs, PARTS, T.ArrayType(T.IntegerType()), Aligner.align, _lists, a_ranks, b_model)


def _binary(rows):
    return pa.array(rows, pa.binary())


def packed(docs, a_ranks=None, b_model=None):
    """``align`` with the columns ``PACKED``."""
    return _made(docs, PACKED, T.BinaryType(), Aligner.pack, _binary, a_ranks, b_model)


def _names(aligned):
    return PACKED if PACKED[-1] in aligned.columns else PARTS


def _flat(batch, name, kind):
    """All values of a column of lists, or of bytes of ``kind``, and how many each row has."""
    column = batch.column(name)
    if pa.types.is_binary(column.type):
        rows = column.to_pylist()
        size = np.dtype(kind).itemsize
        return np.frombuffer(b"".join(rows), kind), np.array([len(r) // size for r in rows], np.int64)
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()).astype(np.int64)


class Rows:
    """A batch of alignments: for both sides all ids, whether each ends a group, and each row's number of ids."""

    def __init__(self, batch):
        parts = PACKED if PACKED[-1] in batch.schema.names else PARTS
        self.ids, self.lasts, self.n = [], [], []
        for name, marks in zip(parts[:2], parts[2:], strict=True):
            ids, n = _flat(batch, name, "<u2")
            lasts, _ = _flat(batch, marks, np.uint8)
            if parts is PARTS:
                # the sizes of a row add up to its ids, so one running sum serves all rows
                at, lasts = lasts.cumsum(dtype=np.int64) - 1, np.zeros(len(ids), np.uint8)
                lasts[at] = 1
            self.ids.append(ids)
            self.lasts.append(lasts.view(bool))
            self.n.append(n)

    def links(self):
        """A ids and B ids of all links."""
        return [ids[lasts] for ids, lasts in zip(self.ids, self.lasts, strict=True)]

    def groups(self):
        """How many groups each row has."""
        ends = np.r_[0, self.n[0].cumsum()]
        return np.diff(np.r_[0, self.lasts[0].cumsum(dtype=np.int64)][ends])

    def each(self):
        """a, b, a_lasts and b_lasts of every row."""
        columns = [np.split(part, n.cumsum()[:-1]) for parts in (self.ids, self.lasts) for part, n in zip(parts, self.n, strict=True)]
        return zip(*columns, strict=True)


def _pairs(a, b):
    return a.astype(np.int64) << 32 | b


def _sum_pairs(batches):
    def merged(parts):
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        # sums stay below 2^53
        return keys, np.bincount(back, counts, len(keys)).astype(np.int64)

    held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for batch in batches:
        held.append(np.unique(_pairs(*Rows(batch).links()), return_counts=True))
        size += len(held[-1][0])
        if size > HELD_PAIRS:
            held, size = [merged(held)], 0
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged(held)], names=["pair", "n"])


def link_counts(aligned):
    """a_id, b_id, n and best of every linked id pair; a pair is best if no other A id meets its B id more often."""
    small_batches(aligned.sparkSession)
    sums = aligned.select(*_names(aligned)).mapInArrow(_sum_pairs, "pair long, n long")
    sums = sums.groupBy("pair").agg(F.sum("n").alias("n"))
    named = sums.select(F.shiftright("pair", 32).cast("int").alias("a_id"), (F.col("pair") % (1 << 32)).cast("int").alias("b_id"), "n")
    highest = named.groupBy("b_id").agg(F.max("n").alias("_n"))
    return named.join(highest, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("_n")).alias("best"))


def _order(a, b, a_lasts, b_lasts, marked):
    """Ids of one row in the order of its groups, each with its mark, as one string without the last mark."""
    a_ends, b_ends = np.flatnonzero(a_lasts) + 1, np.flatnonzero(b_lasts) + 1
    codes = np.empty(len(a) + len(b), np.int64)
    b_before = np.repeat(np.r_[0, b_ends[:-1]], np.diff(a_ends, prepend=0))
    a_upto = np.repeat(a_ends, np.diff(b_ends, prepend=0))
    codes[np.arange(len(a)) + b_before] = 2 * a.astype(np.int64) + a_lasts
    codes[np.arange(len(b)) + a_upto] = 2 * MOST_IDS + 2 * b.astype(np.int64) + b_lasts
    return marked.joined(codes)[:-1]


def score(aligned, counts):
    """Each row's numbers of tokens, groups and links, its best links, the sum of their counts, and its groups' digest.

    ``aligned`` is a written table, as its links are read twice; ``counts`` is bounded by the vocabularies.
    """
    spark = aligned.sparkSession
    small_batches(spark)
    table = counts.select("a_id", "b_id", "n", "best").toArrow()
    pair = _pairs(*(table.column(c).to_numpy() for c in ("a_id", "b_id")))
    by_pair = np.argsort(pair)
    known = spark.sparkContext.broadcast(
        (pair[by_pair], table.column("n").to_numpy()[by_pair], table.column("best").to_numpy()[by_pair])
    )
    rest = [name for name in aligned.columns if name not in (*PARTS, *PACKED, *SCORES)]

    def run(batches):
        pairs, n, best = known.value
        marked = Strings([f"{i}{mark}".encode() for marks in (",|", ",;") for i in range(MOST_IDS) for mark in marks])
        for batch in batches:
            rows = Rows(batch)
            at = np.searchsorted(pairs, _pairs(*rows.links()))
            held = rows.groups()
            to = held.cumsum()
            sums = []
            for values in (best, n):
                upto = np.r_[0, values[at].cumsum(dtype=np.int64)]
                sums.append(upto[to] - upto[to - held])
            digests = [hashlib.sha256(_order(*row, marked)).hexdigest() if len(row[0]) else "" for row in rows.each()]
            tokens = [*rows.n, held]
            columns = [*tokens, held, *sums]
            arrays = [*map(batch.column, rest), *map(pa.array, columns), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *SCORES])

    shape = T.StructType([aligned.schema[name] for name in rest])
    for name in SCORES:
        shape = shape.add(name, "string" if name == "groups_sha256" else "long")
    return aligned.select(*rest, *_names(aligned)).mapInArrow(run, shape)


SCORES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
