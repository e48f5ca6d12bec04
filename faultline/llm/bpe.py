"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

A task takes its texts in blocks of about ``BLOCK_BYTES``.  Each text becomes the positions
of its pre-tokens in the block's list of distinct words, and the list is dealt to
``WORD_BUCKETS`` buckets by a hash of the word.  The task of a bucket gets a word once
for every block that holds it, encodes each distinct word of the corpus once, and
returns the ids to the blocks.  There the texts are put together by position.  Words and
positions travel packed: a row for each block and bucket, and for each text.  Decoding
joins every id with the byte string of its token, a table as large as the vocabulary,
on the map side.

Words and positions come from two passes over ``docs``, which must be read from files
(stage other tables first): a block is named by its task and place, so each pass, and a
task that is run again, must see the same rows in the same order, as file scans do.

Null text is empty: no ids.  Repeated rows repeat; an empty table gives an empty result.
Only doc_id and text are read.
"""

import hashlib
import zlib
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import vocab
from faultline.llm.base import Memo, blank_cut, small_batches, text_columns

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Buckets of distinct words; the words of a bucket must fit into a task.
WORD_BUCKETS = 1024

PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)

def pre_tokens(text):
    return PRE_TOKEN.findall(text)


def _packed(array):
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(array.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data):
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)


class Block:
    """Texts of one task, and their distinct words numbered as they come."""

    def __init__(self, key, buckets):
        self.key, self.buckets = key, buckets
        self.words, self.rows, self.size = {}, [], 0
        # the block's size bounds both caches
        self.heads = Memo(self._places, entries=float("inf"))
        self.rest = Memo(self._rest_places, entries=float("inf"))

    def _place(self, word):
        return self.words.setdefault(word, len(self.words)).to_bytes(4, "little")

    def _places(self, chunk):
        return b"".join(map(self._place, pre_tokens(chunk)))

    def _rest_places(self, word):
        # letters alone are one pre-token with their blank
        return self._place(f" {word}") if word.isalpha() else self._places(f" {word}")

    def add(self, doc_id, text, keep):
        first, rest = blank_cut(text)
        places = [self.heads[first], *map(self.rest.__getitem__, rest)]
        self.size += len(text)
        if keep:
            self.rows.append((doc_id, _packed(np.frombuffer(b"".join(places), "<u4"))))

    def word_rows(self):
        """(bucket, block, words, numbers): the block's words dealt to buckets."""
        dealt = {}
        for word, place in self.words.items():
            data = word.encode()
            dealt.setdefault(zlib.crc32(data) % self.buckets, []).append((data, place))
        for bucket, items in dealt.items():
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(d for d, _ in items))
            numbers = np.array([[len(d) for d, _ in items], [p for _, p in items]]).reshape(-1)
            yield bucket, self.key, data, _packed(numbers)

    def text_rows(self):
        """(block, doc_id, places) of each text."""
        for doc_id, places in self.rows:
            yield self.key, doc_id, places


def _blocks(batches, block_bytes, buckets, keep):
    """The blocks of a task; the same for every pass over the same rows."""
    block = Block(TaskContext.get().partitionId() << 32, buckets)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for doc_id, text in zip(ids, texts, strict=True):
            block.add(doc_id, text, keep)
            if block.size >= block_bytes:
                yield block
                block = Block(block.key + 1, buckets)
    yield block


def _batches(rows, shape):
    """Record batches of a thousand rows."""
    while part := list(islice(rows, 1000)):
        columns = zip(*part, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
        )


WORD_ROWS = pa.schema(
    [("key", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("numbers", pa.binary())]
)


def _deal_words(block_bytes, buckets):
    def run(batches):
        for block in _blocks(batches, block_bytes, buckets, keep=False):
            yield from _batches(block.word_rows(), WORD_ROWS)

    return run


def _deal_texts(block_bytes, id_type):
    shape = pa.schema([("key", pa.int64()), ("doc_id", id_type), ("data", pa.binary())])

    def run(batches):
        for block in _blocks(batches, block_bytes, 1, keep=True):
            yield from _batches(block.text_rows(), shape)

    return run


def _encode_words(file):
    """For each block of a bucket: word places, token counts and ids of its words."""

    def run(batches):
        coder, bucket, known = vocab.ranked(file), None, None
        for batch in batches:
            made = []
            for key, block, data, numbers in zip(
                *(batch.column(n).to_pylist() for n in ("key", "block", "data", "numbers")), strict=True
            ):
                if key != bucket:
                    bucket = key
                    known = Memo(
                        lambda w: np.array(coder.encode_ordinary(w.decode()), "<u4").tobytes(),
                        entries=float("inf"),
                    )
                lengths, places = _unpacked(numbers).reshape(2, -1)
                text = zstandard.ZstdDecompressor().decompress(data)
                ends = np.cumsum(lengths).tolist()
                words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                ids = [known[w] for w in words]
                counts = np.array([len(i) // 4 for i in ids])
                made.append((block, _packed(np.stack([places, counts]).reshape(-1)), _packed(np.frombuffer(b"".join(ids), "<u4"))))
            columns = zip(*made, strict=True) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                names=["key", "places", "ids"],
            )

    return run


def _assemble(docs, words):
    """The ids of every text of a block, by the positions of its words."""
    places, counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
    for numbers, packed in zip(words.column("places").to_pylist(), words.column("ids").to_pylist(), strict=True):
        at, n = _unpacked(numbers).reshape(2, -1)
        places.append(at)
        counts.append(n)
        ids.append(_unpacked(packed))
    places, counts, ids = (np.concatenate(x).astype(np.int64) for x in (places, counts, ids))
    # by place: how many ids a word has and where they begin
    size, begin = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    size[places], begin[places] = counts, np.cumsum(counts) - counts
    ids, ends, parts = ids.astype(np.int32), [0], []
    for data in docs.column("data").to_pylist():
        words_here = _unpacked(data)
        n = size[words_here]
        last = np.cumsum(n)
        total = int(last[-1]) if len(last) else 0
        parts.append(ids[np.repeat(begin[words_here] - last + n, n) + np.arange(total)])
        ends.append(ends[-1] + total)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return pa.Table.from_arrays([docs.column("doc_id"), lists], names=["doc_id", "ids"])


def encode(docs, ranks=None, block_bytes=BLOCK_BYTES, buckets=WORD_BUCKETS):
    """doc_id and ids (array of int) of every row."""
    file = ranks or vocab.path(RANKS)
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_field = docs.schema["doc_id"]
    id_type = pa.int32() if isinstance(id_field.dataType, T.IntegerType) else pa.int64()
    shape = T.StructType.fromDDL("key long").add(id_field).add("data", "binary")
    listed = texts.mapInArrow(
        _deal_words(block_bytes, buckets), "key long, block long, data binary, numbers binary"
    )
    back = (
        listed.repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(_encode_words(file), "key long, places binary, ids binary")
    )
    placed = texts.mapInArrow(_deal_texts(block_bytes, id_type), shape)
    made = T.StructType([id_field, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return placed.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(_assemble, made)


def _rows(column):
    """The integers of each row of a list column."""
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def _per_ids(frame, columns, compute):
    return text_columns(frame, columns, compute, source="ids", rows=_rows)


def decode(encoded, ranks=None):
    """doc_id and text of every row of doc_id and ids."""
    file = ranks or vocab.path(RANKS)

    def texts(rows):
        table = vocab.token_bytes(file)
        return [[b"".join(map(table.__getitem__, ids)).decode(errors="replace") for ids in rows]]

    return _per_ids(encoded, {"text": "string"}, texts)


def digests(encoded, ranks=None):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of doc_id and ids."""
    file = ranks or vocab.path(RANKS)

    def digest(rows):
        table = vocab.token_bytes(file)
        decimal = [b"%d" % i for i in range(len(table))]
        sha = lambda parts, by: hashlib.sha256(by.join(parts)).hexdigest()
        of_ids = [sha(map(decimal.__getitem__, ids), b",") for ids in rows]
        of_bytes = [sha(map(table.__getitem__, ids), b"") for ids in rows]
        return [list(map(len, rows)), of_ids, of_bytes]

    shape = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    return _per_ids(encoded, shape, digest)
