"""Spelling variants by permuterm rotations.

Words are maximal runs of letters, A-Z lowered, counted in the tasks and then by a
shuffle; those of ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences are kept and numbered in
code-point order (by a range sort, so that ids compare like words).

A word w is marked with a terminator and rotated, w[j:] $ w[:j] for every j.  Two words
that differ by a replaced character have rotations that agree in all but the last
character; of two words that differ by an inserted one, the whole rotation of the shorter
is the longer one's without its last character.  So every rotation is entered under itself
and under its prefix without the last character, the edited one, and all entries are sorted by that
key.  The words of a key are all near each other: at most one for each letter, and the
shorter word.  A scan gives each of them the number of its near words there and the one
of largest count.  A pair that differs by a replacement meets under one key; a pair that
differs by an indel within a run of equal characters meets under several, and is counted
at the first character of the run.  No pairs are formed.

Keys of over ``WHOLE_KEY`` characters are replaced by their length and a fingerprint of
127 bits, computed for all rotations of a word in one pass, so entries of a very long
word stay as small as others.

Null texts hold no words.  Each row counts: repeated rows and repeated ids count again.
A null doc_id hashes like an empty one.  Ties of count go to the word that is smaller
in code-point order.  Tables without a frequent word give an empty result.  Columns other
than doc_id and text are not read.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from faultline.llm.base import small_batches, stage

MIN_CHARS = 6
MIN_COUNT = 5
#: A near word is a word's form if it is this many times as frequent.
TIMES = 5
#: One hash in so many deletes a code point of a run.
DELETE_ONE_IN = 199
#: Distinct words and characters a task holds before it passes its counts on.
HELD_WORDS = 200_000
HELD_CHARS = 16 << 20
#: Rows of entries in a batch.
ENTRY_ROWS = 20_000
WHOLE_KEY = 64
END = "$"

RUN = re.compile("[a-zÀ-ÿ]+")
_PRIME = (1 << 127) - 1
_BASE = 0x5DEECE66D1234567890ABCDEF


def runs(text):
    """Occurrences of each lowered run of a text."""
    return Counter(RUN.findall(text.encode().lower().decode()))


def altered(prefix, run):
    """The run as it counts in the document whose id has the checksum ``prefix``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % DELETE_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counts(batches):
    held, chars = Counter(), 0

    def passed():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            prefix = zlib.crc32(f"{doc}:".encode())
            for run, n in runs(text).items():
                word = altered(prefix, run)
                if len(word) >= MIN_CHARS:
                    if word not in held:
                        chars += len(word)
                    held[word] += n
            if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                yield passed()
                held, chars = Counter(), 0
    yield passed()


def words(docs, min_count=MIN_COUNT):
    """id, word and n of every frequent word; ids are in code-point order."""
    small_batches(docs.sparkSession)
    texts = docs.filter("text is not null").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text"
    )
    counted = texts.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sorted_words = counted.filter(F.col("n") >= min_count).orderBy("word")
    return stage(sorted_words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


def _fingerprints(word):
    """A function from (a, b) to the key of word[b:] $ word[:a], for long words."""
    head, power = [0], [1]
    for char in word:
        head.append((head[-1] * _BASE + ord(char)) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    size = len(word)

    def key(a, b):
        tail = head[size] - head[b] * power[size - b]
        value = ((tail * _BASE + ord(END)) * power[a] + head[a]) % _PRIME
        return f"{a + size - b}:{value:x}"

    return key


def _keys(word):
    if len(word) > WHOLE_KEY:
        long = _fingerprints(word)
    else:
        long = None

    def key(a, b):
        if a + len(word) - b > WHOLE_KEY:
            return long(a, b)
        return f"{word[b:]}{END}{word[:a]}"

    return key


def entries(word):
    """(key, whole, first) of all rotations: under themselves and under their prefixes.

    ``whole`` marks the former; ``first`` marks, of the latter, those whose edited
    character opens a run of equal ones.
    """
    key, size = _keys(word), len(word)
    for at in range(size + 1):
        yield key(at, at), True, False
        if at:
            yield key(at - 1, at), False, at == 1 or word[at - 2] != word[at - 1]


def _rotate(batches):
    names = ["key", "id", "n", "whole", "first"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def made(rows):
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = []
    for batch in batches:
        for id_, word, n in zip(*(batch.column(c).to_pylist() for c in ("id", "word", "n")), strict=True):
            for key, whole, first in entries(word):
                rows.append((key, id_, n, whole, first))
                if len(rows) == ENTRY_ROWS:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def _near(table):
    """Near words and the best of them for every entry of whole keys, sorted by key, n (descending) and id."""
    keys = table.column("key")
    change = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, change])
    sizes = np.diff(np.r_[starts, len(keys)])
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    whole, first = (table.column(c).to_numpy(zero_copy_only=False) for c in ("whole", "first"))
    group = np.repeat(np.arange(len(starts)), sizes)
    wholes, firsts = (np.add.reduceat(x.astype(np.int64), starts)[group] for x in (whole, first))
    n_near = np.where(whole, firsts, sizes[group] - wholes - 1 + (first & (wholes > 0)))
    best = starts[group]
    best = np.where(np.arange(len(ids)) == best, np.minimum(best + 1, len(ids) - 1), best)
    met = sizes[group] > 1
    return pa.RecordBatch.from_arrays(
        [pa.array(x[met]) for x in (ids, n_near, n[best], ids[best])], names=["id", "n_near", "best_n", "best"]
    )


def _scan(batches):
    """``_near`` of a partition; the last key of a batch may go on in the next one."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if kept is None else [*kept, batch]).combine_chunks()
        keys = table.column("key").combine_chunks()
        last = pc.index(keys, keys[len(keys) - 1]).as_py()
        kept = table.slice(last).to_batches()
        if last:
            yield _near(table.slice(0, last).combine_chunks().to_batches()[0])
    if kept:
        yield _near(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])


def neighbours(known):
    """id, n_near and the best near word (best_n, best) of every word that has one."""
    entered = known.mapInArrow(_rotate, "key string, id long, n long, whole boolean, first boolean")
    order = entered.repartition("key").sortWithinPartitions("key", F.desc("n"), "id")
    near = order.mapInArrow(_scan, "id long, n_near long, best_n long, best long")
    found = near.groupBy("id").agg(
        F.sum("n_near").alias("n_near"), F.max(F.struct("best_n", (-F.col("best")).alias("back"))).alias("top")
    )
    return found.select("id", "n_near", F.col("top.best_n").alias("best_n"), (-F.col("top.back")).alias("best"))


def follow(forms):
    """(id, root) from (id, form): the end of each chain, by doubling.

    A form is ``TIMES`` times as frequent as its word, so chains are short and have no cycles.
    """
    reached = forms.select("id", F.col("form_id").alias("root"))
    while True:
        ahead = reached.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        stepped = reached.join(ahead, F.col("root") == F.col("_id"), "left").select(
            "id", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")
        )
        reached = stage(stepped, "spelling-roots")
        if not reached.filter("moved").limit(1).count():
            return reached.select("id", "root")


def variants(docs, min_count=MIN_COUNT, times=TIMES):
    """word, form, root, n, n_near and form_n of every frequent word."""
    known = words(docs, min_count)
    near = stage(neighbours(known), "spelling-near")
    taken = known.join(near, "id").filter(F.col("best_n") >= times * F.col("n"))
    forms = stage(taken.select("id", F.col("best").alias("form_id"), F.col("best_n").alias("form_n")), "spelling-forms")
    roots = follow(forms)
    named = known.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
    form = forms.join(named, F.col("form_id") == F.col("_id")).select("id", F.col("_word").alias("form"), "form_n")
    root = roots.join(named, F.col("root") == F.col("_id")).select("id", F.col("_word").alias("root"))
    joined = known.join(near.select("id", "n_near"), "id", "left").join(form, "id", "left").join(root, "id", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"
    )
