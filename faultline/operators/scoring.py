"""Scores of query rows against cases that every task holds, in the workers that read the rows.

A task gets lists and cases once, with its first row.  A term is looked for in the cases of
the query that has it; once it has been looked for about as often as there are cases, it is
looked for in all of them and gets a bit in each (``MAX_BITS`` terms have one), so a task's
tests are at most about twice the fewest possible.  A pair then counts the common bits of
its query and its case.  Terms are compared as bytes, so a term is found where Spark's
``contains`` finds it.  What is counted follows ``functions/similarity.py``.
"""

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from faultline import fixed_values as fv

#: Terms that have a bit in each case of a task, and bytes of these bits.
MAX_BITS = 4096
HELD_BYTES = 64 << 20
#: Terms whose uses a task counts.
COUNTED_TERMS = 200_000
#: Query rows that are scored together, and their hits that leave together.
ROWS = 64
ROWS_OUT = 512
#: Numbers of values: missing among the cases, and matching nothing.
MISSING, NOTHING = -1, -2


def _raw(array):
    """Strings as their bytes; other values as they are."""
    if pa.types.is_string(array.type):
        return array.cast(pa.binary())
    if pa.types.is_large_string(array.type):
        return array.cast(pa.large_binary())
    return array


def _numbers(array):
    return array.to_numpy(zero_copy_only=False)


def _starts(lengths):
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _lengths(lists):
    return _numbers(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _runs(starts, lengths):
    """The places start, start + 1 and so on of each run, one run behind the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _changes(ordered):
    """Whether each of some ordered values is another than the one before."""
    return np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])


def _places_within(lengths):
    return _runs(np.zeros(len(lengths), np.int64), lengths)


def _encoded(array):
    """The distinct values, and the number of each value's among them; of a null ``MISSING``."""
    encoded = _raw(array).dictionary_encode()
    return encoded.dictionary.to_pylist(), _numbers(pc.fill_null(encoded.indices, MISSING)).astype(np.int64)


class _Attribute:
    """One column of the cases as numbers, to compare with one of the queries."""

    def __init__(self, held):
        values, self.held = _encoded(held)
        self.number = {value: i for i, value in enumerate(values)}

    def asked(self, column, given=lambda value: True):
        """The number each row's value has among the cases, else ``NOTHING``."""
        values, places = _encoded(column)
        numbers = [self.number.get(value, NOTHING) if given(value) else NOTHING for value in values]
        return np.array([*numbers, NOTHING], np.int64)[places]


class _Terms:
    """Which cases contain a term, as a bit of each case."""

    def __init__(self, texts):
        self.texts = texts
        self.most = min(MAX_BITS, max(64, 8 * HELD_BYTES // max(1, len(texts)) // 64 * 64))
        self._clear()

    def _clear(self):
        self.places, self.uses = {}, {}
        self.bits = np.zeros((len(self.texts), 1), np.uint64)

    def _keep(self, term):
        place = len(self.places)
        if place == 64 * self.bits.shape[1]:
            wider = min(2 * self.bits.shape[1], self.most // 64)
            self.bits = np.pad(self.bits, ((0, 0), (0, wider - self.bits.shape[1])))
        found = np.fromiter((term in text for text in self.texts), np.uint64, len(self.texts))
        self.bits[:, place // 64] |= found << np.uint64(place % 64)
        self.places[term] = place

    def look_up(self, columns, tests):
        """Give each column the bits of its terms, ``MISSING`` where they are looked for in the
        candidates.  ``tests`` says how many cases a query has."""
        now = {}
        for term, uses in chain.from_iterable(column.uses() for column in columns):
            if term not in self.places:
                now[term] = now.get(term, 0) + uses
                self.uses[term] = self.uses.get(term, 0) + uses
        worth = [term for term in now if self.uses[term] * tests >= len(self.texts)]
        if len(self.places) + len(worth) > self.most or len(self.uses) > COUNTED_TERMS:
            # begin again with the terms of this batch
            self._clear()
            now = Counter()
            for term, uses in chain.from_iterable(column.uses() for column in columns):
                now[term] += uses
            worth = [term for term in now if now[term] * tests >= len(self.texts)]
        for term in sorted(worth, key=now.get, reverse=True)[: self.most]:
            self._keep(term)
            self.uses.pop(term, None)
        for column in columns:
            column.places = np.array([self.places.get(term, MISSING) for term in column.names], np.int64)


class _Shared:
    """Lists, entries and cases as ``search._shared_lists`` gives them, and what follows from them."""

    def __init__(self, given, limit):
        lists, entries, cases = given.flatten()
        names, held = lists[0].values.flatten()
        self.number = {name: i for i, name in enumerate(_raw(names).to_pylist())}
        self.list_lengths, self.listed = _lengths(held), _numbers(held.flatten())
        self.list_starts = _starts(self.list_lengths)[:-1]
        _, _, first, places = entries.flatten().flatten()
        self.first = _numbers(first).astype(np.int64)
        self.single = bool((self.first == np.arange(len(self.first))).all())
        self.place_lengths, self.places = _lengths(places), _numbers(places.flatten()).astype(np.int64)
        self.place_starts = _starts(self.place_lengths)[:-1]
        _, self.ids, installation, model, power, self.closed_at, text = cases.flatten().flatten()
        self.installation, self.model, self.power = (_Attribute(x) for x in (installation, model, power))
        self.terms = _Terms(_raw(text).to_pylist())
        self.limit = limit

    def candidates(self, lists, rows, n_rows):
        """(row, place) of the newest cases of each row's lists; ``rows`` says whose a list is."""
        lengths = self.list_lengths[lists]
        size = max(1, len(self.first))
        # small numbers sort faster
        kind = np.int32 if n_rows * size < 1 << 31 else np.int64
        met = self.listed[_runs(self.list_starts[lists], lengths)].astype(kind)
        met += np.repeat((rows * size).astype(kind), lengths)
        met.sort()
        met = met[_changes(met)]
        row, entry = np.divmod(met.astype(np.int64), size)
        if not self.single:
            # the first entry of each id, where it comes first
            _, at = np.unique(row * size + self.first[entry], return_index=True)
            at.sort()
            row, entry = row[at], self.first[entry[at]]
        kept = _places_within(np.bincount(row, minlength=n_rows)) < self.limit
        row, entry = row[kept], entry[kept]
        lengths = self.place_lengths[entry]
        return np.repeat(row, lengths), self.places[_runs(self.place_starts[entry], lengths)]


class _Asked:
    """The terms of one column in a batch of queries, numbered; a null term is found nowhere."""

    def __init__(self, lists, weight):
        self.weight = weight
        lengths, items = _lengths(lists), lists.flatten()
        if items.null_count:
            given = _starts(_numbers(items.is_valid()))[_starts(lengths)]
            lengths, items = np.diff(given), items.drop_null()
        self.starts = _starts(lengths)
        self.names, self.numbers = _encoded(items)

    def uses(self):
        return zip(self.names, np.bincount(self.numbers, minlength=len(self.names)).tolist(), strict=True)

    def found(self, terms, at, end, row, place):
        """How many terms of rows ``at`` to ``end`` each pair (row, place) holds."""
        inside = slice(self.starts[at], self.starts[end])
        numbers = self.numbers[inside]
        whose = np.repeat(np.arange(end - at), np.diff(self.starts[at : end + 1]))
        bit, counts = self.places[numbers], np.zeros(len(row), np.int64)
        known = bit >= 0
        if known.any():
            held = terms.bits[place]
            for mask in _masks(whose[known], bit[known], end - at, held.shape[1]):
                counts += np.bitwise_count(held & mask[row]).sum(axis=1, dtype=np.int64)
        ends = np.searchsorted(row, np.arange(end - at + 1))
        for one in np.flatnonzero(~known):
            term, its = self.names[numbers[one]], slice(*ends[whose[one] : whose[one] + 2])
            counts[its] += np.fromiter((term in terms.texts[i] for i in place[its]), np.int64)
        return counts


def _masks(rows, bits, n_rows, width):
    """One mask of bits a row for first uses, one for second uses, until all are in one."""
    own = np.sort(rows * (64 * width) + bits)
    while len(own):
        first = _changes(own)
        row, bit = np.divmod(own[first], 64 * width)
        mask = np.zeros(n_rows * width, np.uint64)
        np.bitwise_or.at(mask, row * width + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        yield mask.reshape(n_rows, width)
        own = own[~first]


def _best_first(row, value, place):
    """The order by row, highest value and place."""
    top, size = int(value.max(initial=0)), int(place.max(initial=0)) + 1
    if ROWS * (top + 1) * size >= 1 << 63 or value.min(initial=0) < 0:
        return np.lexsort((place, -value, row))
    return np.argsort((row * (top + 1) + top - value) * size + place)


def _given(value):
    return value not in (b"", "")


def _scored(shared, batch, needed, most):
    """(row, place, tenths, is_own) of a batch's hits, best first in each row, some rows at a time."""
    codes, symptoms, words = asked = [
        _Asked(batch.column(name), weight)
        for name, weight in (
            ("q_codes", fv.CODE_TENTHS), ("q_symptoms", fv.SYMPTOM_TENTHS), ("q_words", fv.WORD_TENTHS)
        )
    ]
    shared.terms.look_up(asked, shared.limit)
    models = shared.model.asked(batch.column("asked_model"), _given)
    powers = shared.power.asked(batch.column("asked_power"), _given)
    installations = shared.installation.asked(batch.column("asking_installation"))
    read = batch.column("names")
    list_starts = _starts(_lengths(read))
    names, numbers = _encoded(read.flatten())
    lists = np.array([shared.number.get(name, MISSING) for name in names], np.int64)[numbers]
    for at in range(0, batch.num_rows, ROWS):
        end = min(at + ROWS, batch.num_rows)
        whose = np.repeat(np.arange(end - at), np.diff(list_starts[at : end + 1]))
        its = lists[list_starts[at] : list_starts[end]]
        row, place = shared.candidates(its[its >= 0], whose[its >= 0], end - at)
        found = [one.weight * one.found(shared.terms, at, end, row, place) for one in (codes, symptoms, words)]
        tenths = found[0] + found[1] + np.minimum(found[2], fv.WORD_TENTHS_MAX)
        tenths += fv.MODEL_TENTHS * (shared.model.held[place] == models[at:end][row])
        tenths += fv.POWER_TENTHS * (shared.power.held[place] == powers[at:end][row])
        own = shared.installation.held[place] == installations[at:end][row]
        if needed is not None:
            kept = tenths >= np.where(own, *needed)
            row, place, tenths, own = row[kept], place[kept], tenths[kept], own[kept]
        best = _best_first(row, 2 * tenths + own, place)
        if most is not None:
            best = best[_places_within(np.bincount(row, minlength=end - at)) < most]
        yield at + row[best], place[best], tenths[best], own[best]


def _hits(shared, query_ids, rows, places, tenths, own):
    at = pa.array(places)
    ranks = _places_within(np.bincount(rows, minlength=len(query_ids))) + 1
    made = {
        "query_id": query_ids.take(pa.array(rows)),
        "hit_rank": pa.array(ranks.astype(np.int32)),
        "case_id": shared.ids.take(at),
        "closed_at": shared.closed_at.take(at),
        "is_own": pa.array(own),
        "tenths": pa.array(tenths.astype(np.int32)),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def scorer(limit, needed, most):
    """A function of Arrow batches: the scored pairs of each row, best first, or its best ``most``.

    ``needed`` are the tenths that an own case and another must reach, if any.  The column
    ``given`` holds lists and cases in the first row of a task.
    """

    def run(batches):
        shared = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shared is None:
                shared = _Shared(batch.column("given").slice(0, 1), limit)
            held = []
            for part in _scored(shared, batch, needed, most):
                held.append(part)
                if len(held) * ROWS >= ROWS_OUT:
                    yield _hits(shared, batch.column("query_id"), *map(np.concatenate, zip(*held, strict=True)))
                    held = []
            if held:
                yield _hits(shared, batch.column("query_id"), *map(np.concatenate, zip(*held, strict=True)))

    return run
