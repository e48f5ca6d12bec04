"""The scorer of shared cases against a plain restatement, without a session."""

import random

import pyarrow as pa
import pytest

from faultline.operators import scoring

STRINGS = pa.list_(pa.string())


class Text(bytes):
    """A text that counts how often a term is looked for in it."""

    tests = 0

    def __contains__(self, term):
        Text.tests += 1
        return bytes(self).find(term) >= 0


def shared_of(lists, entries, cases):
    """One row as Spark hands it over; entries are (id, first, places), cases (id, installation, model, power, text)."""
    names = ["installation_id", "vehicle_model", "engine_power"]
    kind = pa.struct([
        ("lists", pa.map_(pa.string(), pa.list_(pa.int32()))),
        ("entries", pa.list_(pa.struct([("entry", pa.int32()), ("id", pa.string()), ("first", pa.int32()), ("places", pa.list_(pa.int32()))]))),
        ("cases", pa.list_(pa.struct([("place", pa.int32()), ("id", pa.string()), *[(n, pa.string()) for n in names], ("closed_at", pa.int64()), ("text", pa.string())]))),
    ])
    value = {
        "lists": list(lists.items()),
        "entries": [{"entry": i, "id": e[0], "first": e[1], "places": e[2]} for i, e in enumerate(entries)],
        "cases": [
            {"place": i, "id": c[0], **dict(zip(names, c[1:4], strict=True)), "closed_at": -i, "text": c[4]}
            for i, c in enumerate(cases)
        ],
    }
    return pa.array([value], kind)


def batch_of(given, queries):
    """Queries are (id, names, installation, model, power, codes, symptoms, words)."""
    kinds = [pa.string(), STRINGS, pa.string(), pa.string(), pa.string(), STRINGS, STRINGS, STRINGS]
    names = ["query_id", "names", "asking_installation", "asked_model", "asked_power", "q_codes", "q_symptoms", "q_words"]
    columns = [pa.array(list(column), kind) for column, kind in zip(zip(*queries, strict=True), kinds, strict=True)]
    shared = pa.concat_arrays([given, pa.nulls(len(queries) - 1, given.type)])
    return pa.RecordBatch.from_arrays([*columns, shared], names=[*names, "given"])


def plain(lists, entries, cases, queries, limit, needed, most):
    out = []
    for qid, names, installation, model, power, codes, symptoms, words in queries:
        newest, seen = [], set()
        for entry in sorted({e for name in names for e in lists.get(name, [])}):
            if entries[entry][1] not in seen:
                seen.add(entries[entry][1])
                newest.append(entries[entries[entry][1]])
        scored = []
        for place in [p for entry in newest[:limit] for p in entry[2] or []]:
            _, held, its_model, its_power, text = cases[place]

            def found(terms, text=text):
                return sum(term is not None and term in text for term in terms)

            tenths = 40 * found(codes) + 15 * found(symptoms) + min(20, 3 * found(words))
            tenths += 30 * (bool(model) and model == its_model) + 20 * (bool(power) and power == its_power)
            own = installation is not None and installation == held
            if needed is None or tenths >= needed[not own]:
                scored.append((-(2 * tenths + own), place, tenths, own))
        for rank, (_, place, tenths, own) in enumerate(sorted(scored)[:most], 1):
            out.append((qid, rank, cases[place][0], -place, own, tenths))
    return out


def world(seed, n_cases=150, n_queries=200):
    pick = random.Random(seed)
    words = ["", "ventil", "únik", "oleje", "turbo", "tur", "P0003", "čidlo", *[f"w{i}" for i in range(90)]]

    def maybe(*values):
        return pick.choice([None, "", *values])

    cases = [
        (f"c{i // 2}", maybe("i1", "i2"), maybe("M1", "M2"), maybe("1", "2"), " ".join(pick.choices(words, k=8)))
        for i in range(n_cases)
    ]
    # two cases an id, ids that come twice, and ids without a case
    entries = [(f"c{i // 2}", i // 2 * 2, [i // 2 * 2, i // 2 * 2 + 1]) for i in range(n_cases)]
    entries += [(None, n_cases, None), ("gone", n_cases + 1, None)]
    lists = {f"l{i}": pick.sample(range(len(entries)), 40) for i in range(9)}
    queries = [
        (f"q{i}", pick.sample([*lists, "none"], pick.randint(0, 3)), maybe("i1", "i2", "i3"), maybe("M1", "M2", "M3"), maybe("1"),
         *[pick.choices([*words, None], k=pick.randint(0, 6)) for _ in range(2)], pick.choices(words, k=12))
        for i in range(n_queries)
    ]
    return lists, entries, cases, queries


@pytest.mark.parametrize("most, needed", [(5, (50, 80)), (3, (0, 0)), (None, None)])
@pytest.mark.parametrize("bits", [4096, 64, 1])
def test_scorer_equals_a_plain_one(monkeypatch, most, needed, bits):
    monkeypatch.setattr(scoring, "MAX_BITS", bits)
    lists, entries, cases, queries = world(bits)
    batches = [batch_of(shared_of(lists, entries, cases), queries[i : i + 70]) for i in range(0, len(queries), 70)]
    found = [row for out in scoring.scorer(25, needed, most)(batches) for row in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    assert found == plain(lists, entries, cases, queries, 25, needed, most) and found


def test_no_hits_and_no_cases():
    nothing = shared_of({}, [], [])
    row = ("q", ["l1"], "i", "M", "1", ["a"], [], [])
    assert not sum(out.num_rows for out in scoring.scorer(25, (50, 80), 5)([batch_of(nothing, [row, row])]))


def test_a_term_is_not_looked_for_again_in_every_pair():
    """Many queries of few terms: a case is tested once a term, not once a pair."""
    lists, entries, cases, _ = world(1)
    queries = [(f"q{i}", ["l1", "l2", "l3"], None, None, None, ["P0003"], ["turbo"], ["oleje"] * 5) for i in range(500)]
    shared = scoring._Shared(shared_of(lists, entries, cases), 25)
    shared.terms.texts = [Text(text) for text in shared.terms.texts]
    Text.tests = 0
    for _ in scoring._scored(shared, batch_of(shared_of(lists, entries, cases), queries), (50, 80), 5):
        pass
    assert 0 < Text.tests <= 3 * len(cases)


def test_rare_terms_are_looked_for_in_candidates_only():
    lists, entries, cases, _ = world(2)
    query = ("q", ["l1"], None, None, None, ["P0003"], [], ["oleje"])
    shared = scoring._Shared(shared_of(lists, entries, cases), 5)
    shared.terms.texts = [Text(text) for text in shared.terms.texts]
    Text.tests = 0
    list(scoring._scored(shared, batch_of(shared_of(lists, entries, cases), [query]), None, None))
    assert 0 < Text.tests <= 2 * 5 * 2
