"""Broken documents are told apart from cases."""

from faultline import schemas
from faultline.sources import readers

ROWS = [
    ("1", '{"id": "a", "tokenCount": 3, "vehicle": {"brand": "B"}}', None),
    ("2", '{"id": "b", "tokenCount": 3', "unreadable"),
    ("3", '{"id": "c", "tokenCount": "many"}', "unreadable"),
    ("4", None, "missing"),
    ("5", "", "not_an_object"),
    ("6", '["x"]', "not_an_object"),
    ("7", "null", "not_an_object"),
    ("8", "  {}", None),
    ("9", '{"other": 1, "id": null}', None),
    ("9", "a text that is no document", "not_an_object"),
]


def test_each_row_is_a_case_or_quarantined(table):
    sessions = table([(i, data, "s", "t") for i, data, _ in ROWS], "id string, data string, status string, created_at string")
    readable, quarantined = readers.split_sessions(sessions, schemas.CASE_DOCUMENT)
    kept, turned = readable.collect(), quarantined.collect()
    assert sorted(r["_rowId"] for r in kept) == [i for i, _, reason in ROWS if reason is None]
    assert sorted(map(str, ((r["id"], r["raw"], r["reason"]) for r in turned))) == sorted(str(r) for r in ROWS if r[2])
    valid = table([(i, data, "s", "t") for i, data, reason in ROWS if not reason], "id string, data string, status string, created_at string")
    plain = readers.parse_sessions(valid)
    assert readable.columns == plain.columns
    assert sorted(map(str, kept)) == sorted(map(str, plain.collect()))


def test_no_sessions(table):
    both = readers.split_sessions(table([], "id string, data string, status string, created_at string"))
    assert [frame.count() for frame in both] == [0, 0]
