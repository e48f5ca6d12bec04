"""Spelling variants, tokenizer alignment and line removal against plain restatements."""

import hashlib
import json
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from faultline.llm import alignment, line_dedup, queries, spelling, vocab
from faultline.llm.base import stage

BLANKS = " \t\n\r\x0b\x0c"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- 11: spelling variants ------------------------------------------------------------


def plain_words(rows):
    seen = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[word] = best if best and n[best] >= 5 * n[word] else None
    out = Counter()
    for word in n:
        root = word
        while form[root]:
            root = form[root]
        out[word, form[word], root, n[word], len(near[word]), n.get(form[word])] += 1
    return out


def variant_rows():
    draw = random.Random(11)
    base = ["".join(draw.choices("abcà÷ÿ", k=draw.randint(5, 9))) for _ in range(40)]
    base += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "bbaabb", "bbaaabb", "x" * 70, "x" * 69, "x" * 64, "x" * 65]
    long = "".join(draw.choices("abcd", k=300))
    base += [long, long[:120] + long[121:], long[:200] + "z" + long[201:], "ab" * 40, "ba" * 40]
    words = []
    for word in base:
        words += [word] * draw.choice([5, 6, 30, 200])
        for _ in range(3):
            at = draw.randrange(len(word))
            other = draw.choice([word[:at] + word[at + 1 :], word[:at] + "q" + word[at:], word[:at] + "Z" + word[at + 1 :]])
            words += [other] * draw.choice([1, 5, 7, 40])
    draw.shuffle(words)
    texts = [draw.choice([" ", "\n", "1", ", "]).join(words[i : i + 23]) for i in range(0, len(words), 23)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[0], (None, texts[1]), (None, None), (7, ""), (8, "-- 123 漢字")]


def variant_bag(docs):
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    return Counter(tuple(r) for r in spelling.variants(docs).select(columns).collect())


def test_variants_equal_all_pairs(spark):
    rows = variant_rows()
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n long")
    found = variant_bag(docs.repartition(5))
    assert found == plain_variants(rows)
    assert sum(1 for r in found if r[1]) > 20


def test_variants_of_odd_documents(spark, docs, rows, no_docs):
    assert variant_bag(docs) == plain_variants(rows)
    assert not spelling.variants(no_docs).count()


def test_forms_are_followed_to_the_end(spark):
    # each word five times as frequent as the one before, one letter apart
    chain = ["abcdefgh"[:i] + "z" * (8 - i) for i in range(5)]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(5 ** (i + 1)))
    rows = [(k, text) for k in (1,)]
    found = variant_bag(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == plain_variants(rows)
    assert max(sum(r[2] == root for r in found) for _, _, root, *_ in found) >= 4


def test_ties_of_count_go_to_the_smaller_word(spark):
    words = ["abcdeg"] * 25 + ["abcdea"] * 25 + ["abcdez"] * 5
    rows = [(10**6, " ".join(words))]
    found = variant_bag(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == plain_variants(rows)
    assert ("abcdez", "abcdea", "abcdea", 5, 2, 25) in found


def test_entries_of_a_very_long_word_stay_small():
    word = "ab" * 10_000
    keys = list(spelling.entries(word))
    assert len(keys) == 2 * len(word) + 1
    assert max(len(k) for k, _, _ in keys) < 100
    other = word[:777] + "c" + word[778:]
    shared = {k for k, *_ in keys} & {k for k, *_ in spelling.entries(other)}
    assert len(shared) == 1


def test_groups_may_cross_batches(spark):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spelling.words(docs)
    whole = Counter(map(tuple, spelling.neighbours(known).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert Counter(map(tuple, spelling.neighbours(known).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# --- 12: alignment ----------------------------------------------------------------------


def byte_letters():
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.letters = byte_letters()

    def tokens(self, text):
        """[(id, end)] of both sides."""
        if not text:
            return [], []
        data = f" {text}".encode()
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        a_parts = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        pieces = [self.b.id_to_piece(i) for i in b]
        b_parts = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        if b"".join(a_parts) != data or b"".join(b_parts) != data:
            return [], []
        ends = [np.cumsum([len(p) for p in parts]).tolist() for parts in (a_parts, b_parts)]
        return list(zip(a, ends[0], strict=True)), list(zip(b, ends[1], strict=True))


def plain_alignment(rows):
    coder = Plain()
    tokens = [coder.tokens(text) for _, text, *_ in rows]
    per_row = []
    for a, b in tokens:
        at = {end: i for i, end in b}
        per_row.append([(i, at[end]) for i, end in a if end in at])
    counts = Counter(pair for pairs in per_row for pair in pairs)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = Counter()
    for (doc_id, *_), (a, b), pairs in zip(rows, tokens, per_row, strict=True):
        ends = sorted({e for _, e in a} & {e for _, e in b})
        groups = [([], []) for _ in ends]
        for side, found in enumerate((a, b)):
            for i, end in found:
                groups[bisect_left(ends, end)][side].append(str(i))
        text = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        best = sum(counts[p] == highest[p[1]] for p in pairs)
        out[doc_id, len(a), len(b), len(groups), len(pairs), best, sum(counts[p] for p in pairs), sha] += 1
    return out


def alignment_bag(docs):
    aligned = stage(alignment.align(docs), "test-alignments")
    found = alignment.score(aligned, alignment.link_counts(aligned))
    return Counter(tuple(r) for r in found.select("doc_id", *alignment.SCORES).collect())


def odd_texts():
    draw = random.Random(12)
    parts = [" ", "  ", "\n", "\t", "a", "B", "the", "ing", "é", "漢字", "🙂", " ", "　", "'s", "12", "<s>", "<0x41>",
             "<|endoftext|>", "</s>", "<unk>", "\x00", " ", "!?", "ſ", "é", "\r\n", "ﬁ", "½", "​", "▁"]
    return ["".join(draw.choices(parts, k=draw.randint(1, 25))) for _ in range(700)]


def test_alignment_equals_byte_offsets(spark, docs, rows):
    assert alignment_bag(docs) == plain_alignment(rows)
    odd = [(i, t) for i, t in enumerate(odd_texts())]
    frame = spark.createDataFrame([(*r, "x", [1]) for r in odd], "doc_id long, text string, n_a string, b_ids array<int>")
    assert alignment_bag(frame.repartition(3)) == plain_alignment(odd)


def test_alignment_of_nothing(no_docs, spark):
    assert not alignment_bag(no_docs)
    rows = [(1, None), (None, ""), (2, "a▁b")]
    found = alignment_bag(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == Counter([(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows])


def test_groups_are_whole(docs):
    for row in alignment.align(docs).collect():
        assert sum(row["a_sizes"]) == len(row["a_ids"]) and sum(row["b_sizes"]) == len(row["b_ids"])
        assert len(row["a_sizes"]) == len(row["b_sizes"]) and all(row["a_sizes"]) and all(row["b_sizes"])


def test_windows_end_at_words_and_are_kept():
    made = alignment.Aligner(public_tokenizers.path(alignment.A_RANKS), public_tokenizers.path(alignment.B_MODEL))
    text = "one two unbreachable one unbreachable three one"
    made.align(text)
    data = np.frombuffer(f" {text}".encode(), np.uint8)
    a_at, b_at = made.windows(made.a.ids(text, data), made.b.ids(text, data))
    assert len(a_at) == len(b_at) == 8
    assert len(made.groups) == 1


def test_linked_pairs_are_bounded_by_the_vocabularies(docs):
    aligned = stage(alignment.align(docs), "test-alignments")
    a = vocab.token_bytes(public_tokenizers.path(alignment.A_RANKS))
    b = alignment.piece_bytes(public_tokenizers.path(alignment.B_MODEL))
    for row in alignment.link_counts(aligned).collect():
        one, two = a[row["a_id"]], b[row["b_id"]]
        assert one.endswith(two) or two.endswith(one)


def test_ranks_are_the_ids_of_the_json_file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        known = json.load(file)["model"]["vocab"]
    letters = byte_letters()
    table = vocab.token_bytes(public_tokenizers.path(alignment.A_RANKS))
    ranked = {token: i for token, i in known.items() if i < len(table)}
    assert len(ranked) == len(table)
    assert all(table[i] == bytes(letters[c] for c in token) for token, i in ranked.items())


# --- 13: line removal -------------------------------------------------------------------


def plain_dedup(rows, least=40, min_docs=5):
    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            key = lowered(line.strip(BLANKS))
            if len(key) >= least:
                held[key].add(doc_id)
    keeper = {k: max((d for d in ids if d is not None), default=None) for k, ids in held.items() if len(ids) >= min_docs}
    out = Counter()
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if (k := lowered(x.strip(BLANKS))) not in keeper or keeper[k] == doc_id]
        sha = hashlib.sha256("\n".join(left).encode()).hexdigest()
        out[doc_id, len(lines), len(lines) - len(left), sha] += 1
    return out


def dedup_bag(docs, **options):
    found = line_dedup.deduplicate(docs, **options)
    return Counter(
        (r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest())
        for r in found.select("doc_id", "n_lines", "n_dropped", "text").collect()
    )


def line_rows():
    draw = random.Random(13)
    pool = [f"{'Shared' if i % 2 else 'SHÄRED'} passage number {i} " + "word " * (i % 9) for i in range(40)]
    pool += ["x" * 39, "x" * 40, "é" * 39, "é" * 40, "漢" * 14, "İ" * 40, "İ" * 41, " " * 41, "K" * 40]
    rows = []
    for i in range(300):
        lines = [draw.choice(pool) for _ in range(draw.randint(0, 6))] + [f"a line of its own with the number {i:>12}"]
        lines = [draw.choice(["", " ", "\t", "\r", "\x0b\x0c"]) + x.swapcase() * (draw.random() < 0.2) + x + draw.choice(["", " ", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    hot = "This very common line stands in a third of all of the documents."
    rows = [(i, t + f"\n{hot}\n{hot.upper()}") if i % 3 == 0 else (i, t) for i, t in rows]
    rows += [rows[3]] * 30 + [(9, f"another text of the document\n{hot}"), (299, None), (299, ""), (1, "\n\n")]
    return rows + [(None, f"{hot}\n{pool[0]}"), (None, pool[0]), (None, None)]


def test_lines_equal_plain_removal(spark):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, n_lines int, high string, lost int")
    assert dedup_bag(docs.repartition(7)) == plain_dedup(rows)


def test_lines_of_odd_documents(docs, rows, no_docs):
    assert dedup_bag(docs, min_docs=2, least=3) == plain_dedup(rows, 3, 2)
    assert dedup_bag(docs) == plain_dedup(rows)
    assert not dedup_bag(no_docs)


def test_a_full_filter_changes_nothing(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dedup_bag(docs, most=line_dedup.SEGMENTS * 8) == plain_dedup(rows)
    few, many = (line_dedup.suspects(docs, most=m).count() for m in (line_dedup.MAX_BITS, line_dedup.SEGMENTS * 8))
    assert few <= many


def test_lines_join_by_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dedup_bag(docs) == plain_dedup(rows)


def test_only_repeats_are_suspected(spark):
    texts = [(i, f"a line that stands in this document only: {i:>20}") for i in range(5000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert line_dedup.suspects(docs).count() < 50
    every = docs.unionByName(docs.selectExpr("doc_id + 5000 AS doc_id", "text"))
    assert line_dedup.suspects(every).count() >= 10_000


@pytest.mark.parametrize("name", ["op13_bloom_line_dedup"])
def test_sql_of_lines(spark, name, tmp_path):
    rows = line_rows()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query = queries.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        columns = ", ".join(query.columns)
        expected = Counter(db.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall())
    assert Counter(map(tuple, query.collect())) == expected == plain_dedup(rows)
