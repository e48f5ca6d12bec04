import random

import pytest

SYLLABLES = {
    "en": "the on er an th ing ou nd ea re at st".split(),
    "de": "ein der sch ung keit ver zu auf lich en ge bez".split(),
    "fr": "les ai eau que ment eux tion oi ère pour une éa".split(),
}
CLASHING = "score double, fp long, _text string, _known long, _removed string, _doc_id long, _masked string, n_tokens long, part int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def prose(draw, lang, words):
    out = ["".join(draw.choices(SYLLABLES[lang], k=draw.randint(1, 3))) for _ in range(words)]
    for at in range(9, words, 10):
        out[at] += draw.choice([".", ",", ".\n", ".\n"])
    return " ".join(out).replace("\n ", "\n")


def make_rows():
    """Documents with odd texts, copies, nulls, repeated rows and columns of clashing names."""
    draw = random.Random(3)
    rows = []
    for i in range(160):
        lang = ["en", "de", "fr"][i % 3]
        rows.append([i, prose(draw, lang, draw.choice([8, 60, 120, 300])), lang, f"s{i % 4}"])
    shared = "This line stands in many documents of its host."
    for i in range(40, 80):
        rows[i][1] += "\n" + shared
        rows[i][3] = "hot"
    for i in range(80, 95):
        rows[i][1], rows[i][3] = rows[80][1], "hot"
    rows[95][1] = rows[80][1].replace(" ", "  ", 3)
    rows[96][1] = rows[80][1] + " more"
    odd = [
        None, "", " ", "\n\n", "a", "A b", "word " * 2000, "x" * 50_000, "  lead and trail  ",
        "tab\tand\r\nline \n end ", "12345 !!! ???", "ünï çödé 漢字 🙂 \u00a0x\u3000y", "a▁b ▁▁c",
        "<|endoftext|> and <s> </s> <unk>", "it's we'll I'd don't  'twas", "\u0085 \x1c \u2028 x",
        "mail a.b@mail1.example.com +1 (208) 555-1177 4284896609045836 1.2.3.4 end",
        "call +1 (222) 555-0199 now or 10.20.30.40, 4111 1111 1111 1111; 300.1.1.1 @x a@b",
    ]
    rows += [[200 + i, text, None if i % 2 else "en", None if i % 3 else "s1"] for i, text in enumerate(odd)]
    rows += [[None, "no id at all", None, None], [None, "no id at all", None, None], [5, rows[5][1], "de", "s1"]]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 7, "other", 1, "r", 2, "m", 3, 4) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
