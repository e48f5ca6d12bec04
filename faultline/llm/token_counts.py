"""Token counts by a map-side two-tier lookup.

Pre-tokens are the words between blanks; a piece of the vocabulary never holds a blank
behind another character, so the tokens of a text are those of its words, each with
the blanks before it.  Tier one is a broadcast table of the token counts of the most frequent
words of all documents, at most ``TABLE_WORDS`` of at most ``WORD_CHARS`` code points.  Each
task counts the words of its own texts in a summary of bounded size (Misra and Gries:
counts fall short by at most the task's words over ``TABLE_WORDS``), and only the
summaries meet in a shuffle.  Tier two is a bounded cache in each Python worker, whose
misses are encoded.  No pre-token is shuffled, and neither tier can change a count.

Null text is empty and has no tokens.  The character U+2581, which the vocabulary uses
for a blank, counts as one, as in the library.  Repeated rows repeat; an empty table
gives an empty result; other columns pass unread.
"""

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

from faultline.llm import vocab
from faultline.llm.base import Memo, small_batches, text_columns
from faultline.session import Scope

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
TABLE_WORDS = 50_000
#: Code points of a word in the table; longer ones are left to the second tier.
WORD_CHARS = 64
#: Levels of the counts in each doubling, and how many words are sorted for one in the table.
LEVELS = 8
LISTED = 4
#: Rows in one batch of a summary.
SUMMARY_ROWS = 10_000

#: A run of blanks and the word behind it.
RUN = re.compile(r" +[^ ]*")


@lru_cache(2)
def _library(file):
    return sentencepiece.SentencePieceProcessor(model_file=file)


@lru_cache(2)
def _cache(file):
    library = _library(file)
    return Memo(lambda word: word_tokens(library, word))


def word_tokens(library, word):
    """Tokens of a word behind a blank; without a word, of the blank itself."""
    return len(library.encode(word)) if word else 1


def words(text):
    """The words of a text, each with all but one of the blanks before it.

    The library puts a blank before what it encodes, so a word that is encoded alone
    is one that follows a blank.
    """
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in RUN.findall(f" {text}")]
    return text.split(" ")


def count_tokens(text, table, cache):
    return sum(table[w] if w in table else cache[w] for w in words(text))


def cut_summary(seen, size):
    """A summary of counts reduced to its ``size`` largest, all less by the largest left out."""
    if len(seen) <= size:
        return seen
    ranked = sorted(seen.values(), reverse=True)
    return Counter({word: n - ranked[size] for word, n in seen.items() if n > ranked[size]})


def _summaries(size):
    def run(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(word for word in words(text or "") if len(word) <= WORD_CHARS)
                if len(seen) > 2 * size:
                    seen = cut_summary(seen, size)
        found = list(cut_summary(seen, size).items())
        for at in range(0, len(found), SUMMARY_ROWS):
            part = found[at : at + SUMMARY_ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())],
                names=["word", "n"],
            )

    return run


def _least_count(counted, size):
    """The count from which on there are at most ``LISTED`` times ``size`` words."""
    level = F.floor(F.log2("n") * LEVELS).cast("int").alias("level")
    levels = counted.groupBy(level).agg(F.count("*").alias("words"), F.min("n").alias("n"))
    total, least = 0, None
    for row in sorted(levels.collect(), key=lambda row: -row["level"]):
        total += row["words"]
        if total > LISTED * size:
            break
        least = row["n"]
    return least


def frequent_words(docs, file, size=TABLE_WORDS):
    """Token counts of the most frequent words of all documents (ties: first in code-point order).

    Words are cut by levels of their counts first, so at most ``LISTED`` times ``size`` of them
    are sorted and reach the driver; a level too large for that is left to the second tier.
    """
    library = _library(file)
    small_batches(docs.sparkSession)
    parts = docs.select("text").mapInArrow(_summaries(size), "word string, n long")
    with Scope() as scope:
        counted = scope.stage(parts.groupBy("word").agg(F.sum("n").alias("n")), "frequent-words")
        least = _least_count(counted, size)
        if least is None:
            return {}
        most = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(size).collect()
    return {row["word"]: word_tokens(library, row["word"]) for row in most}


def token_counts(docs, model=None, limit=LIMIT):
    """The other columns of ``docs`` with n_bytes, n_tokens and over_limit instead of text."""
    file = model or vocab.path(VOCABULARY)
    table = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, file))

    def count(texts):
        texts = [text or "" for text in texts]
        cache = _cache(file)
        tokens = [count_tokens(text, table.value, cache) for text in texts]
        return [[len(text.encode()) for text in texts], tokens, [n > limit for n in tokens]]

    shape = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}
    return text_columns(docs, shape, count)
