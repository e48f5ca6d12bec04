"""Quality rules by cross-document line frequency.

Every line is normalised (A-Z lowered, blanks collapsed and trimmed) and hashed.  A
line is counted in each host (column ``source``) over the distinct documents that
hold it.  A line found in more than ``max_docs`` documents of a host, and in more than
``max_share`` of all distinct documents of that host, is boilerplate there: it is removed from all of them but the one with the smallest doc_id, which
stays as its original.  A document that keeps less than ``min_left`` of the
characters of its distinct lines is depleted and rejected.

The query's SQL knows a number of documents only (``MAX_DOCS``, no share), so ``judge``
keeps that.  ``clean``, the pipeline's stage, takes a share with a small minimum, which
holds for hosts of any size.

Null text counts as empty: no lines, no words.  Lines without a word are neither
counted nor removed.  A null host is a host of its own.  Repeated rows are one
document and get the same verdict.  Null ids come last as originals.  Ties cannot
change a count.  An empty table gives an empty result.  Columns other than doc_id,
text and source are not read.
"""

from collections import Counter

from pyspark.sql import functions as F

from faultline.llm.base import own_prefix, stage, text_columns

#: Documents of one host that may share a line: the query's limit, as in its SQL.
MAX_DOCS = 100
#: The stage's limits: as many documents, and this share of the host's distinct documents.
MIN_DOCS = 5
MAX_SHARE = 0.02
#: Share of its line characters that a document must keep.
MIN_LEFT = 0.3
#: Rules on the whole text.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Boilerplate lines, 24 bytes each, that are joined by broadcast; beyond, by shuffle.
BROADCAST_ROWS = 500_000

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What makes rows the same document.
DOCUMENT = ["doc_id", "source", "text_hash"]


def text_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.encode().split()
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _count_texts(texts):
    return list(zip(*map(text_counts, texts), strict=True)) or [[] for _ in COUNTS]


def _keyed(docs):
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "source", text.alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def _normal(line):
    lowered = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " "))


def _line_hash(line):
    return F.xxhash64(_normal(line))


def _lines(text):
    """Hash and characters of every distinct line with a word."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(
            _line_hash(x).alias("line"), F.char_length(_normal(x)).cast("long").alias("chars")
        ),
    )
    return F.array_distinct(F.filter(lines, lambda x: x["chars"] > 0))


def document_lines(docs):
    """DOCUMENT, line, chars: one row for each distinct line of each document."""
    return _keyed(docs).select(*DOCUMENT, F.inline(_lines("text"))).distinct()


def host_sizes(docs, max_docs):
    """held_host and host_docs: distinct documents of every host where a line can pass the limit."""
    hosts = _keyed(docs).select(*DOCUMENT).distinct().groupBy(F.col("source").alias("held_host"))
    return hosts.agg(F.count("*").alias("host_docs")).filter(F.col("host_docs") > max_docs)


def boilerplate(lines, max_docs=MAX_DOCS, hosts=None, max_share=0.0):
    """Lines above the limits: host, common_line, n_docs and the document that keeps it.

    ``hosts`` (see ``host_sizes``) is needed where a share is given.
    """
    many = (
        lines.groupBy(F.col("source").alias("host"), F.col("line").alias("common_line"))
        .agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
        .filter(F.col("n_docs") > max_docs)
    )
    if hosts is None:
        return many
    above = F.col("host").eqNullSafe(F.col("held_host")) & (
        F.col("n_docs") > max_share * F.col("host_docs")
    )
    return many.join(hosts, above).select(*many.columns)


def losses(docs, max_docs=MAX_DOCS, max_share=0.0):
    """For each document that loses lines: their hashes and characters."""
    lines = stage(document_lines(docs), "document-lines")
    hosts = None
    if max_share:
        hosts = stage(host_sizes(docs, max_docs), "host-sizes")
        if hosts.count() <= BROADCAST_ROWS:
            hosts = F.broadcast(hosts)
    common = stage(boilerplate(lines, max_docs, hosts, max_share), "boilerplate-lines")
    if common.count() <= BROADCAST_ROWS:
        common = F.broadcast(common)
    here = F.col("source").eqNullSafe(F.col("host")) & (F.col("line") == F.col("common_line"))
    gone = lines.join(common, here).filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    return gone.groupBy(*[F.col(name).alias(f"_{name}") for name in DOCUMENT]).agg(
        F.collect_set("line").alias("_removed"), F.sum("chars").alias("_removed_chars")
    )


def _with_losses(keyed, lost):
    same = (
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("text_hash") == F.col("_text_hash"))
    )
    return keyed.join(lost, same, "left")


def _depleted(min_left):
    left = F.col("line_chars") - F.col("_removed_chars")
    return F.coalesce(left < min_left * F.col("line_chars"), F.lit(False))


def judge(docs, max_docs=MAX_DOCS, min_left=MIN_LEFT, max_share=0.0):
    """The counts, the verdict and the removed lines of every row of ``docs``."""
    keyed = _keyed(docs)
    chars = F.aggregate(_lines("text"), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    counted = text_columns(
        keyed.withColumn("line_chars", chars), dict.fromkeys(COUNTS, "long"), _count_texts
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )
    return _with_losses(counted, losses(docs, max_docs, max_share)).select(
        "doc_id",
        "source",
        "text_hash",
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & ~_depleted(min_left)).alias("kept"),
        "line_chars",
        F.coalesce("_removed_chars", F.lit(0)).alias("removed_chars"),
        "_removed",
    )


def clean(docs, max_docs=MIN_DOCS, min_left=MIN_LEFT, max_share=MAX_SHARE):
    """The documents that stay, without their boilerplate lines; same columns.

    A text that loses no line stays as it is; ``n_chars``, if there, follows the text.
    """
    verdict = judge(docs, max_docs, min_left, max_share).filter("kept").select(*DOCUMENT, "_removed")
    own = own_prefix(docs)
    verdict = verdict.dropDuplicates(DOCUMENT).select(
        *[F.col(name).alias(own + name) for name in DOCUMENT],
        F.col("_removed").alias(f"{own}removed"),
    )
    removed = F.col(f"{own}removed")
    same = (
        F.col("doc_id").eqNullSafe(F.col(f"{own}doc_id"))
        & F.col("source").eqNullSafe(F.col(f"{own}source"))
        & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(f"{own}text_hash"))
    )
    changed = removed.isNotNull()
    left = F.array_join(
        F.filter(
            F.split("text", "\n"),
            lambda x: ~F.array_contains(removed, _line_hash(x)),
        ),
        "\n",
    )
    out = docs.join(verdict, same).withColumn(
        "text", F.when(changed, left).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.char_length("text").cast(kind)
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
