"""Language identification with bit-sliced Bloom filters of character n-grams.

One filter table holds all languages: a slot is a bit mask with a bit for each
language, and an n-gram sets the bit of each language it belongs to in all its slots.
Looking an n-gram up is the AND of its slots: the set of languages that contain it.
A text's n-grams are counted for each language; what the filter's own rate of false
positives would give is taken off; the largest remainder decides (ties: first by name).

N-grams are the runs of three and four characters of lower-cased words (runs of
letters) with a blank on either side, so every text with a letter has one.

The filters are learnt from labelled documents, a bounded sample of about
``SAMPLE_DOCS`` a language drawn by the hash of the id.  An n-gram belongs to a
language if it was seen there at least ``MIN_SEEN`` times and its share of that
language's n-grams is at least ``MIN_SHARE`` of its largest share in any language.
At most ``GRAMS`` a language are kept, the most frequent ones (a model's size, not a
limit on texts).  Texts to be judged are read whole, in slices.

Null or letterless text gives ``und`` with score 0, as does any text if no language
was learnt.  Empty tables give empty results; columns other than doc_id, text and lang
are not read, and lang only for learning.  Rows repeat in the result as they do in the table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faultline.llm.base import below_share, own_prefix, stage, text_columns

SAMPLE_DOCS = 2000
MIN_SEEN = 3
MIN_SHARE = 0.25
GRAMS = 100_000
SLOTS = 1 << 20
HASHES = 2
LENGTHS = (3, 4)
#: Code points handled at a time.
SLICE = 1 << 20
UNKNOWN = "und"
#: Documents of the pipeline with a smaller score are rejected.
MIN_SCORE = 0.15

_LETTER = np.zeros(0, bool)


def _letters():
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTER


def _mix(values):
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def _slice_grams(points, starts):
    grams = []
    for length in LENGTHS:
        n = min(len(points) - length + 1, starts)
        if n < 1:
            continue
        value = np.full(n, length, np.uint64)
        inside = np.ones(n, bool)
        for at in range(length):
            part = points[at : at + n]
            value = value * np.uint64(0x100000001B3) + part
            if 0 < at < length - 1:
                inside &= part > 0
        grams.append(_mix(value[inside]))
    return np.concatenate(grams) if grams else np.zeros(0, np.uint64)


def text_grams(text):
    """Hashes of the n-grams of a text, slice by slice."""
    overlap = max(LENGTHS) - 1
    text = text.lower()
    for at in range(0, max(len(text), 1), SLICE):
        piece = text[at : at + SLICE + overlap]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_letters()[points], points, 0).astype(np.uint64)
        first, last = at == 0, at + SLICE >= len(text)
        points = np.pad(points, (int(first), int(last)))
        yield _slice_grams(points, len(points) if last else SLICE + int(first))


class Filters:
    """The bit-sliced Bloom filters of some languages."""

    def __init__(self, languages, grams, slots=SLOTS):
        """``grams``: one array of n-gram hashes for each language."""
        self.languages, self.slots = languages, slots
        self.masks = np.zeros((-(-len(languages) // 64) or 1, slots), np.uint64)
        for at, own in enumerate(grams):
            for places in self._places(np.asarray(own, np.uint64)):
                self.masks[at // 64, places] |= np.uint64(1 << (at % 64))
        filled = np.array([self._bit(self.masks, at).mean() for at in range(len(languages))])
        self.false_rate = filled**HASHES

    def _places(self, grams):
        step = (grams >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            yield (grams + np.uint64(i) * step) % np.uint64(self.slots)

    @staticmethod
    def _bit(masks, language):
        return (masks[language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def containing(self, grams):
        """Bit masks of the languages that contain each n-gram."""
        found = None
        for places in self._places(grams):
            here = self.masks[:, places]
            found = here if found is None else found & here
        return found

    def predict(self, text):
        """Language and score of one text."""
        counts, total = np.zeros(len(self.languages)), 0
        for grams in text_grams(text or ""):
            masks = self.containing(grams)
            counts += [self._bit(masks, at).sum() for at in range(len(self.languages))]
            total += len(grams)
        if not total or not self.languages:
            return UNKNOWN, 0.0
        true = np.maximum(counts - total * self.false_rate, 0) / np.maximum(1 - self.false_rate, 1e-9)
        best = int(true.argmax())
        share = true[best] / true.sum() if true.sum() else 0.0
        return self.languages[best], float(share * min(1.0, true[best] / total) ** 0.5)


def _gram_counts(batches):
    for batch in batches:
        names, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for name in sorted(set(names)):
            own = [g for n, t in zip(names, texts, strict=True) if n == name for g in text_grams(t)]
            values, seen = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(values)), pa.array(values.view(np.int64)), pa.array(seen)],
                names=["lang", "gram", "seen"],
            )


def learn(labelled, sample_docs=SAMPLE_DOCS):
    """Filters from labelled rows (doc_id, text, lang); nulls of text or lang teach nothing."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    held = usable.groupBy("lang").count().select(
        F.col("lang").alias("_lang"), (F.lit(float(sample_docs)) / F.col("count")).alias("_share")
    )
    # one row a language
    sample = (
        usable.join(F.broadcast(held), F.col("lang") == F.col("_lang"))
        .filter(below_share(F.col("_share"), "doc_id"))
        .select("lang", "text")
    )
    counts = (
        sample.mapInArrow(_gram_counts, "lang string, gram long, seen long")
        .groupBy("lang", "gram")
        .agg(F.sum("seen").alias("seen"))
    )
    counts = stage(counts, "language-grams")
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("seen").alias("total")))
    shares = counts.join(total, "lang").withColumn("share", F.col("seen") / F.col("total"))
    own = (
        shares.withColumn("best", F.max("share").over(W.partitionBy("gram")))
        .filter((F.col("share") >= MIN_SHARE * F.col("best")) & (F.col("seen") >= MIN_SEEN))
        .withColumn(
            "at", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("seen"), "gram"))
        )
        .filter(F.col("at") <= GRAMS)
    )
    rows = own.select("lang", "gram").toPandas()
    languages = sorted(rows["lang"].unique())
    grams = [
        rows["gram"][rows["lang"] == name].to_numpy(np.int64).view(np.uint64) for name in languages
    ]
    return Filters(languages, grams)


def predict(docs, filters, names=("lang_pred", "score")):
    """The other columns of ``docs`` with the language and its score instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def judge(texts):
        return list(zip(*map(shared.value.predict, texts), strict=True)) or [[], []]

    return text_columns(docs, dict(zip(names, ("string", "double"), strict=True)), judge)


def held_out():
    """Whether a document is kept from learning: the CRC-32 of its id, modulo four, is two."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accept(docs, min_score=MIN_SCORE):
    """The documents whose language is told, with all their columns.

    A document is rejected if it has no letter or scores below ``min_score``.
    """
    filters = learn(docs.filter(~held_out()))
    if not filters.languages:
        return docs
    own = own_prefix(docs)
    names = (f"{own}lang", f"{own}score")
    judged = predict(docs.withColumn(f"{own}text", F.col("text")), filters, names)
    kept = judged.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= min_score))
    return kept.withColumnRenamed(f"{own}text", "text").select(*docs.columns)
