"""A stored index of posting lists for the search.

The newest cases of a key are among the newest of any parts of the corpus, so cut lists of
parts merge exactly, without the corpus.  Each added part leaves a run of cut lists, in
buckets by their key; a bucket with many runs is merged into one when the next one arrives.  A search
reads the buckets of its own keys.  Cases are added once closed and do not change afterwards; one
that is added again counts once.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from faultline import fixed_values as fv
from faultline.operators import search
from faultline.sources.keyed_store import KeyedStore

_ENTRY = StructType().add("recency", "long").add("case_id", "string")
SCHEMA = StructType().add("shape", "string").add("brand", "string").add("term", "string").add("posting", ArrayType(_ENTRY))


class PostingIndex:
    def __init__(self, spark, path, limit=fv.CANDIDATE_LIMIT, buckets=64, most_runs=8):
        self.limit = limit
        self.store = KeyedStore(spark, path, SCHEMA, search.POSTING_KEY, buckets, most_runs)

    def _merged(self, lists):
        return search.merge_lists(lists, self.limit)

    def add(self, corpus, version):
        """Index more closed cases; the same version again replaces its run."""
        self.store.append(search.cut_lists(search.corpus_keys(corpus), self.limit), version, self._merged)

    def lists(self, keys):
        """The cut list of every wanted key (columns ``search.POSTING_KEY``) that has one."""
        return self._merged(self.store.lookup(keys))
