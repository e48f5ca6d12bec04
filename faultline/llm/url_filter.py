"""URL rules through a cascade of Bloom filters, native expressions only.

A rule is a host and a path prefix and fits its host, all subdomains, and every path
that starts with its prefix.  A url's candidate keys are, for each shape of listed key
(labels of the host, length of the path), its own last labels and first characters.
Rules of each action form a list of keys held in one cascade: level 0 is a Bloom
filter of the listed keys, level 1 of the corpus keys that level 0 takes wrongly,
level 2 of the listed keys that level 1 takes, and so on until no level errs.  Built
over the complete key universe of the corpus, the cascade answers every candidate key
of the corpus exactly, without a join.  The longest listed candidate decides (of equal
length the one with the longer host).  Urls without a rule get the list's default.

A filter has ``BITS_PER_KEY`` bits for each listed key or each false positive, of which there
are about ``FALSE_RATE`` of the corpus keys.  It must fit into every task, so where a list or the false
positives exceed about ``MAX_KEYS``, keys are dealt by hash into blocks, each with cascades of its
own.  The urls then pass the blocks one after the other, each pass a written table that holds a
url's best rule so far; one block, the usual case, needs none.

Null urls and urls without ``://`` have empty host and path and no rule.  Repeated urls are
judged alike; an empty table gives an empty result and a cascade of one level.  Only
page_id and url are read.
"""

from pyspark.sql import functions as F

from faultline.llm.base import stage

BITS_PER_KEY = 10
HASHES = 4
MAX_LEVELS = 60
MAX_KEYS = 5_000_000
#: Share of keys that a filter of these bits and hashes takes wrongly, rounded up.
FALSE_RATE = 0.015
ALLOW, BLOCK = "allow", "block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages):
    """page_id, host and path of every url."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def shapes(rules):
    """(labels, length) of the listed keys, longest first; ``rules`` has host, path, action."""
    rows = rules.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length")
    )
    return [tuple(r) for r in rows.distinct().orderBy(F.desc("length"), F.desc("labels")).collect()]


def candidates(found):
    """Array of a url's candidate keys, one for each shape it is long enough for."""
    labels = F.split("host", r"\.")
    keys = [
        F.when(
            (F.size(labels) >= n) & (F.char_length("path") >= length) & (F.col("host") != ""),
            F.concat(
                F.array_join(F.slice(labels, -n, n), "."), F.substring("path", 1, length)
            ),
        )
        for n, length in found
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def _places(key, level, bits):
    """Bit positions of a key in the filter of a level."""
    one, two = F.xxhash64(key, F.lit(level)), F.hash(key, F.lit(level))
    return [F.pmod(one + F.lit(i) * two.cast("long"), F.lit(bits)) for i in range(HASHES)]


def bloom(keys, level):
    """(bits, words) of a Bloom filter over the column ``key``; words as decimal text."""
    n = keys.count()
    bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
    place = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = place.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(one).alias("set"))
    filled = {r["word"]: r["set"] for r in words.collect()}
    return bits, ",".join(str(filled.get(i, 0)) for i in range(bits // 64))


def passes(key, level, made):
    """Whether the filter of a level takes a key."""
    bits, text = made
    words = F.split(F.lit(text), ",").cast("array<bigint>")
    taken = F.lit(True)
    for place in _places(key, level, bits):
        word = F.element_at(words, (place / 64).cast("int") + 1)
        taken = taken & (F.getbit(word, (place % 64).cast("int")) == 1)
    return taken


def cascade(listed, universe, name):
    """Bloom filters of alternate levels; both tables have one column ``key``."""
    listed = stage(listed.select("key").distinct(), f"{name}-listed")
    levels = [bloom(listed, 0)]
    wrong = universe.filter(passes(F.col("key"), 0, levels[0])).select("key").distinct()
    pending, other = stage(wrong.join(listed, "key", "left_anti"), f"{name}-wrong"), listed
    while pending.limit(1).count():
        if len(levels) == MAX_LEVELS:
            raise RuntimeError(f"{name}: still wrong after {MAX_LEVELS} levels")
        level = len(levels)
        levels.append(bloom(pending, level))
        taken = other.filter(passes(F.col("key"), level, levels[level]))
        pending, other = stage(taken, f"{name}-level"), pending
    return levels


def member(key, levels):
    """Exact membership of a key of the universe."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        answer = F.when(passes(key, level, levels[level]), answer).otherwise(F.lit(level % 2 == 1))
    return answer


def block_count(listed, universe):
    """Blocks of keys whose filters stay near ``MAX_KEYS``, for counts of listed and corpus keys."""
    return max(1, -(-max(listed, int(universe * FALSE_RATE)) // MAX_KEYS))


def _block(key, blocks):
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))


def _best(found, cascades, block, blocks):
    """The longest listed candidate of a url in a block: struct, or null."""

    def hit(key):
        action = F.when(member(key, cascades[BLOCK]), F.lit(BLOCK)).when(
            member(key, cascades[ALLOW]), F.lit(ALLOW)
        )
        return F.struct(
            F.char_length(key).alias("length"),
            F.char_length(F.substring_index(key, "/", 1)).alias("host_length"),
            key.alias("rule"),
            action.alias("action"),
        )

    keys = candidates(found)
    if blocks > 1:
        keys = F.filter(keys, lambda key: _block(key, blocks) == block)
    return F.array_max(F.filter(F.transform(keys, hit), lambda x: x["action"].isNotNull()))


def judge(pages, rules, default=ALLOW):
    """page_id, host, path, rule and verdict of every row.

    ``rules`` has host, path and action (block or allow); a rule is written host + path.
    """
    rules = rules.withColumn("key", F.concat("host", "path"))
    found = shapes(rules)
    urls = parts(pages)
    universe = urls.select(F.explode(candidates(found)).alias("key")).distinct()
    universe = stage(universe, "url-keys")
    blocks = block_count(rules.count(), universe.count())
    best = urls
    for block in range(blocks):
        own = _block(F.col("key"), blocks) == block
        cascades = {
            action: cascade(
                rules.filter((F.col("action") == action) & own),
                universe.filter(own),
                f"urls-{action}",
            )
            for action in (BLOCK, ALLOW)
        }
        here = _best(found, cascades, block, blocks)
        if block:
            best = best.withColumn("best", F.greatest("best", here))
        else:
            best = urls.withColumn("best", here)
        if block + 1 < blocks:
            best = stage(best, "urls-best")
    return best.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


def rule_table(spark, rules):
    """Rules given as (action, host, path) as a table."""
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path"))
            for a, h, p in rules
        ]
    )
    return spark.range(1).select(F.inline(rows))
