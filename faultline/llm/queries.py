"""The registered queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

from faultline.llm import (
    alignment,
    ann,
    bpe,
    language,
    line_dedup,
    line_rules,
    packing,
    pii,
    sharding,
    simhash,
    spelling,
    token_counts,
    url_filter,
)
from faultline.llm.base import read, stage

URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def op1_line_frequency(spark, sf_dir):
    verdicts = line_rules.judge(read(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", *line_rules.COUNTS, "base_failed", "kept", "line_chars", "removed_chars"
    )


def op2_simhash_multi_index(spark, sf_dir):
    found = simhash.classes(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", digits, "component_id")


def op3_language_bitmask(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    filters = language.learn(docs.filter(~language.held_out()))
    texts = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(texts, filters)


def op4_pii_tagger(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.spans(docs, pii.train(docs))


def op5_shortest_pack_first(spark, sf_dir):
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents")))


def op6_two_tier_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs)


def op7_virtual_slots(spark, sf_dir):
    placed, _ = sharding.shard(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op8_projection_forest(spark, sf_dir):
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op9_bloom_cascade(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES))


def op10_distinct_word_bpe(spark, sf_dir):
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents")))


def op11_permuterm_variants(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_anchor_alignment(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = stage(alignment.packed(docs), "alignments")
    counts = stage(alignment.link_counts(aligned), "link-counts")
    return alignment.score(aligned, counts)


def op13_bloom_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit("")).cast("binary")
    return line_dedup.deduplicate(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_frequency,
        op2_simhash_multi_index,
        op3_language_bitmask,
        op4_pii_tagger,
        op5_shortest_pack_first,
        op6_two_tier_token_counts,
        op7_virtual_slots,
        op8_projection_forest,
        op9_bloom_cascade,
        op10_distinct_word_bpe,
        op11_permuterm_variants,
        op12_anchor_alignment,
        op13_bloom_line_dedup,
    )
}

ORACLE_SQL = {
    "op1_line_frequency": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
        grams AS (
            SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
        repeats AS (
            SELECT r, count(DISTINCT i + j) AS n
            FROM (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1), range(3) AS s(j)
            GROUP BY r),
        raw AS (SELECT r, doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
        dup AS (
            SELECT r, count(*) - count(DISTINCT line) AS n FROM raw
            WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
        lines AS (
            SELECT DISTINCT r, doc_id, source, text, trim(regexp_replace(
                translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line FROM raw),
        common AS (
            SELECT source, line, min(doc_id) AS first_doc
            FROM (SELECT DISTINCT doc_id, source, text, line FROM lines WHERE line <> '')
            GROUP BY source, line HAVING count(*) > 100),
        sums AS (
            SELECT r, sum(length(l.line)) AS line_chars,
                coalesce(sum(length(l.line)) FILTER (
                    c.line IS NOT NULL AND l.doc_id IS DISTINCT FROM c.first_doc), 0) AS removed_chars
            FROM lines l LEFT JOIN common c
                ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line
            WHERE l.line <> '' GROUP BY r),
        counts AS (
            SELECT d.doc_id, len(w.words) AS n_words, coalesce(length(array_to_string(w.words, '')), 0) AS word_chars,
                length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars,
                CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
            FROM d JOIN w USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dup USING (r) LEFT JOIN sums USING (r)),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
        SELECT *, NOT base_failed AND NOT (removed_chars > 0
            AND line_chars - removed_chars < 0.3 * line_chars) AS kept
        FROM judged
    """,
    "op9_bloom_cascade": """
        WITH u AS (
            SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        p AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u),
        r(action, h, p) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (
            SELECT page_id, host, path, h || r.p AS rule, action,
                row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || r.p) DESC, length(h) DESC) AS n
            FROM p LEFT JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, r.p))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM m WHERE n = 1
    """,
    "op13_bloom_line_dedup": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        raw AS (
            SELECT r, doc_id, i, lines[i] AS line,
                trim(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
            FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
                  FROM (SELECT r, doc_id, string_split(text, chr(10)) AS lines FROM d))),
        many AS (
            SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM raw WHERE length(key) >= 40)
            GROUP BY key HAVING count(*) >= 5),
        marked AS (
            SELECT raw.*, many.key IS NOT NULL AND raw.doc_id IS DISTINCT FROM keeper AS gone
            FROM raw LEFT JOIN many ON raw.key = many.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY r
    """,
}
