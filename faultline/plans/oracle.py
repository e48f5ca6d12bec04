"""The registered queries stated independently in SQL, for checking results."""

from faultline import fixed_values as fv
from faultline.plans import registry, views

WS = r"\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

VIEWS = {
    "case_parts": """
        SELECT l_orderkey, list_sort(list(DISTINCT p_type)) AS types,
               list_sort(list(DISTINCT p_brand)) AS brands,
               list_sort(list(DISTINCT p_name)) AS names
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "case_rows": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS installation_id,
               CASE WHEN c_acctbal >= -500 THEN c_mktsegment END AS brand,
               CASE WHEN c_acctbal <= 9500 THEN n_name END AS model,
               CAST(floor(o_totalprice) AS INTEGER) AS mileage, o_orderpriority AS power,
               types AS symptoms,
               CASE WHEN o_totalprice >= 5000 THEN brands ELSE CAST([] AS VARCHAR[]) END AS codes,
               array_to_string(names, ' ') AS description,
               CASE WHEN o_totalprice < 495000 THEN o_orderdate END AS closed_at,
               o_orderdate AS created_at, o_orderstatus AS status
        FROM case_parts JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "corpus": "SELECT * FROM case_rows WHERE status = 'F'",
    "asked": "SELECT * FROM case_rows WHERE status = 'O'",
    "docs": """
        SELECT *, list_transform(codes, lambda c: 'P00' || replace(c, 'Brand#', '')) AS dtc
        FROM case_rows""",
    "messages": f"""
        SELECT conv_id AS case_id, turn AS position, text,
               CASE role WHEN 'user' THEN 'input' WHEN 'assistant' THEN 'diagnosis'
                         ELSE 'system' END AS type,
               length(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'))
                 AS tokens
        FROM conversations""",
    "usage_log": """
        SELECT event_id, CAST(user_id AS VARCHAR) AS installation_id, ts, value,
               event_type <> 'error' AS success, event_type AS model,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens
        FROM events""",
    "violations": """
        SELECT *, row_number() OVER (PARTITION BY installation_id ORDER BY ts, event_id)
                    AS violation_count
        FROM usage_log WHERE NOT success""",
    "ordered": """
        SELECT installation_id, event_id, ts,
               row_number() OVER (PARTITION BY installation_id ORDER BY ts, event_id) AS place
        FROM usage_log""",
    "walk": f"""
        SELECT installation_id, event_id, ts, place, TRUE AS admitted, [ts] AS held
        FROM ordered WHERE place = 1
        UNION ALL
        SELECT installation_id, event_id, ts, place, len(live) < {registry.CALL_LIMIT},
               CASE WHEN len(live) < {registry.CALL_LIMIT} THEN list_append(live, ts) ELSE live END
        FROM (SELECT o.*, list_filter(w.held, lambda t: t > o.ts - INTERVAL 24 HOURS) AS live
              FROM walk w JOIN ordered o
                ON o.installation_id = w.installation_id AND o.place = w.place + 1)""",
    "free_texts": """
        SELECT 'documents' AS source, doc_id AS text_id, text FROM documents
        UNION ALL SELECT 'benchmark', item_id, text FROM benchmark
        UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations
        UNION ALL SELECT 'part', p_partkey, p_name FROM part
        UNION ALL SELECT 'pages', page_id, url FROM pages
        UNION ALL SELECT 'pages.html', page_id, html FROM pages
        UNION ALL SELECT 'customer', c_custkey, c_name FROM customer""",
    "items": """
        SELECT r_name AS brand, r_regionkey AS brand_position, r_name LIKE 'A%' AS active,
               'expertise ' || r_name AS expertise, 0 AS position,
               'models of ' || r_name AS header, CAST(NULL AS VARCHAR) AS label
        FROM region
        UNION ALL
        SELECT r_name, r_regionkey, r_name LIKE 'A%', 'expertise ' || r_name, n_nationkey + 1,
               NULL, n_name
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "scans": """
        SELECT o_orderkey AS scan_id, o_orderpriority AS priority, o_orderstatus AS status,
               o_custkey % 65536 AS customer, o_orderkey % 65536 AS ordered,
               CAST(floor(o_totalprice) AS BIGINT) % 65536 AS price
        FROM orders""",
    # Brute force: every open case against every closed one.
    "candidates": """
        SELECT query_id, case_id, closed_at, candidate_rank FROM (
          SELECT q.id AS query_id, c.id AS case_id, c.closed_at,
                 row_number() OVER (PARTITION BY q.id
                                    ORDER BY c.closed_at DESC NULLS FIRST, c.id) AS candidate_rank
          FROM asked q JOIN corpus c
            ON (q.brand IS NULL OR c.brand = q.brand)
           AND CASE WHEN len(q.codes) > 0 THEN list_has_any(c.codes, q.codes)
                    WHEN q.model IS NOT NULL THEN c.model = q.model ELSE TRUE END
        ) WHERE candidate_rank <= 200""",
    "texts": """
        SELECT id, lower(array_to_string(list_concat(list_concat(symptoms, codes), [description]),
                                         ' ')) AS all_text
        FROM case_rows""",
    "terms": """
        SELECT id, list_transform(codes, lambda x: lower(x)) AS t_codes,
               list_transform(symptoms, lambda x: lower(x)) AS t_symptoms,
               list_filter(regexp_split_to_array(lower(description), '\\s+'),
                           lambda w: length(w) > 4) AS t_words
        FROM case_rows""",
    "scored": """
        SELECT k.query_id, k.case_id, k.closed_at,
               coalesce(q.installation_id = c.installation_id, FALSE) AS is_own,
               (CASE WHEN q.model = c.model THEN 30 ELSE 0 END
                + CASE WHEN q.power = c.power THEN 20 ELSE 0 END
                + 40 * len(list_filter(t_codes, lambda x: contains(all_text, x)))
                + 15 * len(list_filter(t_symptoms, lambda x: contains(all_text, x)))
                + least(20, 3 * len(list_filter(t_words, lambda x: contains(all_text, x))))
               ) AS tenths
        FROM candidates k JOIN asked q ON k.query_id = q.id JOIN corpus c ON k.case_id = c.id
        JOIN terms t ON t.id = q.id JOIN texts x ON x.id = c.id""",
    "placed": """
        SELECT *, row_number() OVER (PARTITION BY query_id
                    ORDER BY tenths DESC, is_own DESC, closed_at DESC NULLS FIRST, case_id)
                    AS hit_rank
        FROM scored WHERE tenths >= CASE WHEN is_own THEN 50 ELSE 80 END""",
    "hits": "SELECT * FROM placed WHERE hit_rank <= 5",
    "entries": """
        SELECT query_id, hit_rank,
               '[' || hit_rank || '] '
               || CASE WHEN tenths >= 80 THEN '🔴 VYSOKÁ SHODA'
                       WHEN tenths >= 50 THEN '🟡 STŘEDNÍ SHODA' ELSE '🟢 ČÁSTEČNÁ SHODA' END
               || ' (skóre: ' || printf('%.1f', tenths / 10) || ') | '
               || concat_ws(' ', brand, model, power)
               || chr(10) || '   Příznaky: ' || array_to_string(symptoms, ', ')
               || chr(10) || '   OBD: '
               || CASE WHEN len(codes) = 0 THEN '—' ELSE array_to_string(codes, ', ') END
               || chr(10) || '   ✅ Ověřené řešení: ' || description AS entry
        FROM hits JOIN corpus ON id = case_id""",
    "blocks": f"""
        SELECT query_id, $header || string_agg(entry, chr(10) || chr(10) ORDER BY hit_rank)
                         || $footer AS context
        FROM entries GROUP BY query_id""",
    "shapes": """
        SELECT p_partkey AS answer_id, p_type AS kind, p_name, p_brand, p_size,
               CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'ok'
                    WHEN p_type IN ('MEDIUM', 'ECONOMY') THEN 'repaired' ELSE 'failed' END AS status,
               CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 0 WHEN p_type = 'MEDIUM' THEN 2
                    WHEN p_size = 50 THEN 1 ELSE 3 END AS n_faults
        FROM part""",
    "faults": """
        SELECT answer_id, kind, p_name, p_size, position,
               (p_size = 50 AND kind <> 'MEDIUM') AS off_topic,
               CASE WHEN p_size = 50 AND kind <> 'MEDIUM' THEN 'Nesouvisející dotaz'
                    ELSE [p_name, p_brand, 'third'][position + 1] END AS fault_name,
               CASE WHEN p_size = 50 AND kind <> 'MEDIUM' THEN 0
                    ELSE [p_size, 45, 71][position + 1] END AS probability
        FROM (SELECT *, unnest(range(n_faults)) AS position FROM shapes)""",
}


def text(value):
    return "'" + value.replace("'", "''") + "'"


VIEWS["blocks"] = (
    VIEWS["blocks"]
    .replace("$header", text(fv.CONTEXT_HEADER))
    .replace("$footer", text(fv.CONTEXT_FOOTER))
)


def _needs(sql, wanted=None):
    """The views a statement uses, definitions before uses."""
    import re

    wanted = [] if wanted is None else wanted
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", sql) and name not in wanted:
            _needs(body.replace(name, ""), wanted)
            if name not in wanted:
                wanted.append(name)
    return wanted


def with_views(sql):
    needed = _needs(sql)
    if not needed:
        return sql
    head = "WITH RECURSIVE " if "walk" in needed else "WITH "
    body = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"{head}{body} {sql}"


TRIMMED = f"regexp_replace(text, '^[{WS}]+|[{WS}]+$', '', 'g')"

RESOLUTION_REASON = f"""
    CASE WHEN length(trimmed) = 0 THEN 'missing'
         WHEN length(trimmed) < 10 THEN 'too_short'
         WHEN length(trimmed) > 200 THEN 'too_long'
         WHEN len(list_filter(range(1, length(trimmed) - 5),
                lambda i: substring(trimmed, i, 7) = repeat(substring(trimmed, i, 1), 7)
                          AND substring(trimmed, i, 1) NOT IN (chr(10), chr(13)))) > 0
           THEN 'repeated_character'
         WHEN len(list_distinct(list_filter(regexp_split_to_array(lower(trimmed), '[{WS}]+'),
                lambda w: length(w) > 2))) < 2 THEN 'too_few_words' END"""

RELEVANT = (
    "(length(trimmed) <= 80 OR regexp_matches(trimmed, '\\b[PCBU][0-9A-F]{4}\\b', 'i')"
    f" OR regexp_matches(trimmed, '\\b({'|'.join(registry.TERMS)})\\b', 'i')"
    f" OR regexp_matches(trimmed, '[0-9]+[{WS}]*({'|'.join(fv.TOPIC_UNITS)})|[0-9]+°[cf]', 'i'))"
)

CASE_REASON = f"""
    coalesce({RESOLUTION_REASON},
      CASE WHEN list_bool_or(list_transform(dtc, lambda c: NOT regexp_matches(c, '^[PCBU][0-9A-F]{{4}}$')))
             THEN 'bad_code'
           WHEN model IS NULL THEN 'no_model' END)"""

JUDGED = f"""
    SELECT id, status, created_at, power, dtc, {CASE_REASON} AS reason
    FROM (SELECT *, {TRIMMED.replace('text', 'description')} AS trimmed FROM docs)"""

OUTCOMES = f"""
    SELECT id, reason,
           CASE WHEN reason IS NOT NULL THEN 'validation_error' WHEN power = '5-LOW' THEN 'failed'
                WHEN created_at < TIMESTAMP '1998-01-01' THEN 'duplicate' ELSE 'inserted' END AS outcome
    FROM ({JUDGED}) WHERE status = 'F'"""

DISPOSITIONS = f"""
    SELECT id, CASE outcome WHEN 'validation_error' THEN 'dropped' WHEN 'failed' THEN 'remaining'
                            ELSE 'sent' END AS disposition
    FROM ({OUTCOMES})"""

LINE_COLUMNS = (
    "l_orderkey AS installation_id, l_linenumber AS local_id, l_linestatus, l_shipdate, l_partkey,"
    " l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
)
LINE_ORDER = [f"{c}" for c in views.VERSION_ORDER]


def one_version(direction):
    order = ", ".join(f"{c} {direction}" for c in ["l_linestatus", *LINE_ORDER])
    return (
        f"SELECT {LINE_COLUMNS} FROM lineitem QUALIFY row_number() OVER"
        f" (PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1"
    )


ALERT_BODY = (
    text(fv.ALERT_HEADING % views.SENDER + fv.ALERT_TABLE)
    + "".join(
        f" || {text(fv.ALERT_CELL.split('%s')[0] + label + fv.ALERT_CELL.split('%s')[1])}"
        f" || {value} || {text(fv.ALERT_CELL.split('%s')[2])}"
        for label, value in zip(
            fv.ALERT_LABELS,
            [
                "installation_id",
                "model",
                "violation_count",
                "CASE WHEN violation_count >= 3 THEN '⛔ ANO' ELSE 'Ne' END",
                "ts",
            ],
        )
    )
    + " || '</table>'"
)


def rolling(condition, edge):
    return f"""
        SELECT event_id, installation_id, prior_count, prior_count < {registry.CALL_LIMIT} AS admitted
        FROM (SELECT e.event_id, e.installation_id,
                (SELECT count(*) FROM usage_log p
                 WHERE p.installation_id = e.installation_id AND {condition}
                   AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id))
                   AND p.ts {edge} e.ts - INTERVAL 24 HOURS) AS prior_count
              FROM usage_log e)"""


CODE = (
    "(CASE WHEN {v} <> 0 THEN ['P','C','B','U'][({v} >> 14) + 1] || (({v} >> 12) & 3)"
    " || right(printf('%03X', {v} & 4095), 3) END)"
)


def code(value):
    return CODE.format(v=f"CAST({value} AS BIGINT)")


def joined(*codes):
    """Codes joined without nulls and repeats, first occurrence first."""
    kept = []
    for i, c in enumerate(codes):
        earlier = "".join(f" AND {c} <> coalesce({e}, '')" for e in codes[:i])
        kept.append(f"CASE WHEN {c} IS NOT NULL{earlier} THEN {c} END")
    return f"concat_ws('|', {', '.join(kept)})"


SESSIONS = f"""
    SELECT *, max(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS UNBOUNDED PRECEDING) AS response_start
    FROM (SELECT *, CASE WHEN previous IS NULL OR ts > previous + INTERVAL {views.CHUNK_GAP}
                         THEN ts END AS fresh
          FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous
                FROM events))"""

CLOSED = f"""
    HAVING max(ts) + INTERVAL {views.CHUNK_GAP} <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"""

GATED = f"""
    SELECT id, fate, CASE WHEN fate = 'rejected' THEN reason END AS reason
    FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN power = '2-HIGH' THEN 'queued'
                         ELSE 'accepted' END AS fate
          FROM (SELECT id, power, {CASE_REASON} AS reason
                FROM (SELECT * REPLACE (CASE WHEN power = '2-HIGH' THEN ' ' ELSE model END AS model),
                             {TRIMMED.replace('text', 'description')} AS trimmed FROM docs)))"""

STATEMENTS = {
    "s1_read_cases": "SELECT CAST(event_id AS VARCHAR) AS row_id, event_type AS row_status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "s1_quarantined_cases": """
        SELECT CAST(event_id AS VARCHAR) AS row_id,
               CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
               CASE WHEN event_type = 'signup' THEN 'missing' WHEN event_type = 'view' THEN 'not_an_object'
                    WHEN event_type = 'error' THEN 'unreadable' END AS reason,
               CASE WHEN event_type = 'view' THEN '[' || props || ']'
                    WHEN event_type = 'error' THEN substring(props, 1, length(props) - 1) END AS raw
        FROM events""",
    "s2_read_corpus": "SELECT id, installation_id, brand AS vehicle_brand, model AS vehicle_model, mileage, closed_at, array_to_string(symptoms, '|') AS symptoms, array_to_string(codes, '|') AS codes FROM corpus",
    "s3_insert_if_absent": one_version("ASC"),
    "s4_upsert_last": one_version("DESC"),
    "s5_update_by_json_key": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, events.ts AS created_at,
               coalesce('{"k": ' || c.k || ', "by": ' || c.last_id || '}', props) AS data,
               CASE WHEN c.k IS NOT NULL THEN 'closed' ELSE event_type END AS status,
               coalesce(c.last_ts, events.ts) AS updated_at
        FROM events LEFT JOIN (
          SELECT json_extract_string(props, '$.k') AS k, arg_max(event_id, ts) AS last_id,
                 max(ts) AS last_ts
          FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING max(value) > 150) c
          ON c.k = json_extract_string(props, '$.k')""",
    "s6_delete_by_json_key": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, props AS data,
               event_type AS status, ts AS created_at, ts AS updated_at
        FROM events WHERE json_extract_string(props, '$.k') NOT IN (
          SELECT json_extract_string(props, '$.k') FROM events WHERE event_type = 'error'
          GROUP BY 1 HAVING max(value) < 150)""",
    "s7_append_usage": "SELECT installation_id, model, tokens AS input_tokens, CASE WHEN model = 'click' THEN tokens ELSE 0 END AS output_tokens, ts AS created_at FROM usage_log WHERE success",
    "s8_retry_dead_letters": DISPOSITIONS,
    "s8_retry_counts": f"SELECT count(*) AS queued, count(*) FILTER (disposition <> 'remaining') AS left_queue, count(*) FILTER (disposition = 'sent') AS sent FROM ({DISPOSITIONS})",
    "s9_violation_alerts": f"""
        SELECT event_id, violation_count, violation_count >= 3 AS blocked,
               CASE WHEN violation_count >= 3
                    THEN '[{views.SENDER}] ⛔ Instalace ZABLOKOVÁNA — ' || violation_count || '. porušení'
                    ELSE '[{views.SENDER}] ⚠ Porušení pravidel č. ' || violation_count END AS subject,
               {ALERT_BODY} AS body
        FROM violations""",
    "s10_push_outcome": f"""
        SELECT id, outcome, outcome IN ('duplicate', 'inserted') AS ok,
               outcome = 'validation_error' AS validation_error,
               CASE outcome WHEN 'validation_error' THEN reason WHEN 'failed' THEN 'timeout'
                 ELSE CASE WHEN power_low THEN 'timeout' END END AS error
        FROM (SELECT *, FALSE AS power_low FROM ({OUTCOMES}))""",
    "p1_explode_messages": """
        SELECT id AS case_id, 0 AS position, description AS text, CAST(len(symptoms) AS INTEGER) AS n_symptoms, id || '-1' AS message_id FROM docs
        UNION ALL
        SELECT id, 2, CASE WHEN status <> 'O' THEN power ELSE '' END, CAST(len(symptoms) + 1 AS INTEGER), id || '-3' FROM docs""",
    "p2_collect_signals": "SELECT id, array_to_string(list_append(symptoms, power), '|') AS symptoms, array_to_string(dtc, '|') AS codes FROM docs",
    "p3_join_texts": "SELECT page_id, length(url || chr(10) || html) AS n_chars, md5(url || chr(10) || html) AS fingerprint, CAST(NULL AS VARCHAR) AS nothing FROM pages",
    "p4_case_to_row": """
        SELECT id AS local_id, installation_id, brand AS vehicle_brand, model AS vehicle_model,
               CASE WHEN status <> 'P' THEN mileage END AS mileage, power AS engine_power,
               array_to_string(list_append(symptoms, power), '|') AS symptoms,
               array_to_string(dtc, '|') AS codes,
               CASE WHEN status <> 'O' THEN description || chr(10) || power ELSE description END AS description,
               description AS resolution,
               strftime(coalesce(closed_at, TIMESTAMP '2002-01-01'), '%Y-%m-%d') AS closed_on
        FROM docs""",
    "p5_row_to_case": """
        SELECT id, '[Cloud] ' || CASE WHEN brand IS NULL THEN '' ELSE brand || ' ' END
                   || coalesce(model, 'Neznámý model') || ' | ' || left(description, 40) AS name,
               'uzavřený' AS status, TRUE AS "fromCloud", coalesce(brand, '') AS brand,
               coalesce(model, '') AS model, CAST(mileage AS VARCHAR) AS mileage,
               id || '_input' AS message_id, array_to_string(codes, '|') AS codes,
               description AS text
        FROM corpus""",
    "p6_case_title": """
        SELECT id, CASE WHEN model IS NULL THEN 'Nový případ'
                        ELSE model || ' · ' || split_part(power, ' ', 1) || ' kW · '
                             || replace(format('{:,}', mileage), ',', chr(160)) || ' km' END AS title
        FROM case_rows""",
    "p7_retitle_on_first_diagnosis": """
        SELECT id, CASE WHEN status = 'P' THEN 'case ' || id
                        ELSE coalesce(model, brand, 'Vozidlo') || ' | ' || symptoms[1] END AS name
        FROM docs""",
    "p8_build_query_input": """
        SELECT id AS query_id, installation_id, coalesce(model, '') AS model,
               array_to_string(list_append(symptoms, power), '|') AS symptoms,
               array_to_string(dtc, '|') AS codes,
               CASE WHEN status <> 'O' THEN description || ' ' || power ELSE description END AS text
        FROM docs WHERE status <> 'F'""",
    "p9_render_user_prompt": """
        SELECT id, concat_ws(chr(10),
                 CASE WHEN brand IS NOT NULL OR model IS NOT NULL
                      THEN 'Vozidlo: ' || concat_ws(' ', brand, model, power) END,
                 CASE WHEN status = 'P' THEN 'Nájezd: abc km' ELSE 'Nájezd: ' || mileage || ' km km' END,
                 'Příznaky: ' || array_to_string(list_append(symptoms, power), ', '),
                 CASE WHEN len(dtc) > 0 THEN 'OBD kódy: ' || array_to_string(dtc, ', ') END,
                 CASE WHEN status = 'O' THEN 'Popis mechanika:' || chr(10) || description
                      ELSE 'Popis mechanika 1:' || chr(10) || description || chr(10)
                           || 'Popis mechanika 2:' || chr(10) || power END) AS user_prompt
        FROM docs WHERE status <> 'F'""",
    "v1_validate_resolution": f"SELECT source, text_id, {RESOLUTION_REASON} AS reason FROM (SELECT *, {TRIMMED} AS trimmed FROM free_texts)",
    "v2_validate_case": f"SELECT id, reason, CASE WHEN reason = 'bad_code' THEN list_filter(dtc, lambda c: NOT regexp_matches(c, '^[PCBU][0-9A-F]{{4}}$'))[1] END AS bad_code FROM ({JUDGED})",
    "v3_check_constraints": """
        SELECT id, length(description) BETWEEN 10 AND 200 AS resolution_length_ok,
               len(codes) > 0 OR len(symptoms) > 0 OR length(description) >= 20 AS signal_ok,
               model IS NOT NULL AS model_ok,
               length(description) BETWEEN 10 AND 200
               AND (len(codes) > 0 OR len(symptoms) > 0 OR length(description) >= 20)
               AND model IS NOT NULL AS valid
        FROM case_rows""",
    "v4_extract_codes": """
        SELECT id, array_to_string(list_sort(list_distinct(list_concat(['P0401', 'U0001', 'C12FF'],
                 list_filter(list_transform(codes, lambda c: upper(replace(c, 'Brand#', 'B00'))),
                             lambda c: regexp_full_match(c, '[PCBU][0-9A-F]{4}'))))), '|') AS codes
        FROM case_rows""",
    "v5_topic_relevance": f"SELECT source, text_id, {RELEVANT} AS relevant FROM (SELECT *, {TRIMMED} AS trimmed FROM free_texts)",
    "v6_admit_input": f"""
        SELECT case_id, position, CAST(used AS BIGINT) AS used_before,
               CASE WHEN used >= {registry.TOKEN_BUDGET} THEN 'token_budget'
                    WHEN trimmed <> '' AND NOT {RELEVANT} THEN 'off_topic' END AS reason
        FROM (SELECT *, {TRIMMED} AS trimmed,
                coalesce(sum(CASE WHEN type = 'diagnosis' THEN tokens END) OVER
                  (PARTITION BY case_id ORDER BY position
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
              FROM messages)
        WHERE type = 'input'""",
    "v7_admit_request": """
        SELECT event_id,
               CASE WHEN value >= 300 THEN 'no_installation'
                    WHEN model NOT IN ('view', 'click', 'signup') THEN 'model_not_allowed'
                    WHEN value <= 5 THEN 'no_messages' END AS reason,
               CAST(least(CASE WHEN tokens > 20 THEN tokens * 100 ELSE 4000 END, 8000) AS BIGINT) AS granted_tokens
        FROM usage_log""",
    "v8_own_rows": """
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, event_type AS status
        FROM events WHERE user_id = (SELECT user_id FROM events GROUP BY user_id
                                     ORDER BY count(*) DESC, CAST(user_id AS VARCHAR) DESC LIMIT 1)""",
    "v9_non_empty_submission": "SELECT id, CAST(len(codes) + CASE WHEN model IS NULL THEN 0 ELSE 1 END AS INTEGER) AS total, len(codes) > 0 OR model IS NOT NULL AS accepted FROM case_rows",
    "v10_active_brands": "SELECT r_name AS brand, 'expertise ' || r_name AS expertise, r_regionkey = (SELECT min(r_regionkey) FROM region WHERE r_name LIKE 'A%') AS is_default FROM region WHERE r_name LIKE 'A%'",
    "j1_candidate_cases": "SELECT query_id, CAST(count(*) AS INTEGER) AS n_candidates, string_agg(case_id, '|' ORDER BY candidate_rank) AS case_ids FROM candidates GROUP BY query_id",
    "j2_similarity_score": "SELECT query_id, tenths / 10 AS score, is_own, count(*) AS n_cases FROM scored GROUP BY ALL",
    "j2_self_similarity": """
        SELECT r.id, (CASE WHEN model IS NULL THEN 0 ELSE 30 END + 20
                + 40 * len(list_filter(t_codes, lambda x: contains(all_text, x)))
                + 15 * len(list_filter(t_symptoms, lambda x: contains(all_text, x)))
                + least(20, 3 * len(list_filter(t_words, lambda x: contains(all_text, x))))) / 10 AS score
        FROM case_rows r JOIN terms t ON t.id = r.id JOIN texts x ON x.id = r.id""",
    "j3_search_top5": "SELECT query_id, CAST(hit_rank AS INTEGER) AS hit_rank, case_id, tenths / 10 AS score, is_own FROM hits",
    "j4_evidence_join": """
        SELECT id AS case_id, count(DISTINCT m) AS n_cited,
               count(DISTINCT m) FILTER (m IN (SELECT id FROM corpus)) AS n_found
        FROM (SELECT id, unnest([installation_id, CAST(mileage AS VARCHAR)]) AS m FROM case_rows)
        GROUP BY id""",
    "j5_brand_lookup": f"""
        SELECT id, c.brand, r_name AS catalog_brand,
               coalesce('expertise ' || r_name, {text(fv.DEFAULT_EXPERTISE)}) AS expertise
        FROM (SELECT id, CASE WHEN mileage > 250000 THEN 'asia' ELSE brand END AS brand FROM case_rows) c
        LEFT JOIN region ON lower(r_name) = lower(c.brand)""",
    "j6_model_powers": """
        SELECT id, c.model AS vehicle_model, coalesce(p.powers, '') AS powers
        FROM case_rows c LEFT JOIN (
          SELECT n_name, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS powers
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          WHERE n_nationkey <> 3 GROUP BY n_name) p ON p.n_name = c.model""",
    "j7_new_pending_codes": """
        SELECT id, array_to_string(list_concat(
                 list_filter(list_reverse(codes), lambda c: length(c) <> 7), symptoms), '|') AS new_codes
        FROM case_rows""",
    "j8_symptom_category_counts": "SELECT id, left(s, 1) AS category, count(*) AS n_selected FROM (SELECT id, unnest(symptoms) AS s FROM case_rows) GROUP BY ALL",
    "a1_total_count": "SELECT count(*) AS n FROM corpus",
    "a2_top_codes": "SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM corpus) GROUP BY code ORDER BY n DESC, code LIMIT 20",
    "a3_top_models": "SELECT model AS vehicle_model, count(*) AS n FROM corpus WHERE model IS NOT NULL GROUP BY model",
    "a4_recent_rows": f"SELECT id, created_at, model AS vehicle_model FROM corpus WHERE created_at > TIMESTAMP '{registry.CORPUS_AS_OF}' - INTERVAL 30 DAYS AND created_at <= TIMESTAMP '{registry.CORPUS_AS_OF}'",
    "a5_status_counts": "SELECT count(*) AS n_cases, count(*) FILTER (status = 'F') AS n_closed FROM case_rows",
    "a5_diagnosis_counts": "SELECT conv_id AS case_id, count(*) FILTER (role = 'assistant') AS n_diagnoses FROM conversations GROUP BY conv_id",
    "a6_case_tokens": "SELECT installation_id, CAST(sum(CASE WHEN model = 'click' THEN 2 * tokens ELSE tokens END) AS BIGINT) AS tokens FROM usage_log GROUP BY installation_id",
    "a7_daily_count": f"SELECT installation_id, count(*) AS n FROM usage_log WHERE ts > TIMESTAMP '{registry.AS_OF}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{registry.AS_OF}' GROUP BY installation_id",
    "a7_daily_count_function": f"SELECT installation_id, CAST(count(*) FILTER (ts > TIMESTAMP '{registry.AS_OF}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{registry.AS_OF}') AS INTEGER) AS n FROM usage_log GROUP BY installation_id",
    "a8_violation_totals": "SELECT installation_id, count(*) AS violations, count(*) >= 3 AS blocked FROM violations GROUP BY installation_id",
    "a9_signal_counts": "SELECT id, CAST(len(symptoms) AS INTEGER) AS n_symptoms, CAST(len(codes) AS INTEGER) AS n_codes, 0 AS n_pending FROM case_rows",
    "w1_rolling_write_limit": rolling("TRUE", ">"),
    "w2_rolling_call_limit": rolling("p.success", ">="),
    "w3_input_round_no": "SELECT case_id, position, CAST(count(*) FILTER (type = 'input') OVER (PARTITION BY case_id ORDER BY position) AS BIGINT) AS round_no FROM messages",
    "w4_token_budget": f"""
        SELECT case_id, position, used, percent,
               CASE WHEN percent >= 90 THEN 'critical' WHEN percent >= 70 THEN 'warning' ELSE 'normal' END AS band,
               CASE WHEN percent >= 5 THEN percent || '%' ELSE '<1%' END AS label
        FROM (SELECT case_id, position, used,
                CAST(least(100, floor(used * 100.0 / {registry.TOKEN_BUDGET} + 0.5)) AS INTEGER) AS percent
              FROM (SELECT case_id, position, CAST(sum(tokens) OVER (PARTITION BY case_id ORDER BY position) AS BIGINT) AS used FROM messages))""",
    "w5_first_diagnosis": """
        SELECT case_id, position, type = 'diagnosis' AND position = min(position) FILTER (type = 'diagnosis')
                 OVER (PARTITION BY case_id) AS is_first
        FROM messages""",
    "w6_running_violations": "SELECT event_id, installation_id, violation_count, violation_count >= 3 AS blocked FROM violations",
    "w7_carry_group_header": "SELECT brand, label, 'models of ' || brand AS header FROM items WHERE active AND label IS NOT NULL",
    "w8_hit_rank": "SELECT CAST(hit_rank AS INTEGER) AS hit_rank, count(*) AS n_queries, count(*) FILTER (is_own) AS n_own FROM hits GROUP BY hit_rank",
    "o1_newest_n": "SELECT id, closed_at FROM corpus ORDER BY closed_at DESC NULLS FIRST, id LIMIT 200",
    "o2_newest_first": "SELECT id, created_at FROM case_rows",
    "o3_multi_key_topk": """
        SELECT query_id, CAST(hit_rank AS INTEGER) AS hit_rank, case_id, tenths / 10 AS score, is_own
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tenths DESC, is_own DESC,
                          closed_at DESC NULLS FIRST, case_id) AS hit_rank FROM scored)
        WHERE hit_rank <= 3""",
    "o4_top_fault": "SELECT answer_id, fault_name AS top_fault FROM faults WHERE position = 0",
    "u1_merge_code_lists": "SELECT id, array_to_string(list_concat(list_reverse(symptoms), codes), '|') AS codes FROM case_rows",
    "u2_union_candidates": """
        SELECT id AS query_id, CASE WHEN brand IS NULL THEN 'code' ELSE 'brand+code' END AS shape,
               coalesce(brand, '') AS brand, unnest(codes) AS term FROM asked
        UNION ALL
        SELECT id, CASE WHEN model IS NOT NULL AND brand IS NOT NULL THEN 'brand+model'
                        WHEN model IS NOT NULL THEN 'model' WHEN brand IS NOT NULL THEN 'brand'
                        ELSE 'all' END, coalesce(brand, ''), coalesce(model, '')
        FROM asked WHERE len(codes) = 0""",
    "d1_decode_dtc": f"SELECT o_orderkey, {code('v')} AS code FROM (SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) % 65536 AS v FROM orders)",
    "d2_clean_response": """
        SELECT scan_id, '03' AS mode,
               CASE priority WHEN '1-URGENT' THEN 'CANERROR' WHEN '5-LOW' THEN 'NODATA'
                    WHEN '2-HIGH' THEN 'UNABLETOCONNECT'
                    ELSE '4302' || printf('%04X', customer) || printf('%04X', price) END AS lines
        FROM scans
        UNION ALL
        SELECT scan_id, '07', CASE WHEN status = 'P' THEN 'BUSBUSY'
                 ELSE '4702' || printf('%04X', customer) || printf('%04X', ordered) END
        FROM scans""",
    "d3_parse_response": f"SELECT l_orderkey AS scan_id, l_linenumber, l_partkey, l_suppkey, {joined(code('l_partkey % 65536'), code('l_suppkey % 65536'))} AS codes, CAST(NULL AS VARCHAR) AS error FROM lineitem",
    "d3_scan_errors": f"""
        SELECT mode, error, count(*) AS n, CAST(sum(n_codes) AS BIGINT) AS n_codes FROM (
          SELECT '03' AS mode,
                 CASE priority WHEN '1-URGENT' THEN 'can_error' WHEN '2-HIGH' THEN 'no_connection' END AS error,
                 CASE WHEN priority IN ('3-MEDIUM', '4-NOT SPECIFIED')
                      THEN (customer <> 0)::INT + (price <> 0 AND price <> customer)::INT ELSE 0 END AS n_codes
          FROM scans
          UNION ALL
          SELECT '07', CASE WHEN status = 'P' THEN 'bus_busy' END,
                 CASE WHEN status <> 'P'
                      THEN (customer <> 0)::INT + (ordered <> 0 AND ordered <> customer)::INT ELSE 0 END
          FROM scans)
        GROUP BY ALL""",
    "d4_is_adapter": "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS is_adapter FROM orders",
    "d4_adapter_in_texts": """
        SELECT 'pages' AS origin, CAST(page_id AS BIGINT) AS item_id, regexp_matches(url, '(?i)ELM ?327|OBDII') AS is_adapter FROM pages
        UNION ALL
        SELECT 'documents', CAST(doc_id AS BIGINT), regexp_matches(text, '(?i)ELM ?327|OBDII') FROM documents""",
    "d5_read_codes": f"""
        SELECT scan_id, CASE WHEN reads THEN {joined(code('customer'), code('price'))} ELSE '' END AS stored,
               CASE WHEN error IS NOT NULL OR status = 'P' THEN ''
                    ELSE concat_ws('|',
                      CASE WHEN customer <> 0 AND NOT reads THEN {code('customer')} END,
                      CASE WHEN ordered <> 0 AND ordered <> customer AND NOT (reads AND ordered = price)
                           THEN {code('ordered')} END) END AS pending,
               error
        FROM (SELECT *, priority IN ('3-MEDIUM', '4-NOT SPECIFIED') AS reads,
                CASE priority WHEN '1-URGENT' THEN 'can_error' WHEN '2-HIGH' THEN 'no_connection' END AS error
              FROM scans)""",
    "d6_assemble_chunks": f"""
        SELECT CAST(user_id AS VARCHAR) AS port, response_start,
               string_agg(event_type, '' ORDER BY ts, event_id)
                 FILTER (ts < response_start + INTERVAL {views.CHUNK_LIMIT}) AS raw,
               count(*) FILTER (ts < response_start + INTERVAL {views.CHUNK_LIMIT}) AS n_chunks,
               count(*) FILTER (ts >= response_start + INTERVAL {views.CHUNK_LIMIT}) AS n_late
        FROM ({SESSIONS}) GROUP BY user_id, response_start""",
    "g1_parse_answer": "SELECT answer_id, status, CAST(n_faults AS INTEGER) AS n_faults, CASE WHEN status <> 'failed' THEN p_name END AS summary FROM shapes",
    "g2_join_content_blocks": """
        SELECT answer_id, length(raw) AS n_chars, md5(raw) AS fingerprint
        FROM (SELECT answer_id, prefix || CASE WHEN kind IN ('PROMO', 'STANDARD') THEN ''
                       WHEN kind = 'MEDIUM' THEN first_fault || ',' || second_fault || ', '
                       WHEN p_size = 50 THEN '{"název":"Nesouvisející dotaz","pravděpodobnost":0}'
                       ELSE first_fault || ',' || second_fault || ',' || third_fault END || suffix AS raw
              FROM (SELECT *,
                      CASE kind WHEN 'STANDARD' THEN 'sorry, ' WHEN 'SMALL' THEN 'Answer: ' ELSE '' END
                      || CASE WHEN kind = 'STANDARD' THEN ''
                              ELSE '{"shrnutí":"' || p_name || '","závady":[' END AS prefix,
                      '{"název":"' || p_name || '","pravděpodobnost":' || p_size || shared
                        || CASE WHEN p_size > 40 THEN 'kritická' WHEN p_size > 20 THEN 'vysoká'
                                ELSE 'nízká' END || '"}' AS first_fault,
                      '{"název":"' || p_brand || '","pravděpodobnost":45' || shared || 'střední"}' AS second_fault,
                      '{"název":"third","pravděpodobnost":71' || shared || 'vysoká"}' AS third_fault,
                      CASE kind WHEN 'MEDIUM' THEN '{"název":"cut } off [' WHEN 'PROMO' THEN '{"název":"only'
                                WHEN 'STANDARD' THEN 'no object at all'
                        ELSE '],"doporučené_testy":[' || CASE WHEN p_size > 25 THEN '"test"' ELSE '' END
                             || '],"varování":null,"další_info":"'
                             || CASE WHEN p_size > 10 THEN 'Výsledek zkrácen.' ELSE 'more' END || '"}'
                             || CASE WHEN kind = 'ECONOMY' THEN ' thanks' ELSE '' END END AS suffix
                    FROM (SELECT *, ',"popis":"a \\"quoted\\" {brace} and ]","příznaky_shoda":["' || p_name
                            || '"],"obd_kódy":["' || p_brand || '"],"naléhavost":"' AS shared
                          FROM shapes)))""",
    "g3_explode_faults": """
        SELECT answer_id, CAST(position AS INTEGER) AS position, position = 0 AS is_primary, fault_name,
               CAST(probability AS INTEGER) AS probability,
               CASE WHEN NOT off_topic THEN p_name END AS first_symptom,
               CASE WHEN NOT off_topic THEN 'a "quoted" {brace} and ]' END AS description
        FROM faults""",
    "g4_fault_bands": """
        SELECT answer_id, CAST(position AS INTEGER) AS position,
               CASE WHEN off_topic THEN 'low' WHEN position = 1 THEN 'medium' WHEN position = 2 THEN 'high'
                    WHEN p_size > 40 THEN 'critical' WHEN p_size > 20 THEN 'high' ELSE 'low' END AS urgency_level,
               CASE WHEN probability > 70 THEN 'high' WHEN probability > 40 THEN 'medium' ELSE 'low' END AS probability_band
        FROM faults""",
    "g5_answer_meta": """
        SELECT answer_id, CASE WHEN status = 'ok' AND p_size <= 10 THEN 'more' END AS info,
               status = 'ok' AND (p_size > 25 OR p_size <= 10) AS has_meta
        FROM shapes WHERE status <> 'failed'""",
    "g6_off_topic_answers": "SELECT kind, count(*) AS n_answers, count(*) FILTER (p_size = 50 AND kind IN ('LARGE', 'SMALL', 'ECONOMY')) AS n_off_topic FROM shapes GROUP BY kind",
    "r1_match_strength": """
        SELECT CASE WHEN tenths >= 80 THEN '🔴 VYSOKÁ SHODA' WHEN tenths >= 50 THEN '🟡 STŘEDNÍ SHODA'
                    ELSE '🟢 ČÁSTEČNÁ SHODA' END AS strength, count(*) AS n_hits
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tenths DESC, is_own DESC,
                          closed_at DESC NULLS FIRST, case_id) AS hit_rank FROM scored)
        WHERE hit_rank <= 5 GROUP BY 1""",
    "r2_context_block": "SELECT query_id, context FROM blocks",
    "r3_system_prompt": f"""
        SELECT q.id AS query_id, {text(fv.PROMPT_OPENING)}
               || CASE WHEN q.power = '1-URGENT' THEN 'expertise AFRICA' ELSE {text(fv.DEFAULT_EXPERTISE)} END
               || '.' || coalesce(b.context, '') || {text(fv.PROMPT_RULES)} AS system_prompt
        FROM asked q LEFT JOIN blocks b ON b.query_id = q.id""",
}

_CLOSE = registry.CLOSE_SETTINGS
CLOSED_FATES = f"""
    SELECT * FROM (WITH judged AS (
        SELECT id, installation_id, status, closed_at, power, {CASE_REASON} AS reason
        FROM (SELECT * REPLACE (CASE WHEN power = '2-HIGH' THEN ' ' ELSE model END AS model),
                     {TRIMMED.replace('text', 'description')} AS trimmed FROM docs)),
    used AS (
        SELECT installation_id, count(*) AS n FROM corpus
        WHERE created_at > TIMESTAMP '{registry.CORPUS_AS_OF}' - INTERVAL {_CLOSE["length"]}
          AND created_at <= TIMESTAMP '{registry.CORPUS_AS_OF}' GROUP BY installation_id),
    fresh AS (
        SELECT *, row_number() OVER (PARTITION BY installation_id
                      ORDER BY coalesce(closed_at, TIMESTAMP '2002-01-01'), id) AS place
        FROM judged WHERE reason IS NULL AND power <> '2-HIGH' AND status <> 'F')
    SELECT j.id, j.installation_id,
           CASE WHEN j.reason IS NOT NULL THEN 'rejected' WHEN j.power = '2-HIGH' THEN 'queued'
                WHEN j.status = 'F' THEN 'duplicate'
                WHEN f.place + coalesce(u.n, 0) <= {_CLOSE["limit"]} THEN 'inserted' ELSE 'queued' END AS fate,
           CASE WHEN j.reason IS NOT NULL THEN j.reason WHEN j.power = '2-HIGH' THEN 'constraint'
                WHEN f.place + coalesce(u.n, 0) > {_CLOSE["limit"]} THEN 'rate_limit' END AS reason
    FROM judged j LEFT JOIN fresh f ON f.id = j.id LEFT JOIN used u ON u.installation_id = j.installation_id)"""

STATEMENTS |= {
    "close_flow": CLOSED_FATES,
    "retry_flow": f"""
        SELECT id, CASE fate WHEN 'rejected' THEN 'dropped' WHEN 'queued' THEN 'remaining' ELSE 'sent' END AS disposition
        FROM ({CLOSED_FATES})""",
    "gate_rounds": f"""
        SELECT * FROM (WITH judged AS (
            SELECT id, installation_id, status, CASE WHEN mileage >= {registry.ROUND_BUDGET} THEN 'token_budget'
                       WHEN NOT {RELEVANT} THEN 'off_topic' END AS own
            FROM (SELECT *, {TRIMMED.replace('text', 'description')} AS trimmed FROM docs WHERE status <> 'F')),
        used AS (
            SELECT installation_id, count(*) AS n FROM usage_log
            WHERE success AND ts >= TIMESTAMP '{registry.AS_OF}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{registry.AS_OF}'
            GROUP BY installation_id),
        placed_rounds AS (
            SELECT id, row_number() OVER (PARTITION BY installation_id ORDER BY id) AS place FROM judged WHERE own IS NULL)
        SELECT id, reason, CAST(CASE status WHEN 'P' THEN 3 ELSE 4 END
                                - CASE WHEN reason IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_messages
        FROM (SELECT j.id, j.status, coalesce(own, CASE WHEN p.place + coalesce(u.n, 0) > {registry.CALL_LIMIT}
                                                THEN 'rate_limit' END) AS reason
              FROM judged j LEFT JOIN placed_rounds p ON p.id = j.id
              LEFT JOIN used u ON u.installation_id = j.installation_id))""",
    "record_diagnoses": """
        SELECT id,
               CASE WHEN done AND status = 'P' THEN coalesce(model, brand, 'Vozidlo') || ' | pump'
                    ELSE 'case ' || id END AS name,
               CAST(CASE status WHEN 'P' THEN 3 ELSE 4 END + CASE WHEN done THEN 1 WHEN error IS NOT NULL THEN -1 ELSE 0 END
                    AS INTEGER) AS n_messages,
               CAST(mileage AS BIGINT) + CASE power WHEN '1-URGENT' THEN 15 WHEN '4-NOT SPECIFIED' THEN 10 ELSE 0 END AS "tokenCount",
               error, id || CASE WHEN done THEN '-d' WHEN error IS NOT NULL THEN '-3' ELSE '-4' END AS last_id,
               CASE WHEN done THEN 'diagnosis' ELSE 'input' END AS last_type,
               CASE power WHEN '1-URGENT' THEN '{"závady":[{"název":"pump","pravděpodobnost":70}]}'
                          WHEN '4-NOT SPECIFIED' THEN '{"závady":[{"název":"pump","pravděpodobnost":70}],"doporučené_testy":[]}' END AS last_result
        FROM (SELECT *, power IN ('1-URGENT', '4-NOT SPECIFIED') AS done,
                     CASE power WHEN '2-HIGH' THEN 'unreadable' WHEN '3-MEDIUM' THEN 'no_faults' END AS error
              FROM docs WHERE status <> 'F')""",
    "t1_debounced_last_write": f"""
        SELECT CAST(user_id AS VARCHAR) AS case_id, arg_max(event_type || '-' || event_id, ts) AS data,
               max(ts) AS edited_at, count(*) AS n_edits
        FROM ({SESSIONS}) GROUP BY user_id, response_start {CLOSED}""",
    "s3_stored_insert": STATEMENTS["s3_insert_if_absent"],
    "s4_stored_upsert": STATEMENTS["s4_upsert_last"],
    "t2_idempotent_ingest": STATEMENTS["s3_insert_if_absent"],
    "t2_without_recent_repeats": "SELECT DISTINCT l_orderkey AS installation_id, l_linenumber AS local_id FROM lineitem",
    "t3_stream_rate_limit": "SELECT event_id, installation_id, admitted FROM walk",
    "t3_batch_admission": "SELECT event_id, installation_id, admitted FROM walk",
    "t4_stream_chunk_assembly": f"""
        SELECT CAST(user_id AS VARCHAR) AS port, string_agg(event_type, '' ORDER BY ts, event_id) AS raw,
               response_start, count(*) AS n_chunks
        FROM ({SESSIONS}) GROUP BY user_id, response_start {CLOSED}""",
    "j3_indexed_search": STATEMENTS["j3_search_top5"],
    "t5_stream_search": STATEMENTS["j3_search_top5"],
    "t6_stream_quality_gate": GATED,
    "t7_stream_violations": STATEMENTS["s9_violation_alerts"],
}


def oracle_sql():
    return {name: with_views(sql) for name, sql in STATEMENTS.items()}
