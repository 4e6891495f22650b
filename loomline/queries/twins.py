"""DuckDB twins of the queries in ``texts``. Patterns come from the fixed values, so both sides use the same ones."""

from __future__ import annotations

from loomline import adapters as A
from loomline.functions import patterns as P
from loomline.queries.texts import _LEAKS as LEAKS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


def _cards(text: str, pattern: str) -> str:
    """Number of matches whose digits, 13 to 19 of them, have a doubled sum that ends in 0."""
    digit = "substr(s, (length(s) - i)::INTEGER, 1)::INTEGER * (1 + i % 2)"
    luhn = f"list_sum(list_transform(range(length(s)), lambda i: CASE WHEN {digit} > 9 THEN {digit} - 9 ELSE {digit} END)) % 10 = 0"
    return f"len(list_filter(list_transform(regexp_extract_all({text}, {_q(pattern)}), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda s: length(s) BETWEEN 13 AND 19 AND {luhn}))"


def _clean(text: str) -> str:
    for kind, pattern in P.SECRETS:
        text = f"regexp_replace({text}, {_q(pattern)}, '[REDACTED:{kind}]', 'g')"
    for kind, before, value, after in P.SECRET_VALUES:
        flags, rest = (before[:4], before[4:]) if before.startswith("(?i)") else ("", before)
        text = f"regexp_replace({text}, {_q(f'{flags}({rest}){value}({after})')}, '\\1[REDACTED:{kind}]\\2', 'g')"
    return text


_INJECTION = r"(?i)\b(?:" + "|".join(P.INJECTIONS) + r")\b"
_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)
_STEM1 = (
    "CASE WHEN length(w) > 5 AND w LIKE '%ing' THEN left(w, length(w) - 3) WHEN length(w) > 4 AND w LIKE '%ed' THEN left(w, length(w) - 2) "
    "WHEN length(w) > 4 AND w LIKE '%es' THEN left(w, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
)


def _tokens(text: str) -> str:
    words = f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
    return f"list_sort(list_distinct(list_transform(list_transform({words}, lambda w: {_STEM1}), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%e' THEN left(w, length(w) - 1) ELSE w END)))"


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({{t}}, {_q(p)}) THEN '{c}'" for c, p in P.CATEGORIES) + " ELSE 'unknown' END"
_RANK = "list_position(['false', 'high_probability', 'verified'], {})"

_LADDER = f"""WITH RECURSIVE {A.SQL['facts']},
    e AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM fact_events),
    s AS (SELECT DISTINCT entity, 0::BIGINT AS n, NULL::VARCHAR AS value, NULL::VARCHAR AS confidence, NULL::BIGINT AS seq, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value,
                 NULL::VARCHAR AS old_confidence, NULL::VARCHAR AS new_confidence, NULL::VARCHAR AS reason FROM e
        UNION ALL
        SELECT entity, n, CASE WHEN r = 'demote' OR r = 'skip' OR r = 'reassert' OR r = 'rejected' THEN sv ELSE ev END, nc, seq, sv, CASE WHEN r = 'demote' THEN sv ELSE ev END,
               sc, CASE WHEN r = 'rejected' THEN ec ELSE nc END, CASE WHEN r <> 'skip' THEN r END
        FROM (SELECT *, CASE r WHEN 'skip' THEN sc WHEN 'demote' THEN 'false' WHEN 'initial' THEN ec WHEN 'contradicted' THEN ec WHEN 'rejected' THEN sc ELSE CASE WHEN up THEN ec ELSE sc END END AS nc
              FROM (SELECT *, CASE WHEN kind = 'demote' THEN CASE WHEN sc IS NULL OR sc = 'false' THEN 'skip' ELSE 'demote' END WHEN sc IS NULL THEN 'initial'
                                   WHEN coalesce(sv = ev, false) THEN 'reassert' WHEN up THEN 'contradicted' ELSE 'rejected' END AS r
                    FROM (SELECT e.entity, e.n, e.kind, e.seq, s.value AS sv, s.confidence AS sc, e.value AS ev, e.confidence AS ec,
                                 {_RANK.format('e.confidence')} >= {_RANK.format('s.confidence')} AS up
                          FROM s JOIN e ON e.entity = s.entity AND e.n = s.n + 1))))
    SELECT """


def _side(k: int) -> str:
    return f"""(SELECT o_orderkey AS entity, CASE WHEN o_orderkey % {4 + k} = 0 THEN 'x' ELSE o_orderpriority END AS value, (['false', 'high_probability', 'verified'])[1 + (o_orderkey * {7 + k}) % 3] AS confidence,
        o_orderkey % {11 + k} AS created_at, o_orderkey % {5 + 2 * k} AS last_updated FROM orders WHERE o_orderkey % 3 <> {k})"""


def _chosen(column: str) -> str:
    same = {"value": "a.value", "confidence": f"CASE WHEN {_RANK.format('a.confidence')} >= {_RANK.format('b.confidence')} THEN a.confidence ELSE b.confidence END", "created_at": "least(a.created_at, b.created_at)", "last_updated": "greatest(a.last_updated, b.last_updated)"}[column]
    ra, rb = _RANK.format("a.confidence"), _RANK.format("b.confidence")
    return f"""CASE WHEN a.entity IS NULL THEN b.{column} WHEN b.entity IS NULL THEN a.{column}
        WHEN a.confidence = 'false' AND b.confidence <> 'false' THEN CASE WHEN a.last_updated >= b.last_updated THEN a.{column} ELSE b.{column} END
        WHEN b.confidence = 'false' AND a.confidence <> 'false' THEN CASE WHEN b.last_updated >= a.last_updated THEN b.{column} ELSE a.{column} END
        WHEN a.value = b.value THEN {same} WHEN {ra} > {rb} THEN a.{column} WHEN {ra} < {rb} THEN b.{column}
        WHEN a.last_updated > b.last_updated THEN a.{column} WHEN a.last_updated < b.last_updated THEN b.{column} WHEN a.value >= b.value THEN a.{column} ELSE b.{column} END AS {column}"""


def _bm25(table: str, key: str, columns: dict[str, float], terms: list[str], prefix: bool) -> str:
    """Words without accents in lower case; a phrase is one or more of them between single spaces."""
    flat = lambda c: f"(' ' || array_to_string(regexp_extract_all(lower(strip_accents({c})), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ')"
    count = lambda c: f"(length({flat(c)}) - length(replace({flat(c)}, ' ', '')) - 1 - ({flat(c)} = '  ')::INTEGER)"
    length = " + ".join(count(c) for c in columns)
    end = "" if prefix else " "
    hits = lambda c, t: f"((length({flat(c)}) - length(replace({flat(c)}, ' {t}{end}', ''))) / {len(t) + 1 + len(end)})"
    # neighbours share a space, so each space is two
    twice = lambda c, t: hits(c, t).replace(flat(c), f"replace({flat(c)}, ' ', '  ')") if " " not in t else f"len(regexp_extract_all({flat(c)}, ' {t}{end}'))"
    tf = ", ".join("(" + " + ".join(f"{w} * {twice(c, t)}" for c, w in columns.items()) + f")::DOUBLE AS tf{k}" for k, t in enumerate(terms))
    dfs = ", ".join(f"count(*) FILTER (tf{k} > 0) AS df{k}" for k in range(len(terms)))
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * length / mean))" for k in range(len(terms)))
    hit = " + ".join(f"(tf{k} > 0)::INTEGER" for k in range(len(terms)))
    return f"""WITH c AS (SELECT {key}, ({length})::DOUBLE AS length, {tf} FROM {table}), st AS (SELECT count(*) AS n, avg(length) AS mean, {dfs} FROM c),
        h AS (SELECT {key}, ({hit})::INTEGER AS matched, {score} AS sc FROM c, st WHERE {hit} > 0)"""


_SECTIONED = """WITH w AS (SELECT doc_id, '# Top' || chr(10) || text || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## BOOT BOUNDARY below' ELSE 'about the BOOT BOUNDARY' END || chr(10) || lang
            || chr(10) || '# One ' || source || chr(10) || 'memory_id: deadbeef' || lpad(doc_id::VARCHAR, 8, '0') || chr(10) || '## Two' || chr(10) || 'end' || chr(10) AS t FROM documents),
        x AS (SELECT doc_id, length(t) AS total, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM w),
        l AS (SELECT doc_id, total, line, k, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM x)"""
_TRUSTED = "['trusted_local', 'trusted_curated_import', 'semi_trusted_remote', 'untrusted_web']"
_FLUFF = "(" + " OR ".join(f"regexp_matches(lower(claim), {_q(p)})" for p in P.FLUFF) + r" OR len(list_filter(regexp_split_to_array(trim(claim), '\s+'), lambda w: w <> '')) < 3)"

_LEAKY = f"leaky AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || ([{', '.join(_q(x) for x in LEAKS)}])[1 + (doc_id // 5) % {len(LEAKS)}] ELSE text END AS text FROM documents)"

ORACLE_SQL = {
    "redacted": f"""WITH {_LEAKY}, c AS (SELECT doc_id, text, {_clean('text')} AS clean FROM leaky)
        SELECT doc_id, sha256(clean) AS clean_sha256, len(regexp_extract_all(clean, '\\[REDACTED:'))::BIGINT AS marks FROM c WHERE clean <> text""",
    "redaction_kinds": f"""WITH {_LEAKY}, c AS (SELECT unnest(regexp_extract_all({_clean('text')}, '\\[REDACTED:([a-z-]+)\\]', 1)) AS kind FROM leaky) SELECT kind, count(*) AS n FROM c GROUP BY kind""",
    "suggested_category": f"SELECT {_CATEGORY.replace('{t}', 'text')} AS category, count(*) AS n FROM documents GROUP BY 1",
    "category_keywords": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'topology' WHEN 1 THEN 'incident' ELSE 'unknown' END AS category,
        CASE p_partkey % 3 WHEN 0 THEN 'port' WHEN 1 THEN 'outage,crash,failure' ELSE '' END AS keywords FROM part""",
    "routine_logs": "SELECT event_type, (event_id % 5 < 4 OR event_id % 7 = 0) AS routine, count(*) AS n FROM events GROUP BY 1, 2",
    "token_sets": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "personal_data": "SELECT " + ", ".join(f"sum({_cards('text', p) if n == 'pii_credit_card_luhn' else _count('text', p)})::BIGINT AS {n}" for n, _, _, p in P.PII) + " FROM documents",
    "card_numbers": """WITH d AS (SELECT o_orderkey, '45320151' || lpad(o_orderkey::VARCHAR, 4, '0') || '0366' AS s FROM orders),
        v AS (SELECT o_orderkey, list_sum(list_transform(range(16), lambda i: CASE WHEN s[16 - i]::INTEGER * (1 + i % 2) > 9 THEN s[16 - i]::INTEGER * 2 - 9 ELSE s[16 - i]::INTEGER * (1 + i % 2) END)) AS t FROM d)
        SELECT o_orderkey FROM v WHERE t % 10 = 0""",
    "secret_detectors": "SELECT " + ", ".join(f"sum({_count('text', p)})::BIGINT AS {n}" for n, p in P.SECRET_DETECTORS) + " FROM documents",
    "injections": f"SELECT * FROM (SELECT doc_id, {_count('text', _INJECTION)}::BIGINT + CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 0 END AS n FROM documents) WHERE n > 0",
    "fluff": f"""WITH c AS (SELECT CASE p_partkey % 4 WHEN 0 THEN 'The user is awesome today' WHEN 1 THEN p_name WHEN 2 THEN 'user is a ' || p_type || ' person' ELSE 'uses ' || p_name || ' daily at work' END AS claim FROM part)
        SELECT {_FLUFF} AS fluff, count(*) AS n FROM c GROUP BY 1""",
    "ids_and_slugs": "SELECT c_custkey, left(sha256(c_name || ':' || c_mktsegment), 16) AS id, trim(regexp_replace(lower(c_name || ' / ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer",
    "written_near_duplicates": f"""WITH i AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {_tokens('text')} AS t FROM embeddings JOIN documents ON doc_id = vec_id),
        p AS (SELECT q.id AS query, i.id, q.v AS qv, i.v AS v, q.t AS qt, i.t AS t, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, i.v), i.id) AS r FROM i q, i WHERE q.id % 50 = 0),
        s AS (SELECT *, list_cosine_similarity(qv, v) AS c, CASE WHEN least(len(qt), len(t)) > 0 THEN len(list_intersect(qt, t))::DOUBLE / least(len(qt), len(t)) ELSE 0 END AS o FROM p WHERE r <= 6 AND query <> id AND len(qt) >= 5)
        SELECT query, id, round(c, 4) AS cosine, round(o, 4) AS overlap FROM s WHERE c >= 0.3 AND o >= 0.1""",
    "write_decision": "SELECT CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN 'held' ELSE 'archived' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "retry_dedup": """WITH RECURSIVE e AS (SELECT user_id, event_type, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT user_id, event_type, event_id, t AS last, true AS keep, n FROM e WHERE n = 1
            UNION ALL SELECT e.user_id, e.event_type, e.event_id, CASE WHEN e.t - s.last >= 86400 THEN e.t ELSE s.last END, e.t - s.last >= 86400, e.n FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.n = s.n + 1)
        SELECT user_id, count(*) AS kept, sum(event_id)::BIGINT AS id_sum FROM s WHERE keep GROUP BY user_id""",
    "rate_limited": """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT user_id, n, [t] AS recent, true AS accepted FROM e WHERE n = 1
            UNION ALL SELECT user_id, n, CASE WHEN len(r) < 3 THEN list_append(r, t) ELSE r END, len(r) < 3 FROM (SELECT e.user_id, e.n, e.t, list_filter(s.recent, lambda x: e.t - x < 86400) AS r FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
        SELECT user_id, accepted, count(*) AS n FROM s GROUP BY 1, 2""",
    "session_numbers": """WITH a AS (SELECT *, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 36000 AS apart FROM events),
        r AS (SELECT *, sum(coalesce(apart, false)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a),
        p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 3 AS part FROM r),
        n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY run, part)::INTEGER AS session_no FROM p)
        SELECT user_id, session_no, count(*) AS exchange_count, min(ts) AS first_exchange, max(ts) AS last_exchange FROM n GROUP BY 1, 2""",
    "session_windows": """WITH a AS (SELECT *, coalesce(epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600, true) AS fresh FROM events),
        r AS (SELECT user_id, sum(fresh::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM a), c AS (SELECT user_id, s, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS largest FROM c GROUP BY 1""",
    "turn_pairs": """WITH n AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, turn, length(text) AS prompt_chars, sha256(response) AS response_sha256 FROM n WHERE role = 'user' AND next_role = 'assistant'""",
    "session_tiers": """WITH r AS (SELECT user_id, count(*) AS entries, max(ts) AS last, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1), a AS (SELECT *, (1706745600 - floor(epoch(last))) / 86400.0 AS age FROM r)
        SELECT CASE WHEN user_id % 20 = 0 THEN 'deleted' WHEN age >= 30 THEN 'cold' WHEN age >= 3 THEN 'warm' ELSE 'hot' END AS tier, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM a GROUP BY 1""",
    "recent": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS at, left(event_type, 300) AS prompt, left(props, 300) AS response FROM events ORDER BY ts DESC, event_id DESC LIMIT 20",
    "turn_budgets": """WITH t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 3 THEN '[tool: x] ' || text ELSE text || text || text END AS t FROM conversations),
        c AS (SELECT *, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '[tool'))) > 0 AS talk FROM t)
        SELECT conv_id, turn, least(length(t), CASE WHEN NOT talk THEN 300 WHEN role = 'user' THEN 2000 WHEN role = 'assistant' THEN 1200 ELSE 300 END)::BIGINT AS kept FROM c""",
    "latency_summary": "SELECT event_type AS prompt, count(*) AS calls, sum((event_type <> 'error')::BIGINT)::BIGINT AS ok, round(median(value), 6) AS mid, round(max(value), 6) AS top FROM events GROUP BY 1",
    "breaker": """WITH RECURSIVE e AS (SELECT user_id, epoch(ts) AS t, event_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0 AS fails, false AS is_open, NULL::DOUBLE AS last, NULL::VARCHAR AS state FROM e
            UNION ALL SELECT user_id, n, CASE WHEN skip THEN fails WHEN ok THEN 0 ELSE base + 1 END, CASE WHEN skip THEN true WHEN ok THEN false ELSE base + 1 >= 3 END,
                CASE WHEN skip OR ok THEN last ELSE t END, CASE WHEN skip THEN 'skipped' WHEN ok THEN 'ok' ELSE 'failed' END
            FROM (SELECT e.user_id, e.n, e.t, e.ok, s.fails, s.last, s.is_open AND e.t - s.last < 86400 AS skip, CASE WHEN s.is_open THEN 0 ELSE s.fails END AS base FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
        SELECT user_id, state, count(*) AS n FROM s WHERE n > 0 GROUP BY 1, 2""",
    "fact_state": _LADDER + "entity, 'priority' AS attribute, arg_max(value, n) AS value, arg_max(confidence, n) AS confidence, count(reason) AS steps FROM s GROUP BY entity",
    "fact_history": _LADDER + "entity, 'priority' AS attribute, seq, old_value, new_value, old_confidence, new_confidence, reason FROM s WHERE reason IS NOT NULL",
    "fact_contradictions": _LADDER + "reason, count(*) AS n FROM s WHERE reason IN ('contradicted', 'rejected', 'demote') GROUP BY 1",
    "fact_alerts": _LADDER + "entity, seq, old_value, new_value FROM s WHERE reason = 'rejected' AND old_confidence = 'verified'",
    "fact_query": f"WITH {A.SQL['facts']} SELECT entity, attribute || '_' || seq AS attribute, value, confidence FROM fact_events WHERE value ILIKE '%urg%t%' AND confidence <> 'false' ORDER BY ts DESC, entity, attribute || '_' || seq LIMIT 100",
    "fact_merge": f"SELECT coalesce(a.entity, b.entity) AS entity, 'p' AS attribute, {', '.join(_chosen(c) for c in ('value', 'confidence', 'created_at', 'last_updated'))} FROM {_side(0)} a FULL JOIN {_side(1)} b ON a.entity = b.entity",
    "three_way_merge": """WITH h AS (SELECT o_orderkey AS p, o_orderkey % 2 AS x FROM orders WHERE o_orderkey % 13 <> 0), s AS (SELECT o_orderkey AS p, o_orderkey % 3 AS x FROM orders WHERE o_orderkey % 17 <> 0),
        b AS (SELECT o_orderkey AS p, o_orderkey % 5 AS x FROM orders WHERE o_orderkey % 7 <> 0), k AS (SELECT p FROM h UNION SELECT p FROM s UNION SELECT p FROM b),
        j AS (SELECT h.x AS h, s.x AS s, b.x AS b FROM k LEFT JOIN h ON h.p = k.p LEFT JOIN s ON s.p = k.p LEFT JOIN b ON b.p = k.p)
        SELECT CASE WHEN h IS NOT DISTINCT FROM s THEN 'same' WHEN h IS NOT DISTINCT FROM b THEN CASE WHEN s IS NULL THEN 'delete_host' ELSE 'to_host' END
               WHEN s IS NOT DISTINCT FROM b THEN CASE WHEN h IS NULL THEN 'delete_stick' ELSE 'to_stick' END ELSE 'conflict' END AS action, count(*) AS n FROM j GROUP BY 1""",
    "delete_guard": "SELECT count(*) AS total, count(*) FILTER (c_custkey % 3 = 0) AS deletions, count(*) >= 8 AND count(*) FILTER (c_custkey % 3 = 0) / count(*) > 0.25 AS blocked FROM customer",
    "log_union": """WITH r AS (SELECT CASE WHEN event_id % 4 <> 0 THEN event_id // 2 END AS id, event_type || user_id AS line, event_id AS pos, 0 AS side FROM events WHERE event_id % 3 <> 0
            UNION ALL SELECT CASE WHEN event_id % 4 <> 0 THEN event_id // 2 END, event_type || user_id, event_id, 1 FROM events WHERE event_id % 5 <> 0)
        SELECT id, line, pos, side FROM r QUALIFY row_number() OVER (PARTITION BY coalesce(id::VARCHAR, sha256(line)) ORDER BY side, pos) = 1""",
    "file_diff": """WITH d AS (SELECT doc_id AS p, n_chars AS size FROM documents WHERE doc_id % 10 <> 0), i AS (SELECT doc_id AS p, n_chars + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 0)
        SELECT CASE WHEN i.p IS NULL THEN 'added' WHEN d.p IS NULL THEN 'deleted' WHEN d.size <> i.size THEN 'changed' ELSE 'unchanged' END AS status, count(*) AS n FROM d FULL JOIN i ON d.p = i.p GROUP BY 1""",
    "vanished_groups": "SELECT source, count(*) AS entries FROM documents WHERE source = 'src3' GROUP BY 1 HAVING count(*) >= 10",
    "manifest_check": """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'malformed' WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'hash' ELSE 'ok' END AS state FROM documents)
        SELECT state, (1 + (state = 'hash')::INTEGER)::INTEGER AS version, count(*) AS n FROM m GROUP BY 1, 2""",
    "newest_within_budget": "SELECT source, doc_id, running FROM (SELECT source, doc_id, (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id DESC))::BIGINT AS running FROM documents) WHERE running <= 20000",
    "greedy_chunks": """WITH RECURSIVE e AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
        s AS (SELECT source, doc_id, n_chars, n_chars AS used, 0 AS chunk, n FROM e WHERE n = 1
            UNION ALL SELECT e.source, e.doc_id, e.n_chars, CASE WHEN s.used + e.n_chars > 8000 THEN e.n_chars ELSE s.used + e.n_chars END, s.chunk + (s.used + e.n_chars > 8000)::INTEGER, e.n FROM s JOIN e ON e.source = s.source AND e.n = s.n + 1)
        SELECT source, doc_id, n_chars, chunk FROM s""",
    "head_cut": _SECTIONED + r""",
        h AS (SELECT doc_id, total, trim(regexp_extract(line, '^#{1,6}\s+(.+)$', 1)) AS name, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), total) AS finish FROM l WHERE regexp_matches(line, '^#{1,6}\s+.+$')),
        n AS (SELECT doc_id, 0 AS kind, start AS place, name FROM h WHERE total > 1500 AND finish > 1500
              UNION ALL SELECT doc_id, 1, 0, unnest(regexp_extract_all(substring(t, 1501), '(?i)\b(?:memory_id|id)[:=]\s*([a-f0-9]{8,64})\b', 1)) FROM w WHERE length(t) > 1500),
        f AS (SELECT doc_id, name, min(kind * 1000000000 + place) AS first FROM n GROUP BY 1, 2), g AS (SELECT doc_id, string_agg(name, '|' ORDER BY first) AS lost FROM f GROUP BY 1)
        SELECT w.doc_id, length(t) AS units, greatest(length(t) - 1500, 0) AS dropped, coalesce(lost, '') AS lost FROM w LEFT JOIN g ON g.doc_id = w.doc_id""",
    "write_verdicts": _SECTIONED + r""",
        m AS (SELECT doc_id, min(start) AS mark FROM l WHERE starts_with(ltrim(line), '#') AND contains(line, 'BOOT BOUNDARY') GROUP BY 1),
        v AS (SELECT w.doc_id, length(t) AS total, w.doc_id % 2 = 0 AS lane, CASE WHEN w.doc_id % 2 = 0 THEN mark END AS mark FROM w LEFT JOIN m ON m.doc_id = w.doc_id)
        SELECT doc_id, CASE WHEN total <= 1500 THEN CASE WHEN lane AND 1500 - total < 500 THEN 'tight' ELSE 'ok' END WHEN mark IS NULL THEN 'cut' WHEN mark <= 1500 THEN 'bound' ELSE 'lies' END AS status,
               greatest(total - 1500, 0) AS dropped, CASE WHEN total <= 1500 THEN 1500 - total WHEN mark <= 1500 THEN 1500 - mark ELSE mark - 1500 END AS spare FROM v""",
    "memory_search": _bm25("(SELECT p_partkey AS id, p_name AS text, p_type AS title, p_brand AS names, p_size FROM part)", "id, names, p_size", {"text": 8.0, "title": 2.0, "names": 3.0}, ["small"], False)
    + """ SELECT id, round(sc, 6) AS score, date FROM (SELECT *, CASE WHEN p_size % 5 <> 0 THEN '2024-01-' || lpad((1 + p_size % 28)::VARCHAR, 2, '0') END AS date FROM h)
        WHERE (date IS NULL OR date >= '2024-01-10') AND names = 'Brand#2' ORDER BY sc DESC, coalesce(date, '0000-00-00') DESC, id DESC LIMIT 30""",
    "bm25_search": _bm25("documents", "doc_id", {"text": 8.0, "source": 2.0}, ["the", "idiot", "tion"], False) + " SELECT doc_id, matched, round(sc, 6) AS score FROM h ORDER BY round(sc, 6) DESC, doc_id LIMIT 50",
    "accent_search": _bm25("documents", "doc_id", {"text": 1.0, "lang": 4.0}, ["cafe", "fur", "d une", "l ete"], False) + " SELECT doc_id, matched, round(sc, 6) AS score FROM h",
    "indexed_search": _bm25(
        """(SELECT doc_id, CASE WHEN lang = 'fr' THEN text || ' Caf\u00e9 na\u00efve' ELSE text END AS text, CASE WHEN lang = 'de' THEN '\u00dcber' ELSE source END AS source
            FROM documents WHERE lang IS DISTINCT FROM 'es')""", "doc_id", {"text": 8.0, "source": 2.0}, ["cafe", "naive", "uber", "idiot"], False) + " SELECT doc_id, matched, round(sc, 6) AS score FROM h",
    "file_search": _bm25("part", "p_partkey", {"p_name": 8.0, "p_type": 4.0, "p_brand": 1.0}, ["small", "ri", "eco"], True) + " SELECT p_partkey, matched, round(sc, 6) AS score FROM h WHERE matched = 3 OR (SELECT count(*) FROM h WHERE matched = 3) < 3",
    "line_search": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE contains(lower(text), 'idiot')),
        h AS (SELECT doc_id, k FROM l WHERE contains(lower(line), 'idiot')), w AS (SELECT DISTINCT l.doc_id, l.k, l.line FROM l JOIN h ON h.doc_id = l.doc_id AND abs(h.k - l.k) <= 1)
        SELECT doc_id, k AS line_no, sha256(line) AS line_sha256 FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) <= 12""",
    "bullets": """WITH c AS (SELECT c_custkey, c_mktsegment AS seg, replace(c_name, '#000', '-') AS name FROM customer)
        SELECT c_custkey, 2::BIGINT AS line_no, seg AS heading, 'fact' AS kind, 0.9::DOUBLE AS confidence, name || ' pays' AS text, name AS entities, '2026-03-09' AS date FROM c
        UNION ALL SELECT c_custkey, 6, 'Notes', 'lesson', NULL, 'never a.b retry c=1', 'a.b', '2026-03-09' FROM c
        UNION ALL SELECT c_custkey, 8, 'Notes', 'x', NULL, 'y', '', '2026-03-09' FROM c""",
    "entity_pages": """WITH r AS (SELECT unnest([event_type, 'u' || (user_id % 10)]) AS entity, strftime(ts, '%Y-%m-%d') AS date, event_id AS id, props FROM events),
        t AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC, id DESC) AS place FROM r)
        SELECT entity, count(*) AS bullets, string_agg('- ' || props, chr(10) ORDER BY place) AS page FROM t WHERE place <= 4 GROUP BY 1""",
    "topics": r"""WITH s(section, slug, names) AS (VALUES ('concepts', 'of-the', 'of-the|of the'), ('concepts', 'in-the', 'in-the|in the'), ('entities', 'idiot', 'idiot|clown'), ('concepts', 'de-la', 'de-la|de la'))
        SELECT section, slug, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM documents, s WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(' || names || ')($|[^\p{L}\p{N}_])') GROUP BY 1, 2""",
    "observation_verdicts": """WITH o AS (SELECT p_partkey AS obs_id, p_partkey % 6 AS kind, p_partkey % 7 = 0 AS malformed, p_size % 4 = 3 AS unknown, p_name,
            (['trusted_local', 'trusted_curated_import', 'untrusted_web', 'untrusted_web'])[1 + p_size % 4] AS source FROM part),
        l AS (SELECT l_partkey AS obs_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS place, l_orderkey % 5 = 0 AS told,
            CASE l_linenumber % 4 WHEN 1 THEN 'trusted_local' WHEN 2 THEN 'untrusted_web' END AS bucket FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 42),
        e AS (SELECT obs_id, count(*) AS n, bool_or(told) AS told, string_agg(CASE WHEN told THEN 'injection_in_evidence:injection_phrase@evidence[' || place || ']' END, ',' ORDER BY place) AS codes,
            arg_min(b, CASE b WHEN 'trusted_local' THEN 4 WHEN 'trusted_curated_import' THEN 3 WHEN 'semi_trusted_remote' THEN 2 ELSE 1 END) AS weakest, bool_and(b = 'untrusted_web') AS alone
            FROM (SELECT l.*, coalesce(bucket, source) AS b FROM l JOIN o USING (obs_id)) GROUP BY 1),
        j AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(told, false) AS told, codes, coalesce(alone, false) AS alone, malformed OR unknown AS tainted, CASE WHEN malformed OR unknown THEN 'metadata_untrusted' ELSE weakest END AS trust FROM o LEFT JOIN e USING (obs_id)),
        b AS (SELECT *, greatest(CASE kind WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 3 THEN 3 WHEN 5 THEN 2 ELSE 1 END, CASE WHEN told THEN 2 ELSE 1 END) AS before, CASE WHEN trust = 'untrusted_web' THEN 2 ELSE 1 END AS floor FROM j),
        f AS (SELECT *, greatest(before, floor) AS final FROM b)
        SELECT obs_id, CASE WHEN kind = 2 THEN 'hard_block' WHEN n < 2 THEN 'review_required' WHEN alone AND final = 1 THEN 'local_only' ELSE (['allow', 'review_required', 'local_only', 'hard_block'])[final] END AS disposition,
            CASE WHEN kind = 2 THEN 'claim_too_long' WHEN n < 2 THEN 'insufficient_evidence' ELSE concat_ws(',', CASE WHEN unknown THEN 'metadata_integrity:unknown_source_platform' END, CASE WHEN malformed THEN 'metadata_integrity:malformed_session_id' END,
                CASE kind WHEN 1 THEN 'pii_hard:pii_email@claim' WHEN 3 THEN 'pii_soft:pii_ipv4@claim' WHEN 5 THEN 'private_dict:private_client_term@claim' END, codes, CASE WHEN kind = 0 THEN 'generic_fluff' END,
                CASE WHEN kind = 5 THEN 'redaction:private_dict_salvaged' END, CASE WHEN final <> before THEN 'bucket_floor:untrusted_web=review_required' END, CASE WHEN alone THEN 'provenance:untrusted_web_alone' END) END AS reasons,
            CASE WHEN kind <> 2 AND n >= 2 THEN trust END AS evidence_trust,
            CASE WHEN kind = 2 OR n < 2 THEN '' ELSE concat_ws(',', CASE WHEN tainted THEN 'metadata_untrusted' END, CASE WHEN told THEN 'untrusted_instructional_text' END) END AS taint,
            CASE WHEN kind = 2 OR n < 2 THEN 'portable' WHEN final = 4 THEN 'blocked' WHEN final = 3 OR alone THEN 'local_only' ELSE 'portable' END AS portability,
            CASE WHEN kind = 5 AND n >= 2 THEN 'works with a client on ' || p_name END AS redacted_claim, CASE WHEN kind = 5 AND n >= 2 THEN 'redactable' ELSE 'none' END AS salvageability FROM f""",
    "evaluation": """WITH r AS (SELECT toxic AS truth, contains(lower(text), 'idiot')::INTEGER AS guess FROM labels JOIN documents USING (doc_id)), l AS (SELECT unnest([0, 1])::INTEGER AS label),
        c AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (guess = label) AS guessed, count(*) FILTER (truth = label AND guess = label) AS tp FROM l, r GROUP BY label)
        SELECT label, support, round(CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 6) AS recall, round(CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END, 6) AS f1
        FROM c WHERE support + guessed > 0""",
    "trust": f"""SELECT o_custkey, ({_TRUSTED})[max(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END)] AS trust, count(*) AS n_evidence FROM orders GROUP BY 1""",
    "evaluation_overall": """WITH r AS (SELECT toxic AS truth, contains(lower(text), 'idiot')::INTEGER AS guess FROM labels JOIN documents USING (doc_id)), l AS (SELECT unnest([0, 1])::INTEGER AS label),
        c AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (guess = label) AS guessed, count(*) FILTER (truth = label AND guess = label) AS tp FROM l, r GROUP BY label)
        SELECT (SELECT round(avg((truth = guess)::INTEGER::DOUBLE), 6) FROM r) AS accuracy, round(avg(2 * tp / (support + guessed)), 6) AS macro_f1 FROM c WHERE support + guessed > 0""",
    "minted": """WITH p AS (SELECT p_partkey, p_size, left(regexp_replace(lower(string_split(p_name, ' ')[1]), '[^a-z0-9]', '', 'g'), 16) AS slug FROM part),
        used AS (SELECT DISTINCT slug, 2 * (p_size - 40) AS n FROM p WHERE p_size > 40), new AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM p WHERE p_size <= 40),
        every AS (SELECT slug, unnest(range(1, c + 1)) AS n FROM (SELECT slug, (SELECT count(*) FROM p) AS c FROM p GROUP BY slug)),
        free AS (SELECT slug, n, row_number() OVER (PARTITION BY slug ORDER BY n) AS k FROM every ANTI JOIN used USING (slug, n))
        SELECT p_partkey, 'pref_' || new.slug || '_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS minted FROM new JOIN free ON free.slug = new.slug AND free.k = new.k""",
    "best_claims": """SELECT p_partkey AS claim_id, CASE WHEN p_size % 5 <> 0 THEN round(p_size / 50.0::DOUBLE, 6) END AS confidence FROM part WHERE p_partkey % 3 = 0 AND (p_brand = 'Brand#2' OR p_type = 'ECONOMY')
        ORDER BY coalesce(CASE WHEN p_size % 5 <> 0 THEN p_size / 50.0::DOUBLE END, 0) DESC, p_partkey LIMIT 20""",
    "distinct_sets": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY 1",
}
