"""Queries of the write path, the recall pass, lenses, the nightly batch and sessions, each beside its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import adapters as A
from loomline.functions import patterns as P
from loomline.functions import text as X
from loomline.llm.common import discard, materialize
from loomline.operators import claims as C
from loomline.operators import dedup as D
from loomline.operators import detect as G
from loomline.operators import index as I
from loomline.operators import lens as L
from loomline.operators import nightly as N
from loomline.operators import recall as R
from loomline.operators import search as S
from loomline.operators import sessions as E
from loomline.operators import sync as Y
from loomline.operators import wiki as W
from loomline.queries.batch import query
from loomline.queries.twins import _CATEGORY, _q, _tokens

QUERIES, ORACLE_SQL = {}, {}


def named(sql: str | None):
    return query(sql, QUERIES, ORACLE_SQL)


# --- recall -----------------------------------------------------------------------------------------------------

_HAY = "props || ' ' || event_type"


@named(f"SELECT event_id, 0.75::DOUBLE AS relevance, 'session_log' AS category FROM events WHERE contains(lower({_HAY}), 'k\": 7') ORDER BY event_type DESC, event_id LIMIT 3")
def hot_search(spark: SparkSession, d: str) -> DataFrame:
    """The newest sessions' exchanges that hold the words."""
    rows = A.table(spark, d, "events").select("event_id", F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.concat_ws(" ", "props", "event_type").alias("haystack"))
    return R.hot_keyword(rows, 'K": 7', 5).select("event_id", F.col("relevance").cast("double").alias("relevance"), "category")


_CACHED = "(memory_id * 613) % 172800 <= 86400"
_SEEN = "(category IS NULL OR category <> 'session_log')"


@named(f"""WITH {A.SQL['vectors']}, hot AS (SELECT NULL::BIGINT AS memory_id, 0.75::DOUBLE AS relevance, 0 AS tier, row_number() OVER (ORDER BY event_type DESC, event_id) AS position FROM (SELECT * FROM events WHERE contains(lower({_HAY}), 'k": 7') ORDER BY event_type DESC, event_id LIMIT 3) WHERE false),
    l1 AS (SELECT memory_id, cosine AS relevance, 1 AS tier, row_number() OVER (ORDER BY cosine DESC, memory_id) AS position FROM (SELECT * FROM scored WHERE {_SEEN} AND {_CACHED} AND cosine >= 0.75 ORDER BY cosine DESC, memory_id LIMIT 15)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY distance, memory_id) AS place FROM scored), wide AS (SELECT * FROM ranked WHERE place <= 375 AND {_SEEN}),
    v AS (SELECT * FROM wide WHERE place <= 75 OR (SELECT count(*) FROM wide WHERE place <= 75) < 15 ORDER BY distance, memory_id LIMIT 15),
    vec AS (SELECT memory_id, similarity AS relevance, 2 AS tier, row_number() OVER (ORDER BY distance, memory_id) AS position FROM v),
    l2 AS (SELECT memory_id, cosine AS relevance, 3 AS tier, row_number() OVER (ORDER BY cosine DESC, memory_id) AS position FROM (SELECT * FROM scored WHERE {_SEEN} AND cosine > 0.5 ORDER BY cosine DESC, memory_id LIMIT 15)),
    u AS (SELECT * FROM hot UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM vec UNION ALL SELECT * FROM l2)
    SELECT memory_id, round(relevance, 6) AS relevance, tier::INTEGER AS tier, position FROM u QUALIFY memory_id IS NULL OR row_number() OVER (PARTITION BY memory_id ORDER BY tier, position) = 1""")
def recall_pass(spark: SparkSession, d: str) -> DataFrame:
    """All tiers of one recall; session logs are hidden, so keyword hits are, and the vector tier serves, so the scan of base
    rows stays shut."""
    index = A.vectors(spark, d)
    rows = A.table(spark, d, "events").select("event_id", F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.concat_ws(" ", "props", "event_type").alias("haystack"))
    base = index.withColumn("created_at", -F.coalesce("age_days", F.lit(0.0)))
    cached = index.withColumn("age_seconds", F.expr("(memory_id * 613) % 172800"))
    found = R.retrieve(index, base, rows, A.query_vector(spark, d), 'k": 7', 5, cached)
    return found.select("memory_id", F.round("relevance", 6).alias("relevance"), F.col("tier").cast("int").alias("tier"), "position")


@named(f"""WITH {A.SQL['vectors']}, hot AS (SELECT NULL::BIGINT AS memory_id, 0.75::DOUBLE AS relevance, 0 AS tier, row_number() OVER (ORDER BY event_type DESC, event_id) AS position FROM (SELECT * FROM events WHERE contains(lower({_HAY}), 'k": 7') ORDER BY event_type DESC, event_id LIMIT 3)),
    newest AS (SELECT * FROM vectors WHERE category = 'session_log' ORDER BY -coalesce(age_days, 0) DESC, memory_id LIMIT 80), one AS (SELECT embedding AS ov FROM newest ORDER BY -coalesce(age_days, 0) DESC, memory_id LIMIT 1),
    near AS (SELECT memory_id, list_cosine_similarity(embedding, ov) AS cosine FROM newest, one),
    l3 AS (SELECT memory_id, cosine AS relevance, 4 AS tier, row_number() OVER (ORDER BY cosine DESC, memory_id) AS position FROM (SELECT * FROM near WHERE cosine > 0.4 ORDER BY cosine DESC, memory_id LIMIT 15)),
    u AS (SELECT * FROM hot UNION ALL SELECT * FROM l3 WHERE (SELECT count(*) FROM hot) < 5) SELECT coalesce(memory_id, -1) AS memory_id, round(relevance, 6) AS relevance, tier::INTEGER AS tier, position FROM u""")
def recall_open(spark: SparkSession, d: str) -> DataFrame:
    """Session logs like the newest one, asked for by category, of an index whose rows are not classified yet: keyword hits
    come through, no tier of the index serves, and so the base rows are scanned."""
    base = A.vectors(spark, d).withColumn("created_at", -F.coalesce("age_days", F.lit(0.0)))
    index = A.vectors(spark, d).withColumn("category", F.lit(None).cast("string"))
    rows = A.table(spark, d, "events").select("event_id", F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.concat_ws(" ", "props", "event_type").alias("haystack"))
    cached = index.withColumn("age_seconds", F.expr("(memory_id * 613) % 172800"))
    latest = base.where("category = 'session_log'").orderBy(F.col("created_at").desc(), "memory_id").first()["embedding"]
    found = R.retrieve(index, base, rows, list(latest), 'k": 7', 5, cached, category="session_log")
    return found.select(F.coalesce("memory_id", F.lit(-1)).alias("memory_id"), F.round("relevance", 6).alias("relevance"), F.col("tier").cast("int").alias("tier"), "position")


@named("""WITH s AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), l AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events WHERE event_type <> 'view' GROUP BY 1)
    SELECT coalesce(s.id, l.id) AS memory_id, coalesce(s.n, 0) + coalesce(l.n, 0) AS access_count, greatest(s.t, l.t) AS last_accessed FROM s FULL JOIN l ON s.id = l.id""")
def access_bump(spark: SparkSession, d: str) -> DataFrame:
    """Counters of an old log after those of a new one."""
    e = A.table(spark, d, "events")
    old = e.where("event_type = 'view'").groupBy(F.col("user_id").alias("memory_id")).agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))
    return R.bump_access(old, e.where("event_type != 'view'").select(F.col("user_id").alias("memory_id"), "ts"))


@named(f"""WITH {A.SQL['vectors']} SELECT * FROM (SELECT memory_id, 'L1' AS tier, round(cosine, 6) AS relevance FROM scored WHERE {_CACHED} AND cosine >= 0.75 ORDER BY cosine DESC, memory_id LIMIT 2)
    UNION ALL SELECT * FROM (SELECT memory_id, 'L2', round(cosine, 6) FROM scored WHERE cosine > 0.5 ORDER BY cosine DESC, memory_id LIMIT 2)""")
def preflight_context(spark: SparkSession, d: str) -> DataFrame:
    index = A.vectors(spark, d)
    found = R.preflight_context(index.withColumn("age_seconds", F.expr("(memory_id * 613) % 172800")), index, A.query_vector(spark, d))
    return found.select("memory_id", "tier", F.round("relevance", 6).alias("relevance"))


@named("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'UNAVAILABLE' END AS verdict, CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM events""")
def preflight_verdicts(spark: SparkSession, d: str) -> DataFrame:
    reply = F.expr("""CASE event_id % 4 WHEN 0 THEN '```json\\n{"verdict": "pass", "confidence": 0.9}\\n```' WHEN 1 THEN '{"verdict": "Warn", "reason": "old"}' WHEN 2 THEN '{"note": 1}' ELSE 'I think so' END""")
    return A.table(spark, d, "events").select("event_id", R.preflight_verdict(reply).alias("v")).select("event_id", "v.verdict", "v.confidence")


@named(f"""WITH {A.SQL['memories']}, r AS (SELECT memory_id, row_number() OVER (ORDER BY -age_days DESC, memory_id DESC) AS place, count(*) OVER () AS n FROM memories WHERE age_days IS NOT NULL)
    SELECT memory_id FROM r WHERE n <= 101 OR place <= 100""")
def evicted_tier(spark: SparkSession, d: str) -> DataFrame:
    """What stays of the second cached tier."""
    rows = A.memories(spark, d).where("age_days is not null").withColumn("created_at", -F.col("age_days"))
    return R.evict_second_tier(rows, 100).select("memory_id")


# --- write path -------------------------------------------------------------------------------------------------

_KNOWN = f"i AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, {_tokens('text')} AS t, text, doc_id % 30 AS age FROM embeddings JOIN documents ON doc_id = vec_id)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.expr("doc_id % 30").alias("age_days"))


@named(f"""WITH {_KNOWN}, w AS (SELECT 1000000000 + id AS id, list_transform(v, lambda x, k: x + 0.01::DOUBLE * ((k + id) % 5 - 2)) AS v, text || ' written anew' AS text FROM i), q AS (SELECT id, v, {_tokens('text')} AS t FROM w WHERE id % 50 = 0),
        p AS (SELECT q.id AS query, i.id, q.v AS qv, i.v AS v, q.t AS qt, i.t AS t, i.text, i.age, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, i.v), i.id) AS r FROM q, i)
    SELECT query, id, age::DOUBLE AS age_days, round(list_cosine_similarity(qv, v), 4) AS cosine, len(list_intersect(qt, t)) AS shared, left(replace(text, chr(10), ' '), 240) AS excerpt FROM p
    WHERE r <= 5 AND query <> id AND len(qt) >= 5 AND list_cosine_similarity(qv, v) >= 0.8 AND len(list_intersect(qt, t))::DOUBLE / least(len(qt), len(t)) >= 0.55 AND id % 250 <> 0""")
def held_writes(spark: SparkSession, d: str) -> DataFrame:
    """What the writers of new versions of every fiftieth record, its vector moved a little, are shown of known near duplicates; any pair with some records is allowed."""
    vectors, texts = _vectors(spark, d), _texts(spark, d)
    index = vectors.join(texts.select("id"), "id")
    new = F.col("id") + 1_000_000_000
    moved = index.where((F.col("id") + 1_000_000_000) % 50 == 0).select(F.expr("transform(vector, (x, k) -> x + 0.01D * ((k + 1 + id) % 5 - 2))").alias("vector"), new.alias("id"))
    written = texts.select(new.alias("id"), F.concat("text", F.lit(" written anew")).alias("text"))
    allow = vectors.where("id % 250 = 0").select(F.lit("*").alias("x"), F.col("id").cast("string").alias("y"))
    found = D.held_matches(moved, index, allow, texts=texts, query_texts=written)
    return found.select("query", "id", F.col("age_days").cast("double").alias("age_days"), "cosine", F.size("shared").cast("long").alias("shared"), "excerpt")


@named(f"""WITH {_KNOWN}, p AS (SELECT q.id AS query, i.id, q.v AS qv, i.v AS v, q.t AS qt, i.t AS t, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, i.v), i.id) AS r FROM i q, i WHERE q.age <= 7 AND q.id % 11 <> 0 AND len(q.t) >= 5),
    s AS (SELECT least(query, id) AS a, greatest(query, id) AS b, round(list_cosine_similarity(qv, v), 4) AS c, round(len(list_intersect(qt, t))::DOUBLE / nullif(least(len(qt), len(t)), 0), 4) AS o FROM p
        WHERE r <= 6 AND query <> id AND list_cosine_similarity(qv, v) >= 0.3 AND len(list_intersect(qt, t))::DOUBLE / nullif(least(len(qt), len(t)), 0) >= 0.1)
    SELECT a, b, max(c) AS cosine, max(o) AS overlap FROM s WHERE a % 25 <> 0 AND b % 25 <> 0 GROUP BY 1, 2""")
def nightly_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of the last week's memories with anything like them, without allowed pairs; thresholds for this data."""
    vectors, texts = _vectors(spark, d), _texts(spark, d)
    index = vectors.join(texts.select("id", "age_days"), "id").withColumn("superseded_by", F.when(F.expr("id % 11 = 0"), F.lit(1)))
    allow = vectors.where("id % 25 = 0").select(F.lit("*").alias("x"), F.col("id").cast("string").alias("y"))
    return D.nightly_scan(index, index, allow, texts=texts, cosine=0.3, share=0.1).select("a", "b", "cosine", "overlap")


@named("SELECT doc_id AS memory_id, CASE WHEN w.id IS NOT NULL THEN w.id ELSE CASE WHEN doc_id % 17 = 0 THEN doc_id + 1 END END AS superseded_by FROM documents LEFT JOIN (SELECT o_custkey AS doc_id, max(o_orderkey) AS id FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) w USING (doc_id)")
def superseding(spark: SparkSession, d: str) -> DataFrame:
    """Memories marked as superseded by the last write that names them."""
    writes = A.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.array("o_custkey", "o_custkey").alias("supersedes"))
    return D.supersede(A.memories(spark, d).select("memory_id", "superseded_by"), writes)


@named("SELECT user_id AS id, arg_max(event_type, (epoch(ts), event_id)) AS kind FROM events GROUP BY 1")
def upserts(spark: SparkSession, d: str) -> DataFrame:
    """A table after later rows were written to it."""
    e = A.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.struct("ts", "event_id").alias("at"))
    return I.upserted(e.where("at.event_id % 2 = 0"), e.where("at.event_id % 2 = 1"), "id", "at").select("id", "kind")


@named("""WITH t AS (SELECT c_custkey AS id, 'about ' || c_mktsegment AS d, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'done' END AS o, repeat(c_name || ' ', 1 + c_custkey % 400) AS a FROM customer)
    SELECT id, length(left(trim(array_to_string(list_filter([d, o, a, 'end'], lambda x: x <> ''), chr(10))), 4000)) AS chars, sha256(left(trim(array_to_string(list_filter([d, o, a, 'end'], lambda x: x <> ''), chr(10))), 4000)) AS text_sha256 FROM t""")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of a recipe is embedded."""
    steps = F.array(F.struct(F.expr("repeat(concat(c_name, ' '), CAST(1 + c_custkey % 400 AS INT))").alias("action")), F.struct(F.lit(None).cast("string").alias("action")), F.struct(F.lit("end").alias("action")))
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), I.embedding_text(F.concat(F.lit("about "), "c_mktsegment"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'done' END"), steps).alias("t"))
    return rows.select("id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("text_sha256"))


@named("SELECT count(*) AS total, count(*) FILTER (doc_id % 3 <> 0) AS embedded, count(*) FILTER (doc_id % 3 = 0) AS skipped, 0::BIGINT AS failed, count(*) FILTER (doc_id % 3 <> 0 AND length(left(text, 4000)) > 1000) AS truncated FROM documents")
def index_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Memories that the index lacks are embedded, over-long ones by halves."""
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), "text")
    index = rows.where("memory_id % 3 = 0").select("memory_id", F.array(F.lit(0.0)).alias("embedding"))
    return I.backfill(rows, index, I.HashEmbedder(most=1000))[1].select(*[F.col(c).cast("long").alias(c) for c in ("total", "embedded", "skipped", "failed", "truncated")])


@named("SELECT vec_id AS memory_id, CASE WHEN doc_id IS NULL THEN 'idea' WHEN doc_id % 11 <> 0 THEN (['topology', 'current_state', 'doctrine', 'incident', 'identity', 'relationship', 'decision', 'idea', 'session_log', 'unknown'])[1 + doc_id % 10] END AS category FROM embeddings LEFT JOIN documents ON doc_id = vec_id * 3")
def refreshed_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of the index as the base rows have them."""
    index = A.table(spark, d, "embeddings").select((F.col("vec_id") * 3).alias("memory_id"), F.col("vec_id"), F.lit("idea").alias("category"))
    return I.refresh_categories(index, A.memories(spark, d)).select(F.col("vec_id").alias("memory_id"), "category")


# --- lenses and classes -----------------------------------------------------------------------------------------


@named(f"""WITH {A.SQL['memories']} SELECT memory_id, length('[log ' || memory_id || ' @ ' || '2024-01-01T00:00' || ']' || chr(10) || left(summary, 3000) || chr(10) || '- a' || chr(10) || '- b') AS chars
    FROM memories m WHERE category = 'session_log' AND memory_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0) ORDER BY m.age_days DESC NULLS FIRST, memory_id LIMIT 30""")
def lens_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The oldest logs that a lens has not read, as it reads them."""
    labels = A.table(spark, d, "labels")
    marks = labels.select(F.col("doc_id").alias("memory_id"), F.when(F.col("toxic") == 0, "analyst").otherwise("muse").alias("lens"))
    logs = A.memories(spark, d).withColumn("created_at", -F.col("age_days"))
    found = L.candidates(logs, marks, "analyst", 30)
    return found.select("memory_id", F.length(L.block(F.col("memory_id"), F.lit("2024-01-01T00:00:00"), F.col("summary"), F.array(F.lit("a"), F.lit("b")))).cast("long").alias("chars"))


@named(f"""WITH {A.SQL['memories']}, r AS (SELECT memory_id, category, CASE WHEN memory_id % 7 = 0 THEN '[AUTO-CAPTURE] ' || summary ELSE summary END AS s FROM memories),
    c AS (SELECT * FROM r WHERE category IS NULL OR category = 'unknown' OR memory_id % 23 = 0 OR (memory_id % 7 = 0 OR trim(s) = '') AND category <> 'session_log')
    SELECT memory_id, CASE WHEN memory_id % 7 = 0 OR trim(s) = '' THEN 'session_log' WHEN memory_id % 4 = 0 THEN 'idea' ELSE {_CATEGORY.replace('{t}', 's')} END AS category,
        CASE WHEN memory_id % 7 = 0 OR trim(s) = '' THEN 'noise' WHEN memory_id % 4 = 0 THEN 'model' ELSE 'pattern' END AS classified_by FROM c""")
def reclassify_sweep(spark: SparkSession, d: str) -> DataFrame:
    """New categories of memories without one, of those marked for another look, and of mislabelled logs."""
    m = A.memories(spark, d).select("memory_id", "category", F.when(F.expr("memory_id % 7 = 0"), F.concat(F.lit("[AUTO-CAPTURE] "), "summary")).otherwise(F.col("summary")).alias("summary"), F.array().cast("array<string>").alias("key_facts"), F.expr("memory_id % 23 = 0").alias("needs_reclassification"))
    return L.reclassified(m, F.when(F.expr("memory_id % 4 = 0"), F.lit("idea"))).select("memory_id", "category", "classified_by")


_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS detector, '{c}' AS category, unnest(regexp_extract_all(text, {_q(p)})) AS m FROM documents" for n, c, _, p in P.PII if n in ("pii_email", "pii_ipv4", "pii_ssn_tin", "pii_phone"))


@named(f"SELECT doc_id, detector, category, CASE WHEN length(m) <= 8 THEN '***' ELSE left(m, 4) || '***' || right(m, 4) END AS match, count(*) AS n FROM ({_FOUND}) GROUP BY 1, 2, 3, 4")
def finding_previews(spark: SparkSession, d: str) -> DataFrame:
    """Findings of four detectors in whole documents, no more of each than its ends."""
    some = G.registry(enabled=["pii_email", "pii_ipv4", "pii_ssn_tin", "pii_phone"])
    found = G.findings(A.table(spark, d, "documents"), some, "doc_id", "text")
    return found.groupBy(F.col("id").alias("doc_id"), "detector", "category", "match").agg(F.count("*").alias("n"))


@named(r"""WITH t AS (SELECT doc_id, text, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])idiot($|[^\p{L}\p{N}_])') AS hit FROM documents) SELECT doc_id, count(*) FILTER (hit) > 0 AS found FROM t GROUP BY 1""")
def private_findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents in which a private term stands."""
    docs = A.table(spark, d, "documents")
    found = G.findings(docs, [x for x in G.registry(private={"family_names": ["Idiot"]}) if x.category == "private_dict"], "doc_id", "text")
    return docs.select("doc_id").join(found.select(F.col("id").alias("doc_id"), F.lit(True).alias("found")).distinct(), "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"))


# --- nightly batch ----------------------------------------------------------------------------------------------

_CHRONICLE = """h AS (SELECT doc_id, source AS agent, strftime(TIMESTAMP '2024-01-01' + to_minutes(doc_id::INTEGER), '%Y-%m-%dT%H:%M:%S') AS ts, text, lang FROM documents WHERE doc_id % 8 <> 0 AND source <> 'src3'),
    b AS (SELECT *, chr(10) || '## [' || ts || '] session=s' || (doc_id % 5) || chr(10) || text || chr(10) || 'Key facts:' || chr(10) || '  - ' || lang || chr(10) || 'Decisions: go; stop' AS block FROM h)"""


def _harvested(spark: SparkSession, d: str) -> DataFrame:
    m = A.table(spark, d, "documents").select(
        F.col("source").alias("agent_id"), F.concat(F.lit("s"), F.expr("doc_id % 5")).alias("session_id"), F.date_format(F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, CAST(doc_id AS INT))"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.col("text").alias("summary"), F.array("lang", F.lit(P.FLUSH_MARKER)).alias("key_facts"), F.array().cast("array<string>").alias("projects_referenced"), F.array(F.lit("go"), F.lit("stop")).alias("decisions_made"),
        F.expr("CASE WHEN doc_id % 8 = 0 THEN TIMESTAMP '2023-12-01' ELSE TIMESTAMP '2024-01-05' END").alias("modified"),
    )
    return N.harvest(m, F.lit("2024-01-01").cast("timestamp"), "src3")


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return _harvested(spark, d).withColumn("block", N.rendered(F.col("timestamp"), F.col("session_id"), F.col("summary"), F.col("key_facts"), F.col("decisions")))


@named(f"""WITH {_CHRONICLE}, r AS (SELECT *, sum(length(block)) OVER (PARTITION BY agent ORDER BY ts DESC, block DESC) AS used FROM b),
    k AS (SELECT agent, count(*) AS entries, string_agg(block, chr(10) ORDER BY ts, block) AS body FROM r WHERE used <= 20000 GROUP BY 1), a AS (SELECT agent, count(*) AS n FROM b GROUP BY 1)
    SELECT agent AS agent_id, coalesce(entries, 0) AS entries, n - coalesce(entries, 0) AS dropped, sha256('# Agent: ' || agent || ' (' || coalesce(entries, 0) || ' entries' || CASE WHEN n > coalesce(entries, 0) THEN '; ' || (n - coalesce(entries, 0)) || ' older entries omitted to fit the 20,000-char cap' ELSE '' END || ')' || coalesce(chr(10) || body, '')) AS section_sha256
    FROM a LEFT JOIN k USING (agent)""")
def agent_sections(spark: SparkSession, d: str) -> DataFrame:
    """Each agent's chronicle, the newest that fits."""
    return N.agent_sections(_blocks(spark, d), 20_000).select("agent_id", "entries", "dropped", F.sha2("section", 256).alias("section_sha256"))


@named(f"""WITH RECURSIVE {_CHRONICLE}, e AS (SELECT agent, block, length(block) AS n, row_number() OVER (PARTITION BY agent ORDER BY ts, doc_id % 5, block) AS k FROM b),
    s AS (SELECT agent, k, block, n AS used, 0 AS chunk FROM e WHERE k = 1
        UNION ALL SELECT e.agent, e.k, e.block, CASE WHEN s.used + e.n > 9000 THEN e.n ELSE s.used + e.n END, s.chunk + (s.used + e.n > 9000)::INTEGER FROM s JOIN e ON e.agent = s.agent AND e.k = s.k + 1)
    SELECT agent AS agent_id, chunk, sha256('# Agent: ' || agent || ' (' || count(*) || ' entries)' || chr(10) || string_agg(block, chr(10) ORDER BY k)) AS section_sha256 FROM s GROUP BY agent, chunk""")
def extraction_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What facts are extracted from: stated records in chunks. Flush markers make a record ambient, so here they go."""
    rows = _harvested(spark, d).withColumn("key_facts", F.filter("key_facts", lambda f: f != P.FLUSH_MARKER))
    return N.extraction_input(rows, [], "nightly", 9000).select("agent_id", "chunk", F.sha2("section", 256).alias("section_sha256"))


@named("SELECT max(doc_id) FILTER (doc_id % 10 <> 0)::VARCHAR AS name, round((epoch(TIMESTAMP '2024-02-01') - epoch(TIMESTAMP '2024-01-01') - 60 * max(doc_id) FILTER (doc_id % 10 <> 0)) / 3600, 1)::DOUBLE AS age_hours FROM documents")
def brief_age(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").select(F.concat(F.lpad("doc_id", 12, "0"), F.when(F.expr("doc_id % 10 = 0"), F.lit("-boot")).otherwise(F.lit(""))).alias("name"), F.expr("TIMESTAMP '2024-01-01' + make_dt_interval(0, 0, CAST(doc_id AS INT))").alias("modified"))
    return N.brief_age(rows, F.lit("2024-02-01").cast("timestamp")).select(F.col("name").cast("long").cast("string").alias("name"), "age_hours")


@named(f"""WITH {_CHRONICLE}, c AS (SELECT 'projects' AS section, lang AS slug, ts, doc_id % 5 AS s, '### [' || ts || '] ' || agent || ' session=s' || (doc_id % 5) || chr(10) || left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 2400) || chr(10) || 'Key facts:' || chr(10) || '  - ' || lang || chr(10) || 'Decisions: go; stop' || chr(10) AS block FROM h)
    SELECT section, slug, count(*) AS n, sha256('Topic ' || section || '/' || slug || ': write its page from the records below.' || chr(10) || chr(10)
        || CASE WHEN slug = 'en' THEN 'Page so far, to be brought up to date:' || chr(10) || chr(10) || 'old' ELSE 'There is no page yet.' END
        || chr(10) || chr(10) || 'Records (' || count(*) || '):' || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY ts, block)) AS prompt_sha256 FROM c GROUP BY 1, 2""")
def topic_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What a topic's page is compiled from."""
    rows = _harvested(spark, d).withColumn("block", W.memory_block(F.col("timestamp"), F.col("agent_id"), F.col("session_id"), F.col("summary"), F.col("key_facts"), F.col("decisions")))
    clusters = rows.select(F.lit("projects").alias("section"), F.col("key_facts")[0].alias("slug"), "timestamp", "block")
    pages = spark.createDataFrame([("projects", "en", " old\n")], "section string, slug string, body string")
    clusters = materialize(clusters)  # counted, sampled and sorted
    found = W.prompt_digests(*W.topic_prompt_parts(clusters, pages)).withColumnRenamed("sha256", "prompt_sha256")
    discard(clusters)
    return found


@named(r"""WITH n(section, slug, names) AS (VALUES ('entities', 'idiot', 'idiot|clown'), ('entities', 'src1', 'src1'), ('concepts', 'of-the', 'of-the|of the')), h AS (SELECT doc_id, lower(left(text, 4000) || ' ' || lang || '  ' || source) AS hay FROM documents WHERE doc_id % 6 <> 0)
    SELECT section, slug, count(*) AS n, sum(doc_id)::BIGINT AS id_sum FROM (SELECT section, slug, doc_id FROM h, n WHERE regexp_matches(hay, '(^|[^\p{L}\p{N}_])(' || names || ')($|[^\p{L}\p{N}_])') UNION ALL SELECT 'projects', 'plan-' || lang, doc_id FROM documents WHERE doc_id % 6 <> 0) GROUP BY 1, 2""")
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Topics of whole records: projects, named pages, and the writer; records of flush markers only have none."""
    empty = F.array().cast("array<string>")
    facts = F.when(F.expr("doc_id % 6 = 0"), F.array(F.lit(P.FLUSH_MARKER))).otherwise(F.array("lang"))
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("summary"), facts.alias("key_facts"), F.array(F.concat(F.lit("Plan "), "lang", F.lit("!"))).alias("projects"), empty.alias("decisions"), F.array("source").alias("writer"))
    pages = spark.createDataFrame([("entities", "idiot", ["Clown"]), ("entities", "src1", None), ("concepts", "of-the", None)], "section string, slug string, aliases array<string>")
    return S.cluster(rows, pages).groupBy("section", "slug").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@named("""SELECT c_custkey, '## Cross References' || chr(10) || '- [[entities/ann]]' || chr(10) || 'prose' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '- [[projects/deep-sea]]' ELSE '' END || chr(10) || '## Else' || chr(10) || '- nobody' AS body,
    'entities/ann' || CASE WHEN c_custkey % 2 = 0 THEN ',projects/deep-sea' ELSE '' END AS links FROM customer""")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    """Cross references that name pages, as links; others go."""
    body = F.concat(F.lit("## Cross References\n- [[Ann]]\nprose\n* nobody\n- "), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'the Deep Sea work' ELSE 'lost' END"), F.lit("\n## Else\n- nobody"))
    pages = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), body.alias("body"))
    known = spark.createDataFrame([(0, "entities", "ann"), (1, "projects", "deep-sea")], "place int, section string, slug string")
    return W.checked_references(pages, known).select(F.col("id").alias("c_custkey"), "body", F.array_join("links", ",").alias("links"))


@named(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (SELECT CASE WHEN starts_with(p, '#') THEN '' WHEN length(p) > 140 THEN left(p, 140) || chr(8230) ELSE p END FROM (SELECT regexp_replace(string_split(regexp_replace(lang || ' ' || text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10))[1], '^\s+|\s+$', '', 'g') AS p)) END AS tagline FROM documents""")
def taglines(spark: SparkSession, d: str) -> DataFrame:
    """First paragraph of each page's summary."""
    docs = A.table(spark, d, "documents").withColumn("text", F.replace("text", F.lit("\n##"), F.lit("\n==")))
    page = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("# T\n"), "text")).otherwise(F.concat(F.lit("# T\n## Summary\n"), "lang", F.lit(" "), "text", F.lit("\n## More\nx")))
    return docs.select("doc_id", W.tagline(page).alias("tagline"))


# --- sessions and claims ----------------------------------------------------------------------------------------


@named("""WITH m AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    l AS (SELECT conv_id, n, turn, '- [' || role || '] ' || left(text, b) || CASE WHEN length(text) > b THEN chr(8230) ELSE '' END AS line FROM (SELECT *, CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '[tool'))) = 0 THEN 300 WHEN role = 'user' THEN 2000 WHEN role = 'assistant' THEN 1200 ELSE 300 END AS b FROM m WHERE back <= 20)),
    h AS (SELECT conv_id, n, turn, line, length('Session activity (auto-sync from JSONL, session=' || left('c' || conv_id, 8) || ').') + length(n || ' new message(s) since last sync.') + 6 + sum(length(line)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM l),
    k AS (SELECT conv_id, n, count(*) FILTER (used <= 12000) AS kept, count(*) AS c, string_agg(line, chr(10) ORDER BY turn) FILTER (used <= 12000) AS body FROM h GROUP BY 1, 2)
    SELECT conv_id, n AS messages, sha256(left('Session activity (auto-sync from JSONL, session=' || left('c' || conv_id, 8) || ').' || chr(10) || n || ' new message(s) since last sync.' || chr(10) || chr(10) || 'Turns:' || coalesce(chr(10) || body, '')
        || CASE WHEN kept < c THEN chr(10) || '... (' || (n - kept) || ' more turns truncated)' ELSE '' END, 12000)) AS summary_sha256, 'a session ' || left('c' || conv_id, 8) || ' activity sync \u2014 no tool invocations in this batch' AS facts FROM k""")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as the records that a session's batches become."""
    rows = A.table(spark, d, "conversations").select(F.col("conv_id").alias("batch_id"), F.concat(F.lit("c"), "conv_id").alias("session_id"), F.col("turn").alias("place"), "role", F.col("text").alias("content"))
    found = Y.summaries(rows, "a")
    return found.select(F.col("batch_id").alias("conv_id"), "messages", F.sha2("summary", 256).alias("summary_sha256"), F.array_join("key_facts", "|").alias("facts"))


@named("SELECT user_id || '' AS session_id, count(*) FILTER (event_type <> 'view') AS entries, round(sum(length(props)) / 1024, 1)::DOUBLE AS size_kb, max(ts) AS modified FROM events GROUP BY 1")
def hot_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "events").select(F.concat("user_id", F.lit(".jsonl")).alias("file"), (F.col("event_type") != "view").alias("is_exchange"), F.length("props").alias("bytes"), F.col("ts").alias("modified"))
    return E.hot_listing(rows)


@named("""WITH f AS (SELECT event_type FROM events GROUP BY 1 ORDER BY max(ts) DESC, event_type DESC LIMIT 1), t AS (SELECT * FROM events WHERE event_type IN (SELECT event_type FROM f) ORDER BY event_id DESC LIMIT 512)
    SELECT sha256(props) AS hash, max(epoch(ts))::DOUBLE AS written FROM t WHERE 1706659200 - epoch(ts) < 864000 GROUP BY 1""")
def dedup_seeds(spark: SparkSession, d: str) -> DataFrame:
    """What a dedup that starts anew must know; props stands for prompt and response."""
    rows = A.table(spark, d, "events").select(F.col("event_type").alias("file"), F.col("ts").alias("modified"), F.col("event_id").alias("line"), "props", F.col("ts").cast("double").alias("seconds"))
    seeds = E.dedup_seed(rows.withColumns({"prompt": F.col("props"), "response": F.lit("")}), 1_706_659_200, 864_000)
    plain = rows.select(F.sha2(F.concat("props", F.lit("\x00")), 256).alias("hash"), F.sha2("props", 256).alias("plain")).distinct()
    return seeds.join(plain, "hash").select(F.col("plain").alias("hash"), "written")


@named("""WITH v AS (SELECT p_partkey AS obs_id, p_size % 4 = 0 AS bad FROM part), n AS (SELECT *, row_number() OVER (ORDER BY obs_id) + 7 AS k FROM v WHERE NOT bad)
    SELECT obs_id, 'pending' AS status, 'obs_' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS observation_id FROM n UNION ALL SELECT obs_id, 'rejected', NULL FROM v WHERE bad""")
def claim_routes(spark: SparkSession, d: str) -> DataFrame:
    """Where observations go: blocked ones nowhere, others into a queue under the next ids."""
    verdicts = A.table(spark, d, "part").select(F.col("p_partkey").alias("obs_id"), F.expr("CASE WHEN p_size % 4 = 0 THEN 'hard_block' ELSE 'allow' END").alias("disposition"))
    return C.routed(verdicts, after=7).select("obs_id", "status", "observation_id")


@named("""WITH r AS (SELECT c_custkey AS id, c_custkey % 4 AS n, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2023-01-01' END AS t FROM customer), l AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events GROUP BY 1)
    SELECT r.id, r.n + coalesce(l.n, 0) AS recall_count, greatest(r.t, l.t) AS last_recalled FROM r LEFT JOIN l ON l.id = r.id""")
def trajectory_counters(spark: SparkSession, d: str) -> DataFrame:
    """Recipes after an append and a log of recalls."""
    rows = A.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr("c_custkey % 4").alias("recall_count"), F.expr("CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2023-01-01' END").alias("last_recalled"))
    log = A.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts")
    return I.trajectories_after(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), log)


@named("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'untagged' WHEN 1 THEN lower(c_mktsegment) || '_x' ELSE 'a_b-c' END AS stem, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(c_mktsegment) || '-x' ELSE 'ab-c' END AS slug FROM customer")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("CASE c_custkey % 3 WHEN 0 THEN ' !! ' WHEN 1 THEN concat(c_mktsegment, ' X') ELSE ' a/b-c? ' END")
    return A.table(spark, d, "customer").select("c_custkey", X.file_stem(raw).alias("stem"), X.page_slug(raw).alias("slug"))


#: Small letters of the documents' languages with what their decomposition is (fixed values).
_MARKS = {"\u0300": "\u00e0\u00e8\u00ec\u00f2\u00f9aeiou", "\u0301": "\u00e1\u00e9\u00ed\u00f3\u00faaeiou", "\u0302": "\u00e2\u00ea\u00ee\u00f4\u00fbaeiou", "\u0308": "\u00e4\u00eb\u00ef\u00f6\u00fcaeiou"}
_PLAIN = "lower(text)"
for _mark, _letters in _MARKS.items():
    for _k in range(5):
        _PLAIN = f"replace({_PLAIN}, '{_letters[_k]}', '{_letters[5 + _k]}{_mark}')"
_PLAIN = f"replace(replace({_PLAIN}, '\u00f1', 'n\u0303'), '\u00e7', 'c\u0327')"


@named(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_tokens(_PLAIN)} AS t FROM documents)")
def decomposed_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Token sets of texts with accents, which come off as signs of their own."""
    rows = A.table(spark, d, "documents").select("doc_id", X.token_set(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@named("SELECT event_id, 's' AS session_id, left(repeat(props, 40), 200) AS prompt, left(repeat(event_type, 60), 150) AS thinking, CASE WHEN event_id % 2 = 0 THEN 5 ELSE 0 END AS actions, CASE WHEN event_id % 2 = 0 THEN '[ls] ' || event_type || ' \u2192 ' ELSE '' END AS first FROM events")
def hot_projections(spark: SparkSession, d: str) -> DataFrame:
    action = F.struct(F.lit("ls").alias("tool"), F.col("event_type").alias("command"), F.lit(None).cast("string").alias("output"))
    rows = A.table(spark, d, "events").select(F.lit("s").alias("session_id"), F.col("event_id").alias("timestamp"), F.expr("repeat(props, 40)").alias("prompt"), F.lit("r").alias("response"), F.when(F.expr("event_id % 2 = 0"), F.array(*[action] * 7)).alias("actions"), F.expr("repeat(event_type, 60)").alias("thinking"))
    found = E.hot_projection(rows)
    return found.select(F.col("timestamp").alias("event_id"), "session_id", "prompt", "thinking", F.size("actions").alias("actions"), F.coalesce(F.try_element_at("actions", F.lit(1)), F.lit("")).alias("first"))


@named("WITH m AS (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0) SELECT d.doc_id AS path, CASE WHEN m.doc_id IS NULL THEN 1 WHEN d.doc_id % 7 = 0 THEN 4 ELSE 3 END AS version FROM (SELECT doc_id FROM documents WHERE doc_id % 4 <> 0) d LEFT JOIN m ON m.doc_id = d.doc_id")
def manifest_repair(spark: SparkSession, d: str) -> DataFrame:
    from loomline.operators.merge import repaired

    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    manifest = docs.where("path % 5 != 0").select("path", F.when(F.expr("path % 7 = 0"), F.lit("old")).otherwise(F.col("hash")).alias("hash"), F.lit(3).alias("version"))
    return repaired(manifest, docs.where("path % 4 != 0")).select("path", "version")


@named("SELECT count(*) FILTER (age >= 30) AS cold, count(*) FILTER (age >= 3 AND age < 30) AS warm, count(*) FILTER (age < 3) AS hot FROM (SELECT user_id, (1706745600 - floor(epoch(max(ts)))) / 86400.0 AS age FROM events GROUP BY 1)")
def tier_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by tier as one row."""
    last = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rows = last.select(E.session_tier((F.lit(1_706_745_600) - F.col("last").cast("long")) / 86400.0, F.col("n")).alias("tier"), F.lit(1 << 20).alias("bytes"))
    stats = E.tier_statistics(rows)
    one = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("files"))), F.lit(0)).alias(t)
    return stats.agg(one("cold"), one("warm"), one("hot"))


@named("SELECT vec_id AS memory_id FROM embeddings WHERE vec_id NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def superseded_filter(spark: SparkSession, d: str) -> DataFrame:
    """Memories that no other one supersedes."""
    index = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.array().cast("array<long>").alias("supersedes"))
    writes = A.table(spark, d, "lineitem").where("l_returnflag = 'R'").select((-F.col("l_orderkey") - 1).alias("memory_id"), F.array("l_suppkey").alias("supersedes"))
    return D.superseded(index.unionByName(writes)).where("memory_id >= 0").select("memory_id")
