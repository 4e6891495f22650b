"""Facts with provenance over orders, in batch and as a stream, and their twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline import adapters as A
from loomline.operators import facts as K
from loomline.operators import ledger as L
from loomline.sources.commits import scratch
from loomline.streaming.exchanges import drain

_EVENT = {
    "entity": "concat(CASE WHEN o_orderkey % 2 = 0 THEN '  Customer ' ELSE 'customer ' END, o_custkey)",
    "attribute": "CASE o_orderkey % 3 WHEN 0 THEN 'Ship Priority' WHEN 1 THEN 'ship-priority' ELSE ' ship_priority' END",
    "kind": "CASE WHEN o_orderkey % 23 = 0 THEN 'demote' ELSE 'save' END",
    "value": "CASE WHEN o_orderkey % 23 = 0 THEN CASE WHEN o_orderkey % 46 = 0 THEN ' ' ELSE 'wrong' END ELSE o_orderpriority END",
    "confidence": "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'high_probability' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'sure' ELSE 'false' END END",
    "evidence_source": "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE concat('order ', o_orderkey) END",
    "source_memory_id": "CASE WHEN o_orderkey % 7 <> 0 THEN concat('m', o_orderkey) END",
    "source_agent": "concat('agent', o_orderkey % 9)",
}


def _events(orders: DataFrame) -> DataFrame:
    return orders.select(*[F.expr(e).alias(c) for c, e in _EVENT.items()], F.col("o_orderkey").alias("seq"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("at"))


def fact_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's fact, with evidence, source and times, after all assertions."""
    return L.facts_of(L.ledger(_events(A.table(spark, d, "orders"))))


def fact_ledger(spark: SparkSession, d: str) -> DataFrame:
    """What happened to facts: counts and the sum of seq by reason and by who changed them."""
    return L.history_of(L.ledger(_events(A.table(spark, d, "orders")))).groupBy("reason", "changed_by").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum"))


def fact_problems(spark: SparkSession, d: str) -> DataFrame:
    return L.problems(_events(A.table(spark, d, "orders"))).groupBy("problem").agg(F.count("*").alias("n"))


def stream_fact_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same facts from a stream of the assertions."""
    return L.facts_of(drain(L.ledger_stream(_events(A.stream(spark, d, "orders"))), scratch(spark, "stream")))


def fact_row_merge(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the even and of the odd orders as two replicas, merged with their provenance; times in whole years, so that many are equal."""
    rows = _events(A.table(spark, d, "orders")).withColumn("at", F.floor(F.col("at") / 31_536_000).cast("double"))
    sides = [L.facts_of(L.ledger(rows.where(f"pmod(seq div 2, 2) = {k}"))) for k in (0, 1)]
    return K.merge_rows(*sides)


def _fold(where: str = "true", at: str = "epoch(o_orderdate)::DOUBLE") -> str:
    """Common table expressions of the fold: e (valid events, numbered), s (the fact after each)."""
    own = ", ".join(f"({e}) AS {c}" for c, e in _EVENT.items()).replace("'  Customer '", "'  Customer '")
    rank = "list_position(['false', 'high_probability', 'verified'], {})"
    higher = f"{rank.format('e.confidence')} >= {rank.format('s.confidence')}"
    same, replaced = "e.kind = 'save' AND e.value = s.value", f"e.kind = 'save' AND (s.value IS NULL OR e.value <> s.value AND {higher})"
    dropped = "e.kind = 'demote' AND s.confidence <> 'false'"
    pick = lambda c, on_same, on_drop: f"CASE WHEN {dropped} THEN {on_drop} WHEN {same} THEN {on_same} WHEN {replaced} THEN e.{c} ELSE s.{c} END"
    return f"""r AS (SELECT {own}, o_orderkey AS seq, {at} AS secs FROM orders WHERE {where}),
        c AS (SELECT * REPLACE (lower(trim(entity)) AS entity, replace(replace(lower(trim(attribute)), ' ', '_'), '-', '_') AS attribute),
            CASE WHEN kind = 'save' THEN CASE WHEN confidence NOT IN ('false', 'high_probability', 'verified') THEN 'confidence' WHEN trim(evidence_source) = '' THEN 'evidence' END WHEN trim(value) = '' THEN 'reason' END AS problem FROM r),
        e AS (SELECT *, row_number() OVER (PARTITION BY entity, attribute ORDER BY seq) AS n FROM c WHERE problem IS NULL),
        s AS (
            SELECT entity, attribute, n, seq, source_agent AS changed_by, CASE WHEN kind = 'save' THEN 'initial' END AS reason, CASE WHEN kind = 'save' THEN value END AS value, CASE WHEN kind = 'save' THEN confidence END AS confidence,
                CASE WHEN kind = 'save' THEN evidence_source END AS evidence_source, CASE WHEN kind = 'save' THEN source_memory_id END AS source_memory_id, CASE WHEN kind = 'save' THEN source_agent END AS source_agent,
                CASE WHEN kind = 'save' THEN secs END AS created_at, CASE WHEN kind = 'save' THEN secs END AS last_updated FROM e WHERE n = 1
            UNION ALL
            SELECT e.entity, e.attribute, e.n, e.seq, e.source_agent,
                CASE WHEN {dropped} THEN 'demote' WHEN e.kind = 'demote' THEN NULL WHEN s.confidence IS NULL THEN 'initial' WHEN {same} THEN 'reassert' WHEN {higher} THEN 'contradicted' ELSE 'rejected' END,
                {pick('value', 's.value', 's.value')}, {pick('confidence', f"CASE WHEN {higher} THEN e.confidence ELSE s.confidence END", "'false'")}, {pick('evidence_source', 'e.evidence_source', "'demoted: ' || e.value")},
                {pick('source_memory_id', 's.source_memory_id', 's.source_memory_id')}, {pick('source_agent', 's.source_agent', 's.source_agent')},
                CASE WHEN s.created_at IS NULL AND e.kind = 'save' THEN e.secs ELSE s.created_at END, CASE WHEN {dropped} OR {same} OR {replaced} THEN e.secs ELSE s.last_updated END
            FROM s JOIN e ON e.entity = s.entity AND e.attribute = s.attribute AND e.n = s.n + 1),
        f AS (SELECT * FROM s WHERE confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity, attribute ORDER BY n DESC) = 1)"""


_COLUMNS = "value, confidence, evidence_source, source_memory_id, source_agent, created_at, last_updated"


def _side(k: int) -> str:
    return f"(WITH RECURSIVE {_fold(f'(o_orderkey // 2) % 2 = {k}', 'floor(epoch(o_orderdate) / 31536000)::DOUBLE')} SELECT entity, attribute, {_COLUMNS} FROM f)"


def _merged(c: str) -> str:
    rank = "list_position(['false', 'high_probability', 'verified'], {})"
    ra, rb = rank.format("a.confidence"), rank.format("b.confidence")
    aux = "(coalesce({0}.evidence_source, ''), coalesce({0}.source_agent, ''), coalesce({0}.source_memory_id, ''))"
    later = f"(a.last_updated > b.last_updated OR a.last_updated = b.last_updated AND {aux.format('a')} >= {aux.format('b')})"
    same = {"value": "a.value", "confidence": f"CASE WHEN {ra} >= {rb} THEN a.confidence ELSE b.confidence END", "created_at": "least(a.created_at, b.created_at)"}.get(c, f"CASE WHEN {later} THEN a.{c} ELSE b.{c} END")
    return f"""CASE WHEN a.entity IS NULL THEN b.{c} WHEN b.entity IS NULL THEN a.{c} WHEN a.confidence = 'false' AND b.confidence <> 'false' THEN CASE WHEN a.last_updated >= b.last_updated THEN a.{c} ELSE b.{c} END
        WHEN b.confidence = 'false' AND a.confidence <> 'false' THEN CASE WHEN b.last_updated >= a.last_updated THEN b.{c} ELSE a.{c} END WHEN a.value = b.value THEN {same}
        WHEN {ra} > {rb} OR {ra} = {rb} AND (a.last_updated > b.last_updated OR a.last_updated = b.last_updated AND a.value >= b.value) THEN a.{c} ELSE b.{c} END AS {c}"""


QUERIES = {f.__name__: f for f in (fact_rows, fact_ledger, fact_problems, stream_fact_rows, fact_row_merge)}
_ROWS = f"WITH RECURSIVE {_fold()} SELECT entity, attribute, {_COLUMNS} FROM f"
ORACLE_SQL = {
    "fact_rows": _ROWS,
    "stream_fact_rows": _ROWS,
    "fact_ledger": f"WITH RECURSIVE {_fold()} SELECT reason, changed_by, count(*) AS n, sum(seq)::BIGINT AS seq_sum FROM s WHERE reason IS NOT NULL GROUP BY 1, 2",
    "fact_problems": f"WITH RECURSIVE {_fold()} SELECT problem, count(*) AS n FROM c WHERE problem IS NOT NULL GROUP BY 1",
    "fact_row_merge": f"SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.attribute, b.attribute) AS attribute, {', '.join(_merged(c) for c in _COLUMNS.split(', '))} FROM {_side(0)} a FULL JOIN {_side(1)} b ON a.entity = b.entity AND a.attribute = b.attribute",
}
