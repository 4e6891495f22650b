"""Facts with a confidence ladder: the streamed fold over assertions, its history, and merges of two stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.fold import Step, fields, streamed

LADDER = ("false", "high_probability", "verified")


def rank(confidence: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in LADDER]), confidence)


def normalized_entity(entity: Column) -> Column:
    return F.lower(F.trim(entity))


def normalized_attribute(attribute: Column) -> Column:
    """Blanks and hyphens within are underscores, one for each."""
    return F.translate(F.lower(F.trim(attribute)), " -", "__")


def steps(events: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """One row per event (keys, seq, kind, value, confidence) in the order of seq: what it did to its fact.

    kind 'save': the first is initial; the same value reasserts with the higher confidence; another value overwrites
    if its rank is at least the old one, else it is rejected. kind 'demote' sets confidence false; where there is no
    fact, or it is false already, reason is null and nothing happens. ``value`` and ``confidence`` are the fact after it.
    """
    n, order = len(keys), {c: k for k, c in enumerate(LADDER)}

    def start() -> Step:
        fact: list = [None, None]

        def step(row: tuple):
            own, seq, kind, value, confidence = row[:n], *row[n:]
            old_value, old = fact
            if kind == "demote":
                reason = None if old in (None, "false") else "demote"
                if reason:
                    fact[1] = "false"
                shown = old_value, fact[1]
            else:
                higher = old is None or order.get(confidence, -1) >= order.get(old, -1)
                reason = "initial" if old is None else "reassert" if value == old_value and value is not None else "contradicted" if higher else "rejected"
                if reason in ("initial", "contradicted"):
                    fact[:] = [value, confidence]
                elif reason == "reassert" and higher:
                    fact[1] = confidence
                shown = value, confidence if reason == "rejected" else fact[1]
            yield (*own, seq, old_value if reason else None, shown[0] if reason else None, old if reason else None, shown[1] if reason else None, reason, *fact)

        return step

    rows = events.select(*keys, F.col("seq").cast("bigint").alias("seq"), "kind", "value", "confidence")
    text = T.StringType()
    schema = fields(rows, [*keys, "seq"], old_value=text, new_value=text, old_confidence=text, new_confidence=text, reason=text, value=text, confidence=text)
    return streamed(rows, list(keys), ["seq", "kind", "value", "confidence"], start, schema)


def state(done: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """Per key the fact after its last step, and the number of steps that did something."""
    last = F.max_by(F.struct("value", "confidence"), "seq")
    return done.groupBy(*keys).agg(last.alias("f"), F.count("reason").alias("steps")).select(*keys, "f.value", "f.confidence", "steps")


def history(done: DataFrame, keys: tuple[str, ...] = ("entity", "attribute"), reasons: tuple[str, ...] = ()) -> DataFrame:
    rows = done.where("reason is not null").select(*keys, "seq", "old_value", "new_value", "old_confidence", "new_confidence", "reason")
    return rows.where(F.col("reason").isin(list(reasons))) if reasons else rows


def contradictions(done: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    return history(done, keys, ("contradicted", "rejected", "demote"))


def verified_alerts(done: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """Assertions that were turned down by a verified fact."""
    return history(done, keys, ("rejected",)).where("old_confidence = 'verified'")


def query_facts(facts: DataFrame, entity: str | None = None, attribute: str | None = None, contains: str | None = None, confidence: str | None = None, include_false: bool = True, limit: int = 20) -> DataFrame:
    """Filters and newest first; LIKE wildcards in ``contains`` work; the limit is held to 1..100."""
    keep = F.lit(True)
    for column, value in (("entity", entity), ("attribute", attribute), ("confidence", confidence)):
        if value is not None:
            keep = keep & (F.col(column) == value)
    if contains is not None:
        keep = keep & F.col("value").ilike(f"%{contains}%")
    if not include_false:
        keep = keep & (F.col("confidence") != "false")
    return facts.where(keep).orderBy(F.col("last_updated").desc(), "entity", "attribute").limit(max(1, min(100, limit)))


def merge_rows(host: DataFrame, other: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """Full outer merge of facts by a total order, the same whichever side is the host.

    One side false: it wins if it is not older. Equal values: the newer row, with the higher confidence and the earlier
    creation; of equal times that with the larger evidence, agent and memory. Else the higher confidence, then the newer, then the
    larger value. evidence_source, source_agent and source_memory_id go with their row, where the tables have them.
    """
    aside = tuple(c for c in ("evidence_source", "source_agent", "source_memory_id") if c in host.columns and c in other.columns)
    names = ("value", "confidence", *aside, "created_at", "last_updated")
    a = host.select(*keys, F.struct(*names).alias("a"))
    b = other.select(*keys, F.struct(*names).alias("b"))
    j = a.join(b, list(keys), "full_outer")
    A, B = F.col("a"), F.col("b")
    a_false, b_false = A["confidence"] == "false", B["confidence"] == "false"
    a_newer, tie = A["last_updated"] > B["last_updated"], A["last_updated"] == B["last_updated"]
    top = F.when(rank(A["confidence"]) >= rank(B["confidence"]), A["confidence"]).otherwise(B["confidence"])
    text = lambda r: F.struct(*[F.coalesce(r[c], F.lit("")).alias(c) for c in aside]) if aside else F.lit(0)
    later = F.when(a_newer | (tie & (text(A) >= text(B))), A).otherwise(B)
    same = F.struct(A["value"].alias("value"), top.alias("confidence"), *[later[c].alias(c) for c in aside], F.least(A["created_at"], B["created_at"]).alias("created_at"), later["last_updated"].alias("last_updated"))
    by_order = (
        F.when(rank(A["confidence"]) > rank(B["confidence"]), A).when(rank(A["confidence"]) < rank(B["confidence"]), B)
        .when(a_newer, A).when(~tie, B).when(A["value"] >= B["value"], A).otherwise(B)
    )
    chosen = (
        F.when(A.isNull(), B).when(B.isNull(), A)
        .when(a_false & ~b_false, F.when(A["last_updated"] >= B["last_updated"], A).otherwise(B))
        .when(b_false & ~a_false, F.when(B["last_updated"] >= A["last_updated"], B).otherwise(A))
        .when(A["value"] == B["value"], same).otherwise(by_order)
    )
    return j.select(*keys, chosen.alias("m")).select(*keys, "m.*")
