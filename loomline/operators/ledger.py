"""Facts with their provenance: what each assertion does to its fact, in batch and, with the same rule, as a stream.

Events are (entity, attribute, seq, at, kind, value, confidence, evidence_source, source_memory_id, source_agent), ``at`` in seconds; a fact
is value, confidence, evidence_source, source_memory_id, source_agent, created_at, last_updated. Keys are normalised, so spellings
of one key are one fact.

- The first 'save' of a key is its fact. The same value again takes the new evidence and time and the higher confidence, but
  keeps whose memory it was. Another value replaces value, confidence and provenance if its confidence ranks at least as high;
  else it is rejected, and nothing changes.
- 'demote' sets the confidence false and says so in the evidence; its reason stands in ``value``. Where there is no fact, or it is false already,
  nothing happens.
- A save with an unknown confidence or without evidence, and a demotion without a reason, are problems: they touch no fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.facts import LADDER, normalized_attribute, normalized_entity
from loomline.operators.fold import Step, fields, streamed
from loomline.streaming.keyed import by_key

KEYS = ("entity", "attribute")
FACT = ("value", "confidence", "evidence_source", "source_memory_id", "source_agent", "created_at", "last_updated")
EVENT = ("seq", "at", "kind", "value", "confidence", "evidence_source", "source_memory_id", "source_agent")
RANK = {c: k for k, c in enumerate(LADDER)}
STATE = "value string, confidence string, evidence_source string, source_memory_id string, source_agent string, created_at double, last_updated double"


def problem() -> Column:
    """What is wrong with an event, or null."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    known = F.coalesce(F.col("confidence").isin(list(LADDER)), F.lit(False))
    saved = F.when(~known, "confidence").when(blank("evidence_source"), "evidence")
    return F.when(F.col("kind") == "save", saved).when(F.col("kind") == "demote", F.when(blank("value"), "reason")).otherwise(F.lit("kind"))


def checked(events: DataFrame) -> DataFrame:
    """Events with normalised keys, their columns of fixed types, and ``problem``."""
    types = {"seq": "bigint", "at": "double"}
    rest = [F.col(c).cast(types.get(c, "string")).alias(c) for c in EVENT]
    return events.select(normalized_entity(F.col("entity")).alias("entity"), normalized_attribute(F.col("attribute")).alias("attribute"), *rest).withColumn("problem", problem())


def problems(events: DataFrame) -> DataFrame:
    """Events that touch no fact, and why."""
    return checked(events).where("problem is not null")


def after(fact: tuple | None, event: tuple) -> tuple[tuple | None, str | None]:
    """The fact after a valid event, and what happened: initial, reassert, contradicted, rejected, demote or nothing."""
    _, at, kind, value, confidence, *provenance = event
    if kind == "demote":
        if fact is None or fact[1] == "false":
            return fact, None
        return (fact[0], "false", f"demoted: {value}", *fact[3:6], at), "demote"
    if fact is None:
        return (value, confidence, *provenance, at, at), "initial"
    if value == fact[0]:
        top = max(confidence, fact[1], key=RANK.__getitem__)
        return (value, top, provenance[0], *fact[3:6], at), "reassert"
    if RANK[confidence] >= RANK[fact[1]]:
        return (value, confidence, *provenance, fact[5], at), "contradicted"
    return fact, "rejected"


def _entry(keys: tuple, event: tuple, old: tuple | None, new: tuple | None, reason: str | None) -> tuple:
    shown = event[3] if reason and reason != "demote" else old[0] if reason else None
    turned = (event[4] if reason == "rejected" else new[1]) if reason else None
    return (*keys, event[0], reason, old[0] if old and reason else None, shown, old[1] if old and reason else None, turned, event[1], event[7], *(new or (None,) * len(FACT)))


def _schema(rows: DataFrame) -> T.StructType:
    text, seconds = T.StringType(), T.DoubleType()
    told = {"reason": text, "old_value": text, "new_value": text, "old_confidence": text, "new_confidence": text, "changed_at": seconds, "changed_by": text}
    return fields(rows, [*KEYS, "seq"], **told, **{c: seconds if c in FACT[5:] else text for c in FACT})


def ledger(events: DataFrame) -> DataFrame:
    """A row for every valid event in the order of seq: what it did (reason, old and new value and confidence, when and by whom),
    and the whole fact after it."""

    def start() -> Step:
        fact: list[tuple | None] = [None]

        def step(row: tuple):
            event, old = row[2:], fact[0]
            fact[0], reason = after(old, event)
            yield _entry(row[:2], event, old, fact[0], reason)

        return step

    rows = checked(events).where("problem is null").drop("problem")
    return streamed(rows, list(KEYS), list(EVENT), start, _schema(rows))


def ledger_stream(events: DataFrame) -> DataFrame:
    """``ledger`` of a stream: the state of a key is its whole fact, and events of a batch are taken in the order of seq; states are held by buckets of keys."""
    rows = checked(events).where("problem is null").drop("problem")
    schema = _schema(rows)

    def take(key: tuple, event: tuple, fact: tuple | None) -> tuple[list[tuple], tuple | None]:
        new, reason = after(fact, event)
        return [_entry(key, event, fact, new, reason)], new

    return by_key(rows, list(KEYS), ["seq"], list(EVENT), take, schema, STATE)


def facts_of(done: DataFrame) -> DataFrame:
    """Each key's fact after its last event; keys whose events found no fact have none."""
    last = F.max_by(F.struct(*FACT), "seq")
    return done.groupBy(*KEYS).agg(last.alias("f")).where("f.confidence is not null").select(*KEYS, "f.*")


def history_of(done: DataFrame) -> DataFrame:
    """What happened to facts: events that did something, also those that were rejected."""
    return done.where("reason is not null").drop(*FACT)
