"""Classification, validation and assembly steps of ingest and of the nightly batch."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import patterns as P
from loomline.functions import text as X
from loomline.operators.pack import greedy_chunks, halve_until
from loomline.sources.commits import remove, scratch

#: Marks of the nightly batch's own output, without case; {batch} is the name it signs with (fixed values).
SELF_SIGNS = ("dream-contradictions", "dream-git-sync-drift", "{batch} dream \u2014", "by {batch}-dream.py_", "verified-vs-extracted", "dream brief")


def resolve_category(explicit: Column, summary: Column, facts: Column, model: Column, routine: Column | None = None) -> Column:
    """Struct of category and the method that gave it: explicit, noise, model or pattern; patterns ask for another look.

    ``routine`` says which records are routine logs where something else than their summary and facts decides it.
    """
    routine = X.is_routine(summary, facts) if routine is None else routine
    category = F.when(explicit.isNotNull(), explicit).when(routine, F.lit("session_log")).when(model.isNotNull(), model).otherwise(X.suggest_category(summary))
    method = F.when(explicit.isNotNull(), F.lit("explicit")).when(routine, F.lit("noise")).when(model.isNotNull(), F.lit("model")).otherwise(F.lit("pattern"))
    return F.struct(category.alias("category"), method.alias("method"), (method == "pattern").alias("needs_reclassification"))


def is_auto_capture(summary: Column, session_id: Column, facts: Column, agents: Sequence[str] = ()) -> Column:
    """Ambient records: flushed tool calls, synchronised logs, and sessions named by an automaton (``agents`` are those whose
    synchronised sessions are called <agent>-jsonl-...)."""
    s, sid = F.coalesce(summary, F.lit("")), F.coalesce(session_id, F.lit(""))
    out = F.substring(s, 1, 50).startswith(P.ROUTINE_PREFIX) | F.contains(F.substring(s, 1, 200), F.lit("auto-sync from JSONL"))
    out = out | F.coalesce(F.array_contains(facts, P.FLUSH_MARKER), F.lit(False)) | F.contains(sid, F.lit("-auto-"))
    for agent in agents:
        out = out | sid.startswith(f"{agent}-jsonl-")
    return out


def is_self_derived(summary: Column, facts: Column, decisions: Column, batch: str) -> Column:
    """Whether a record's text, facts or decisions quote the output of the nightly batch of that name."""
    empty = F.array().cast("array<string>")
    low = F.lower(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.array_join(F.coalesce(facts, empty), " "), F.array_join(F.coalesce(decisions, empty), " ")))
    return F.exists(F.array(*[F.lit(s.format(batch=batch)) for s in SELF_SIGNS]), lambda s: F.contains(low, s))


def private_hits(text: Column, terms: dict[str, list[str]]) -> dict[str, Column]:
    """Per bucket whether a private term stands in the text as a word of its own, without case."""
    quoted = lambda t: "\\Q" + t + "\\E"
    return {bucket: text.rlike(r"(?iU)(?<!\w)(?:" + "|".join(map(quoted, own)) + r")(?!\w)") for bucket, own in terms.items()}


def classify_seeds(seeds: DataFrame, facts: DataFrame, keys: tuple[str, ...] = ("entity", "attribute")) -> DataFrame:
    """NEW, MATCH or CONTRADICTION for each seed (keys, value)."""
    have = facts.select(*keys, F.col("value").alias("have"))
    state = F.when(F.col("have").isNull(), "NEW").when(F.col("have") == F.col("value"), "MATCH").otherwise("CONTRADICTION")
    return seeds.join(have, list(keys), "left").select(*keys, "value", state.alias("state"))


_SENDER = r"(?s)^Sender \(untrusted metadata\):\s*```json\s*\{[^}]*\}\s*```\s*"


def without_sender(text: Column) -> Column:
    """A user's text without the block about its sender, unless nothing would be left."""
    clean = X.stripped(F.regexp_replace(text, _SENDER, ""))
    return F.when(clean != "", clean).otherwise(text)


def flatten_message(parts: Column) -> Column:
    """Text of a message's typed parts, a line each: text as is, tools and results as marks; thinking is left out."""
    name = lambda p: F.coalesce(p["name"], F.lit("?"))
    shown = F.transform(
        parts,
        lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool_use", F.concat(F.lit("[tool: "), name(p), F.lit("]"))).when(p["type"] == "tool_result", F.lit("[tool_result]")),
    )
    return F.array_join(F.filter(shown, lambda s: s.isNotNull() & (s != "")), "\n")


def thinking_summary(parts: Column, each: int = 200, most: int = 500) -> Column:
    """The heads of thinking parts, cut to ``each`` characters, joined and cut to ``most``."""
    own = F.filter(parts, lambda p: (p["type"] == "thinking") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.substring(F.array_join(F.transform(own, lambda p: X.stripped(F.substring(p["text"], 1, each))), " | "), 1, most)


def tool_names(text: Column) -> Column:
    """Tools named in the lines of a flattened message, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[^\n]*?\[tool:([^\]\n]*)"), F.lit(1)), lambda n: F.trim(n))


def reported_lines(report: Column) -> Column:
    """Line numbers that a checker's report names."""
    return F.transform(F.regexp_extract_all(report, F.lit(r"(?m)^\s*line\s+(\d+)\s+"), F.lit(1)), lambda n: n.cast("int"))


def drop_lines(text: Column, numbers: Column) -> Column:
    """Text without the numbered lines (from 1) and with a last line that says how many went; numbers of no line count
    for nothing, and without any other the text stays as it is."""

    def kept(every: Column, valid: Column) -> Column:
        rest = F.filter(every, lambda _, i: ~F.array_contains(valid, (i + 1).cast("int")))
        loss = F.concat(F.lit("DROPPED: "), F.size(valid).cast("string"), F.lit(" invalid stated line(s) after corrective retry"))
        return F.when(F.coalesce(F.size(valid), F.lit(0)) > 0, X.stripped(F.array_join(F.concat(rest, F.array(loss)), "\n"))).otherwise(text)

    asked = F.array_distinct(numbers)
    return X.bound(X.lines(text), lambda every: X.bound(F.filter(asked, lambda n: (n >= 1) & (n <= F.size(every))), lambda valid: kept(every, valid)))


def agent_of(source: Column) -> Column:
    """Agent named by a session's source: what stands before its time or date; sources of the other store by their prefix;
    else null."""
    timed = F.nullif(F.regexp_extract(source, r"^session:(.+?)-\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2}", 1), F.lit(""))
    dated = F.nullif(F.regexp_extract(source, r"^session:(.+?)-\d{4}-\d{2}-\d{2}$", 1), F.lit(""))
    return F.coalesce(timed, dated, F.when(source.startswith("mem0:"), F.lit("mem0")))


#: Words that prove nothing in an answer (fixed values).
ANSWER_STOP = ("the", "and", "with", "from", "that", "this", "for", "was", "are", "has", "have", "will")


def recall_score(level: Column, context: Column, expected: Column, keywords: Column) -> Column:
    """correct, partial, wrong or not_found. A needle must stand in the context, its numbers (or else its long words) earn
    half; other levels go by the share of keywords (0.8, 0.4), without keywords by that of the answer's words (0.6, 0.3)."""
    low, want = F.lower(context), F.lower(expected)
    empty = X.stripped(context) == ""
    miss = F.when(empty, F.lit("not_found")).otherwise(F.lit("wrong"))
    needle = F.replace(F.replace(want, F.lit("$"), F.lit("")), F.lit("\u00b0f"), F.lit(""))
    numbers = F.regexp_extract_all(needle, F.lit(r"(\d[\d,.]*)"), F.lit(1))
    words = F.filter(F.split(needle, r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(list(ANSWER_STOP)))
    tokens = F.when(F.size(numbers) > 0, numbers).otherwise(words)
    by_needle = F.when(F.contains(low, needle), F.lit("correct")).when(F.exists(tokens, lambda t: F.contains(low, t)), F.lit("partial")).otherwise(miss)
    share = lambda some: F.size(F.filter(some, lambda w: F.contains(low, F.lower(w)))) / F.greatest(F.size(some), F.lit(1))
    by_keywords = F.when(share(keywords) >= 0.8, F.lit("correct")).when(share(keywords) >= 0.4, F.lit("partial")).otherwise(miss)
    long = F.filter(F.split(want, r"\s+"), lambda w: F.length(w) > 3)
    by_words = F.when(share(long) >= 0.6, F.lit("correct")).when(share(long) >= 0.3, F.lit("partial")).otherwise(F.lit("wrong"))
    return F.when(level == "needle", by_needle).when(F.coalesce(F.size(keywords), F.lit(0)) > 0, by_keywords).otherwise(by_words)


def recall_accuracy(scores: DataFrame, column: str = "score") -> DataFrame:
    """One row: answers and percent right, half credit for partial ones."""
    point = F.when(F.col(column) == "correct", 1.0).when(F.col(column) == "partial", 0.5).otherwise(0.0)
    return scores.agg(F.count("*").alias("answers"), F.round(F.avg(point) * 100, 1).alias("accuracy_pct"))


def is_sentinel(summary: Column, facts: Column) -> Column:
    """Records to purge: without text, or flush markers only beside next to no text."""
    text = X.stripped(F.coalesce(summary, F.lit("")))
    marks = F.forall(facts, lambda f: F.lower(F.trim(F.coalesce(f, F.lit("")))) == P.FLUSH_MARKER)
    return (text == "") | (F.coalesce(F.size(facts) > 0, F.lit(False)) & F.coalesce(marks, F.lit(False)) & (F.length(text) < 40))


def latest_status(events: DataFrame, key: str = "claim_id") -> DataFrame:
    """Status of claims after promote, deprecate, forget and override events, with the claim that replaced an overridden
    one (``replacement``): the last event decides, forget is final."""
    status = {"promote": "active", "deprecate": "deprecated", "forget": "forgotten", "override": "overridden"}
    to = F.create_map(*[x for k, v in status.items() for x in (F.lit(k), F.lit(v))])
    gone = F.max((F.col("action") == "forget").cast("int"))
    extra = [F.max_by("replacement", F.when(F.col("action") == "override", F.col("seq"))).alias("superseded_by")] if "replacement" in events.columns else []
    rows = events.groupBy(key).agg(F.max_by("action", "seq").alias("last"), gone.alias("gone"), F.count("*").alias("events"), *extra)
    return rows.select(key, F.when(F.col("gone") == 1, F.lit("forgotten")).otherwise(to[F.col("last")]).alias("status"), "events", *(["superseded_by"] if extra else []))


def audit_rows(events: DataFrame, columns: list[str], order: str, per: str) -> DataFrame:
    """Sequential audit numbers per stream and a hash of the row as JSON with sorted keys."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(per).orderBy(order))).withColumn("hash", F.sha2(body, 256))


def flush_batches(rows: DataFrame, key: str, ts: str, id_col: str, most: int = 6, idle: float = 300) -> DataFrame:
    """Batch numbers: a batch ends at ``most`` rows or before a pause of at least ``idle`` seconds.

    A pause always ends a batch, so runs between pauses are cut by row numbers: windows, no fold.
    """
    order = Window.partitionBy(key).orderBy(ts, id_col)
    pause = F.coalesce(F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(order) >= idle, F.lit(False))
    runs = rows.withColumn("run", F.sum(pause.cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy(key, "run").orderBy(ts, id_col)) - 1
    parts = runs.withColumn("part", F.floor(place / most))
    return parts.withColumn("batch", F.dense_rank().over(Window.partitionBy(key).orderBy("run", "part"))).drop("run", "part")


def backlog(files: DataFrame, idle: float = 600) -> DataFrame:
    """Files with unsynced bytes that have been idle too long; a torn last line does not count."""
    return files.where((F.col("size") - F.col("offset") - F.col("torn") > 0) & (F.col("idle_seconds") > idle)).withColumn("unsynced", F.col("size") - F.col("offset"))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """Each path with its longest prefix: sizes by channel and the like. A path is looked up by its heads of the lengths that
    prefixes have, which are few; a null or shorter path has none of them."""
    lengths = sorted(r["n"] for r in prefixes.where(F.col(prefix).isNotNull()).select(F.length(prefix).alias("n")).distinct().collect())
    heads = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")])
    j = rows.withColumn("head", F.explode(F.array_compact(heads))).join(prefixes, F.col("head") == F.col(prefix)).drop("head")
    return j.withColumn("r", F.row_number().over(Window.partitionBy(path).orderBy(F.length(prefix).desc(), prefix))).where("r = 1").drop("r")


def narrative(rows: DataFrame, key: str, order: str, text: str, most: int = 30_000, automatic: Column | None = None) -> DataFrame:
    """Per key the last ``most`` characters of its texts in order, without ``automatic`` rows; only rows that can reach into
    them are gathered."""
    rows = rows if automatic is None else rows.where(~automatic)
    after = F.sum(F.length(text) + 1).over(Window.partitionBy(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length(text) - 1
    near = rows.withColumn("after", after).where(F.col("after") <= most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return near.groupBy(key).agg(F.right(joined, F.lit(most)).alias("text"))


def _unfenced(text: str) -> str:
    text = text.strip()
    if text.startswith("```"):
        text = text.partition("\n")[2] if "\n" in text else text[3:]
        text = text.rstrip().removesuffix("```")
    return text.strip()


def salvage(reply: str) -> list:
    """The values of a JSON array in a model's reply, whole or cut off; of a cut one every complete value before the cut.

    Raw line breaks inside strings are taken. A bracket that opens no value is prose, and the next one is tried.
    """
    text, decoder = _unfenced(reply), json.JSONDecoder(strict=False)
    try:
        value = decoder.decode(text)
        if isinstance(value, list | dict):
            return value if isinstance(value, list) else [value]
    except ValueError:
        pass
    for opening in (k for k, c in enumerate(text) if c == "["):
        found, at = [], opening + 1
        while (gap := re.compile(r"[ \t\r\n,]*").match(text, at).end()) < len(text) and text[gap] != "]":
            try:
                value, at = decoder.raw_decode(text, gap)
            except ValueError:
                break
            found.append(value)
        if found:
            return found
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def salvaged(reply: pd.Series) -> pd.Series:
    """Every complete value of a JSON array that may be cut off, as JSON; no built-in function reads torn JSON."""
    return reply.map(lambda t: [json.dumps(x, sort_keys=True) for x in salvage(t or "")])


def valid_notes(replies: DataFrame, allowed: tuple[str, ...], most: int = 3) -> DataFrame:
    """Notes of salvaged replies (id, objects), at most ``most`` a reply: of high confidence, an allowed category and a
    summary of at most 1000 characters; at most five facts of at most 300."""
    note = F.from_json("object", "summary string, category string, confidence string, key_facts array<string>")
    rows = replies.select("id", F.posexplode("objects").alias("pos", "object")).withColumn("n", note)
    summary = F.trim(F.coalesce("n.summary", F.lit("")))
    ok = F.lower(F.coalesce("n.confidence", F.lit(""))).eqNullSafe("high") & F.trim("n.category").isin(list(allowed)) & (summary != "") & (F.length(summary) <= 1000)
    place = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    kept = rows.where(ok).withColumn("place", place).where(F.col("place") <= most)
    facts = F.slice(F.filter(F.transform(F.coalesce("n.key_facts", F.array().cast("array<string>")), lambda f: F.substring(F.trim(f), 1, 300)), lambda f: f != ""), 1, 5)
    return kept.select("id", "place", summary.alias("summary"), F.trim("n.category").alias("category"), facts.alias("key_facts"))


def valid_facts(replies: DataFrame, today: str) -> DataFrame:
    """Facts of salvaged replies (id, objects): entity, attribute and value are needed; the source is the day's extraction
    unless it is given."""
    rows = replies.select("id", F.posexplode("objects").alias("pos", "object")).withColumn("f", F.from_json("object", "entity string, attribute string, value string, evidence_source string"))
    named = [F.coalesce(F.col(f"f.{c}"), F.lit("")) for c in ("entity", "attribute", "value")]
    whole = (named[0] != "") & (named[1] != "") & (named[2] != "")
    return rows.where(whole).select("id", "pos", "f.entity", "f.attribute", "f.value", F.coalesce("f.evidence_source", F.lit(f"dream:{today} extraction")).alias("evidence_source"))


def valid_strategies(replies: DataFrame, today: str) -> DataFrame:
    """Strategies of salvaged replies (agent_id, session_id, objects): type, description, outcome, success or failure and at
    least one step with an action are needed; the rating is held to 1..5 and is 3 if it is no number."""
    shape = "task_type string, task_description string, outcome string, derived_from string, evidence string, rating string, steps array<string>"
    rows = replies.select("agent_id", "session_id", F.posexplode("objects").alias("pos", "object")).withColumn("s", F.from_json("object", shape))
    text = {c: F.trim(F.coalesce(F.col(f"s.{c}"), F.lit(""))) for c in ("task_type", "task_description", "outcome", "derived_from", "evidence")}
    one = "struct<action:string,tool_used:string,result_summary:string>"
    as_object = lambda x: F.from_json(x, "action string, tool_used string, result_summary string")
    bare = lambda x: F.struct(F.trim(x).alias("action"), F.lit(None).cast("string").alias("tool_used"), F.lit("").alias("result_summary")).cast(one)
    read = lambda x: F.when(x.startswith("{"), F.struct(as_object(x)["action"].alias("action"), F.nullif(as_object(x)["tool_used"], F.lit("")).alias("tool_used"), F.coalesce(as_object(x)["result_summary"], F.lit("")).alias("result_summary")).cast(one)).otherwise(bare(x))
    steps = F.filter(F.transform(F.coalesce("s.steps", F.array().cast("array<string>")), read), lambda p: F.trim(F.coalesce(p["action"], F.lit(""))) != "")
    source = F.concat(F.lit(f"dream:{today} "), F.col("session_id"), F.when(text["evidence"] != "", F.concat(F.lit(" \u2014 "), text["evidence"])).otherwise(F.lit("")))
    rating = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.col("s.rating").try_cast("int"), F.lit(3))))
    kept = rows.withColumn("steps", steps).where((text["task_type"] != "") & (text["task_description"] != "") & (text["outcome"] != "") & F.lower(text["derived_from"]).isin("success", "failure") & (F.size("steps") > 0))
    return kept.select(
        "agent_id", "session_id", "pos", F.substring(text["task_type"], 1, 128).alias("task_type"), F.substring(text["task_description"], 1, 10_000).alias("task_description"), "steps",
        F.substring(text["outcome"], 1, 10_000).alias("outcome"), rating.alias("rating"), F.lower(text["derived_from"]).alias("derived_from"), F.substring(source, 1, 500).alias("evidence_source"),
    )


def rendered(timestamp: Column, session_id: Column, summary: Column, facts: Column, decisions: Column) -> Column:
    """One record as a block of a chronicle: when and where, text, facts but flush markers, decisions."""
    empty = F.array().cast("array<string>")
    own, made = F.coalesce(facts, empty), F.coalesce(decisions, empty)
    head = F.concat(F.lit("\n## ["), F.substring(F.coalesce(timestamp, F.lit("?")), 1, 19), F.lit("] session="), F.coalesce(session_id, F.lit("?")))
    listed = F.transform(F.filter(own, lambda f: f != P.FLUSH_MARKER), lambda f: F.concat(F.lit("  - "), f))
    parts = F.concat(F.array(head, F.coalesce(summary, F.lit(""))), F.when(F.size(own) > 0, F.concat(F.array(F.lit("Key facts:")), listed)).otherwise(empty), F.when(F.size(made) > 0, F.array(F.concat(F.lit("Decisions: "), F.array_join(made, "; ")))).otherwise(empty))
    return F.array_join(parts, "\n")


def harvest(memories: DataFrame, since: Column, left_out: str) -> DataFrame:
    """Records of all agents but the nightly batch's own, modified since then, in the batch's form."""
    empty = F.array().cast("array<string>")
    rows = memories.where((F.col("modified") >= since) & (F.col("agent_id") != left_out))
    return rows.select(
        "agent_id", F.coalesce("session_id", F.lit("unknown")).alias("session_id"), F.coalesce(F.col("timestamp"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("key_facts", empty).alias("key_facts"), F.coalesce("projects_referenced", empty).alias("projects"), F.coalesce("decisions_made", empty).alias("decisions"),
    )


def harvest_store(conversations: DataFrame, messages: DataFrame, summaries: DataFrame, since: Column, most: int = 50) -> DataFrame:
    """What the older store adds: all summaries after ``since``, and of the ``most`` newest assistant messages after it those
    over 100 characters, cut to 2000."""
    who = conversations.select("conversation_id", "agent_id", "session_id")
    told = summaries.where(F.col("created_at") > since).join(who, "conversation_id").select(F.lit("summary").alias("kind"), "agent_id", "session_id", F.col("created_at").alias("timestamp"), F.col("content").alias("summary"))
    newest = messages.where((F.col("created_at") > since) & (F.col("role") == "assistant")).join(who, "conversation_id").orderBy(F.col("created_at").desc(), "message_id").limit(most)
    said = newest.where(F.length("content") > 100).select(F.lit("message").alias("kind"), "agent_id", "session_id", F.col("created_at").alias("timestamp"), F.substring("content", 1, 2000).alias("summary"))
    return told.unionByName(said)


def agent_sections(rows: DataFrame, budget: int = 1_000_000) -> DataFrame:
    """(agent_id, entries, dropped, section): each agent's records (timestamp, block) in order, the newest that fit the
    budget, with a heading that says what was left out. Only records within the budget are gathered."""
    newest = Window.partitionBy("agent_id").orderBy(F.col("timestamp").desc(), F.col("block").desc())
    sized = rows.withColumn("used", F.sum(F.length("block")).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    counts = rows.groupBy("agent_id").agg(F.count("*").alias("all"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "block"))), lambda x: x["block"]), "\n")
    kept = sized.where(F.col("used") <= budget).groupBy("agent_id").agg(F.count("*").alias("entries"), body.alias("body"))
    out = counts.join(kept, "agent_id", "left").withColumn("entries", F.coalesce("entries", F.lit(0)))
    lost = F.col("all") - F.col("entries")
    note = F.when(lost > 0, F.concat(F.lit("; "), lost.cast("string"), F.lit(f" older entries omitted to fit the {budget:,}-char cap"))).otherwise(F.lit(""))
    head = F.concat(F.lit("# Agent: "), F.col("agent_id"), F.lit(" ("), F.col("entries").cast("string"), F.lit(" entries"), note, F.lit(")"))
    return out.select("agent_id", "entries", lost.alias("dropped"), F.concat_ws("\n", head, "body").alias("section"))


def asked(rows: DataFrame, column: str, model: Callable[[str], str], answer: str = "reply", too_large: Callable[[Exception], bool] | None = None, least: int = 20_000) -> DataFrame:
    """Rows with a model's reply to a column's text, null where the call failed: one failure costs one row.

    With ``too_large``, which knows the errors that a shorter text may mend, a text is halved on those down to ``least``
    characters; its end stays, which of chronological texts is the newest.
    """

    def call(text: str | None) -> str | None:
        try:
            return halve_until(model, text or "", too_large, least, tail=True)[0] if too_large else model(text or "")
        except Exception:
            return None

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(call)

    return rows.withColumn(answer, run(column))


#: Characters of one joint brief's input.
ROLL_UP = 400_000


def briefs(sections: DataFrame, brief: Callable[[str], str], too_large: Callable[[Exception], bool] | None = None) -> DataFrame:
    """(first, agents, brief): a model's brief of each agent's section; agents whose call fails are left out."""
    done = asked(sections, "section", brief, "brief", too_large).where("brief is not null")
    return done.select(F.col("agent_id").alias("first"), F.lit(1).cast("long").alias("agents"), F.concat(F.lit("## "), "agent_id", F.lit("\n\n"), "brief").alias("brief"))


def _titled(title: str, parts: Sequence[str]) -> str:
    return "\n\n".join([title, *parts])


def roll_up_level(rows: DataFrame, roll_up: Callable[[str], str], title: str, most: int, too_large: Callable[[Exception], bool] | None = None) -> DataFrame:
    """One level of a roll-up: neighbouring briefs (first, agents, brief) are joined to inputs of at most ``most`` characters,
    and a model's brief of each takes their place. A single brief beyond that is an input of its own; a group whose call
    fails is left out, which ``agents``, the number of agents that a brief stands for, shows."""
    spark, place = rows.sparkSession, scratch(rows.sparkSession, "briefs")
    sized = rows.withColumn("chars", F.length("brief") + 2)
    total = sized.agg(F.sum("chars")).first()[0] or 0
    # blocks by range of agents, so that no running total goes over all briefs; written, as block numbers must not change
    sized.repartitionByRange(max(1, total // (32 * most)), "first").withColumn("block", F.spark_partition_id()).write.parquet(place)
    narrow = spark.read.parquet(place)
    groups = greedy_chunks(narrow.select("block", "first", "chars"), ["block"], "first", "chars", most - len(title)).select("block", "first", "chunk")
    members = F.array_sort(F.collect_list(F.struct("first", "brief")))
    joined = narrow.join(groups, ["block", "first"]).groupBy("block", "chunk").agg(F.min("first").alias("first"), F.sum("agents").alias("agents"), members.alias("m"))
    texts = joined.select("first", "agents", F.array_join(F.concat(F.array(F.lit(title)), F.transform("m", lambda x: x["brief"])), "\n\n").alias("text"))
    return asked(texts, "text", roll_up, "reply", too_large).where("reply is not null").select("first", "agents", F.col("reply").alias("brief"))


def map_reduce_brief(sections: DataFrame, brief: Callable[[str], str], roll_up: Callable[[str], str], title: str = "# Briefs by agent", most: int = ROLL_UP, too_large: Callable[[Exception], bool] | None = None) -> str:
    """One joint brief: a model's brief of each agent's section, rolled up in order of the agents.

    While the briefs are more than ``most`` characters, they are rolled up level by level on the executors; only what fits
    one input comes to the driver, for the last call. Every level is written once, so that no call is made twice. Agents
    and groups whose call fails are left out; if all fail, that raises, and so does a model whose roll-ups do not get
    shorter than what they join, as no input would ever hold them.
    """
    spark = sections.sparkSession
    held = scratch(spark, "briefs")
    briefs(sections, brief, too_large).write.parquet(held)
    before = None
    while True:
        rows = spark.read.parquet(held)
        size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("brief") + 2), F.lit(0)).alias("chars")).first()
        if not size["n"]:
            raise RuntimeError("every agent's brief failed" if before is None else "every roll-up failed")
        if size["n"] == 1 or size["chars"] + len(title) <= most:
            break
        if before is not None and (size["n"], size["chars"]) >= before:
            raise RuntimeError("roll-ups do not get shorter than the briefs that they join")
        before, above = (size["n"], size["chars"]), scratch(spark, "briefs")
        roll_up_level(rows, roll_up, title, most, too_large).write.parquet(above)
        remove(spark, held)
        held = above
    parts = [r["brief"] for r in rows.orderBy("first").collect()]
    remove(spark, held)
    text = _titled(title, parts)
    return halve_until(roll_up, text, too_large, tail=True)[0] if too_large else roll_up(text)


def extraction_input(memories: DataFrame, agents: Sequence[str], batch: str, budget: int = 20_000) -> DataFrame:
    """(agent_id, chunk, section): stated records only, neither ambient nor quoting the batch, in chunks of the budget."""
    stated = memories.where(~is_auto_capture(F.col("summary"), F.col("session_id"), F.col("key_facts"), agents) & ~is_self_derived(F.col("summary"), F.col("key_facts"), F.col("decisions"), batch))
    rows = stated.withColumn("block", rendered(F.col("timestamp"), F.col("session_id"), F.col("summary"), F.col("key_facts"), F.col("decisions")))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("agent_id").orderBy("timestamp", "session_id", "block"))).withColumn("chars", F.length("block"))
    chunks = greedy_chunks(rows, ["agent_id"], "place", "chars", budget).select("agent_id", "place", "chunk")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "\n")
    sections = rows.join(chunks, ["agent_id", "place"]).groupBy("agent_id", "chunk").agg(F.count("*").alias("n"), body.alias("body"))
    return sections.select("agent_id", "chunk", F.concat(F.lit("# Agent: "), "agent_id", F.lit(" ("), F.col("n").cast("string"), F.lit(" entries)\n"), "body").alias("section"))


def extract_facts(memories: DataFrame, agents: Sequence[str], batch: str, model: Callable[[str], str], today: str, budget: int = 20_000) -> DataFrame:
    """Facts that a model finds in the stated records, chunk by chunk; a chunk whose call or reply fails costs itself only."""
    replies = asked(extraction_input(memories, agents, batch, budget), "section", model)
    found = replies.where("reply is not null").select(F.struct("agent_id", "chunk").alias("id"), salvaged("reply").alias("objects"))
    return valid_facts(found, today).select("id.agent_id", "id.chunk", "pos", "entity", "attribute", "value", "evidence_source")


def project_notes(memories: DataFrame) -> DataFrame:
    """(memory_id, project, facts, text): a note for every project that a memory (memory_id, session_id, summary, key_facts,
    projects) refers to, with the facts that name it, without case. Without projects there is none; nulls name nothing."""
    rows = memories.select("memory_id", "session_id", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("key_facts", F.array().cast("array<string>")).alias("all"), F.explode("projects").alias("project"))
    named = rows.withColumn("facts", F.filter("all", lambda f: F.coalesce(F.contains(F.lower(f), F.lower("project")), F.lit(False)))).where("project is not null")
    listed = F.when(F.size("facts") > 0, F.concat(F.lit("Facts:\n"), F.array_join(F.transform("facts", lambda f: F.concat(F.lit("- "), f)), "\n"))).otherwise(F.lit(""))
    text = F.concat(F.lit("Project: "), "project", F.lit("\nSession: "), F.coalesce("session_id", F.lit("")), F.lit("\nSummary: "), "summary", F.lit("\n"), listed)
    return named.select("memory_id", "project", "facts", text.alias("text"))


def health(tenants: DataFrame, parts: Column) -> DataFrame:
    """One row: sessions by tier summed over tenants (hot, warm, cold), and ok, degraded or down as all, some or none of the
    parts (an array of booleans; null is not well) are well. Without tenants the sums are 0."""
    well = F.size(F.filter(parts, lambda p: F.coalesce(p, F.lit(False))))
    status = F.when(well == F.size(parts), "ok").when(well > 0, "degraded").otherwise("down")
    return tenants.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hot", "warm", "cold")]).withColumn("status", status)


def stale_recipes(recipes: DataFrame, recalled: DataFrame, now: Column, days: float = 90) -> DataFrame:
    """(id, used) of recipes (id, created) neither made nor recalled (id, ts) in the last ``days``; a null time is none."""
    latest = recalled.groupBy("id").agg(F.max("ts").alias("recalled"))
    used = recipes.select("id", "created").join(latest, "id", "left").select("id", F.greatest("created", "recalled").alias("used"))
    return used.where(now.cast("double") - F.col("used").cast("double") > days * 86_400)


def brief_age(briefs: DataFrame, now: Column, companion: str = "-boot") -> DataFrame:
    """The newest brief (name, modified) that is no companion, with its age in hours."""
    latest = briefs.where(~F.col("name").endswith(companion)).agg(F.max_by(F.struct("name", "modified"), "name").alias("b")).where("b is not null")
    return latest.select("b.name", F.round((now.cast("double") - F.col("b.modified").cast("double")) / 3600, 1).alias("age_hours"))
