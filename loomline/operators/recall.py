"""Recall tiers, predicates, fusion, escalation test and final ranking, as DataFrame transformations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.operators import vector as V

HIDDEN = ("session_log",)
TIERS = ("hot", "l1", "vec", "l2", "l3")
#: Thresholds of the cached tiers and the life of the first in seconds (fixed values).
L1_LEAST, L1_SECONDS, L2_ABOVE, L3_ABOVE, L3_CANDIDATES = 0.75, 86_400, 0.5, 0.4, 80
EXPAND_WORDS, EXPAND_GAP = 3, 0.02


def hidden_categories(requested: str | None, exclude: Sequence[str] | None) -> list[str]:
    """Default-hide rule: an empty list disables hiding, and a requested category is never hidden."""
    return [c for c in (HIDDEN if exclude is None else exclude) if c != requested]


def metadata_predicate(source: str | None = None, category: str | None = None, exclude: Sequence[str] = (), max_age_days: float | None = None, exclude_stale: bool = False) -> Column:
    """Source and category equality fail on null; exclusion and age only drop what is known; stale rows can go."""
    keep = F.lit(True)
    if source is not None:
        keep = keep & F.coalesce(F.col("source") == source, F.lit(False))
    if category is not None:
        keep = keep & F.coalesce(F.col("category") == category, F.lit(False))
    if exclude:
        keep = keep & (F.col("category").isNull() | ~F.col("category").isin(list(exclude)))
    if max_age_days is not None:
        keep = keep & (F.col("age_days").isNull() | (F.col("age_days") <= max_age_days))
    if exclude_stale:
        keep = keep & ~F.coalesce(scores.stale_severity(F.col("category"), F.col("age_days")) == "stale", F.lit(False))
    return keep


def tenant_scope(rows: DataFrame, agent_id: str | None, multi_tenant: bool = True) -> DataFrame:
    """Only the pinned tenant's rows; leaving the tenant out is an error where there are several."""
    if agent_id is None:
        if multi_tenant:
            raise ValueError("agent_id is required when several tenants exist")
        return rows
    return rows.where(F.col("agent_id") == agent_id)


def disk_truth(chunks: DataFrame, memories: DataFrame, routine: Column) -> DataFrame:
    """Cached category and source are replaced by the base row's; missing or superseded rows go.

    Chunks without a memory id stay; those that are routine logs become session_log.
    """
    base = memories.select(F.col("memory_id").alias("base_id"), F.col("category").alias("base_category"), F.col("source").alias("base_source"), F.col("superseded_by").isNotNull().alias("gone"))
    joined = chunks.join(base, F.col("memory_id") == F.col("base_id"), "left")
    alive = F.col("memory_id").isNull() | (F.col("base_id").isNotNull() & ~F.col("gone"))
    category = F.when(F.col("memory_id").isNull(), F.when(routine, F.lit("session_log")).otherwise(F.col("category"))).otherwise(F.coalesce("base_category", "category"))
    source = F.when(F.col("memory_id").isNull(), F.col("source")).otherwise(F.coalesce("base_source", "source"))
    return joined.where(alive).withColumns({"category": category, "source": source}).drop("base_id", "base_category", "base_source", "gone")


def hot_keyword(exchanges: DataFrame, words: str, k: int) -> DataFrame:
    """Newest exchanges that hold the words, case-insensitively; relevance is constant; at most min(3, k)."""
    found = exchanges.where(F.contains(F.lower("haystack"), F.lit(words.lower())))
    return found.orderBy(F.col("file").desc(), "line").limit(min(3, k)).withColumn("relevance", F.lit(0.75)).withColumn("category", F.lit("session_log"))


def l1_hits(cache: DataFrame, k: int, least: float = L1_LEAST, seconds: float = L1_SECONDS) -> DataFrame:
    return cache.where((F.col("age_seconds") <= seconds) & (F.col("cosine") >= least)).orderBy(F.col("cosine").desc(), "memory_id").limit(k)


def l2_hits(index: DataFrame, k: int, above: float = L2_ABOVE) -> DataFrame:
    return index.where(F.col("cosine") > above).orderBy(F.col("cosine").desc(), "memory_id").limit(k)


def l3_hits(memories: DataFrame, keep: Column, k: int, above: float = L3_ABOVE, most: int = L3_CANDIDATES) -> DataFrame:
    """Newest candidates that pass the predicate, then the threshold: the expensive score runs on ``most`` rows."""
    newest = memories.where(keep).orderBy(F.col("created_at").desc(), "memory_id").limit(most)
    return newest.where(F.col("cosine") > above).orderBy(F.col("cosine").desc(), "memory_id").limit(k)


def union_tiers(tiers: dict[str, DataFrame]) -> DataFrame:
    """Rows of all tiers in tier order with pool positions; later tiers drop ids that an earlier one has.

    The first cached tier may repeat an id within itself.
    """
    more = [c for c in next(iter(tiers.values())).columns if c == "content"]
    parts = [df.select("memory_id", "relevance", F.lit(TIERS.index(name)).alias("tier"), F.col("position"), *more) for name, df in tiers.items()]
    rows = reduce(DataFrame.unionByName, parts)
    first = Window.partitionBy("memory_id")
    seen = rows.withColumn("first_tier", F.min("tier").over(first)).withColumn("copy", F.row_number().over(first.orderBy("tier", "position")))
    l1 = TIERS.index("l1")
    keep = F.col("memory_id").isNull() | (F.col("copy") == 1) | ((F.col("tier") == l1) & (F.col("first_tier") == l1))
    return seen.where(keep).select("memory_id", "relevance", "tier", "position", *more)


def fuse(passes: DataFrame) -> DataFrame:
    """One row per key with its greatest relevance; ties keep the first pass; order is by first sight.

    ``passes`` has key, relevance, pass_no, position.
    """
    best = Window.partitionBy("key").orderBy(F.col("relevance").desc(), "pass_no", "position")
    first = Window.partitionBy("key")
    seen = passes.withColumn("seen_at", F.min(F.struct("pass_no", "position")).over(first)).withColumn("r", F.row_number().over(best))
    return seen.where("r = 1").drop("r")


def pool_statistics(pool: DataFrame, column: str = "relevance") -> DataFrame:
    """(top, mid, n): maximum and exact median; 0 for an empty pool."""
    stats = pool.agg(F.coalesce(F.max(column), F.lit(0.0)).alias("top"), F.coalesce(F.median(column), F.lit(0.0)).alias("mid"), F.count("*").alias("n"))
    return stats


def should_expand(pool: DataFrame, prompt: str) -> DataFrame:
    """Whether a query of at least three words found nothing, or nothing that stands out."""
    enough = len(prompt.split()) >= EXPAND_WORDS
    return pool_statistics(pool).withColumn("expand", F.lit(enough) & ((F.col("n") == 0) | (F.col("top") - F.col("mid") < EXPAND_GAP)))


def pool_size(k: int, mode: str = "focus") -> int:
    return max(k * (5 if mode == "explore" else 3), k + 5)


def with_access(pool: DataFrame, log: DataFrame) -> DataFrame:
    """Pool with access counts (0 if never used). The pool is a few rows, so only its ids' part of the log is counted."""
    counts = log.join(F.broadcast(pool.select("memory_id").distinct()), "memory_id", "left_semi").groupBy("memory_id").agg(F.count("*").alias("access_count"))
    return pool.join(F.broadcast(counts), "memory_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)))


def bump_access(stats: DataFrame, log: DataFrame) -> DataFrame:
    """Counters (memory_id, access_count, last_accessed) after the accesses of a log (memory_id, ts): counts add up."""
    new = log.where("memory_id is not null").groupBy("memory_id").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"))
    return stats.select("memory_id", "access_count", "last_accessed").unionByName(new).groupBy("memory_id").agg(F.sum("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))


def parse_variants(reply: str, prompt: str, most: int = 4) -> list[str]:
    """Other phrasings out of a model's reply, a line each: a list marker and quotes go, copies without case too."""
    seen, out = {prompt.strip().lower()}, []
    for line in reply.splitlines():
        phrase = re.sub(r"^\s*(?:[-\u2022*]|\d+[.)])\s+", "", line).strip().strip('"')
        if phrase and phrase.lower() not in seen and len(out) < most:
            seen.add(phrase.lower())
            out.append(phrase)
    return out


def l3_open(pool: DataFrame, k: int, filtered: bool) -> DataFrame:
    """One row, open: whether the scan of base rows runs. It does while the cheap tiers have fewer than k rows, unless a
    category filter is active and the vector tier served some row under it. ``pool`` has tier."""
    served = F.sum((F.col("tier") == TIERS.index("vec")).cast("int"))
    few = F.count("*") < k
    return pool.agg((few & (F.lit(not filtered) | (F.coalesce(served, F.lit(0)) == 0))).alias("open"))


def positioned(rows: DataFrame, *order: Column | str) -> DataFrame:
    """A tier's few rows with their positions."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))


def retrieve(index: DataFrame, memories: DataFrame, exchanges: DataFrame | None, vector: Sequence[float], words: str, k: int, cached: DataFrame | None = None, category: str | None = None, exclude: Sequence[str] | None = None, mode: str = "focus") -> DataFrame:
    """One pass over all tiers: (memory_id, content, relevance, tier, position), in tier order, no id twice.

    HOT: keyword hits in the newest sessions (exchanges with file, line, haystack). L1: young cached rows (``cached`` with
    age_seconds). VEC: filtered nearest neighbours of ``index``, escalated once. L2: the whole index by cosine. L3: newest
    base rows (``memories`` with embedding and created_at), only if ``l3_open``. All obey the category rule.
    """
    hidden = hidden_categories(category, exclude)
    keep, wide = V.category_filter(category, hidden), pool_size(k, mode)
    by_cosine = (F.col("relevance").desc(), "memory_id")
    none = F.lit(None).cast("string")
    tiers: dict[str, DataFrame] = {}
    if exchanges is not None:
        hot = hot_keyword(exchanges, words, k).where(keep).withColumn("memory_id", F.lit(None).cast("long"))
        tiers["hot"] = positioned(hot.withColumn("content", F.col("haystack")), F.col("file").desc(), "line")
    all_scored = V.scored(index, vector).withColumn("content", none)
    if cached is not None:
        l1 = l1_hits(V.scored(cached, vector).where(keep), wide).withColumn("relevance", F.col("cosine")).withColumn("content", none)
        tiers["l1"] = positioned(l1, *by_cosine)
    vec = V.nearest_escalated(index, vector, wide, keep).withColumn("relevance", F.col("similarity")).withColumn("content", none)
    tiers["vec"] = positioned(vec, "distance", "memory_id")
    tiers["l2"] = positioned(l2_hits(all_scored.where(keep), wide).withColumn("relevance", F.col("cosine")), *by_cosine)
    parts = {name: df.select("memory_id", "relevance", "position", "content") for name, df in tiers.items()}
    cheap = union_tiers(parts)
    l3 = l3_hits(V.scored(memories, vector), keep, wide).withColumn("relevance", F.col("cosine")).withColumn("content", none)
    l3 = positioned(l3, *by_cosine).crossJoin(F.broadcast(l3_open(cheap, k, bool(category or hidden)))).where("open")
    return union_tiers(parts | {"l3": l3.select("memory_id", "relevance", "position", "content")})


def preflight_context(cached: DataFrame, index: DataFrame, vector: Sequence[float], each: int = 2) -> DataFrame:
    """The two best rows of the first and the second cached tier, by which a draft is checked: (memory_id, tier, relevance)."""
    l1 = l1_hits(V.scored(cached, vector), each).select("memory_id", F.lit("L1").alias("tier"), F.col("cosine").alias("relevance"))
    return l1.unionByName(l2_hits(V.scored(index, vector), each).select("memory_id", F.lit("L2").alias("tier"), F.col("cosine").alias("relevance")))


def preflight_verdict(reply: Column) -> Column:
    """Struct of verdict, confidence and reason out of a reviewer's reply; without a verdict nothing was validated."""
    bare = F.trim(F.regexp_replace(F.trim(F.trim(reply), F.lit("`")), r"^\s*json", ""))
    got = F.from_json(bare, "verdict string, confidence double, reason string, enrichment string")
    verdict = F.coalesce(F.upper(got["verdict"]), F.lit("UNAVAILABLE"))
    sure = F.when(F.get_json_object(bare, "$").isNull(), F.lit(0.0)).otherwise(F.coalesce(got["confidence"], F.lit(0.5)))
    return F.struct(verdict.alias("verdict"), sure.alias("confidence"), F.coalesce(got["reason"], F.lit("")).alias("reason"), got["enrichment"].alias("enrichment"))


def writable(rows: DataFrame, read_only: Sequence[str]) -> DataFrame:
    """Writes without those of read-only agents."""
    return rows.where(F.col("agent_id").isNull() | ~F.col("agent_id").isin(list(read_only))) if read_only else rows


def since(value: str | None, today: date) -> str | None:
    """'14d' or an ISO date as an ISO date; anything else is an error."""
    text = (value or "").strip().lower()
    if not text:
        return None
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return text
    if found := re.fullmatch(r"(\d+)d", text):
        return (today - timedelta(days=int(found[1]))).isoformat()
    raise ValueError(f"neither a date nor a number of days: {value!r}")


#: Least cosine of the first and second tier by persona (fixed values).
PERSONAS = {"default": (0.75, 0.5), "strict": (0.8, 0.6), "creative": (0.6, 0.35)}


def rank_focus(pool: DataFrame, k: int) -> DataFrame:
    score = scores.composite(F.col("relevance"), F.col("age_days"), F.col("category"), F.col("access_count"))
    return pool.withColumn("score", score).orderBy(F.col("score").desc(), "position").limit(k)


def rank_explore(pool: DataFrame, k: int) -> DataFrame:
    best = F.max("relevance").over(Window.partitionBy(F.lit(1)))
    score = scores.explore(F.col("relevance"), F.col("best"), F.col("category"), F.col("access_count"))
    return pool.withColumn("best", best).withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "position").limit(k)


def evict_second_tier(rows: DataFrame, keep: int = 2000, slack: int = 1) -> DataFrame:
    """The second cached tier is cut to its newest rows only when it is more than ``slack`` over; up to that nothing goes."""
    many = rows.agg((F.count("*") <= keep + slack).alias("fits"))
    place = F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("memory_id").desc()))
    newest_rows = rows.select("created_at", "memory_id").orderBy(F.col("created_at").desc(), F.col("memory_id").desc()).limit(keep + slack).withColumn("place", place)
    last = newest_rows.where(F.col("place") == keep).select(F.struct("created_at", "memory_id").alias("last"))
    return rows.crossJoin(F.broadcast(many)).join(F.broadcast(last), F.lit(True), "left").where(F.col("fits") | F.col("last").isNull() | (F.struct("created_at", "memory_id") >= F.col("last"))).drop("fits", "last")


def newest(rows: DataFrame, keep: int, per: Sequence[str] = (), by: str = "created_at", id_col: str = "memory_id") -> DataFrame:
    """Newest ``keep`` rows of each key: oldest-first eviction, per-entity pages, recent lists."""
    if not per:
        return rows.orderBy(F.col(by).desc(), F.col(id_col).desc()).limit(keep)
    place = Window.partitionBy(*per).orderBy(F.col(by).desc(), F.col(id_col).desc())
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep).drop("place")


def paused(rows: DataFrame, windows: DataFrame, ambient: Column, max_minutes: int = 240) -> DataFrame:
    """Capture gate: ambient rows within a pause window go. Windows are few and end after at most 240 minutes.

    ``windows`` has start and minutes; equal start-day buckets turn the range condition into an equi-join.
    """
    width = max_minutes * 60
    w = windows.select(F.col("start").alias("w_start"), F.least("minutes", F.lit(max_minutes)).alias("w_minutes"))
    w = w.withColumn("slot", F.explode(F.array(F.floor(F.unix_timestamp("w_start") / width), F.floor(F.unix_timestamp("w_start") / width) + 1)))
    hit = (F.col("ts") >= F.col("w_start")) & (F.col("ts") < F.col("w_start") + F.make_dt_interval(mins=F.col("w_minutes")))
    return rows.withColumn("slot", F.floor(F.unix_timestamp("ts") / width)).alias("r").join(w.alias("w"), (F.col("r.slot") == F.col("w.slot")) & hit & ambient, "left_anti").drop("slot")
