"""Write-time and nightly near-duplicate tests by vector neighbourhood and token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import scores
from loomline.functions.text import ascii_token_set, overlap
from loomline.operators.vector import nearest_many

COSINE, OVERLAP, MIN_TOKENS, TOP, EXCERPT, WINDOW_DAYS, REPORTED = 0.80, 0.55, 5, 5, 240, 7, 10


def near_duplicates(candidate_pairs: DataFrame, cosine: float = COSINE, share: float = OVERLAP, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Pairs (query, id, query_vector, vector, query_tokens, tokens) that are near by both measures."""
    rows = candidate_pairs.where((F.size("query_tokens") >= min_tokens) & (F.col("query") != F.col("id")))
    rows = rows.withColumn("cosine", scores.cosine(F.col("query_vector"), F.col("vector"))).withColumn("overlap", overlap(F.col("query_tokens"), F.col("tokens")))
    hit = rows.where((F.col("cosine") >= cosine) & (F.col("overlap") >= share))
    return hit.select("query", "id", F.round("cosine", 4).alias("cosine"), F.round("overlap", 4).alias("overlap"), F.array_sort(F.array_intersect("query_tokens", "tokens")).alias("shared"))


def unordered(pairs: DataFrame, a: str = "query", b: str = "id", best: tuple[str, str] = ("overlap", "cosine")) -> DataFrame:
    """Each pair once, with its best scores."""
    key = [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    return pairs.groupBy(*key).agg(*[F.max(c).alias(c) for c in best])


def not_allowed(pairs: DataFrame, allow: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs without those an allow-list (x, y) names; '*' stands for any id.

    Each pair asks for the seven entries that would allow it, in one join; pairs are computed once.
    """
    p, q, star = F.col(a).cast("string"), F.col(b).cast("string"), F.lit("*")
    keys = [F.struct(x.alias("x"), y.alias("y")) for x, y in ((p, q), (q, p), (p, star), (star, q), (q, star), (star, p), (star, star))]
    asked = pairs.withColumn("allow_key", F.explode(F.array(*keys)))
    listed = allow.select(F.struct("x", "y").alias("allow_key"), F.lit(True).alias("allowed")).distinct()
    seen = asked.join(listed, "allow_key", "left").groupBy(*pairs.columns).agg(F.max("allowed").alias("allowed"))
    return seen.where("allowed is null").drop("allowed")


def write_status(duplicate: Column, interactive: Column, force: Column, supersedes: Column) -> Column:
    """Only interactive writes are held, and not if forced or if they supersede what they resemble."""
    held = duplicate & interactive & ~force & (F.coalesce(F.size(supersedes), F.lit(0)) <= 0)
    return F.when(held, F.lit("held")).otherwise(F.lit("archived"))


def superseded(memories: DataFrame) -> DataFrame:
    """Memories that no other one supersedes: an anti join on the exploded references."""
    gone = memories.select(F.explode("supersedes").alias("memory_id")).distinct()
    return memories.join(gone, "memory_id", "left_anti")


def nearest_candidates(queries: DataFrame, index: DataFrame, top: int = TOP) -> DataFrame:
    """Each query's nearest ``top`` rows of the index, with vectors, tokens and texts where the inputs have them.

    Only the pairs found are joined with the tables again.
    """
    near = nearest_many(index, queries.withColumnRenamed("id", "query"), top, "id", "query", "vector").select("query", "id")
    mine = queries.select(F.col("id").alias("query"), F.col("vector").alias("query_vector"), F.col("tokens").alias("query_tokens"))
    return near.join(mine, "query").join(index.select("id", "vector", "tokens", *(c for c in ("text", "age_days") if c in index.columns)), "id")


def excerpt(text: Column) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, EXCERPT)


def _tokens_of(rows: DataFrame, texts: DataFrame, id_col: str, name: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the token sets of the texts (id, tokens or text) of their ids: joined first, cut into tokens then. Sets are exploded
    arrays of one, for a filter on them does not move below that, where it would cut every text, and they are computed once."""
    source = "tokens" if "tokens" in texts.columns else "text"
    own = texts.select(F.col("id").alias(id_col), F.col(source).alias(name), *also)
    joined = rows.join(own, id_col)
    return joined if source == "tokens" else joined.withColumn(name, F.explode(F.array(ascii_token_set(F.col(name)))))


def near_pairs(
    queries: DataFrame, index: DataFrame, top: int = TOP, cosine: float = COSINE, share: float = OVERLAP, min_tokens: int = MIN_TOKENS, texts: DataFrame | None = None, query_texts: DataFrame | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """(query, id, cosine, overlap, shared, also...) of each query's nearest ``top`` rows of the index that are near by both measures.

    ``queries`` and ``index`` have id and vector, and tokens or text unless ``query_texts`` and ``texts`` have those. The search reads vectors only;
    texts are joined to the pairs that are near by cosine, and only those are cut into tokens.
    """
    texts, query_texts = index if texts is None else texts, queries if query_texts is None else query_texts
    asked = queries.select(F.col("id").alias("query"), "vector")
    found = nearest_many(index.select("id", "vector"), asked, top, "id", "query", "vector")
    found = found.where((F.col("cosine") >= cosine) & (F.col("query") != F.col("id"))).select("query", "id", "cosine")
    rows = _tokens_of(_tokens_of(found, query_texts, "query", "query_tokens"), texts, "id", "tokens", also)
    rows = rows.where(F.size("query_tokens") >= min_tokens).withColumn("overlap", overlap(F.col("query_tokens"), F.col("tokens"))).where(F.col("overlap") >= share)
    shared = F.array_sort(F.array_intersect("query_tokens", "tokens")).alias("shared")
    return rows.select("query", "id", F.round("cosine", 4).alias("cosine"), F.round("overlap", 4).alias("overlap"), shared, *also)


def held_matches(queries: DataFrame, index: DataFrame, allow: DataFrame | None = None, top: int = TOP, texts: DataFrame | None = None, query_texts: DataFrame | None = None) -> DataFrame:
    """What a write is shown: (query, id, age_days, cosine, overlap, shared, excerpt) of the known near duplicates of new
    records; a pair on the allow-list is none. ``texts`` (id, text, age_days) is the index itself unless given."""
    texts = index if texts is None else texts
    own = texts.select("id", *[c for c in ("tokens",) if c in texts.columns], "text", F.round("age_days", 1).alias("age_days"), excerpt(F.col("text")).alias("excerpt"))
    found = near_pairs(queries, index, top, texts=own, query_texts=query_texts, also=("age_days", "excerpt"))
    return found if allow is None else not_allowed(found, allow, "query", "id")


def supersede(memories: DataFrame, writes: DataFrame) -> DataFrame:
    """Memories with superseded_by set from the writes (id, supersedes array) that name them; the last write of an id wins.
    They stay as history and leave the index, see ``demoted``."""
    named = writes.select(F.explode(F.array_distinct("supersedes")).alias("memory_id"), F.col("id").alias("by")).groupBy("memory_id").agg(F.max("by").alias("by"))
    return memories.join(named, "memory_id", "left").withColumn("superseded_by", F.coalesce("by", "superseded_by")).drop("by")


def demoted(index: DataFrame, writes: DataFrame, id_col: str = "memory_id") -> DataFrame:
    """The index without the rows that writes supersede."""
    gone = writes.select(F.explode("supersedes").alias(id_col)).distinct()
    return index.join(gone, id_col, "left_anti")


def nightly_scan(
    memories: DataFrame, index: DataFrame, allow: DataFrame | None = None, window_days: float = WINDOW_DAYS, top: int = TOP, texts: DataFrame | None = None, cosine: float = COSINE, share: float = OVERLAP
) -> DataFrame:
    """Unordered near-duplicate pairs (a, b, cosine, overlap) of memories of the last days with anything in the index.

    ``memories`` has id, vector, age_days and superseded_by, ``index`` id and vector; both have tokens or text unless ``texts`` has them.
    A memory that is not indexed or has few tokens starts no search; each pair counts once, with its best scores.
    """
    recent = memories.where((F.col("age_days") <= window_days) & F.col("superseded_by").isNull() & F.col("vector").isNotNull())
    found = unordered(near_pairs(recent, index, top + 1, cosine, share, texts=texts, query_texts=texts))
    return found if allow is None else not_allowed(found, allow)


def scan_report(pairs: DataFrame, index: DataFrame, agent: str, window_days: int = WINDOW_DAYS, top: int = TOP, reported: int = REPORTED) -> DataFrame:
    """One row: status (blind, clean, duplicates), exit_code, pair_count and the advisory's text with the worst pairs.

    An empty index is blind: it cannot say that all is clean.
    """
    worst = pairs.orderBy(F.col("overlap").desc(), F.col("cosine").desc(), "a", "b").limit(reported)
    four = lambda c: F.format_string("%.4f", F.col(c).cast("double"))
    line = F.concat(F.lit("- "), F.col("a").cast("string"), F.lit(" ~ "), F.col("b").cast("string"), F.lit(" cosine="), four("cosine"), F.lit(" overlap="), four("overlap"))
    shown = worst.agg(F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("o"), (-F.col("cosine")).alias("c"), "a", "b", line.alias("line")))).alias("x")).select(F.transform("x", lambda x: x["line"]).alias("lines"))
    one = pairs.agg(F.count("*").alias("pair_count")).crossJoin(index.agg(F.count("*").alias("corpus"))).crossJoin(shown)
    status = F.when(F.col("corpus") == 0, "blind").when(F.col("pair_count") > 0, "duplicates").otherwise("clean")
    head = F.concat(F.lit(f"## Near-duplicate advisory - {agent}\nSource: corpus="), F.col("corpus").cast("string"), F.lit(f" window={window_days}d top-k={top} cosine>={COSINE:.2f} overlap>={OVERLAP:.2f}\n"))
    body = (
        F.when(F.col("corpus") == 0, F.lit("Blind store: nothing is indexed, so clean cannot be asserted."))
        .when(F.col("pair_count") == 0, F.lit("No near-duplicate pairs outside the allow-list."))
        .otherwise(F.concat(F.lit("Advisory only: "), F.col("pair_count").cast("string"), F.lit(" pair(s); showing "), F.size("lines").cast("string"), F.lit("; nothing merged or demoted.\n"), F.array_join("lines", "\n")))
    )
    return one.select(status.alias("status"), F.when(status == "blind", 2).when(status == "duplicates", 1).otherwise(0).alias("exit_code"), "pair_count", F.concat(head, body).alias("advisory"))
