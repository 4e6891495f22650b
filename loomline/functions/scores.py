"""Similarity and ranking columns. All are JVM expressions; constants are fixed values of the ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Priors by category; a null category is neutral, an unlisted one likewise (fixed values).
CATEGORY_IMPORTANCE = {
    "doctrine": 1.0, "incident": 0.95, "decision": 0.95, "identity": 0.90, "idea": 0.85,
    "relationship": 0.80, "topology": 0.75, "current_state": 0.75, "unknown": 0.40, "session_log": 0.20,
}
NEUTRAL_IMPORTANCE = 0.50

#: Weights of the focused score and the half life of recency in days (fixed values).
WEIGHTS = {"similarity": 0.55, "recency": 0.20, "importance": 0.15, "access": 0.10}
HALF_LIFE_DAYS = 30.0

#: Explore mode: target offset below the best hit, fall-off, floor; weights (fixed values).
EXPLORE = {"offset": 0.03, "scale": 0.05, "floor": 0.08, "adjacency": 0.55, "importance": 0.30, "novelty": 0.15}

#: Days after which a record of a category is suspect, and stale where that is not 1.5 times as many (fixed values).
DECAY = {"topology": (30, 90), "current_state": (90, None), "relationship": (180, None), "session_log": (90, None), "unknown": (90, None)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of unequal length have no cosine."""
    size = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2_distance(a: Column, b: Column) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)))


def l2_similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def importance(category: Column) -> Column:
    out = F.lit(NEUTRAL_IMPORTANCE)
    for value in sorted(set(CATEGORY_IMPORTANCE.values())):
        out = F.when(category.isin([c for c, v in CATEGORY_IMPORTANCE.items() if v == value]), F.lit(value)).otherwise(out)
    return out


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def recency(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Halves every half life; an unknown age is neutral."""
    return F.when(age_days.isNull(), F.lit(0.5)).otherwise(F.exp(-F.greatest(F.lit(0.0), age_days) / half_life * F.log(F.lit(2.0))))


def access(count: Column) -> Column:
    """Saturates at six accesses."""
    return F.least(F.lit(1.0), F.log2(1.0 + F.greatest(F.lit(0), F.coalesce(count, F.lit(0)))) / F.log2(F.lit(7.0)))


def composite(similarity: Column, age_days: Column, category: Column, count: Column, weights: dict = WEIGHTS, half_life: float = HALF_LIFE_DAYS) -> Column:
    return weights["similarity"] * clip01(similarity) + weights["recency"] * recency(age_days, half_life) + weights["importance"] * importance(category) + weights["access"] * access(count)


def explore(similarity: Column, best: Column, category: Column, count: Column) -> Column:
    sim = clip01(similarity)
    top = F.greatest(sim, F.least(F.lit(1.0), best))
    near = F.greatest(F.lit(0.0), 1.0 - F.abs(sim - (top - EXPLORE["offset"])) / EXPLORE["scale"])
    score = EXPLORE["adjacency"] * near + EXPLORE["importance"] * importance(category) + EXPLORE["novelty"] * (1.0 - access(count))
    return F.when(sim < top - EXPLORE["floor"], F.lit(0.0)).otherwise(score)


def stale_severity(category: Column, age_days: Column) -> Column:
    """'stale', 'warn' or null; perpetual categories, unknown and negative ages never warn."""
    out = F.lit(None).cast("string")
    for name, (warn, stale) in DECAY.items():
        late = stale or warn * 1.5
        out = F.when((category == name) & (age_days >= late), F.lit("stale")).when((category == name) & (age_days >= warn), F.lit("warn")).otherwise(out)
    return out


def stale_warning(category: Column, age_days: Column, created: Column) -> Column:
    """Struct of category, age_days (one decimal), threshold_days, severity and message, or null."""
    threshold = F.lit(None).cast("int")
    for name, (warn, _) in DECAY.items():
        threshold = F.when(category == name, F.lit(warn)).otherwise(threshold)
    severity = stale_severity(category, age_days)
    message = F.concat(F.upper(category), F.lit(" fact from "), F.date_format(created, "yyyy-MM-dd"), F.lit(" ("), F.floor(age_days).cast("string"), F.lit(" days old). Verify with a tool call before acting."))
    fields = F.struct(category.alias("category"), F.round(age_days, 1).alias("age_days"), threshold.alias("threshold_days"), severity.alias("severity"), message.alias("message"))
    return F.when(severity.isNotNull(), fields)
