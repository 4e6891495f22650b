"""Claim validation, trust, promotion and evaluation."""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import patterns as P
from loomline.functions import text as X
from loomline.operators import detect as D

MAX_CLAIM, DUPLICATE_RATIO = 180, 0.85
TRUST_ORDER = tuple(P.TRUST)


def disposition_rank(value: Column) -> Column:
    """0 for unknown values, which never win."""
    return F.array_position(F.array(*[F.lit(d) for d in P.DISPOSITIONS]), value)


def strongest(values: Column) -> Column:
    best = F.aggregate(values, F.lit(1).cast("bigint"), lambda m, v: F.greatest(m, F.coalesce(disposition_rank(v), F.lit(0).cast("bigint"))))
    return F.element_at(F.array(*[F.lit(d) for d in P.DISPOSITIONS]), best.cast("int"))


def trust_bucket(platform: Column, platforms: dict[str, str]) -> Column:
    """Bucket of a platform by a configured map; unknown platforms are untrusted."""
    out = F.lit(TRUST_ORDER[-1])
    for name, bucket in platforms.items():
        out = F.when(platform == name, F.lit(bucket)).otherwise(out)
    return out


def weakest_trust(evidence: DataFrame, keys: list[str]) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(b) for b in TRUST_ORDER]), F.col("bucket"))
    return evidence.groupBy(*keys).agg(F.element_at(F.array(*[F.lit(b) for b in TRUST_ORDER]), F.max(rank).cast("int")).alias("trust"), F.count("*").alias("n_evidence"))


#: What a finding's category leads to, and the least that a trust bucket does (fixed values).
DISPOSITION = {
    "secret": "hard_block", "pii_hard": "hard_block", "pii_soft": "local_only", "pii_adjacent": "local_only", "private_dict": "review_required",
    "injection_in_claim": "hard_block", "injection_in_evidence": "review_required", "generic_fluff": "hard_block", "duplicate": "hard_block", "insufficient_evidence": "review_required",
}


def finding_codes(text: Column, in_claim: bool, private: dict[str, list[str]] | None = None) -> Column:
    """category:detector of every finding in a text, in the order of the detectors, as often as it is found."""
    injection = "injection_in_claim" if in_claim else "injection_in_evidence"
    found = [(f"secret:{name}", F.regexp_count(text, F.lit(p))) for name, p in P.SECRET_DETECTORS]
    counts = X.detector_counts(text)
    found += [(f"{category}:{name}", counts[name]) for name, category, _, _ in P.PII]
    found += [(f"private_dict:{name}", F.regexp_count(text, F.lit(p))) for name, p in D.private_patterns(private or {}).items()]
    found += [(f"{injection}:injection_phrase", X.injection_count(text))]
    return F.flatten(F.array(*[F.array_repeat(F.lit(code), F.coalesce(n, F.lit(0)).cast("int")) for code, n in found]))


def _disposition_of(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for category, disposition in DISPOSITION.items():
        out = F.when(F.split(code, ":")[0] == category, F.lit(disposition)).otherwise(out)
    return out


def validate(observations: DataFrame, evidence: DataFrame, platforms: dict[str, str], active: DataFrame | None = None, private: dict[str, list[str]] | None = None, replacements: dict[str, str] | None = None, id_col: str = "obs_id") -> DataFrame:
    """(id, disposition, reasons, evidence_trust, taint, portability, duplicate_of, redacted_claim, salvageability).

    ``observations`` has id, claim, platform and session_id; ``evidence`` id, place, excerpt and bucket (null or unknown:
    that of the platform). A claim over 180 characters, or else one with less than two pieces of evidence, is judged by
    that alone. Otherwise: metadata that cannot be trusted is a taint; findings in claim and excerpts, empty phrases and
    likeness to an active claim (``active``: claim_id, claim) each count; private terms in the claim that ``replacements``
    can all replace turn a block into a review; the strongest disposition decides, but at least the floor of the weakest
    trust; and what only untrusted pages say stays local.
    """
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    buckets = F.array(*[F.lit(b) for b in TRUST_ORDER])
    source = trust_bucket(F.col("platform"), platforms)
    ev = evidence.join(observations.select(id_col, source.alias("source_bucket")), id_col)
    bucket = F.when(F.array_contains(buckets, F.col("bucket")), F.col("bucket")).otherwise(F.col("source_bucket"))
    codes = F.transform(finding_codes(F.col("excerpt"), in_claim=False, private=private), lambda c: F.concat(c, F.lit("@evidence["), F.col("place").cast("string"), F.lit("]")))
    ev = ev.select(id_col, "place", codes.alias("codes"), F.array_position(buckets, bucket).alias("rank"))
    held = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("codes") > 0, F.struct("place", "codes")))), lambda x: x["codes"]))
    seen = ev.groupBy(id_col).agg(F.count("*").alias("n"), F.max("rank").alias("weakest"), F.min("rank").alias("best"), held.alias("evidence_codes"))
    j = observations.join(seen, id_col, "left")
    if active is None:
        j = j.withColumn("duplicate_of", none)
    else:
        j = j.join(fuzzy_duplicates(observations.select(F.col(id_col).alias("obs_id"), "claim"), active).select(F.col("obs_id").alias(id_col), F.col("claim_id").cast("string").alias("duplicate_of")), id_col, "left")

    unknown = ~F.coalesce(F.col("platform").isin(list(platforms)), F.lit(False))
    malformed = ~F.coalesce(F.col("session_id"), F.lit("")).rlike(r"\A[\x20-\x7E]{1,128}\z")
    tainted = unknown | malformed
    trust = F.when(tainted, F.lit("metadata_untrusted")).otherwise(F.element_at(buckets, F.col("weakest").cast("int")))
    claim_codes = F.transform(finding_codes(F.col("claim"), in_claim=True, private=private), lambda c: F.concat(c, F.lit("@claim")))
    found = F.concat(claim_codes, F.coalesce("evidence_codes", empty))
    taint = F.concat(
        F.when(tainted, F.array(F.lit("metadata_untrusted"))).otherwise(empty),
        F.when(F.exists(F.coalesce("evidence_codes", empty), lambda c: c.startswith("injection_in_evidence:")), F.array(F.lit("untrusted_instructional_text"))).otherwise(empty),
    )
    redacted, salvaged = _salvaged(private or {}, replacements or {})
    j = j.withColumns({"found": found, "trust": trust, "taint": taint, "fluff": X.is_fluff(F.col("claim")), "salvaged": salvaged, "redacted": redacted})
    when = lambda test, code: F.when(test, F.array(code)).otherwise(empty)
    seen_all = F.concat(F.transform("found", _disposition_of), when(F.col("fluff"), F.lit(DISPOSITION["generic_fluff"])), when(F.col("duplicate_of").isNotNull(), F.lit(DISPOSITION["duplicate"])))
    seen_all = F.when(F.col("salvaged"), F.concat(F.filter(seen_all, lambda d: d != "hard_block"), F.array(F.lit("review_required")))).otherwise(seen_all)
    floor = F.coalesce(F.create_map(*[x for b, d in P.TRUST.items() for x in (F.lit(b), F.lit(d))])[F.col("trust")], F.lit("allow"))
    j = j.withColumn("before", strongest(seen_all)).withColumn("floor", floor).withColumn("final", strongest(F.array("before", "floor")))
    alone = (F.col("best") == len(TRUST_ORDER)) & (F.col("weakest") == len(TRUST_ORDER))
    reasons = F.concat(
        when(unknown, F.lit("metadata_integrity:unknown_source_platform")), when(malformed, F.lit("metadata_integrity:malformed_session_id")), F.col("found"), when(F.col("fluff"), F.lit("generic_fluff")),
        when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("duplicate_of_active_claim:"), "duplicate_of")), when(F.col("salvaged"), F.lit("redaction:private_dict_salvaged")),
        when(F.col("final") != F.col("before"), F.concat(F.lit("bucket_floor:"), "trust", F.lit("="), "floor")), when(alone, F.lit("provenance:untrusted_web_alone")),
    )
    port = F.when(F.col("final") == "hard_block", "blocked").when((F.col("final") == "local_only") | alone, "local_only").otherwise("portable")
    long, few = F.length("claim") > MAX_CLAIM, F.coalesce(F.col("n"), F.lit(0)) < 2
    early = long | few
    other = lambda value, instead: F.when(early, instead).otherwise(value)
    return j.select(
        id_col,
        F.when(long, F.lit("hard_block")).when(few, F.lit(DISPOSITION["insufficient_evidence"])).when(alone & (F.col("final") == "allow"), F.lit("local_only")).otherwise(F.col("final")).alias("disposition"),
        F.when(long, F.array(F.lit("claim_too_long"))).when(few, F.array(F.lit("insufficient_evidence"))).otherwise(reasons).alias("reasons"),
        other(F.col("trust"), none).alias("evidence_trust"), other(F.col("taint"), empty).alias("taint"), other(port, F.lit("portable")).alias("portability"),
        other(F.col("duplicate_of"), none).alias("duplicate_of"), other(F.col("redacted"), none).alias("redacted_claim"), F.when(~early & F.col("salvaged"), F.lit("redactable")).otherwise(F.lit("none")).alias("salvageability"),
    )


def _salvaged(private: dict[str, list[str]], replacements: dict[str, str]) -> tuple[Column, Column]:
    """The claim with private terms replaced, null unless that changed it and left none; and whether it did."""
    patterns = list(D.private_patterns(private).values())
    if not patterns or not replacements:
        return F.lit(None).cast("string"), F.lit(False)
    clean = D.replaced(F.col("claim"), private, replacements)
    left = F.lit(False)
    for p in patterns:
        left = left | clean.rlike(p)
    good = (clean != F.col("claim")) & ~left
    return F.when(good, clean), F.coalesce(good, F.lit(False))


def routed(verdicts: DataFrame, order: str = "obs_id", after: int = 0) -> DataFrame:
    """Verdicts with status rejected or pending, and for pending ones the next ids obs_NNN in order."""
    rejected = F.col("disposition") == "hard_block"
    pending = verdicts.where(~rejected)
    numbered = numbered_rows(pending, order, after).withColumn("status", F.lit("pending"))
    named = numbered.withColumn("observation_id", F.concat(F.lit("obs_"), F.lpad(F.col("number").cast("string"), F.greatest(F.lit(3), F.length(F.col("number").cast("string"))), F.lit("0")))).drop("number")
    return named.unionByName(verdicts.where(rejected).withColumn("status", F.lit("rejected")).withColumn("observation_id", F.lit(None).cast("string")))


def numbered_rows(rows: DataFrame, order: str, after: int = 0, parts: int = 256) -> DataFrame:
    """Rows with consecutive ``number`` in the order of a numeric column, which should have no ties, without a global sort:
    rows are numbered within ``parts`` ranges and the ranges' counts, which are few, are added up."""
    cuts = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else None
    part = F.size(F.filter(bounds, lambda c: c < F.col(order))) if cuts else F.lit(0)
    inside = rows.withColumn("part", part).withColumn("inside", F.row_number().over(Window.partitionBy("part").orderBy(order)))
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    return inside.join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("inside") + after).drop("part", "inside", "before")


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, for which there is no built-in function; null if it is under the least that counts."""

    def one(x: str, y: str, low: float) -> float | None:
        total = len(x) + len(y)
        have = counted(x)
        common = sum(min(n, have.get(c, 0)) for c, n in counted(y).items())
        if total and 2 * common / total < low:
            return None
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        return ratio if ratio >= low else None

    counted = lru_cache(50_000)(Counter)
    return pd.Series([one(x or "", y or "", low) for x, y, low in zip(a, b, least, strict=True)], dtype="float64")


def normalized(claim: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(claim)), r"\s+", " ")


#: Rarest signs of a claim that are looked up first.
FIRST_SIGNS = 4


def _signs(text: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    last = F.length(text) - 1
    pairs = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def lost_signs(n: Column, least: Column) -> Column:
    """How many of a text's signs may be missing from a text whose ratio to it is at least ``least``.

    Of texts of n and L characters, M >= least * (n + L) / 2 match in order. A character of the one that does not takes two
    of its signs along, a character of the other that does not comes between two, so 2(n - M) + (L - M) are lost at most; that
    is largest at one of the ends of the lengths L that can reach the ratio at all.
    """
    lost = lambda other: 2 * n + other - 1.5 * least * (n + other)
    return F.floor(F.greatest(lost(n * least / (2 - least)), lost(n * (2 - least) / least)) + 1e-9).cast("int")


def _best_of(pairs: DataFrame, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, claim_id, ratio) of the best text of each x among the candidates (x, claim_id), if it reaches the x's ``least``."""
    both = pairs.join(texts.select("claim_id", "y"), "claim_id").join(wanted.select("x", "least"), "x")
    able = 2 * F.least(F.length("x"), F.length("y")) >= F.col("least") * (F.length("x") + F.length("y")) - 1e-9
    found = both.where(able).withColumn("ratio", similarity_ratio("x", "y", "least")).where("ratio is not null")
    best = F.min(F.struct((-F.col("ratio")).alias("less"), "claim_id")).alias("b")
    return found.groupBy("x").agg(best).select("x", "b.claim_id", (-F.col("b.less")).alias("ratio"))


def fuzzy_duplicates(claims: DataFrame, active: DataFrame, least: float = DUPLICATE_RATIO) -> DataFrame:
    """(obs_id, claim_id, ratio) of the best active claim for each new one; of equal ratios the smallest claim id.

    Equal texts are compared once. A claim that has its equal needs no search. Others look up their rarest pairs of neighbouring
    characters: a few first, which mostly finds a good claim; then as many as a claim better or as good cannot lack all of,
    which for a good one are few again. So every join is on equal keys, and texts are compared that share a rare sign, not all with
    all. A claim with fewer signs than may be lost looks up all texts of the lengths that can reach the ratio.
    """
    texts = active.select("claim_id", normalized(F.col("claim")).alias("y")).where("y is not null").groupBy("y").agg(F.min("claim_id").alias("claim_id"))
    rows = claims.select("obs_id", normalized(F.col("claim")).alias("x"))
    asked = rows.select("x").where("x is not null").distinct()
    equal = asked.join(texts, F.col("x") == F.col("y")).select("x", "claim_id", F.lit(1.0).alias("ratio"))
    wanted = asked.join(equal.select("x"), "x", "left_anti").withColumn("least", F.lit(float(least)))
    listed = texts.select("claim_id", F.explode(_signs(F.col("y"))).alias("sign"))
    often = listed.groupBy("sign").agg(F.count("*").alias("n"))
    signs = wanted.select("x", F.explode(_signs(F.col("x"))).alias("sign")).join(often, "sign", "left")
    place = F.row_number().over(Window.partitionBy("x").orderBy(F.coalesce("n", F.lit(0)), "sign"))
    signs = signs.withColumn("place", place).withColumn("signs", F.count("*").over(Window.partitionBy("x")))
    first = _best_of(signs.where(F.col("place") <= FIRST_SIGNS).join(listed, "sign").select("x", "claim_id").distinct(), texts, wanted)
    known = wanted.join(first.select("x", "ratio"), "x", "left").select("x", F.coalesce("ratio", "least").alias("least")).withColumn("lost", lost_signs(F.length("x"), F.col("least")))
    full = signs.join(known.select("x", "lost"), "x").where(F.col("place") <= F.col("lost") + 1)
    by_sign = full.where(F.col("signs") > F.col("lost")).join(listed, "sign").select("x", "claim_id")
    able = known.join(signs.where("place = 1").select("x", "signs"), "x", "left").where(F.coalesce("signs", F.lit(0)) <= F.col("lost"))
    n = F.length("x")
    lengths = F.sequence(F.ceil(n * F.col("least") / (2 - F.col("least")) - 1e-9), F.floor(n * (2 - F.col("least")) / F.col("least") + 1e-9))
    by_length = able.where(n > 0).select("x", F.explode(lengths).alias("length")).join(texts.select("claim_id", F.length("y").cast("long").alias("length")), "length").select("x", "claim_id")
    best = _best_of(by_sign.union(by_length).distinct(), texts, known)
    return rows.join(best.unionByName(equal), "x").select("obs_id", "claim_id", F.round("ratio", 6).alias("ratio"))


def _in_force(scopes: list[str] | None) -> Column:
    keep = F.col("status") == "active"
    return keep & F.coalesce(F.arrays_overlap("scope", F.array(*[F.lit(s) for s in scopes])), F.lit(False)) if scopes else keep


#: What a claim file holds of an owner: sections of claims, claims of what is not wanted, and overlays (fixed shape).
CLAIM = "struct<claim_id:string,claim:string,type:string,scope:array<string>,confidence:double,status:string>"
CLAIM_FILE = f"owner_id string, stable_core map<string,array<{CLAIM}>>, negative_constraints array<{CLAIM}>, situational_overlays array<struct<overlay_id:string,name:string,traits:array<string>,status:string>>"


def section_claims(claim_files: DataFrame) -> DataFrame:
    """(owner_id, section, place, claim columns): every claim of claim files (``CLAIM_FILE``), ``place`` being its order in the
    file; constraints come after all sections. Null sections and files without claims have no rows."""
    core = claim_files.select("owner_id", F.posexplode("stable_core").alias("a", "name", "items")).select("owner_id", F.concat(F.lit("stable_core."), "name").alias("section"), "a", F.posexplode("items").alias("b", "c"))
    never = claim_files.select("owner_id", F.lit("negative_constraints").alias("section"), F.lit((1 << 31) - 1).alias("a"), F.posexplode("negative_constraints").alias("b", "c"))
    return core.unionByName(never).select("owner_id", "section", F.struct("a", "b").alias("place"), "c.*")


def exported(claim_files: DataFrame, scopes: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(owner_id, claims, overlays) of every claim file: its active claims in the scopes, the ``limit`` surest, of equally sure
    ones the first of the file, and its active overlays in their order. Both are empty where there are none."""
    sure = Window.partitionBy("owner_id").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "place")
    top = section_claims(claim_files).where(_in_force(scopes)).withColumn("r", F.row_number().over(sure)).where(F.col("r") <= limit)
    told = F.array_sort(F.collect_list(F.struct("r", "claim_id", "claim", "type", "scope", "confidence")))
    claims = top.groupBy("owner_id").agg(F.transform(told, lambda x: x.dropFields("r")).alias("claims"))
    worn = F.transform(F.filter("situational_overlays", lambda o: o["status"] == "active"), lambda o: F.struct(o["overlay_id"].alias("overlay_id"), o["name"].alias("name"), F.coalesce(o["traits"], F.array().cast("array<string>")).alias("traits")))
    rows = claim_files.select("owner_id", F.coalesce(worn, F.array().cast("array<struct<overlay_id:string,name:string,traits:array<string>>>")).alias("overlays")).join(claims, "owner_id", "left")
    none = F.array().cast("array<struct<claim_id:string,claim:string,type:string,scope:array<string>,confidence:double>>")
    return rows.select("owner_id", F.coalesce("claims", none).alias("claims"), "overlays")


#: Numbers that words of confidence stand for, and that of anything else (fixed values).
CONFIDENCE, UNSURE = {"low": 0.3, "medium": 0.6, "high": 0.9}, 0.6


def confidence_number(raw: Column) -> Column:
    """A number held to 0..1, or a word's number, without case and blanks; anything else and null are 0.6."""
    word, number = F.lower(F.trim(raw)), raw.try_cast("double")
    of_word = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in CONFIDENCE.items()], F.lit(UNSURE))
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).otherwise(of_word)


def corpus_observations(entries: DataFrame) -> DataFrame:
    """Labelled corpus entries (id, label, rationale, observation) as pending observations with numbered evidence and the
    label that a validation is measured by; a context becomes a tag."""
    o, empty = (lambda c: F.col(f"observation.{c}")), F.lit("")
    one = lambda e, k: F.struct(F.concat("id", F.lit("_ev_"), k.cast("string")).alias("evidence_id"), F.coalesce(e["turn_ref"], F.concat("id", F.lit(":turn-"), k.cast("string"))).alias("turn_ref"), F.coalesce(e["quote"], empty).alias("excerpt"), e["origin_type"].alias("origin_type"), e["provenance_bucket"].alias("bucket"))
    none = F.array().cast("array<struct<evidence_id:string,turn_ref:string,excerpt:string,origin_type:string,bucket:string>>")
    tags = F.when(F.coalesce(o("context"), empty) != "", F.array(o("context"))).otherwise(F.array().cast("array<string>"))
    return entries.select(
        F.col("id").alias("obs_id"), F.coalesce(o("pattern"), empty).alias("claim"), confidence_number(o("confidence")).alias("confidence"), F.lit("pending").alias("status"), F.coalesce(o("source_platform"), empty).alias("platform"),
        o("source_session_id").alias("session_id"), F.coalesce(F.transform(o("evidence"), one), none).alias("evidence"), tags.alias("tags"), "label", F.coalesce("rationale", empty).alias("rationale"),
    )


def active_claims(claims: DataFrame, scopes: list[str] | None = None, limit: int = 20) -> DataFrame:
    """Active claims of the scopes, of all if there are none named, surest first; null confidence counts as 0."""
    return claims.where(_in_force(scopes)).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "claim_id").limit(limit)


#: Words that name nothing (fixed values).
SLUG_STOP = ("a", "an", "the", "for", "and", "or", "to", "of", "in")


def claim_slug(claim: Column) -> Column:
    """The first word of a claim that names something, its a-z and 0-9 only, at most 16; 'claim' if there is none."""
    words = F.transform(F.split(F.trim(claim), r"\s+"), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    named = F.filter(words, lambda w: (w != "") & ~w.isin(list(SLUG_STOP)))
    return F.coalesce(F.substring(F.try_element_at(named, F.lit(1)), 1, 16), F.lit("claim"))


def mint_ids(rows: DataFrame, prefix: str, slug: Column, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Ids prefix_slug_NNN with the first free numbers of each slug; ``existing`` has slug and number of ids in use.

    The k-th new id of a slug takes the k-th number that is not in use. With the numbers in use ascending, u_1 < u_2 < ...,
    u_i - i free ones lie below u_i, so it is k plus the count of those with u_i - i < k: a join on counts of equal gaps, not
    a search number by number.
    """
    numbered = rows.withColumn("slug", slug).withColumn("_k", F.row_number().over(Window.partitionBy("slug").orderBy(order)))
    if existing is None:
        numbered = numbered.withColumn("_n", F.col("_k"))
    else:
        used = existing.select("slug", F.col("number").cast("long").alias("u")).where("u > 0").distinct()
        ranked = used.withColumn("gap", F.col("u") - F.row_number().over(Window.partitionBy("slug").orderBy("u")))
        steps = ranked.groupBy("slug", "gap").agg(F.count("*").alias("c"))
        # one ordered pass a slug: taken ids of smaller gap come before the new id whose rank exceeds the gap
        both = steps.select("slug", F.col("gap").alias("at"), F.lit(0).alias("kind"), "c").unionByName(numbered.select("slug", (F.col("_k") - 1).cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("c")))
        before = both.withColumn("_taken", F.sum("c").over(Window.partitionBy("slug").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
        numbered = numbered.join(before.select("slug", (F.col("at") + 1).cast("int").alias("_k"), "_taken"), ["slug", "_k"]).withColumn("_n", F.col("_k") + F.col("_taken")).drop("_taken")
    shown = F.col("_n").cast("string")
    return numbered.withColumn("minted", F.concat(F.lit(f"{prefix}_"), "slug", F.lit("_"), F.lpad(shown, F.greatest(F.lit(3), F.length(shown)), F.lit("0")))).drop("_k", "_n")


def prompt_block(claims: DataFrame, overlays: DataFrame, scopes: list[str] | None = None, limit: int = 20, title: str = "User working-style passport:") -> str:
    """Active claims as bullets, surest first, and active overlays (name, traits) below them."""
    told = [r["claim"] for r in active_claims(claims, scopes, limit).collect()]
    worn = overlays.where("status = 'active'").select("name", "traits").orderBy("name").collect()
    if not told and not worn:
        return f"{title}\n- (no claims on file yet)"
    lines = [title, *(f"- {c}" for c in told)]
    if worn:
        lines += ["", "Active overlay:", *(f"- {r['name']}: {', '.join(r['traits'] or [])}" for r in worn)]
    return "\n".join(lines)


def overall(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """One row: accuracy, and the mean F1 of all classes."""
    hits = rows.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
    return hits.crossJoin(class_scores(rows, truth, guess).agg(F.avg("f1").alias("macro_f1")))


def confusion(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Per class precision, recall and F1 (0 where undefined), from one aggregate over the confusion matrix."""
    c = confusion(rows, truth, guess)
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    by_truth = c.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_guess = c.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("guessed"))
    j = by_truth.join(by_guess, "label", "full_outer").na.fill(0, ["support", "tp", "guessed"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    return j.select("label", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * F.col("tp"), F.col("support") + F.col("guessed")).alias("f1"))
