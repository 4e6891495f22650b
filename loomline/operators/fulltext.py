"""Full-text search over Unicode words: BM25 in one pass over texts, or from a versioned inverted index.

Scores are those of the common embedded full-text engine: with f the weighted occurrences of a phrase in a document, D the
document's words over all columns, N documents, n of them with the phrase,

    score = sum over phrases of idf * f * (K1 + 1) / (f + K1 * (1 - B + B * D / mean D)),   idf = max(ln((N - n + 0.5) / (n + 0.5)), 1e-6)

and more is better. A query is a sequence of phrases; a phrase is one or more words next to each other, and with ``prefix`` its
last word may go on.

The index is a folder of versions. A version holds the postings (term, column, places, words of the document) of the documents
that it adds or replaces, and the (document, version) pairs that it makes void; its commit carries how many documents and words it
adds. So a change costs what it changes; reading looks up a query's terms in few buckets of all versions, leaves out void
postings and adds up the commits' numbers. ``compact`` makes all live versions one, ``vacuum`` deletes what it replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.porter import stem
from loomline.functions.words import APART, count_folded, count_phrase, count_words, folded_text, words_of
from loomline.sources.commits import commit, commits, remove

#: Standard published constants of BM25, and the least weight of a phrase that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@lru_cache(1_000_000)
def _stem(word: str) -> str:
    return stem(word)


@F.pandas_udf(T.StringType())
def stemmed_words(flat: pd.Series) -> pd.Series:
    """Folded words between blanks by their Porter stems, for which there is no built-in function."""
    return flat.map(lambda t: " ".join([_stem(w) if w else w for w in t.split(" ")]) if t else t)


def _idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def _part(f: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    return _idf(n, df) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))


def _queried(query: Sequence[str], porter: bool) -> list[list[str]]:
    return [[stem(w) if porter else w for w in words_of(t)] for t in query]


def bm25(docs: DataFrame, query: Sequence[str], id_col: str, columns: dict[str, float], prefix: bool = False, porter: bool = False) -> DataFrame:
    """(id, score, matched) over all documents without an index; columns carry their weights.

    ``matched`` counts the phrases that a document has; ``porter`` compares stems. A text is folded once, then its words and
    phrases are counted by literal search; what both the statistics and the scores need of a document is a few numbers, and those
    are what is shuffled, once for both.
    """
    flat = [folded_text(F.col(c), APART) for c in columns]
    rows = docs.select(F.col(id_col).alias("id"), *[(stemmed_words(t) if porter else t).alias(c) for c, t in zip(columns, flat, strict=True)])
    phrases = _queried(query, porter)
    length = sum((count_folded(F.col(c), APART) for c in columns), F.lit(0))
    tf = [sum((F.lit(float(w)) * count_phrase(F.col(c), p, prefix) for c, w in columns.items()), F.lit(0.0)).alias(f"tf{k}") for k, p in enumerate(phrases)]
    names = [f"tf{k}" for k in range(len(phrases))]
    counted = rows.select("id", length.alias("length"), *tf).repartition("id")
    stats = counted.agg(F.count(F.struct("id")).alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(c) > 0).cast("int")).alias(f"df{k}") for k, c in enumerate(names)])
    # the test needs both sides, else it would move below the exchange, which then would not serve both
    hits = counted.crossJoin(F.broadcast(stats)).where(F.greatest(F.lit(0.0), F.lit(0.0), *names) * F.col("n") > 0)
    score, matched = F.lit(0.0), F.lit(0)
    for k, c in enumerate(names):
        score = score + _part(F.col(c), F.col(f"df{k}"), F.col("n"), F.col("length"), F.col("mean"))
        matched = matched + (F.col(c) > 0).cast("int")
    return hits.select("id", score.alias("score"), matched.alias("matched"))


# --- the index ---


def _bucket(term: Column, buckets: int) -> Column:
    """By the first two characters, so that a prefix of two or more is in one bucket."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(buckets)).cast("int")


def postings(docs: DataFrame, id_col: str, columns: Sequence[str], porter: bool = False) -> DataFrame:
    """(id, col, term, at, words): places of each folded term in a column, and the document's words over all columns."""
    flat = [folded_text(F.col(f"`{c}`")) for c in columns]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *[(stemmed_words(t) if porter else t).alias(f"w{k}") for k, t in enumerate(flat)])
    total = sum((count_folded(F.col(f"w{k}")) for k in range(len(columns))), F.lit(0)).cast("long")
    counted = rows.select("id", total.alias("words"), *[F.col(f"w{k}") for k in range(len(columns))])
    schema = T.StructType([counted.schema["id"], counted.schema["words"], *T.StructType.fromDDL("col int, term string, at array<int>").fields])
    return counted.mapInArrow(_placed, schema)


#: Documents whose postings are made at a time.
PLACED_ROWS = 256


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents (id, words, folded words of each column): a document's words meet in its row, so none is shuffled."""
    for batch in batches:
        for a in range(0, batch.num_rows, PLACED_ROWS):
            part = batch.slice(a, PLACED_ROWS)
            row, col, term, ends, at = [], [], [], [0], []
            for k in range(part.num_columns - 2):
                for i, flat in enumerate(part.column(k + 2).to_pylist()):
                    places: dict[str, list[int]] = {}
                    for place, word in enumerate(flat.split(" ") if flat else ()):
                        places.setdefault(word, []).append(place)
                    row += [i] * len(places)
                    col += [k] * len(places)
                    term += places
                    for own in places.values():
                        at += own
                        ends.append(len(at))
            taken = pa.array(row, pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(taken), part.column(1).take(taken), pa.array(col, pa.int32()), pa.array(term, pa.string()), lists], names=["id", "words", "col", "term", "at"])


def _state(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number of the last commit and the commits since the last compaction."""
    every = commits(spark, f"{path}/commits")
    base = max((c["base"] for c in every.values()), default=0)
    return max(every, default=0), [c for n, c in sorted(every.items()) if n >= base]


def _folder(path: str, data: str) -> str:
    return f"{path}/data/data={data}"


def _part_of(spark: SparkSession, path: str, live: list[dict], part: str, schema: str) -> DataFrame:
    folders = [f"{_folder(path, c['data'])}/part={part}" for c in live if c[part]]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).drop("data", "part")


def _schemas(id_type: str) -> dict[str, str]:
    return {
        "postings": f"id {id_type}, words long, col int, term string, at array<int>, version int, bucket int",
        "documents": f"id {id_type}, words long, version int",
        "void": f"id {id_type}, words long, version int",
    }


def _live_documents(spark: SparkSession, path: str, live: list[dict], schemas: dict[str, str]) -> DataFrame:
    held = _part_of(spark, path, live, "documents", schemas["documents"])
    return held.join(_part_of(spark, path, live, "void", schemas["void"]), ["id", "version"], "left_anti")


def _write_postings(rows: DataFrame, buckets: int, folder: str) -> None:
    """In as many files a bucket as there are shuffle partitions for each; a frequent term is in all of its bucket's."""
    files = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // buckets)
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("term", "id"), F.lit(files)))
    dealt.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{folder}/part=postings")


def change_index(
    spark: SparkSession, path: str, put: DataFrame | None = None, drop: DataFrame | None = None, id_col: str = "id", columns: Sequence[str] = ("text",), porter: bool = False, buckets: int = 64
) -> int:
    """One commit that adds or replaces the documents ``put`` and removes those of the ids ``drop``; returns its number.

    Ids of ``put`` must be distinct and not null; ids of ``drop`` that are not there, or are in ``put`` too, change nothing more. Columns, stems and
    buckets are those of the first commit. A second writer of the same number gets CommitConflict, and its data is never read.
    """
    last, live = _state(spark, path)
    if live:
        columns, porter, buckets, id_type = live[0]["columns"], live[0]["porter"], live[0]["buckets"], live[0]["id_type"]
    else:
        given = put if put is not None else drop
        id_type = given.schema[id_col].dataType.simpleString()
    schemas, number, data = _schemas(id_type), last + 1, uuid.uuid4().hex
    folder = _folder(path, data)
    body = {"base": live[0]["base"] if live else number, "data": data, "columns": list(columns), "porter": porter, "buckets": buckets, "id_type": id_type, "rows": 0, "words": 0, "postings": False, "documents": False, "void": False}
    ids = drop.select(F.col(f"`{id_col}`").cast(id_type).alias("id")) if drop is not None else spark.createDataFrame([], f"id {id_type}")
    try:
        if put is not None:
            total = sum((count_words(F.col(f"`{c}`")) for c in columns), F.lit(0)).cast("long")
            put.select(F.col(f"`{id_col}`").alias("id"), total.alias("words"), F.lit(number).alias("version")).write.parquet(f"{folder}/part=documents")
            added = spark.read.schema(schemas["documents"]).parquet(f"{folder}/part=documents")
            seen = added.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("words").alias("words")).first()
            if seen["n"] != seen["ids"]:
                raise ValueError("ids of put must be distinct and not null")
            found = postings(put, id_col, columns, porter).withColumns({"version": F.lit(number), "bucket": _bucket(F.col("term"), buckets)})
            _write_postings(found, buckets, folder)
            body |= {"rows": seen["n"], "words": seen["words"] or 0, "postings": seen["words"] is not None and seen["words"] > 0, "documents": True}
            ids = ids.unionByName(added.select("id"))
        if live:
            void = _live_documents(spark, path, live, schemas).join(ids.distinct(), "id", "left_semi").select("id", "words", "version")
            void.write.parquet(f"{folder}/part=void")
            gone = spark.read.schema(schemas["void"]).parquet(f"{folder}/part=void").agg(F.count("*").alias("n"), F.sum("words").alias("words")).first()
            body |= {"rows": body["rows"] - gone["n"], "words": body["words"] - (gone["words"] or 0), "void": True}
        commit(spark, f"{path}/commits", number, body)
    except Exception:
        remove(spark, folder)
        raise
    return number


def compact(spark: SparkSession, path: str) -> int:
    """One commit whose version holds all live documents; earlier versions are read no more, and ``vacuum`` may delete them."""
    last, live = _state(spark, path)
    first, number, data = live[0], last + 1, uuid.uuid4().hex
    schemas, folder = _schemas(first["id_type"]), _folder(path, data)
    void = _part_of(spark, path, live, "void", schemas["void"]).select("id", "version")
    kept = _part_of(spark, path, live, "postings", schemas["postings"]).join(void, ["id", "version"], "left_anti").withColumn("version", F.lit(number))
    _write_postings(kept, first["buckets"], folder)
    _live_documents(spark, path, live, schemas).withColumn("version", F.lit(number)).select("id", "words", "version").write.parquet(f"{folder}/part=documents")
    total = {k: sum(c[k] for c in live) for k in ("rows", "words")}
    commit(spark, f"{path}/commits", number, first | total | {"base": number, "data": data, "postings": total["words"] > 0, "documents": True, "void": False})
    return number


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the data of versions before the last compaction, and commits of theirs; returns how many. Readers of them fail."""
    every = commits(spark, f"{path}/commits")
    base = max((c["base"] for c in every.values()), default=0)
    old = {n: c for n, c in every.items() if n < base}
    for n, c in old.items():
        remove(spark, f"{path}/commits/{n:08d}.json")
        remove(spark, _folder(path, c["data"]))
    return len(old)


def indexed(spark: SparkSession, path: str, query: Sequence[str], weights: dict[str, float] | None = None, prefix: bool = False) -> DataFrame:
    """(id, score, matched) as ``bm25`` gives them, from the last commit of an index; a column without a weight has 1."""
    _, live = _state(spark, path)
    if not live:
        raise ValueError(f"no index at {path}")
    first, schemas = live[0], _schemas(live[0]["id_type"])
    phrases = _queried(query, first["porter"])
    asked = [(k, i, w, prefix and i == len(p) - 1) for k, p in enumerate(phrases) for i, w in enumerate(p)]
    held = _part_of(spark, path, live, "postings", schemas["postings"])
    # buckets of whole terms and of prefixes of two characters or more; a shorter prefix reads all
    if asked and all(len(w) > 1 or not open_ for _, _, w, open_ in asked):
        rows = spark.createDataFrame([(w,) for _, _, w, _ in asked], "term string").select(_bucket(F.col("term"), first["buckets"]).alias("b")).distinct()
        held = held.where(F.col("bucket").isin([r["b"] for r in rows.collect()]))
    hit = lambda w, open_: (F.col("term") >= w) & F.col("term").startswith(w) if open_ else F.col("term") == w
    held = held.where(reduce(lambda a, b: a | b, [hit(w, o) for _, _, w, o in asked], F.lit(False)))
    void = _part_of(spark, path, live, "void", schemas["void"]).select("id", "version")
    held = held.join(void, ["id", "version"], "left_anti")
    tags = [F.when(hit(w, o), F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("i"))) for k, i, w, o in asked]
    tagged = held.withColumn("tag", F.explode(F.array_compact(F.array(*tags)) if tags else F.array().cast("array<struct<phrase:int,i:int>>"))).select("id", "words", "col", "at", "tag.*")
    weight = F.element_at(F.array(*[F.lit(float((weights or {}).get(c, 1.0))) for c in first["columns"]]), F.col("col") + 1)
    if all(len(p) <= 1 for p in phrases):
        freq = tagged.groupBy("id", "words", "phrase").agg(F.sum(F.size("at") * weight).alias("f"))
    else:  # a phrase occurs where all its words, each moved back by its place in it, meet
        starts = tagged.select("id", "words", "col", "phrase", "i", F.explode("at").alias("place")).groupBy("id", "words", "col", "phrase", (F.col("place") - F.col("i")).alias("start"))
        sizes = F.element_at(F.array(*[F.lit(len(p)) for p in phrases]), F.col("phrase") + 1)
        whole = starts.agg(F.countDistinct("i").alias("n")).where(F.col("n") == sizes)
        freq = whole.groupBy("id", "words", "phrase").agg(F.sum(weight).alias("f"))
    n, total = sum(c["rows"] for c in live), sum(c["words"] for c in live)
    freq = freq.where("f > 0").repartition("id")
    df = freq.groupBy("phrase").agg(F.count("*").alias("df"))  # a row a phrase
    score = _part(F.col("f"), F.col("df"), F.lit(n), F.col("words"), F.lit(total / n if n else 1.0))
    return freq.join(F.broadcast(df), "phrase").groupBy("id").agg(F.sum(score).alias("score"), F.count("*").cast("int").alias("matched"))
