"""Full-text search, line search, markdown bullets, entity pages and topics."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.porter import stem
from loomline.functions.text import page_slug
from loomline.functions.words import words_of
from loomline.operators.fulltext import bm25, change_index
from loomline.sources.commits import remove


def write_index(docs: DataFrame, id_col: str, columns: Sequence[str], path: str, mode: str = "overwrite", porter: bool = False, buckets: int = 64) -> None:
    """A full-text index of documents: ``overwrite`` builds it anew, ``append`` adds documents or replaces those of equal id."""
    spark = docs.sparkSession
    if mode == "overwrite":
        remove(spark, path)
    change_index(spark, path, docs, id_col=id_col, columns=list(columns), porter=porter, buckets=buckets)


def relaxed(hits: DataFrame, n_terms: int, least: int = 3) -> DataFrame:
    """Documents with all terms; if those are fewer than ``least``, documents with any."""
    # a hit's score is above zero; asking for it makes the count need the same columns as the hits, so that one exchange serves both
    full = hits.agg(F.sum(((F.col("matched") == n_terms) & (F.col("score") > 0)).cast("int")).alias("full"))
    return hits.crossJoin(F.broadcast(full)).where((F.col("matched") == n_terms) | (F.col("full") < least)).drop("full")


def memory_search(records: DataFrame, query: Sequence[str], since: str | None = None, entity: str | None = None, limit: int = 8) -> DataFrame:
    """The best records (id, date, text, title, entities) for a query, all of whose terms they hold, with score.

    Filters by date (unknown dates pass) and entity come after the statistics, as those belong to the whole store; ties go
    to the later date, then the larger id.
    """
    docs = records.select("id", "text", "title", F.array_join("entities", " ").alias("names"))
    hits = bm25(docs, query, "id", {"text": 8.0, "title": 2.0, "names": 3.0}).where(F.col("matched") == len(query))
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("date").isNull() | (F.col("date") >= since))
    if entity is not None:
        keep = keep & F.coalesce(F.array_contains("entities", entity), F.lit(False))
    found = records.where(keep).join(hits, "id")
    return found.orderBy(F.col("score").desc(), F.coalesce("date", F.lit("0000-00-00")).desc(), F.col("id").desc()).limit(limit)


def snippet(text: str, query: Sequence[str], size: int = 12, marks: tuple[str, str] = (">>", "<<"), more: str = " \u2026 ") -> str:
    """The ``size`` words of a text, from the first best place, that hold most of the stems that begin with a query term."""
    words = (text or "").split()
    wanted = [stem(w) for t in query for w in words_of(t)]
    clean = [stem("".join(words_of(w))) for w in words]
    hit = [next((t for t in wanted if c.startswith(t)), None) for c in clean]
    starts = range(max(1, len(words) - size + 1))
    best = max(starts, key=lambda a: (len({h for h in hit[a : a + size] if h}), -a), default=0)
    part = [f"{marks[0]}{w}{marks[1]}" if h else w for w, h in zip(words[best : best + size], hit[best : best + size], strict=True)]
    return (more.lstrip() if best else "") + " ".join(part) + (more.rstrip() if best + size < len(words) else "")


def file_search(files: DataFrame, query: Sequence[str], id_col: str = "path", limit: int = 20, least: int = 3, columns: dict[str, float] | None = None, body: str = "content") -> DataFrame:
    """Best files for a query of prefixes over stems: name, path and content by weight 8, 4 and 1; files with all terms, or
    with any if those are fewer than ``least``; with score (two decimals) and a snippet of the content."""
    columns = columns or {"name": 8.0, "path": 4.0, "content": 1.0}
    hits = relaxed(bm25(files, query, id_col, columns, prefix=True, porter=True), len(query), least)
    top = hits.orderBy(F.col("score").desc(), "id").limit(limit)

    @F.pandas_udf(T.StringType())
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, query))

    found = files.select(F.col(id_col).alias("id"), F.col(body).alias("body")).join(F.broadcast(top), "id")
    return found.select(F.col("id").alias(id_col), F.round("score", 2).alias("score"), "matched", shown("body").alias("snippet"))


def grep_lines(docs: DataFrame, needle: str, id_col: str, text_col: str, context: int = 1, most: int = 12) -> DataFrame:
    """Lines of each document that hold the needle, without case, with neighbours; at most ``most`` lines a document.

    Line numbers of hits are widened inside the row, so lines of one document are never shuffled.
    """
    lines = F.split(F.col(text_col), "\n")
    hits = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.contains(F.lower(F.element_at("lines", i)), F.lit(needle.lower())))
    wide = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(i - context, F.lit(1)), F.least(i + context, F.size("lines")))))))
    rows = docs.where(F.contains(F.lower(F.col(text_col)), F.lit(needle.lower()))).select(F.col(id_col).alias("id"), lines.alias("lines"))
    return rows.select("id", "lines", F.explode(F.slice(wide, 1, most)).alias("line_no")).select("id", "line_no", F.element_at("lines", F.col("line_no")).alias("line"))


#: A bullet: a kind, how sure it is, and what it says, in which @ marks entities (fixed values).
BULLET = r"^\s*-\s*([A-Za-z_][A-Za-z0-9_-]*)(?:\s*c=(\d+(?:\.\d+)?))?\s+(.+?)\s*$"
HEADING, ENTITY, DATE = r"^#{1,6}\s+(.*)", r"@([A-Za-z0-9_.-]+)", r"(\d{4}-\d{2}-\d{2})"


def markdown_bullets(files: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """(id, line_no from 1, heading, kind, confidence, text, entities, date): bullets with the last heading above them.

    The marks of entities go from the text; the date is the first in the path, if one is given.
    """
    date = F.nullif(F.regexp_extract(path_col, DATE, 1), F.lit("")) if path_col else F.lit(None).cast("string")
    lines = files.select(F.col(id_col).alias("id"), date.alias("date"), F.posexplode(F.split(text_col, "\r?\n")).alias("at", "line"))
    heading = F.when(F.col("line").rlike(HEADING), F.trim(F.regexp_extract("line", HEADING, 1)))
    up = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("heading", F.last(heading, ignorenulls=True).over(up)).where(F.col("line").rlike(BULLET))
    text = F.regexp_extract("line", BULLET, 3)
    return rows.select(
        "id", (F.col("at") + 1).alias("line_no"), "heading", F.lower(F.regexp_extract("line", BULLET, 1)).alias("kind"),
        F.nullif(F.regexp_extract("line", BULLET, 2), F.lit("")).cast("double").alias("confidence"),
        F.regexp_replace(text, ENTITY, "$1").alias("text"), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)).alias("entities"), "date",
    )


def of_entity(records: DataFrame, entities: DataFrame, id_col: str = "id") -> DataFrame:
    """Records that name one of the entities: a semi join on the unnested names."""
    named = records.select(F.col(id_col), F.explode("entities").alias("entity")).join(entities.select("entity").distinct(), "entity", "left_semi").select(id_col).distinct()
    return records.join(named, id_col, "left_semi")


def entity_pages(records: DataFrame, most: int = 10) -> DataFrame:
    """Per entity a page of its newest bullets; records have id, date, text, entities."""
    rows = records.select(F.explode("entities").alias("entity"), "date", "id", "text")
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.col("date").desc(), F.col("id").desc()))
    top = rows.withColumn("place", place).where(F.col("place") <= most)
    bullets = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: F.concat(F.lit("- "), x["text"]))
    return top.groupBy("entity").agg(F.count("*").alias("bullets"), F.array_join(bullets, "\n").alias("page"))


#: Pages whose names are broadcast; more are matched in blocks, each a pass over the texts.
MAX_PAGES = 200_000


def topic_matches(docs: DataFrame, pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, slug): documents that name a page as words of their own, by its slug, its slug with spaces or an alias.

    ``pages`` has section, slug and aliases (array or null). All names go into one automaton that reads each text once,
    whatever their number; texts are never shuffled.
    """
    names = pages.select("section", "slug", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).distinct()
    blocks = max(1, -(-names.count() // MAX_PAGES))
    out = None
    for k in range(blocks):
        block = [(r["section"], r["slug"], r["aliases"]) for r in names.where(F.pmod(F.xxhash64("section", "slug"), F.lit(blocks)) == k).collect()]
        found = _topic_block(docs, block, id_col, text_col)
        out = found if out is None else out.unionAll(found)
    return out


def _topic_block(docs: DataFrame, block: list[tuple[str, str, list[str]]], id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, targets = ahocorasick.Automaton(), {}
        for section, slug, aliases in shared.value:
            for name in {slug, slug.replace("-", " "), *(a.lower() for a in aliases)} - {""}:
                targets.setdefault(name, []).append((section, slug))
        for name in targets:
            automaton.add_word(name, name)
        if targets:
            automaton.make_automaton()
        word = lambda c: c.isalnum() or c == "_"

        def bounded(text: str, start: int, end: int) -> bool:
            """Whether a word begins or ends at both ends of the place."""
            first = start == 0 or word(text[start - 1]) != word(text[start])
            return (first if start else word(text[0])) and (word(text[end - 1]) != word(text[end]) if end < len(text) else word(text[end - 1]))

        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = (text.as_py() or "").lower()
                if targets and text:
                    hits = {name for end, name in automaton.iter(text) if bounded(text, end + 1 - len(name), end + 1)}
                    rows += [(i, *t) for t in sorted({t for name in hits for t in targets[name]})]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))], names=["id", "section", "slug"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, section string, slug string")


def cluster(memories: DataFrame, pages: DataFrame, flush_marker: str = "auto_capture_flush", id_col: str = "memory_id") -> DataFrame:
    """(id, section, slug) of every topic of a memory: its projects, and the pages that its text, facts, decisions, writer or
    the writer's other names mention. Memories that hold nothing but flush markers, or match nothing, are left out.

    ``memories`` has id, summary, key_facts, projects, decisions and writer (array of names).
    """
    empty = F.array().cast("array<string>")
    facts = F.filter(F.coalesce("key_facts", empty), lambda f: f != flush_marker)
    rows = memories.where((F.size(F.coalesce("key_facts", empty)) == 0) | (F.size(facts) > 0))
    text = F.concat_ws(" ", F.substring(F.coalesce("summary", F.lit("")), 1, 4000), F.array_join(facts, " "), F.array_join(F.coalesce("decisions", empty), " "), F.array_join(F.coalesce("writer", empty), " "))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.lit("projects").alias("section"), F.explode("projects").alias("p")).where("p is not null and p != ''")
    return own.select("id", "section", page_slug(F.col("p")).alias("slug")).union(topic_matches(rows.select(id_col, text.alias("haystack")), pages, id_col, "haystack")).distinct()
