"""Packing rows and texts into budgets."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.fold import Step, fields, streamed

#: Units of headroom below which a text that fits is called tight (fixed value).
MARGIN = 500


def newest_within(rows: DataFrame, keys: list[str], order: list[Column], size: str, budget: int) -> DataFrame:
    """Newest rows of each key while the running total fits; stops at the first that does not."""
    run = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", run).where(F.col("running") <= budget)


def first_batch(rows: DataFrame, order: list[Column], size: str, budget: int) -> DataFrame:
    """Rows in order up to the budget, but always the first.

    A row costs at least one, so no more than ``budget`` + 1 rows can matter: a top-k takes those from all rows, and only
    they meet in the running total.
    """
    cost = F.greatest(F.col(size), F.lit(1))
    near = rows.orderBy(*order).limit(budget + 1)
    w = Window.orderBy(*order)
    placed = near.withColumn("running", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(w))
    return placed.where((F.col("running") <= budget) | (F.col("place") == 1)).drop("place")


def greedy_chunks(rows: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """Chunk numbers per key: a row that would overflow the open chunk opens the next; a large row is its own chunk."""
    n = len(keys)

    def start() -> Step:
        used, chunk = [0], [-1]

        def step(row: tuple):
            cost = row[n + 1]
            if chunk[0] < 0 or used[0] + cost > budget:
                chunk[0] += 1
                used[0] = 0
            used[0] += cost
            yield (*row, chunk[0])

        return step

    narrow = rows.select(*keys, order, F.col(size).cast("long").alias(size))
    return streamed(narrow, keys, [order], start, fields(narrow, narrow.columns, chunk=T.IntegerType()))


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def _units_between(text: Column, start: int, count: Column | None = None) -> Column:
    """Text from unit ``start`` (from 0) on; half of a pair at a cut reads as a replacement character."""
    raw = F.encode(text, "UTF-16BE")
    rest = F.substr(raw, F.lit(2 * start + 1)) if count is None else F.substr(raw, F.lit(2 * start + 1), 2 * count)
    return F.decode(rest, "UTF-16BE")


_HEADING = r"(?m)^#{1,6}\s+(.+)$"


def head_cut(text: Column, budget: int) -> Column:
    """Struct of the kept head (``budget`` UTF-16 units), the units dropped, and what is lost: headings whose section
    reaches past the cut, then ids named after it, each once."""
    units = utf16_units(text)
    head, tail = _units_between(text, 0, F.lit(budget)), _units_between(text, budget)
    headings = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_HEADING), F.lit(1)), lambda h: F.trim(h))
    broken = ~head.endswith("\n")  # the cut is inside a line, which belongs to the head's sections
    line = F.when(broken, F.regexp_extract(tail, r"^[^\n]*", 0)).otherwise(F.lit(""))
    rest = F.when(broken, F.regexp_replace(tail, r"^[^\n]*", "")).otherwise(tail)
    open_one = F.when(broken | ~rest.rlike(r"^#{1,6}\s+."), F.slice(F.reverse(headings(F.concat(head, line))), 1, 1)).otherwise(F.array().cast("array<string>"))
    ids = F.regexp_extract_all(tail, F.lit(r"(?i)\b(?:memory_id|id)[:=]\s*([a-f0-9]{8,64})\b"), F.lit(1))
    none = F.array().cast("array<string>")
    cut = units > budget
    return F.struct(
        F.when(cut, head).otherwise(text).alias("head"), F.when(cut, units - budget).otherwise(F.lit(0)).alias("dropped"),
        F.when(cut, F.array_distinct(F.concat(open_one, headings(rest), ids))).otherwise(none).alias("lost"),
    )


def capped(text: Column, budget: int, hint: str) -> Column:
    """The text, or its head with a mark that says what went and where to find it."""
    units = utf16_units(text)
    mark = F.concat(F.lit("\n\n\u2026[truncated "), (units - budget).cast("string"), F.lit(" of "), units.cast("string"), F.lit(f" chars \u2014 top kept; {hint}]\u2026\n"))
    return F.when(units <= budget, text).otherwise(F.concat(_units_between(text, 0, F.lit(budget)), mark))


def boundary_offset(text: Column, marker: str = "BOOT BOUNDARY") -> Column:
    """UTF-16 offset of the first heading line that holds the marker, or null."""
    before = F.regexp_extract(text, r"(?s)^(?:(?![ \t]*#[^\n]*\Q" + marker + r"\E)[^\n]*\n)*", 0)
    has = text.rlike(r"(?m)^[ \t]*#[^\n]*\Q" + marker + r"\E")
    return F.when(has, utf16_units(before))


def write_verdict(text: Column, budget: int, lane: Column, margin: int = MARGIN) -> Column:
    """Struct of status, units dropped, and spare units of a text that a budget will cap.

    ok: it fits; tight: a lane that fits with less than the margin; bound: a lane over budget on purpose, its boundary
    within the budget; lies: a lane whose boundary lies past the cut; cut: over budget without saying so. ``spare`` is
    the headroom, or for bound what is left below the budget after the boundary, for lies how far it is past it.
    """
    units, at = utf16_units(text), boundary_offset(text)
    over = units > budget
    declared = lane & at.isNotNull()
    status = (
        F.when(~over & lane & (budget - units < margin), F.lit("tight")).when(~over, F.lit("ok"))
        .when(declared & (at <= budget), F.lit("bound")).when(declared, F.lit("lies")).otherwise(F.lit("cut"))
    )
    spare = F.when(~over, budget - units).when(declared & (at <= budget), budget - at).when(declared, at - budget)
    return F.struct(status.alias("status"), F.when(over, units - budget).otherwise(F.lit(0)).alias("dropped"), spare.alias("spare"))


def units(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


#: Words of a section's name by which it is kept first or second (fixed values).
FIRST, SECOND = ("built", "shipped", "changed"), ("blocked", "pending", "open", "next")


class _Brief:
    """Sections that are kept whole or in part, and the names of what was lost, which the last line states."""

    def __init__(self, budget: int):
        self.budget, self.kept, self.lost = budget, [], []

    def text(self, more: list[str] = (), lost: list[str] | None = None) -> str:
        lost = self.lost if lost is None else lost
        return "\n\n".join([*(body for _, body in self.kept), *more, f"DROPPED: {', '.join(lost) or 'nothing'}"])

    def fits(self, *args) -> bool:
        return units(self.text(*args)) <= self.budget

    def add(self, name: str, body: str) -> None:
        if self.fits([body]):
            self.kept.append((name, body))
            return
        part = f"{name} (trimmed)"
        some = self._longest_start(body, [*self.lost, part])
        if some is not None:
            self.kept.append((name, some))
        self.lost.append(name if some is None else part)

    def _longest_start(self, body: str, lost: list[str]) -> str | None:
        """The most whole lines from the start that fit; None if that is no more than headings."""
        taken: list[str] = []
        for line in body.splitlines():
            longer = "\n".join([*taken, line]).strip()
            if longer and not self.fits([longer], lost):
                break
            if longer:
                taken.append(line)
        return "\n".join(taken).strip() if any(map(_says_something, taken)) else None

    def shrink(self) -> None:
        """Take lines from the last section until the statement of losses fits too."""
        while self.kept and not self.fits():
            name, body = self.kept.pop()
            part, own = f"{name} (trimmed)", body.splitlines()
            last = max((k for k, line in enumerate(own) if _says_something(line)), default=None)
            known = name in self.lost or part in self.lost
            rest = own[:last] + own[last + 1 :] if last is not None else []
            if any(map(_says_something, rest)):
                self.kept.append((name, "\n".join(rest).strip()))
                if not known:
                    self.lost.append(part)
            elif last is not None and part in self.lost:
                self.lost[self.lost.index(part)] = name
            elif not known:
                self.lost.append(name)


def _says_something(line: str) -> bool:
    return bool(line.strip()) and not line.lstrip().startswith("#")


def pack_sections(text: str, budget: int) -> str:
    """Whole lines of a markdown brief within a budget of UTF-16 units, most needed sections first, and a last line that
    names every section that was dropped or trimmed. Raises if not even that line fits."""
    heads = list(re.finditer(r"(?m)^#{1,3}\s+(.+?)\s*$", text))
    ends = [h.start() for h in heads[1:]] + [len(text)]
    sections = [(h.group(1).strip(), text[h.start() : end].strip()) for h, end in zip(heads, ends, strict=True)] if heads else [("narrative", text.strip())]
    if heads and text[: heads[0].start()].strip():
        sections.insert(0, ("preamble", text[: heads[0].start()].strip()))

    def weight(section: tuple[str, str]) -> int:
        name = section[0].lower()
        if name == "preamble" or any(w in name for w in FIRST):
            return 0
        return 1 if any(w in name for w in SECOND) else 2

    brief = _Brief(budget)
    for name, body in sorted(sections, key=weight):
        brief.add(name, body)
    brief.shrink()
    if not brief.fits():
        raise ValueError("the budget does not hold the names of what was dropped")
    return brief.text()


def packed(text: Column, budget: int) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_sections(t or "", budget))

    return run(text)


def halve_until(call: Callable[[object], object], value, too_large: Callable[[Exception], bool], least: int = 500, tail: bool = False):
    """(result, what was given): ``call`` of a sliceable value, halved on every error that says it is too large, not below
    ``least``. Keeps the start, or with ``tail`` the end, which of chronological texts is the newest."""
    while True:
        try:
            return call(value), value
        except Exception as e:
            if not too_large(e) or len(value) <= least:
                raise
            size = max(least, len(value) // 2)
            value = value[-size:] if tail else value[:size]
