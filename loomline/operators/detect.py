"""Findings of named detectors with their places: a registry that configuration narrows and overrides, private terms.

Counting and testing stay JVM expressions (``functions.text``). Places need positions, for which there is no built-in
function, so ``findings`` runs the same patterns in Arrow batches, over texts that can hold anything only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import patterns as P

#: Kinds of private terms with their detectors (fixed values).
PRIVATE = {
    "clients": "private_client_term", "projects": "private_project_term", "employer_internal_domains": "private_internal_domain",
    "repos": "private_repo_name", "workspaces": "private_workspace_name", "family_names": "private_family_name",
}
KEEP = 4


@dataclass(frozen=True)
class Detector:
    name: str
    category: str
    severity: str
    pattern: str
    plain: bool = False  # whether a finding may be shown as it is


def private_patterns(terms: dict[str, list[str]]) -> dict[str, str]:
    """A pattern for each kind of private terms that has any: a term as a word of its own, without case."""
    quoted = lambda t: re.sub(r"([^\w\s])", r"\\\1", t.strip())
    return {PRIVATE.get(kind, kind): r"(?i)(?<!\w)(?:" + "|".join(map(quoted, own)) + r")(?!\w)" for kind, words in terms.items() if (own := [t for t in words if t and t.strip()])}


def replaced(text: Column, terms: dict[str, list[str]], replacements: dict[str, str]) -> Column:
    """Text with private terms replaced by what stands for them; terms without a replacement stay."""
    for kind in PRIVATE:
        for term in terms.get(kind, []):
            if term.strip() and replacements.get(term):
                text = F.regexp_replace(text, "(?U)" + private_patterns({kind: [term]})[PRIVATE[kind]], replacements[term].replace("\\", "\\\\").replace("$", "\\$"))
    return text


def registry(enabled: Sequence[str] = (), severities: dict[str, str] | None = None, private: dict[str, list[str]] | None = None) -> list[Detector]:
    """All detectors, or the enabled ones, with severities overridden."""
    every = [Detector(name, "secret", "hard_block", p) for name, p in P.SECRET_DETECTORS]
    every += [Detector(name, category, severity, p) for name, category, severity, p in P.PII]
    every += [Detector(name, "private_dict", "review_required", p, True) for name, p in private_patterns(private or {}).items()]
    every += [Detector("injection_phrase", "injection", "review_required", r"(?i)\b(?:" + "|".join(P.INJECTIONS) + r")\b", True)]
    chosen = [d for d in every if not enabled or d.name in enabled]
    return [replace(d, severity=(severities or {}).get(d.name, d.severity)) for d in chosen]


def preview(found: str) -> str:
    """The ends of a finding, nothing of a short one."""
    return "***" if len(found) <= 2 * KEEP else f"{found[:KEEP]}***{found[-KEEP:]}"


def luhn(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def findings(docs: DataFrame, detectors: Sequence[Detector], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, detector, category, severity, start, end, match): every finding with its characters' place, and of what was found
    the whole if it is plain, else only its ends."""
    detectors = list(detectors)
    names = ["id", "detector", "category", "severity", "start", "end", "match"]
    types = [pa.int64(), *[pa.string()] * 3, pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(d, re.compile(d.pattern)) for d in detectors]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for d, pattern in ready:
                    for m in pattern.finditer(text):
                        if d.name != "pii_credit_card_luhn" or luhn(re.sub(r"\D", "", m.group())):
                            rows.append((i, d.name, d.category, d.severity, m.start(), m.end(), m.group() if d.plain else preview(m.group())))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text != ''")
    return some.mapInArrow(run, "id long, detector string, category string, severity string, start long, end long, match string")
