"""Sequential rules over the keys of a stream: the state of many keys is one value, so that Python is called once a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Buckets of keys. A call costs some milliseconds however few rows it has, and reads and writes the states of its bucket's keys.
BUCKETS = 1024

Step = Callable[[tuple, tuple, tuple | None], tuple[list[tuple], tuple | None]]


def _values(column: pd.Series, kind: T.DataType) -> list:
    """A column as Python's own values; what pandas makes of nulls, and of integers beside them, is undone."""
    if not column.hasnans:
        return column.tolist()
    whole = isinstance(kind, T.IntegralType)
    return [None if lost else int(x) if whole else x for x, lost in zip(column, column.isna(), strict=True)]


def by_key(
    rows: DataFrame, keys: list[str], order: list[str], columns: list[str], step: Step, out: T.StructType, state: str, expires: Callable[[tuple], float] | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """What ``step`` gives for each row: it gets the key, the row's ``columns`` and the key's state, a tuple of the fields in
    ``state`` or None, and returns rows of ``out`` and the new state.

    The rows of a key in a micro-batch come by ``order``. ``expires`` says after which second of event time a state is void; it
    is dropped then. ``buckets`` belongs to the checkpoint: a running stream keeps its number. What meets in a task is one
    bucket's rows of a micro-batch and the states of its keys.
    """
    n, kinds = len(keys), {c: rows.schema[c].dataType for c in {*keys, *columns}}
    held_type = f"held array<struct<{', '.join([*(f'`{k}`: {kinds[k].simpleString()}' for k in keys), *(f.replace(' ', ': ', 1) for f in state.split(', '))])}>>"

    def run(_: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(x[:n]): tuple(x[n:]) for x in kept.get[0]} if kept.exists else {}
        parts, found = [] if kept.hasTimedOut else [f for f in frames if len(f)], []
        if parts:
            table = pd.concat(parts).sort_values(order, kind="stable")
            own = zip(*(_values(table[k], kinds[k]) for k in keys), strict=True)
            for key, row in zip(own, zip(*(_values(table[c], kinds[c]) for c in columns), strict=True), strict=True):
                more, after = step(key, row, held.get(key))
                found.extend(more)
                if after is not None:
                    held[key] = after
        if expires is not None:
            now = kept.getCurrentWatermarkMs()
            held = {k: s for k, s in held.items() if int(expires(s) * 1000) > now}
        if held:
            kept.update(([(*k, *s) for k, s in held.items()],))
            if expires is not None:
                kept.setTimeoutTimestamp(max(min(int(expires(s) * 1000) for s in held.values()), now + 1))
        elif kept.exists:
            kept.remove()
        if found:
            yield pd.DataFrame(found, columns=out.names)

    timeout = GroupStateTimeout.NoTimeout if expires is None else GroupStateTimeout.EventTimeTimeout
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("_bucket").applyInPandasWithState(run, out, held_type, "append", timeout)
