"""Places and running sums within keys, of which one may hold any share of the rows.

Rows are dealt out by ranges of (key, order), so a hot key spans many tasks. Every task
counts and sums for itself; what its first key has in earlier tasks is then added from a
table with at most two rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize, ship


class _Local:
    """Places and sums of the keys of one task, batch after batch."""

    def __init__(self, sums: int):
        self.key, self.place, self.totals = None, 0, np.zeros(sums, np.uint64)

    def run(self, keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(places, sums up to and with each row, starts of keys)."""
        n = len(keys)
        starts = np.concatenate([[self.key is None or keys[0] != self.key], keys[1:] != keys[:-1]])
        first = np.maximum.accumulate(np.where(starts, np.arange(n), -1))  # -1: the key goes on
        places = np.where(first >= 0, np.arange(n) - first, np.arange(n) + self.place)
        sums = []
        for k, v in enumerate(values):
            total = np.cumsum(v.view(np.uint64), dtype=np.uint64)
            before = np.concatenate([[np.uint64(0)], total])[np.maximum(first, 0)]
            sums.append(total - before + np.where(first >= 0, np.uint64(0), self.totals[k]))
        self.key, self.place, self.totals = keys[-1], int(places[-1]) + 1, np.array([s[-1] for s in sums], np.uint64)
        return places, sums, starts


def scan(rows: DataFrame, key: str, order: list, keep: list[str], sums: tuple[str, ...], name: str) -> DataFrame:
    """The columns ``key`` (long, never null), ``keep`` and ``sums`` (all long) with ``place``, from 0 on in
    each key in this order, and for each of ``sums`` its running sum modulo 2**64 up to the row
    (``<name>_before``) and with it (``<name>_with``). Rows that the order does not tell
    apart come in any order."""
    ship(rows.sparkSession)
    columns = [key, *keep, *sums]
    ordered = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order).select(*columns)
    types = ", ".join(f"`{c}` long" for c in [*columns, "place", *(f"{c}_with" for c in sums)])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, state, held, keys_met = TaskContext.get().partitionId(), _Local(len(sums)), None, 0
        names = [*columns, "place", *(f"{c}_with" for c in sums), "part", "edge"]

        def out(table: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(c) for c in table] + [pa.array(np.full(len(edges), part, np.int32)), pa.array(edges.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            data = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            places, added, starts = state.run(data[0], [data[columns.index(c)] for c in sums])
            table = [*data, places.astype(np.int64), *(s.view(np.int64) for s in added)]
            if held is not None:  # the last row of a batch waits: it may be its key's last
                table = [np.concatenate([h, c]) for h, c in zip(held, table)]
                starts = np.concatenate([[False], starts])
            ends = np.concatenate([starts[1:], [False]])
            edges = np.zeros(len(ends), np.int32)
            if keys_met == 0 and ends.any():
                edges[np.flatnonzero(ends)[0]] = 1  # all of the task's first key
            keys_met += int(ends.sum())
            held = [c[-1:] for c in table]
            if len(ends) > 1:
                yield out([c[:-1] for c in table], edges[:-1])
        if held is not None:
            yield out(held, np.array([2 if keys_met else 3]))

    done = materialize(ordered.mapInArrow(local, f"{types}, part int, edge int"), name)
    marks = done.where("edge > 0").select("part", "edge", key, "place", *(f"{c}_with" for c in sums)).orderBy("part", "edge").collect()
    carried, last, wrap = {}, None, 1 << 64  # at most two marks a task
    for r in marks:
        own = [r[key], r["place"] + 1, *(r[f"{c}_with"] % wrap for c in sums)]
        if r["edge"] & 1 and last and last[0] == own[0]:
            carried[r["part"]] = last
            own = [own[0], *((a + b) % wrap for a, b in zip(own[1:], last[1:]))]
        last = own
    parts = np.array(sorted(carried), np.int64)
    adds = [np.array([carried[p][k] for p in parts.tolist()], np.uint64 if k > 1 else np.int64) for k in range(2 + len(sums))]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            at = np.minimum(np.searchsorted(parts, own["part"]), max(0, len(parts) - 1))
            goes_on = (parts[at] == own["part"]) & (adds[0][at] == own[key]) if len(parts) else np.zeros(batch.num_rows, bool)
            add = [np.where(goes_on, a[at], a.dtype.type(0)) if len(parts) else np.zeros(batch.num_rows, a.dtype) for a in adds]
            cols = [*(own[c] for c in [key, *keep, *sums]), own["place"] + add[1]]
            for k, c in enumerate(sums):
                whole = own[f"{c}_with"].view(np.uint64) + add[2 + k]
                cols += [(whole - own[c].view(np.uint64)).view(np.int64), whole.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    names = [key, *keep, *sums, "place", *(f"{c}{end}" for c in sums for end in ("_before", "_with"))]
    return done.mapInArrow(finish, ", ".join(f"`{c}` long" for c in names))
