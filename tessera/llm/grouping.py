"""Comparing the members of large groups in steps of bounded size.

A group (a hash bucket, a filter, a component) may hold any share of all rows. Its members
are dealt to sub-blocks; every pair of sub-blocks is a unit of work of bounded size, and a
unit returns links that connect what it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUB_BLOCK = 1024


def in_sub_blocks(rows: DataFrame, group: list[str], member: str, sub_block: int = SUB_BLOCK) -> DataFrame:
    """Every row once for each pair (i, j) of sub-blocks of its group that has its own
    sub-block ``sub``; groups of one row are left out."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("m")).where("m > 1")
    return (
        rows.join(sizes, group)
        .withColumn("subs", F.ceil(F.col("m") / F.lit(sub_block)).cast("int"))
        .withColumn("sub", F.pmod(F.xxhash64(member, F.lit(7)), F.col("subs")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        .withColumn("i", F.least("sub", "other"))
        .withColumn("j", F.greatest("sub", "other"))
        .drop("m", "subs", "other")
    )


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by key, with the number of each row's group."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        keys = [table.column(c).to_numpy() for c in key]
        starts = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        last = int(np.flatnonzero(starts)[-1])  # the last group may go on in the next batch
        held = table.slice(last)
        if last:
            yield table.slice(0, last), np.cumsum(starts[:last])
    if held is not None:
        yield held, np.ones(held.num_rows, np.int64)


def settle(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least row that each of n rows reaches by the pairs (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        after = label.copy()
        np.minimum.at(after, p, low)
        np.minimum.at(after, q, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def sketch_links(key: list[str], member: str, words: tuple[str, str], most: int):
    """For rows in sub-blocks, sorted by key (its last columns i, j): links (u, v) that
    connect the members whose two sketch words differ in at most ``most`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in sorted_groups(batches, key):
            n = table.num_rows
            ids, sub, i, j, s0, s1 = (table.column(c).to_numpy() for c in (member, "sub", "i", "j", *words))

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                # as unsigned words: of a negative one numpy counts the bits of its magnitude
                differ = sum(np.bitwise_count((s[a] ^ s[b]).view(np.uint64)).astype(np.int64) for s in (s0, s1))
                return (differ <= most) & ((i[a] == j[a]) | (sub[a] != sub[b]))

            first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(n), 0))
            starred = near(np.arange(n), first) & (first != np.arange(n))
            p, q = [first[starred]], [np.flatnonzero(starred)]
            at, k = np.arange(n), 1
            while True:  # pairs k rows apart, but those that the first row connects already
                at = at[at + k < n]
                at = at[group[at] == group[at + k]]
                if not len(at):
                    break
                a = at[~(starred[at] & starred[at + k])]
                hit = near(a, a + k)
                p.append(a[hit])
                q.append(a[hit] + k)
                k += 1
            label = settle(n, np.concatenate(p), np.concatenate(q))
            moved = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    return run


def cross_links(key: list[str], member: str, side: str, words: tuple[str, str], most: int, pairs: int = 1 << 20):
    """For rows sorted by (key, side): links (u, v) that connect a group's members of side 0
    with those of side 1 whose two sketch words differ in at most ``most`` bits. At most
    about ``pairs`` pairs are compared at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in sorted_groups(batches, key):
            ids, sides, s0, s1 = (table.column(c).to_numpy() for c in (member, side, *words))
            n = table.num_rows
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            lefts = np.bincount(of[sides == 0], minlength=len(starts))
            rights = np.bincount(of, minlength=len(starts)) - lefts
            left = np.flatnonzero((sides == 0) & (rights[of] > 0))
            todo = rights[of[left]]
            found_u, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            part = np.cumsum(todo) // pairs  # which slice a left row is compared in
            for k in range(int(part[-1]) + 1 if len(part) else 0):
                some = left[part == k]
                m = rights[of[some]]
                p = np.repeat(some, m)
                q = np.repeat(starts[of[some]] + lefts[of[some]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                # as unsigned words: of a negative one numpy counts the bits of its magnitude
                differ = sum(np.bitwise_count((s[p] ^ s[q]).view(np.uint64)).astype(np.int64) for s in (s0, s1))
                hit = (differ <= most) & (ids[p] != ids[q])
                found_u.append(p[hit]), found_v.append(q[hit])
            u, v = np.concatenate(found_u), np.concatenate(found_v)
            label = settle(n, u, v)
            moved = np.flatnonzero(label != np.arange(n))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    return run
