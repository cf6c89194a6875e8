"""Rows that find what they need in rows close by, and so do not move."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import Tuple  # noqa: UP035  arrow_udf knows an iterator's columns by this name

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize, sieve

#: Rows of a block: what is less than that apart, in one partition, is near.
BLOCK = 16_384
#: Rows whose labels are sorted at once; labels on both sides of an end of these are far.
STRETCH = 4_194_304
#: Ranges of hashes.
PARTS = 256
#: Far labels up to which their rows are written, to be read more than once.
FEW = 100_000


def _hashes(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By ranges, the hashes of a stretch; those that are far by what is seen here are there twice."""
    rows = pa.Table.from_batches(held)
    at = np.flatnonzero(rows["h"].is_valid().to_numpy())
    h, link = rows["h"].drop_null().to_numpy(), rows["link"].to_numpy()[at].astype(np.int32)
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    far = (np.add.reduceat(link[order], first) != 1) | (at[last] - at[first] >= BLOCK)
    h = h[first]
    h = np.sort(np.concatenate([h, h[far]]))
    ends = np.searchsorted(h, np.arange(-PARTS // 2 + 1, PARTS // 2) * (2**64 // PARTS))
    some = [(i, x.tobytes()) for i, x in enumerate(np.split(h, ends)) if len(x)]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int32()), pa.array([x for _, x in some], pa.binary())], ["part", "hashes"])


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= STRETCH:
            yield from _hashes(held)
            held, n = [], 0
    if n:
        yield from _hashes(held)


def _twice(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(part, []).append(np.frombuffer(hashes, np.int64))
    for some in found.values():
        h = np.sort(np.concatenate(some))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[1:][h[1:] == h[:-1]]))], ["h"])


def _blocks(batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[pa.RecordBatch]:
    """The same rows, BLOCK at a time."""
    held, n = [], 0
    for columns in batches:
        held.append(pa.RecordBatch.from_arrays(list(columns), ["b", "own", "seq"]))
        n += len(columns[0])
        if n >= BLOCK:
            rows = pa.concat_batches(held)
            whole = n - n % BLOCK
            yield from (rows.slice(i, BLOCK) for i in range(0, whole, BLOCK))
            held, n = [rows.slice(whole)], n - whole
    if n:
        yield pa.concat_batches(held)


def _owners(batches: Iterator[Tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:  # noqa: UP006
    before = here = None
    for rows in chain(_blocks(batches), [None]):
        after = rows and (rows.column(0), rows.filter(rows.column(1).is_valid()))
        if here:
            links = pa.concat_batches([x[1] for x in (before, here, after) if x])
            at = pc.index_in(here[0], value_set=links.column(0), skip_nulls=True)
            yield pa.StructArray.from_arrays([links.column(1).take(at), links.column(2).take(at)], ["owner", "at"])
        before, here = here, after


def owned(df: DataFrame, label: Column, own: Column) -> tuple[DataFrame, DataFrame]:
    """Two parts of df: rows with no label or a near one, with what the label's link has as own and as seq in the columns __owner and
    __at; and rows with a far one. A link is a row with own. A label is near if there is one link, and all its rows are in one
    partition less than BLOCK apart: then a function of the rows around finds it. Which are far, hashes tell: each task sends those that
    it met, sorted, as binary values. df must be repeatable()."""

    def told(batches):
        return _stretches(batches)

    h = F.xxhash64(F.lit(3), label)
    hashes = df.select(F.when(label.isNotNull(), h).alias("h"), own.isNotNull().alias("link")).mapInArrow(told, "part int, hashes binary")
    far = materialize(hashes.repartition("part").mapInArrow(_twice, "h bigint"), "far")
    n, kept = far.count(), [F.col(f"`{c}`") for c in df.columns]
    # not deterministic, so that no filter of what is made of it goes below: the function needs the rows around
    find = F.arrow_udf(_owners, "owner string, at array<bigint>").asNondeterministic()
    near = df.select(*kept, find(label, own, F.when(own.isNotNull(), F.col("seq"))).alias("__x"))
    passes = sieve(far, "h")
    is_far = lambda: F.coalesce(passes(F.when(label.isNotNull(), h)), F.lit(False))
    if n:
        near = near.where(~is_far())
    rest = df.where(is_far() if n else F.lit(False))
    return near.select(*kept, F.col("__x.owner").alias("__owner"), F.col("__x.at").alias("__at")), rest if n > FEW else materialize(rest, "far_quads")
