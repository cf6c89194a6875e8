"""Near-duplicate vectors: spherical k-means deals vectors to cells, blocked cosine products compare within cells,
and one vector of each group is kept.

Nothing within the threshold is missed. A vector's home is the cell with the nearest centre. If u's home is c and v's
is d, then u.(c - d) >= 0, and as |u - v| <= r = sqrt(2 - 2 t) for a cosine of t or more, v.d - v.c <= r |c - d|. So v
is also sent, as a partner only, to each cell c for which that holds; every vector then meets all its partners in its
home. Equal vectors of a label are one row with a count. The centres are fitted on a bounded sample; that choice moves
work between tasks and no link. A hot cell is compared in blocks by several tasks; tasks return counts and a spanning
forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialize, star, thrifty, unit_hash
from .components import components

THRESHOLD = 0.98
#: Centres at most, vectors to fit them on at most, and cells that a vector is sent to at most in the mean of those:
#: the number of centres is halved until it holds. (It costs time only: any number of centres finds all links.)
CENTRES, SAMPLE, SENT = 4096, 65_536, 6
#: Bytes of that sample in double precision, of all numbers of components together, at most.
SAMPLE_BYTES = 64 << 20
#: Vectors of a cell above which it is compared in blocks; blocks at most (they grow beyond that).
BLOCK, BLOCKS = 1024, 64
_SLACK = 1e-9


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Unit centres (k or fewer, at least one) of the unit rows of x; no rows: no centres."""
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: max(1, k)]]
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _unit(vectors: pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision."""
    if not len(vectors):
        return np.zeros((0, 0))
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home of each unit row, and (row, cell) for each cell in which a partner of the row may be at home."""
    near = x @ centres.T
    home = near.argmax(1)
    row, cell = np.nonzero(near[np.arange(len(x)), home][:, None] - near <= radius * gaps[home] + _SLACK)
    return home, row, cell


def _gaps(centres: np.ndarray) -> np.ndarray:
    """Distances between centres, rounded up."""
    return np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T)) + 1e-7


def _deal(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray], radius: float) -> Iterator[pa.RecordBatch]:
    """Rows (nid, label, v, mult): a row for the home and for each other cell where a partner may be at home."""
    gaps = {d: _gaps(c) for d, c in centres.items()}
    for batch in batches:
        dims = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            for i in range(0, len(rows), 1024):
                some = batch.take(pa.array(rows[i : i + 1024]))
                home, row, cell = cells(_unit(some.column("v")), centres[dim], gaps[dim], radius)
                sent = some.take(pa.array(row))
                yield pa.record_batch(
                    {
                        "nid": sent.column("nid"),
                        "label": sent.column("label"),
                        "dim": pa.array(np.full(len(row), dim), pa.int32()),
                        "cell": pa.array(cell, pa.int32()),
                        "home": pa.array(cell == home[row]),
                        "mult": sent.column("mult"),
                        "v": sent.column("v"),
                    }
                )


def cosines(q: np.ndarray, d: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of q and d have a cosine of at least the threshold; those next to it are worked out once more from
    exactly rounded sums."""
    from math import fsum, sqrt

    product = q @ d.T
    near = product >= threshold
    for i, j in zip(*np.nonzero(np.abs(product - threshold) < _SLACK), strict=True):
        a, b = q[i].tolist(), d[j].tolist()
        near[i, j] = fsum(s * t for s, t in zip(a, b, strict=True)) / sqrt(fsum(s * s for s in a) * fsum(t * t for t in b)) >= threshold
    return near


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are."""
    return column.to_numpy() if not pa.types.is_string(column.type) else column.combine_chunks().dictionary_encode().indices.to_numpy()


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cell blocks, group by group: (nid, n, null) counts links, (nid, 0, other) is a link of a forest."""
    keys = ["label", "dim", "cell", "qb", "db"]

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nid, mult = rows.column("nid").to_numpy(), rows.column("mult").to_numpy()
        asks, gives = (rows.column(c).to_numpy() for c in ("asks", "gives"))
        change = np.zeros(len(nid), bool)
        for c in keys:
            col = _codes(rows.column(c))
            change[1:] |= col[1:] != col[:-1]
        starts = np.concatenate(([0], np.flatnonzero(change), [len(nid)]))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            q, d = lo + np.flatnonzero(asks[lo:hi]), lo + np.flatnonzero(gives[lo:hi])
            if not len(q) or not len(d) or (len(d) == 1 and len(q) == 1 and nid[q[0]] == nid[d[0]]):
                continue
            x = _unit(rows.slice(lo, hi - lo).column("v").combine_chunks())
            n = np.zeros(hi - lo, np.int64)
            a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for i in range(0, len(q), 1024):
                for j in range(0, len(d), 1024):
                    qs, ds = q[i : i + 1024], d[j : j + 1024]
                    near = cosines(x[qs - lo], x[ds - lo], threshold) & (nid[qs][:, None] != nid[ds])
                    n[qs - lo] += near @ mult[ds]
                    s, t = np.nonzero(near)
                    label = star(hi - lo, np.concatenate((a, qs[s] - lo)), np.concatenate((b, ds[t] - lo)))
                    a = np.flatnonzero(label != np.arange(hi - lo))
                    b = label[a]
            has = np.flatnonzero(n)
            if len(has):
                ids = np.concatenate((nid[lo + has], nid[lo + a]))
                yield pa.record_batch(
                    {
                        "nid": pa.array(ids),
                        "n": pa.array(np.concatenate((n[has], np.zeros(len(a), np.int64)))),
                        "other": pa.array(np.concatenate((np.zeros(len(has), np.int64), nid[lo + b])), mask=np.arange(len(ids)) < len(has)),
                    }
                )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 4 * BLOCK:
            rows = pa.Table.from_batches(held)
            differ = np.zeros(len(rows), bool)
            for c in keys:
                col = _codes(rows.column(c))
                differ |= col != col[-1]
            at = np.flatnonzero(differ)
            if len(at):
                n = int(at[-1]) + 1
                yield from done(rows.slice(0, n))
                held, size = rows.slice(n).combine_chunks().to_batches(), size - n
    if size:
        yield from done(pa.Table.from_batches(held))


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, seed: int = 0
) -> DataFrame:
    """Returns (id, n_links, component_id, kept) for every row.

    Rows link if their labels are equal and not null, their vectors have as many components and their cosine, in
    double precision, is `threshold` (above 0) or more. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing: n_links 0, component_id the own id. Repeated rows are rows of their own, linked with
    each other. Null ids never are a component's smallest; component_id is null only where all its ids are, and kept
    (id = component_id) then is true. No rows, no rows. Other columns are not read."""
    bounded(df.sparkSession)
    v = F.col(vector_col)
    if not isinstance(df.schema[vector_col].dataType.elementType, T.FloatType):
        v = F.transform(v, lambda x: x.cast("double"))
    vectors = "array<float>" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("double")))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    keyed = rows.withColumn("sound", sound).withColumns({f"h{i}": F.when(F.col("sound"), F.xxhash64(F.lit(i), "label", "v")) for i in (1, 2)})
    distinct = (
        keyed.where("sound")
        .groupBy("h1", "h2")
        .agg(F.first("label").cast("string").alias("label"), F.first("v").alias("v"), F.count("*").alias("mult"), F.min("id").alias("least"))
        .withColumn("nid", F.monotonically_increasing_id())
    )
    distinct = materialize(distinct, "vectors")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    centres = _centres(distinct, radius, seed)
    dealt = materialize(
        distinct.select("nid", "label", "v", "mult").mapInArrow(
            thrifty(lambda batches: _deal(batches, centres, radius)), f"nid long, label string, dim int, cell int, home boolean, mult long, v {vectors}"
        ),
        "cells",
    )
    cell = ["label", "dim", "cell"]
    sizes = dealt.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("asking"), F.count("*").alias("giving")).where("giving > 1")
    blocks = lambda c: F.least(F.lit(BLOCKS), F.ceil(F.col(c) / BLOCK)).cast("int")
    mine = lambda s, c: F.pmod(F.xxhash64("nid", F.lit(s)), F.col(c)).cast("int")
    to = F.concat(
        F.when((F.col("nq") == 1) & (F.col("nd") == 1), F.array(_at(F.lit(0), F.lit(0), F.col("home"), F.lit(True)))).otherwise(
            F.concat(
                F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nd") - 1), lambda d: _at(mine(7, "nq"), d, F.lit(True), F.lit(False)))).otherwise(
                    F.array().cast("array<struct<qb:int,db:int,asks:boolean,gives:boolean>>")
                ),
                F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda q: _at(q, mine(8, "nd"), F.lit(False), F.lit(True))),
            )
        )
    )
    met = (
        dealt.join(sizes.where("asking > 0").select(*cell, blocks("asking").alias("nq"), blocks("giving").alias("nd")), cell)
        .select(*cell, "nid", "mult", "v", F.explode(to).alias("p"))
        .select(*cell, "p.qb", "p.db", "nid", "mult", "p.asks", "p.gives", "v")
        .repartition(*cell, "qb", "db")
        .sortWithinPartitions(*cell, "qb", "db", "nid")
    )
    found = materialize(met.mapInArrow(thrifty(lambda batches: _compare(batches, threshold)), "nid long, n long, other long"), "links")
    counts = found.where("other is null").groupBy("nid").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("nid").alias("a"), F.col("other").alias("b")))
    named = distinct.select("nid", "h1", "h2", "mult", "least").join(roots.withColumnRenamed("node", "nid"), "nid", "left").join(counts, "nid", "left")
    named = named.withColumn("root", F.coalesce("root", "nid"))
    least = named.groupBy("root").agg(F.min("least").alias("group_least"))
    place = materialize(named.join(least, "root").select("h1", "h2", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "group_least"), "groups")
    out = keyed.select("id", "sound", "h1", "h2").join(place, ["h1", "h2"], "left")
    smallest = F.when(F.col("sound"), F.col("group_least")).otherwise(F.col("id"))
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), smallest.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id"))
    )


def _at(qb, db, asks, gives):
    return F.struct(qb.alias("qb"), db.alias("db"), asks.alias("asks"), gives.alias("gives"))


def _centres(distinct: DataFrame, radius: float, seed: int) -> dict[int, np.ndarray]:
    """Centres for each number of components: the square root of the rows over four of them, or so many fewer that a
    vector of the sample goes to SENT cells in the mean; fitted on a sample of at most SAMPLE rows."""
    out = {}
    dims = distinct.groupBy(F.size("v").alias("dim")).count().collect()
    for r in dims:
        k = int(min(CENTRES, max(1, round(r["count"] ** 0.5 / 4))))
        most = max(1, min(SAMPLE, 64 * k, SAMPLE_BYTES // (8 * r["dim"] * len(dims))))
        k = min(k, most)
        u = unit_hash(seed, F.col("h1"), F.col("h2"))
        some = distinct.where((F.size("v") == r["dim"]) & (u < 1.2 * most / r["count"])).select(u.alias("u"), "v").toArrow()
        order = np.argsort(some.column("u").to_numpy(), kind="stable")[:most]
        if not len(order):
            out[int(r["dim"])] = np.eye(1, int(r["dim"]))
            continue
        x = _unit(some.column("v").combine_chunks().take(pa.array(order)))
        while True:
            out[int(r["dim"])] = c = spherical_kmeans(x, k, seed=seed)
            gaps = _gaps(c)
            if k == 1 or sum(len(cells(x[i : i + 1024], c, gaps, radius)[1]) for i in range(0, len(x), 1024)) <= SENT * len(x):
                break
            k //= 2
    return out
