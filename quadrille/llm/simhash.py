"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint takes the majority of each bit over the XXH64 values of its word shingles. Two fingerprints
within `radius` bits agree in all but `radius` of any b > radius blocks of bits, so bucketing by every choice of
b - radius blocks brings each such pair together in some bucket: nothing within the radius is missed, and b grows
with the number of fingerprints so that buckets stay small. Within buckets the fingerprints' bit planes stand
vertically, 64 fingerprints to a machine word; carry-save counters add up 64 distances at once, and a block is
abandoned as soon as all its distances exceed the radius. A task returns a spanning forest of its links, at most a
row for each fingerprint it has read, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, bounded, materialize, star, thrifty
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Mean fingerprints in a bucket above which more blocks are taken.
BUCKET = 4096
#: Rows of a bucket above which it is compared in blocks, by several tasks; blocks into which it goes at most (they
#: grow beyond that).
BLOCK, BLOCKS = 1024, 1024
#: Fingerprints compared at a time.
CHUNK = 1 << 16
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint; zero for null and for a text without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for i in range(0, n, 1 << 15):
        j = min(n, i + (1 << 15))
        spans = zip(starts[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)
        found = np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in spans]), np.uint8)
        ones += np.unpackbits(found.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that are set in over half of them; zero for none."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: Column, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """df and the fingerprint of text, as a signed long, in the column `name` (which replaces one of that name)."""

    def prints(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(x.as_py(), shingle, seed) for x in texts), pa.uint64()).view(pa.int64())

    bounded(df.sparkSession)
    return df.withColumn(name, arrow_column(prints, "long")(text.cast("string")))


def block_masks(blocks: int, agree: int) -> list[int]:
    """A mask of bits for each choice of `agree` of `blocks` even blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def plan_blocks(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> list[int]:
    """Masks for n fingerprints: as few blocks as keep the mean bucket at `bucket` or less."""
    for blocks in range(radius + 1, 65):
        if n / 2 ** (64 * (blocks - radius) / blocks) <= bucket or blocks == radius + 4:
            return block_masks(blocks, blocks - radius)
    return [0]


def linked(key: np.ndarray, prints: np.ndarray, radius: int, known: list[int], side: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by key: the smallest row that each can reach by steps of at most `radius` bits between rows of
    equal key. known: bits in which rows of a key agree anyway. side: for a key that has rows of both sides, 0 before 1, steps lead
    from one to the other alone."""
    n = len(key)
    tiles = -(-n // 64)
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate((first, [n])))
    end = np.repeat(np.concatenate((first[1:], [n])), size)
    # a row meets those from here on
    begin = np.arange(n) + 1
    if side is not None and n:
        other = np.add.reduceat(side, first)
        begin = np.where(np.repeat((other > 0) & (other < size), size), np.where(side == 1, end, end - np.repeat(other, size)), begin)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((tiles * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view(np.uint64)
    order = [b for b in range(64) if b not in set(known)]
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.arange(n)
    for apart in range(tiles):
        at = rows // 64 + apart
        low = np.maximum(begin - at * 64, 0)
        high = np.minimum(end - at * 64, 64)
        row = rows[(high > low)]
        if not len(row):
            if (high <= 0).all():
                break
            continue
        lo, hi = low[row].astype(np.uint64), high[row].astype(np.uint64)
        valid = (_ALL >> (np.uint64(64) - hi)) & (_ALL << lo)
        tile = at[row]
        c0, c1, c2, over = (np.zeros(len(row), np.uint64) for _ in range(4))
        for k in range(0, len(order), 2):
            p = order[k]
            x = planes[p, tile] ^ (np.uint64(0) - bits[row, p].astype(np.uint64))
            if k + 1 < len(order):
                p = order[k + 1]
                y = planes[p, tile] ^ (np.uint64(0) - bits[row, p].astype(np.uint64))
            else:
                y = np.zeros_like(x)
            half = c0 ^ x
            carry = (c0 & x) | (y & half)
            c0 = half ^ y
            more = c1 & carry
            c1 ^= carry
            over |= c2 & more
            c2 ^= more
            if k % 8 == 6 and radius < 8:
                alive = valid & ~(over | _above(c0, c1, c2, radius))
                keep = alive != 0
                if not keep.all():
                    row, tile, valid, c0, c1, c2, over = (z[keep] for z in (row, tile, alive, c0, c1, c2, over))
                    if not len(row):
                        break
        hit = valid & ~(over | _above(c0, c1, c2, radius))
        keep = np.flatnonzero(hit)
        if len(keep):
            for i in range(0, len(keep), 1 << 14):
                some = keep[i : i + (1 << 14)]
                on = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                q, lane = np.nonzero(on)
                label = star(n, np.concatenate((a, row[some][q])), np.concatenate((b, tile[some][q] * 64 + lane)))
                a = np.flatnonzero(label != np.arange(n))
                b = label[a]
    label = np.arange(n)
    label[a] = b
    return label


def _above(c0: np.ndarray, c1: np.ndarray, c2: np.ndarray, radius: int) -> np.ndarray:
    """Where the three-bit counters exceed the radius (0 to 7)."""
    above, equal = np.zeros_like(c0), np.full_like(c0, _ALL)
    for plane, bit in ((c2, 4), (c1, 2), (c0, 1)):
        if radius & bit:
            equal &= plane
        else:
            above |= equal & plane
            equal &= ~plane
    return above


def _forest(batches: Iterator[pa.RecordBatch], masks: list[int], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (t, k, i, j, side, fp), sorted: links that span what a task finds."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [rows.column(c).to_numpy() for c in ("t", "k", "i", "j")]
        prints = rows.column("fp").to_numpy().view(np.uint64)
        change = np.zeros(len(prints), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        key = np.cumsum(change)
        same = np.bitwise_and.reduce([np.uint64(masks[t]) for t in np.unique(cols[0])])
        known = [b for b in range(64) if int(same) >> b & 1]
        label = linked(key, prints, radius, known, rows.column("side").to_numpy().astype(np.int64))
        at = np.flatnonzero(label != np.arange(len(label)))
        if len(at):
            yield pa.record_batch({"a": prints[at].view(np.int64), "b": prints[label[at]].view(np.int64)})

    def cut(rows: pa.Table) -> int:
        """Where the last bucket begins."""
        last = {c: rows.column(c)[len(rows) - 1].as_py() for c in ("t", "k", "i", "j")}
        differ = np.zeros(len(rows), bool)
        for c, v in last.items():
            differ |= rows.column(c).to_numpy() != v
        at = np.flatnonzero(differ)
        return int(at[-1]) + 1 if len(at) else 0

    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK and (n := cut(rows := pa.Table.from_batches(held))):
            yield from done(rows.slice(0, n))
            held, size = rows.slice(n).combine_chunks().to_batches(), size - n
    if size:
        yield from done(pa.Table.from_batches(held))


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """prints: distinct fingerprints, column fp (long). Links (a, b) that connect exactly those fingerprints which
    steps of at most `radius` bits connect."""
    if not 0 <= radius <= 7:
        raise ValueError("radius: 0 to 7 bits")
    n = prints.count()
    masks = plan_blocks(n, radius, bucket)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
    rows = prints.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").count().where(F.col("count") > 1)
    blocks = F.least(F.lit(BLOCKS), F.ceil(F.col("count") / BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb")).cast("int")
    # of a bucket that is cut into blocks, each meets itself once and each other one
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j"), (F.col("mine") > o).cast("int").alias("side")),
    )
    dealt = (
        rows.join(sizes.select("t", "k", blocks.alias("nb")), ["t", "k"])
        .withColumn("mine", mine)
        .select("t", "k", "fp", F.explode(pairs).alias("p"))
        .select("t", "k", "p.i", "p.j", "p.side", "fp")
        .repartition("t", "k", "i", "j")
        .sortWithinPartitions("t", "k", "i", "j", "side", "fp")
    )
    return dealt.mapInArrow(thrifty(lambda batches: _forest(batches, masks, radius)), "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """Returns (id, fp, component_id) for every row: its fingerprint as a signed long, and the smallest id that links
    reach.

    Links join fingerprints that differ in at most `radius` bits, equal ones included; texts that are null, empty or
    blank have fingerprint zero and link like any other. Null ids count for nothing as smallest id: component_id is
    null only where all ids of the component are. Repeated rows each give a row; no rows, no rows. Other columns of df
    are not read."""
    rows = materialize(
        with_fingerprint(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), F.col("text"), "fp", shingle, seed).select("id", "fp"), "prints"
    )
    return group_prints(rows, radius)


def group_prints(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """near_duplicates() of rows (id, fp) whose fingerprints are already there."""
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked_to = components(materialize(near_links(prints.select("fp"), radius), "near"))
    named = prints.join(linked_to.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    place = materialize(named.join(least, "root").select("fp", "component_id"), "groups")
    return rows.join(place, "fp").select("id", "fp", "component_id")
