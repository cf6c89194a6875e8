"""Packing documents into windows by non-negative least squares.

Whole windows of a document are sequences of their own; what is left of it, shorter than a window, is counted by
length. All combinations of two or three such lengths that fill a window exactly are enumerated, and their repeat counts
are solved against that histogram by non-negative least squares (greedy coordinate descent, which keeps few of them);
rounded down, they deal out most rests whole and without padding. What remains is packed greedily, end to end, cut
where a window is full, so that one sequence of the whole corpus has padding.

The histogram has as many entries as a window has tokens, so planning takes bounded work whatever the corpus; rests of a
length are numbered in as many groups as their count asks for, so that a length that a third of the corpus shares is not one
task's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, materialize, spread, thrifty
from .repair import encoded
from .tokens import Encoder

WINDOW = 1024
END = 0
#: Steps of the solver at most, times it is run on what is left; rests of a length that one task numbers, about.
STEPS, ROUNDS, GROUP = 3000, 3, 500


@cache
def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c that add up to the window; c is 0 for combinations of two."""
    rows = []
    for a in range(-(-window // 3), window):
        b = np.arange(-(-(window - a) // 2), min(a, window - a) + 1)
        if len(b):
            rows.append(np.stack((np.full(len(b), a), b, window - a - b), 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def relaxed(free: np.ndarray, combos: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative uses of the combinations for which the squares of what is left of free, or lacking, are least: by coordinate
    descent, the step that gains most first, until none is half a use or `steps` are done."""
    left = free.astype(np.float64)
    left[0] = 0
    a, b, c = combos.T
    norm = 2.0 + (c > 0) + 2.0 * ((a == b) + 0.0) + 2.0 * ((b == c) + 0.0) + 2.0 * ((a == c) + 0.0)
    uses = np.zeros(len(combos))
    for _ in range(steps):
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -uses)
        j = int(np.argmax(step * step * norm))
        if abs(step[j]) < 0.5:
            break
        uses[j] += step[j]
        for x in combos[j]:
            if x:
                left[x] -= step[j]
    return uses


def _solve(free: np.ndarray, combos: np.ndarray, steps: int) -> np.ndarray:
    """How often each combination is used, rounded down so that no length is used more often than free has it; what is
    used is taken from free."""
    uses = relaxed(free, combos, steps)
    counts = np.zeros(len(combos), np.int64)
    picked = np.flatnonzero(uses >= 1)
    for j in picked[np.argsort(-uses[picked], kind="stable")]:
        size, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
        n = min(int(uses[j]), int((free[size] // times).min()))
        counts[j] = n
        free[size] -= n * times
    return counts


def solve(histogram: np.ndarray, window: int, steps: int = STEPS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """histogram[l]: rests of length l (0 counts for nothing). Combinations and how often each is used, whole numbers
    that together use no length more often than it is there. What rounding leaves is solved for again, `rounds` times."""
    combos, free = combinations(window), histogram.astype(np.int64)
    counts = np.zeros(len(combos), np.int64)
    for _ in range(rounds if len(combos) else 0):
        more = _solve(free, combos, steps)
        counts += more
        if not more.any():
            break
    on = counts > 0
    return combos[on], counts[on]


class Plan:
    """Where the k-th rest of each length goes."""

    def __init__(self, histogram: np.ndarray, window: int, first: int):
        """first: number of the first sequence."""
        self.window = window
        combos, counts = solve(histogram, window)
        rows = []
        base = first
        used = np.zeros(window, np.int64)
        for combo, n in zip(combos, counts, strict=True):
            offset = 0
            for x in combo:
                if x:
                    rows.append((int(x), int(used[x]), base, offset))
                    used[x] += n
                    offset += int(x)
            base += int(n)
        # the rests that are left stand end to end, longer ones first
        left = (histogram - used) * np.arange(window)
        left[0] = 0
        self.stream, self.used = base, used
        self.at = np.concatenate((np.cumsum(left[::-1])[::-1][1:], [0]))
        rows.sort()
        self.length, self.rank, self.sequence, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.key = self.length * (1 << 50) + self.rank

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) where each rest begins; one that is cut goes on at offset 0 of the next sequence."""
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        whole = rank < self.used[length]
        if whole.any():
            row = np.searchsorted(self.key, length[whole] * (1 << 50) + rank[whole], "right") - 1
            sequence[whole] = self.sequence[row] + rank[whole] - self.rank[row]
            offset[whole] = self.offset[row]
        rest = ~whole
        place = self.at[length[rest]] + (rank[rest] - self.used[length[rest]]) * length[rest]
        sequence[rest], offset[rest] = self.stream + place // self.window, place % self.window
        return sequence, offset


def _read(batches: Iterator[pa.RecordBatch], path: str, end: int, window: int, width: str, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(id, tokens, full, rest, crcs of the whole windows, ids of the rest, part, row) of each text."""
    encoder, part, row = Encoder.of(path), TaskContext.get().partitionId(), 0
    for batch in batches:
        for i, rows, ids, n in encoded(batch.column("text"), encoder, end):
            ids = ids.astype("<u4")
            raw, small = ids.tobytes(), ids.astype(width)
            starts = np.cumsum(n) - n
            full = n // window
            heads = np.repeat(starts, full) + window * spread(np.zeros(rows, np.int64), full)
            crc = [zlib.crc32(raw[4 * s : 4 * (s + window)]) for s in heads.tolist()]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full))), pa.int32()), pa.array(crc, pa.int64()))
            tails = [small[s:e].tobytes() for s, e in zip((starts + full * window).tolist(), (starts + n).tolist(), strict=True)]
            yield pa.record_batch(
                [
                    batch.column("id").slice(i, rows).cast(kind),
                    pa.array(n),
                    pa.array(full),
                    pa.array(n - full * window, pa.int32()),
                    lists,
                    pa.array(tails, pa.binary()),
                    pa.array(np.full(rows, part), pa.int32()),
                    pa.array(np.arange(row, row + rows)),
                ],
                ["id", "tokens", "full", "rest", "crcs", "tail", "part", "row"],
            )
            row += rows


def _pieces(batches: Iterator[pa.RecordBatch], plan: Plan, width: str) -> Iterator[pa.RecordBatch]:
    w = plan.window
    for batch in batches:
        n, full, rest, rank, first = (batch.column(c).to_numpy().astype(np.int64) for c in ("tokens", "full", "rest", "rank", "first"))
        owner = np.repeat(np.arange(len(n)), full)
        nth = spread(np.zeros(len(n), np.int64), full)
        rows = [(owner, nth * w, np.full(len(owner), w), batch.column("crcs").flatten().to_numpy(), first[owner] + nth, np.zeros(len(owner), np.int64))]
        has = np.flatnonzero(rest)
        sequence, offset = plan.places(rest[has], rank[has])
        head = np.minimum(rest[has], w - offset)
        tails = batch.column("tail").take(pa.array(has)).to_pylist()
        wide = [np.frombuffer(t, width).astype("<u4").tobytes() for t in tails]
        crc = np.array([zlib.crc32(t[: 4 * h]) for t, h in zip(wide, head.tolist(), strict=True)], np.int64)
        begin = full[has] * w
        rows.append((has, begin, head, crc, sequence, offset))
        cut = np.flatnonzero(head < rest[has])
        crc = np.array([zlib.crc32(wide[k][4 * head[k] :]) for k in cut.tolist()], np.int64)
        rows.append((has[cut], begin[cut] + head[cut], rest[has][cut] - head[cut], crc, sequence[cut] + 1, np.zeros(len(cut), np.int64)))
        own, *columns = (np.concatenate([r[i] for r in rows]) for i in range(6))
        start, length, crc, sequence, offset = columns
        yield pa.record_batch(
            [batch.column("id").take(pa.array(own)), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, n[own], sequence, offset))],
            ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Returns (id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of each row of df: its
    place in its document and in its sequence, and the unsigned CRC-32 of its ids as little-endian 32-bit integers.

    A document is its text's ids and the end id; null is an empty text. Sequences have the numbers 0, 1, .. and are full
    but for the last. Repeated rows and ids are documents of their own, told apart by nothing; no rows, no pieces. Texts
    are read whole; other columns are not read."""
    if window < 2:
        raise ValueError("window: 2 tokens at least")
    from pyspark.sql.pandas.types import to_arrow_type

    bounded(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)
    width = "<u2" if max(end, Encoder.of(tokenizer).size) <= 1 << 16 else "<u4"
    docs = materialize(
        rows.mapInArrow(
            thrifty(lambda b: _read(b, tokenizer, end, window, width, arrow)),
            f"id {kind.simpleString()}, tokens long, full long, rest int, crcs array<long>, tail binary, part int, row long",
        ),
        "rests",
    )
    histogram, fulls = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in docs.groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect():
        histogram[r["rest"]], fulls[r["rest"]] = r["n"], r["full"]
    # a length's rows are numbered by groups, groups by heaps, and heaps in one go: a task sees a GROUP-th of a GROUP-th of them
    groups = F.lit([int(max(1, -(-n // GROUP))) for n in histogram])
    bases = F.lit([int(x) for x in np.cumsum(fulls) - fulls])
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("part", "row"), F.get(groups, F.col("rest")))).withColumn("heap", F.floor(F.col("salt") / GROUP))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = salted.groupBy("rest", "heap", "salt").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    heaps, h = sums.groupBy("rest", "heap").agg(F.sum("n").alias("hn"), F.sum("f").alias("hf")), Window.partitionBy("rest").orderBy("heap")
    heaps = heaps.select("rest", "heap", before(h, "hn").alias("hn"), (before(h, "hf") + F.get(bases, F.col("rest"))).alias("hf"))
    g = Window.partitionBy("rest", "heap").orderBy("salt")
    sums = sums.select("rest", "heap", "salt", before(g, "n").alias("n0"), before(g, "f").alias("f0")).join(heaps, ["rest", "heap"])
    sums = sums.select("rest", "salt", (F.col("hn") + F.col("n0")).alias("n0"), (F.col("hf") + F.col("f0")).alias("f0"))
    w = Window.partitionBy("rest", "salt").orderBy("id", "part", "row")
    ranked = salted.withColumns({"k": F.row_number().over(w), "f": before(w, "full")}).join(sums, ["rest", "salt"])
    ranked = ranked.select("id", "tokens", "full", "rest", "crcs", "tail", (F.col("n0") + F.col("k") - 1).alias("rank"), (F.col("f0") + F.col("f")).alias("first"))
    plan = Plan(histogram, window, int(fulls.sum()))
    return ranked.mapInArrow(
        thrifty(lambda b: _pieces(b, plan, width)), f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
