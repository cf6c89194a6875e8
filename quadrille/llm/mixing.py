"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to); a small network then
routes each pattern's tokens to its sources' quotas. A pattern can be taken again and again, up to a limit, at a cost
that rises with each repetition (convex, so that fresh tokens always go first and repeats spread evenly). As only the arcs
into patterns cost anything, the cheapest paths are those of the fewest repetitions: the flow is made greatest for
first passes, then augmented with second ones, and so on, each time by blocking flows. What flows out of a pattern is whole
passes over its documents, and of one last pass the documents of least seeded hash, the last of them in part, so that the
words taken add up to the flow.

Only sums by pattern, and by hash range within a pattern, reach the driver.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, materialize

#: Times a document is taken at most.
REPEATS = 3
#: Patterns whose sums the driver takes at most; more are an error, not a sample. (So many of one source each take 2 s there,
#: so many that overlap at random 16 s.)
PATTERNS = 100_000
#: Hash ranges that the last pass over a pattern is cut into, level by level, and the documents of a range that are few
#: enough to be put in order.
RANGES, FEW = 256, 1000


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(weights: list[Fraction], caps: list[Fraction], total: Fraction) -> list[Fraction]:
    """Shares of the total in proportion to the weights, each at most its cap; what caps cut off is shared again by
    weight among the others until none exceeds its cap, or all are full."""
    share, left, weight = [Fraction(0)] * len(caps), Fraction(total), sum(weights, Fraction(0))
    # the first to be full is the one of least cap for its weight
    for i in sorted((i for i in range(len(caps)) if weights[i]), key=lambda i: caps[i] / weights[i]):
        share[i] = min(caps[i], left * weights[i] / weight)
        left -= share[i]
        weight -= weights[i]
    return share


class Network:
    """Arcs with capacities; flow() augments to a greatest flow from what is there, by blocking flows on shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def flow(self, source: int, sink: int) -> None:
        out, to, cap = self.out, self.to, self.cap
        while True:
            far = [-1] * len(out)
            far[source] = 0
            queue = deque([source])
            while queue and far[sink] < 0:
                x = queue.popleft()
                for e in out[x]:
                    if cap[e] and far[to[e]] < 0:
                        far[to[e]] = far[x] + 1
                        queue.append(to[e])
            if far[sink] < 0:
                return
            nth = [0] * len(out)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    # goes on from the first arc that is full
                    k = next(i for i, e in enumerate(path) if not cap[e])
                    x = to[path[k] ^ 1]
                    del path[k:]
                while nth[x] < len(out[x]):
                    e = out[x][nth[x]]
                    if cap[e] and far[to[e]] == far[x] + 1:
                        path.append(e)
                        x = to[e]
                        break
                    nth[x] += 1
                else:
                    if x == source:
                        break
                    e = path.pop()
                    x = to[e ^ 1]
                    nth[x] += 1


def route(patterns: list[tuple[tuple, int]], targets: dict, repeats: int = REPEATS) -> list[dict]:
    """patterns: (its sources, words), distinct. For each the words that go to each source: of the flows that meet most of the
    targets, one of least cost, where the r-th pass over a pattern costs r - 1 a word. A source that no other shares a pattern with
    needs no network."""
    times: dict = {}
    for p, _ in patterns:
        for s in p:
            times[s] = times.get(s, 0) + 1
    out: list[dict] = [{} for _ in patterns]
    apart = [len(p) == 1 and times[p[0]] == 1 for p, _ in patterns]
    for i, (p, words) in enumerate(patterns):
        if apart[i] and (n := min(repeats * words, int(round(targets.get(p[0], 0))))) > 0:
            out[i][p[0]] = n
    others = [i for i in range(len(patterns)) if not apart[i]]
    names = list(dict.fromkeys(s for i in others for s in patterns[i][0]))
    at = {s: 1 + len(others) + k for k, s in enumerate(names)}
    sink = 1 + len(others) + len(names)
    net = Network(sink + 1)
    into = [net.arc(0, 1 + k, 0) for k in range(len(others))]
    edges = [(net.arc(1 + k, at[s], repeats * patterns[i][1]), i, s) for k, i in enumerate(others) for s in patterns[i][0]]
    for s in names:
        net.arc(at[s], sink, int(round(targets.get(s, 0))))
    for _ in range(repeats):
        for e, i in zip(into, others, strict=True):
            net.cap[e] += patterns[i][1]
        net.flow(0, sink)
    for e, i, s in edges:
        if net.cap[e ^ 1]:
            out[i][s] = net.cap[e ^ 1]
    return out


def _rank(seed: int, name: str) -> Column:
    """A document's place in the seeded order: 60 bits of MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(name).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _tie(text: Column) -> Column:
    """The order of rows of one id: 30 bits of the text's hash, then 30 of where the row was read. Rows that only the latter
    tells apart are equal, so the results are the same whichever has which."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 34), 30).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 34))


def _cutoffs(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each pattern of wanted (pattern, want): the range (rank from r on, r_width wide; in it tie from t on, t_width wide) of
    few rows in which the words of rows in ascending order reach want, and the words `last` still wanted there. Goes down
    ranges of rank, 256 at a time, then of tie where a rank has many rows."""
    whole = 1 << 60
    now = wanted.select("pattern", *[F.lit(x).cast("long").alias(c) for c, x in (("r", 0), ("r_width", whole), ("t", 0), ("t_width", whole))], F.col("want").alias("last"))
    for name, low, wide in (("rank", "r", "r_width"), ("tie", "t", "t_width")):
        width = whole
        while width > 1:
            width = max(1, width // RANGES)
            inside = rows.join(F.broadcast(now), "pattern").where(_inside())
            nth = F.floor((F.col(name) - F.col(low)) / F.lit(width)).cast("long")
            sums = inside.groupBy(*now.columns, nth.alias("k")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
            before = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            hit = sums.withColumn("before", before).where((F.col("before") < F.col("last")) & (F.col("before") + F.col("words") >= F.col("last")))
            new = {low: F.col(low) + F.col("k") * F.lit(width), wide: F.lit(width).cast("long"), "last": F.col("last") - F.col("before")}
            hit = materialize(hit.select(*[new.get(c, F.col(c)).alias(c) for c in now.columns], "n"), "cutoff")
            most = hit.agg(F.max("n")).first()[0]
            now = hit.drop("n")
            if most is None or most <= FEW:
                return now
    return now


def _inside() -> Column:
    r, t = F.col("rank") - F.col("r"), F.col("tie") - F.col("t")
    return (r >= 0) & (r < F.col("r_width")) & (t >= 0) & (t < F.col("t_width"))


def mixture(
    df: DataFrame,
    targets: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    repeats: int = REPEATS,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """mix() with columns of df that go along: (row, size, source_size, target, taken, copies), row being a struct of id_col
    and `keep`. Rows are written once, and not moved."""
    many = isinstance(df.schema[source_col].dataType, T.ArrayType)
    of = F.col(source_col).cast("array<string>") if many else F.array(F.col(source_col).cast("string"))
    of = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(of), F.lit(0)) > 0, of).otherwise(F.array(F.lit(None).cast("string")))))
    row = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys((id_col, *keep))])
    rows = df.select(row.alias("row"), of.alias("sources"), word_count(F.col(text_col)).alias("size"), _rank(seed, id_col).alias("rank"), _tie(F.col(text_col)).alias("tie"))
    rows = materialize(rows, "sizes")
    sums = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(PATTERNS + 1).collect()
    if len(sums) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} membership patterns")
    patterns = sorted(((tuple(r["sources"]), r["words"]) for r in sums), key=lambda p: [(s is None, s or "") for s in p[0]])
    size: dict = {}
    for p, words in patterns:
        for s in p:
            size[s] = size.get(s, 0) + words
    names = sorted(size, key=lambda s: (s is None, s or ""))
    if targets is None:
        share = water_fill([Fraction(weights[i % len(weights)]) for i in range(len(names))], [Fraction(repeats * size[s]) for s in names], Fraction(sum(w for _, w in patterns)))
        targets = dict(zip(names, share, strict=True))
    taken = [sum(f.values()) for f in route(patterns, targets, repeats)]
    plan = pa.table(
        {
            "sources": pa.array([list(p) for p, _ in patterns], pa.list_(pa.string())),
            "pattern": pa.array(range(len(patterns)), pa.int64()),
            "source_size": pa.array([sum(size[s] for s in p) for p, _ in patterns], pa.int64()),
            "target": pa.array([float(sum(targets.get(s, 0) for s in p)) for p, _ in patterns], pa.float64()),
            "passes": pa.array([min(repeats, t // words) if words else 0 for t, (_, words) in zip(taken, patterns, strict=True)], pa.int64()),
            "want": pa.array([t % words if words else 0 for t, (_, words) in zip(taken, patterns, strict=True)], pa.int64()),
        }
    )
    table = materialize(df.sparkSession.createDataFrame(plan), "plan")
    # no more rows than PATTERNS, whatever df
    told = rows.join(F.broadcast(table), "sources")
    cuts = _cutoffs(told.where("want > 0").select("pattern", "size", "rank", "tie"), table.where("want > 0").select("pattern", "want"))
    told = told.join(F.broadcast(cuts), "pattern", "left")
    edge = told.where(_inside())
    before = F.coalesce(F.sum("size").over(Window.partitionBy("pattern").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("last") - before)))
    first = (F.col("rank") < F.col("r")) | ((F.col("rank") < F.col("r") + F.col("r_width")) & (F.col("tie") < F.col("t")))
    rest = told.where(~F.coalesce(_inside(), F.lit(False))).withColumn("extra", F.when(first, F.col("size")).otherwise(0))
    words = F.col("passes") * F.col("size") + F.col("extra")
    return rest.unionByName(edge).select(
        "row",
        "size",
        "source_size",
        "target",
        words.cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.floor(words / F.col("size"))).otherwise(0).cast("int").alias("copies"),
    )


def mix(
    df: DataFrame,
    targets: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    repeats: int = REPEATS,
    seed: int = 0,
) -> DataFrame:
    """Returns (id, size, source_size, target, taken, copies) for every row: its words, those of its source, the
    source's target, and the words and whole copies that the mix takes of it.

    source_col holds a source (null is one, the last) or an array of the sources that a row belongs to; null
    elements and repetitions in an array count once, an empty array is the source null. For rows of several sources, source_size and target
    are sums over them. Without targets (words by source), sources in code-point order weigh `weights`, repeating, and
    share all words, each at most `repeats` times its size, the excess shared again. A row is taken whole some times,
    at most `repeats`, but for one row of each pattern at most, taken in part. Equal rows and ids are told apart by
    nothing, so which of them is taken in part is open, the multiset of results is not. Null and blank texts have no
    words, and none are taken. Same rows, same seed: same result. At most PATTERNS sets of sources."""
    rows = mixture(df, targets, id_col, text_col, source_col, weights, repeats, seed)
    return rows.select(F.col("row")[id_col].alias("id"), "size", "source_size", "target", "taken", "copies")
