"""Near-copies by the Jaccard similarity of word shingles.

Candidates come from two kinds of buckets. SimHash fingerprints of the shingles, compared bit-sliced (simhash.py), bring
together what differs in a few bits; but texts of similarity 0.8 lie about ten bits apart, which no radius of such a search
reaches, so min-wise hashes in bands bring together the rest: two texts of similarity 0.8 agree in none of 28 bands of 5
hashes in one case of 65,000, more similar ones less often. Within buckets links are exact, from the sets themselves, and so that
a bucket with a third of all texts is no task's and makes no pairs: each text first meets the least of its
bucket; buckets whose texts then are all connected, as copies of one text are, are done. In others the few texts apart from the main
group meet all of it, and where they are not few, blocks of texts meet blocks, by tasks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, bounded, materialize, sieve, sifted, thrifty
from .components import components
from .simhash import majority, near_links

SHINGLE = 5
#: Texts are near-copies from this similarity on, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 28, 5
#: Texts of a bucket apart from its main group that meet it one by one; texts of a block where they are more.
FEW, BLOCK = 16, 500
_SEED = 42
_rng = np.random.default_rng(_SEED)
_XOR, _TIMES = _rng.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_TIMES |= np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted XXH64 values of a text's shingles, each once; a text of fewer words is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[s:e], _SEED) for s, e in spans), np.uint64, n))


def bands(found: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for a text without words."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 512):
        np.minimum(least, ((found[i : i + 512, None] ^ _XOR) * _TIMES).min(0), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def with_bands(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df and struct(key, fp, bands) of text in the column `name`: key is the same for equal sets of shingles, fp their SimHash
    fingerprint as a signed long."""

    def sketch(texts: pa.Array) -> pa.Array:
        keys, prints, found = [], [], []
        for x in texts:
            own = shingles(x.as_py())
            keys.append(xxhash.xxh128_digest(own.tobytes(), _SEED))
            prints.append(majority(own))
            found.append(bands(own))
        columns = [pa.array(keys, pa.binary()), pa.array(prints, pa.uint64()).view(pa.int64()), pa.array(found, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(columns, ["key", "fp", "bands"])

    bounded(df.sparkSession)
    return df.withColumn(name, arrow_column(sketch, "key binary, fp long, bands array<long>")(text.cast("string")))


def spanning(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets of similarity SIMILAR or more which connect all that such links connect."""
    over, under = SIMILAR
    m = len(sets)
    size = np.array([len(s) for s in sets])
    end = np.cumsum(size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    own = [np.sort(rank[token[e - n : e]]) for e, n in zip(end, size, strict=True)]
    # two sets that share SIMILAR of their union share one of the first of each, in any common order
    first = [x[: len(x) - -(-over * len(x) // under) + 1] for x in own]
    left, marked, links = np.ones(m, bool), np.zeros(len(often), bool), []
    indexed = 0

    def index() -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(left)
        tokens = np.concatenate([first[i] for i in at])
        whose = np.repeat(at, [len(first[i]) for i in at])
        order = np.argsort(tokens, kind="stable")
        return tokens[order], whose[order]

    for i in range(m):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue and (rest := int(left.sum())):
            x = queue.pop()
            if not indexed or rest < indexed / 2:
                tokens, whose = index()
                indexed = rest
            low, high = np.searchsorted(tokens, first[x], "left"), np.searchsorted(tokens, first[x], "right")
            some = [whose[a:b] for a, b in zip(low, high, strict=True) if b > a]
            if not some:
                continue
            meets = np.unique(np.concatenate(some))
            meets = meets[left[meets]]
            meets = meets[(under * size[meets] >= over * size[x]) & (under * size[x] >= over * size[meets])]
            marked[own[x]] = True
            for k in range(0, len(meets), 1024):
                part = meets[k : k + 1024]
                shared = np.add.reduceat(marked[np.concatenate([own[y] for y in part])], np.cumsum(size[part]) - size[part], dtype=np.int64)
                near = part[under * shared >= over * (size[x] + size[part] - shared)]
                left[near] = False
                links += [(x, int(y)) for y in near]
                queue += near.tolist()
            marked[own[x]] = False
    return links


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, x, y) the pairs a, b whose texts x and y are near-copies. A text that many meet is cut into shingles once."""
    over, under = SIMILAR
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        hit = []
        for i, x, y in zip(batch.column("b").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
            if i not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[i] = shingles(y.as_py())
            own, other = shingles(x.as_py()), held[i]
            shared = len(np.intersect1d(own, other, assume_unique=True))
            hit.append(under * shared >= over * (len(own) + len(other) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))


def _met(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are near-copies. Joined by merging whatever the size, as neither side has a bound."""
    both = texts.select(F.col("id").alias("a"), F.col("text").alias("x")).hint("merge").join(pairs, "a").hint("merge")
    both = both.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(thrifty(_similar), "a long, b long"), "near-pairs")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, i, j, id, text), sorted: links between the texts of each (root, i, j)."""
    group, ids, sets = None, [], []

    def done() -> pa.RecordBatch:
        links = spanning(sets) if len(sets) > 1 else []
        return pa.record_batch({c: pa.array([ids[x[k]] for x in links], pa.int64()) for k, c in enumerate("ab")})

    for batch in batches:
        for *own, i, text in zip(*(batch.column(c) for c in ("root", "i", "j", "id", "text")), strict=True):
            own = [x.as_py() for x in own]
            if group is not None and own != group:
                yield done()
                ids, sets = [], []
            group = own
            ids.append(i.as_py())
            sets.append(shingles(text.as_py()))
    if ids:
        yield done()


def _in_blocks(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Links within what buckets (k, id) connect, by blocks: each two texts of such a group are in some task together."""
    low = members.groupBy("k").agg(F.min("id").alias("b"))
    clusters = components(materialize(members.join(low, "k").where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "clusters"))
    n = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("id", F.lit(3)), F.col("n")).cast("int")
    with_others = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("i"), F.greatest(o, F.col("mine")).alias("j")))
    # a block meets itself where it meets the first other one
    pairs = F.when(F.col("n") == 1, with_others).otherwise(F.filter(with_others, lambda p: p["i"] != p["j"]))
    dealt = clusters.join(n, "root").select("root", "n", F.col("node").alias("id")).withColumn("mine", mine).select("root", "id", F.explode(pairs).alias("p"))
    dealt = dealt.select("root", "p.i", "p.j", "id").join(texts, "id").select("root", "i", "j", "id", "text")
    keys = ["root", "i", "j"]
    return materialize(dealt.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(thrifty(_blocks), "a long, b long"), "near-sets")


def near_sets(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """(node, root) of the texts that near-copies connect, as components() gives them. rows: (id, text), ids distinct;
    sketches: (id, fp, bands) of those to compare."""
    prints = materialize(sketches.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    keys = sketches.select("id", F.explode("bands").alias("k"))
    low = keys.groupBy("k").agg(F.min("id").alias("low"), F.count("*").alias("size")).where("size > 1")
    keys = materialize(keys.hint("merge").join(low, "k").select("k", "id", "low", "size"), "buckets")
    # candidates are (a, b) with a > b: a text and the least of a bucket, and fingerprints that differ in a few bits or none
    name = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_id"))
    near = near_links(prints.select("fp")).join(name("a"), "a").join(name("b"), "b").select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b"))
    same = sketches.select("id", "fp").join(prints, "fp").select(F.col("id").alias("a"), F.col("least").alias("b"))
    pairs = keys.select(F.col("id").alias("a"), F.col("low").alias("b")).unionByName(near).unionByName(same)
    pairs = materialize(pairs.where("a <> b").distinct(), "candidates")
    # the texts of all others are not looked at again, nor moved
    some = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = sifted(rows.select("id", F.col("text").cast("string").alias("text")), "id", sieve(some, "id"))
    texts = materialize(texts.hint("merge").join(some, "id", "left_semi"), "candidate-texts")
    # each with its least partner first; then all pairs that this has not brought under one
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    links = _met(texts, first)
    led = lambda c: links.select(F.col("a").alias(c), F.col("b").alias(f"{c}_led"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(led("a"), "a", "left").join(led("b"), "b", "left")
    links = links.unionByName(_met(texts, apart.where(F.coalesce("a_led", "a") != F.coalesce("b_led", "b")).select("a", "b")))
    found = materialize(components(links), "found")
    # what is left: buckets of three or more whose texts are not all connected
    placed = keys.where("size > 2").join(found, F.col("id") == F.col("node"), "left").select("k", "id", "size", F.coalesce("root", "id").alias("root"))
    kinds = placed.groupBy("k", "size", "root").agg(F.count("*").alias("n")).groupBy("k", "size").agg(F.max("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("main"))
    mixed = materialize(placed.drop("size").join(kinds.where("n < size").select("k", "main", (F.col("size") - F.col("n")).alias("others")), "k"), "mixed")
    many = mixed.agg(F.max("others")).first()[0]
    if many is None:
        return found
    few = mixed.where(F.col("others") <= FEW)
    lone = few.where("root <> main").select("k", F.col("id").alias("x"), F.col("root").alias("x_root"))
    meets = few.join(lone, "k").where("root <> x_root").select(F.greatest("id", "x").alias("a"), F.least("id", "x").alias("b")).distinct()
    more = _met(texts, meets.join(pairs, ["a", "b"], "left_anti"))
    if many > FEW:
        more = more.unionByName(_in_blocks(texts, mixed.where(F.col("others") > FEW).select("k", "id")))
    return found if more.isEmpty() else components(links.unionByName(more))
