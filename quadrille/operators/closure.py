"""Owners of blank nodes: which keys reach a blank node through links and through other blank nodes."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_bnode, is_iri
from ..plans.storage import materialize, repeatable, sieve


def owners(links: DataFrame, edges: DataFrame) -> DataFrame:
    """links (b, key): key reaches b at once; edges (a, b): who reaches a reaches b. Returns the distinct (b, key) of all
    that is reached; cycles end.

    A blank node that only one other names, and no key, has that one's owners. Such chains (lists, nested values) are cut
    short by pointers that double their reach each round, so that rounds grow with the logarithm of the longest chain. What is left,
    blank nodes that several name, is followed step by step from the keys on, each round extending what the last one found."""
    known = materialize(links.select("b", "key").distinct(), "owners")
    edges = edges.select("a", "b").where("a <> b").distinct()
    if edges.isEmpty():
        return known
    edges = materialize(edges, "edges")
    direct = known.select("b").distinct()
    single = edges.groupBy("b").agg(F.min("a").alias("up"), F.count("*").alias("n")).where("n = 1").select("b", "up").join(direct, "b", "left_anti")
    single, n = _shortened(materialize(single, "chains"))
    # on the blank nodes that end a chain; those below a cycle of single ones have no owner
    ends = single.select(F.col("b").alias("a"), "up")
    rest = edges.join(single.select("b"), "b", "left_anti") if n else edges
    rest = rest.join(ends, "a", "left").select(F.coalesce("up", "a").alias("a"), "b").where("a <> b").distinct() if n else rest
    rest = materialize(rest, "edges")
    found = known if rest.isEmpty() else _followed(known, rest)
    if not n:
        return found
    below = single.join(found.withColumnRenamed("b", "up"), "up").select("b", "key")
    return found.unionByName(below)


def _shortened(pointers: DataFrame) -> tuple[DataFrame, int]:
    """(b, up) with up the first node above b that has no pointer, and how many there are. Those that lead into a cycle go."""
    n = pointers.count()
    for _ in range(n.bit_length() + 1):
        above = pointers.select(F.col("b").alias("up"), F.col("up").alias("top"))
        if not n or pointers.join(above, "up", "left_semi").isEmpty():
            return pointers, n
        pointers = materialize(pointers.join(above, "up", "left").select("b", F.coalesce("top", "up").alias("up")), "chains")
    return pointers.join(pointers.select(F.col("b").alias("up")), "up", "left_anti").select("b", "up"), n


def _followed(known: DataFrame, edges: DataFrame) -> DataFrame:
    frontier = known
    while True:
        found = frontier.withColumnRenamed("b", "a").join(edges, "a").select("b", "key").distinct()
        frontier = materialize(found.join(known, ["b", "key"], "left_anti"), "owners")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)


def blank_links(df: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(links, edges) of quads: documents are the IRIs in column key, and blank nodes in column value hang on to them."""
    pending = df.where(F.col(f"{value}.kind") == "bnode")
    links = pending.where(F.col(f"{key}.kind") == "iri").select(F.col(f"{value}.value").alias("b"), F.col(f"{key}.value").alias("key"))
    edges = pending.where(F.col(f"{key}.kind") == "bnode").select(F.col(f"{key}.value").alias("a"), F.col(f"{value}.value").alias("b"))
    return links, edges


def _codes(*labels: pa.Array) -> tuple[list[np.ndarray], int]:
    """Numbers of labels, -1 for null, and how many there are."""
    found = pa.chunked_array(labels).combine_chunks().dictionary_encode()
    at = found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(at, np.cumsum([len(x) for x in labels])[:-1]), len(found.dictionary)


def _near(s: pa.Array, o: pa.Array, p: pa.Array, keys: pa.Array, s_far: pa.Array, o_far: pa.Array) -> pa.Array:
    """Of the quads of a batch (blank subject, blank object, a number of the predicate, keys of an IRI subject, and whether the blank
    nodes occur in other batches): keys of a quad whose subject hangs on one by links that are all here; whether its object is such, and
    linked but once; whether it is the first quad of its subject, and with this predicate. first_at: blank nodes where they
    first occur; batch: a number of the batch."""
    (s_at, o_at), n = _codes(s, o)
    rows = np.arange(len(s))
    links = rows[o_at >= 0]
    once = np.bincount(o_at[links], minlength=n) == 1
    row = np.full(n, -1)
    row[o_at[links]] = links
    for at, far in ((s_at, s_far), (o_at, o_far)):
        once[at[far.fill_null(False).to_numpy(zero_copy_only=False) & (at >= 0)]] = False
    row[~once] = -1
    # the row above a row: the one that links to its subject; IRI subjects are above all, and a chain that ends elsewhere ends at -1
    up = np.where(s_at >= 0, row[s_at] if n else -1, rows)
    for _ in range(len(rows).bit_length() + 1):
        above = np.where(up >= 0, up[up], -1)
        if np.array_equal(above, up):
            break
        up = above
    up = np.where((up >= 0) & (s_at[up] < 0), up, -1)  # a cycle has no end
    given = keys.take(pa.array(up, mask=up < 0))
    near = (o_at >= 0) & once[o_at] & (up >= 0) if n else np.zeros(len(rows), bool)

    def first(*at: np.ndarray) -> np.ndarray:
        order = np.lexsort(at)
        new = np.ones(len(order), bool)
        new[1:] = np.any([x[order][1:] != x[order][:-1] for x in at], 0)
        out = np.zeros(len(order), bool)
        out[order[new]] = True
        return out

    none = (s_at < 0) | (up < 0)
    number = p.to_numpy(zero_copy_only=False)
    seen, where = np.unique(np.concatenate([s_at, o_at]), return_index=True)
    new = np.zeros(2 * len(rows), bool)
    new[where[seen >= 0]] = True
    batch = int.from_bytes(os.urandom(7), "little")
    columns = {
        "keys": given,
        "near": pa.array(near),
        "first": pa.array(first(s_at), mask=none),
        "first_p": pa.array(first(number, s_at), mask=none),
        "new_s": pa.array(new[: len(rows)]),
        "new_o": pa.array(new[len(rows) :]),
        "batch": pa.array(np.full(len(rows), batch)),
    }
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


_NEAR = "keys array<string>, near boolean, first boolean, first_p boolean, new_s boolean, new_o boolean, batch bigint"


def keyed(df: DataFrame, keys: Column) -> DataFrame:
    """Rows (key, s, p, o, near, first, first_p) of quads: those of an IRI subject with each of its keys (an array of strings), those of
    a blank one with each key of all that reach it. near: the object is a blank node that no other quad has as object; first: of a blank subject whose
    quads are marked, one is true, and one for each predicate in first_p; else null.

    Most blank nodes are named within a few rows. Where all quads that name one are in the same batch of rows, and only one links to it, it
    has that one's keys, and its quads do not move. Hashes of labels with numbers of batches tell which are also named elsewhere; these, and those
    that several name, are followed by owners()."""
    df = repeatable(df.select("s", "p", "o"), "quads")
    flags = {"near": F.lit(False), "first": F.lit(None).cast("boolean"), "first_p": F.lit(None).cast("boolean")}
    blank = df.where(is_bnode("s") | is_iri("s") & is_bnode("o"))
    s, o = F.when(is_bnode("s"), F.col("s.value")), F.when(is_bnode("o"), F.col("o.value"))
    given, predicate = F.when(is_iri("s"), keys), F.xxhash64("p")
    marks = F.arrow_udf(_near, _NEAR)
    label = lambda c: F.xxhash64(F.lit(3), c)
    no = F.lit(False)
    # the same columns go to the function both times, so that batches end at the same rows
    seen = blank.select(s.alias("s"), o.alias("o"), marks(s, o, predicate, given, no, no).alias("n"))
    seen = seen.select("n.batch", F.explode(F.array(F.when(F.col("n.new_s"), label(F.col("s"))), F.when(F.col("n.new_o"), label(F.col("o"))))).alias("h")).where("h is not null")
    far = materialize(seen.groupBy("h").agg(F.min("batch").alias("low"), F.max("batch").alias("high")).where("low < high").select("h"), "far")
    passes = sieve(far, "h")
    apart = lambda c: F.coalesce(passes(F.when(c.isNotNull(), label(c))), no)
    near = blank.select("s", "p", "o", marks(s, o, predicate, given, apart(s), apart(o)).alias("n"))
    near = near.select("s", "p", "o", "n.keys", "n.near", "n.first", "n.first_p", F.when(F.col("n.keys").isNull(), s).alias("b"))
    plain = df.where(is_iri("s") & ~is_bnode("o")).select("s", "p", "o", keys.alias("keys"), *[c.alias(k) for k, c in flags.items()], F.lit(None).cast("string").alias("b"))
    rows = materialize(plain.unionByName(near), "keyed", compression="zstd")
    direct = rows.where("keys is not null").select(F.explode("keys").alias("key"), "s", "p", "o", *flags)
    rest = rows.where("keys is null")
    if rest.isEmpty():
        return direct
    open_ = rows.where(is_bnode("o") & ~F.col("near"))
    links = open_.where("keys is not null").select(F.col("o.value").alias("b"), F.explode("keys").alias("key"))
    reach = owners(links, open_.where("keys is null").select(F.col("b").alias("a"), F.col("o.value").alias("b")))
    met = rest.select("b", "s", "p", "o").hint("merge").join(reach.select("b", "key"), "b")
    return direct.unionByName(met.select("key", "s", "p", "o", *[c.alias(k) for k, c in flags.items()]))
