"""Fragmentation strategies: which documents a quad belongs to. assign() returns rows (doc, seq, s, p, o, g)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import is_bnode, is_iri, term_to_string
from ..functions.text import group_count, matches, pattern, resolve_iri
from ..plans.registry import component
from ..plans.storage import materialize
from .closure import blank_links, keyed, owners
from .matchers import Matcher
from .resources import fail, met
from .summaries import Bloom, VoID

FRAGMENT = ["doc", "seq", "s", "p", "o", "g"]


class Strategy:
    stateless = False

    def assign(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def unplaced(self, df: DataFrame) -> DataFrame | None:
        """Rows (warning): what is in no document though it should be; None where that cannot be."""
        return None


def _by_term(df: DataFrame, key: str, value: str, doc: Column) -> DataFrame:
    """Quads whose key is an IRI in its document, and quads whose key is a blank node in those of all that reach it."""
    direct = df.where(is_iri(key)).select(doc.alias("doc"), "seq", "s", "p", "o", "g")
    blank = df.where(is_bnode(key))
    reach = owners(*blank_links(df, key, value))
    owned = met(blank, reach, F.col(f"{key}.value") == F.col("b")).select(F.col("key").alias("doc"), "seq", "s", "p", "o", "g")
    return direct.unionByName(owned)


def unowned(df: DataFrame, key: str = "s", value: str = "o") -> DataFrame:
    """Quads whose blank node in column key no document reaches: they are in no fragment."""
    reach = owners(*blank_links(df, key, value)).select(F.col("b").alias("__b")).distinct()
    return df.where(is_bnode(key)).join(reach, F.col(f"{key}.value") == F.col("__b"), "left_anti")


def _unowned_warnings(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    quad_ = F.concat_ws(" ", *[term_to_string(c) for c in "spo"])
    return unowned(df, key, value).select(F.concat(F.lit(f"Quad with a blank node as {name} that no IRI links to: "), quad_).alias("warning"))


@component("FragmentationStrategySubject")
@dataclass
class BySubject(Strategy):
    """A quad in its subject's document (at relative_path below it, if given); a blank subject's quads in the documents
    of all subjects that reach it; variables in none. Eager or not, all that reach a blank node own it."""

    eager_flushing: bool = True
    relative_path: str | None = None

    def assign(self, df):
        value = F.col("s.value")
        doc = value if self.relative_path is None else resolve_iri(self.relative_path, F.when(value.endswith("/"), value).otherwise(F.concat(value, F.lit("/"))))
        return _by_term(df, "s", "o", doc)

    def unplaced(self, df):
        return _unowned_warnings(df, "s", "o", "subject")


@component("FragmentationStrategyObject")
@dataclass
class ByObject(Strategy):
    """A quad in its object's document; literal objects in none."""

    eager_flushing: bool = True

    def assign(self, df):
        return _by_term(df, "o", "s", F.col("o.value"))

    def unplaced(self, df):
        return _unowned_warnings(df, "o", "s", "object")


@component("FragmentationStrategyResourceObject")
@dataclass
class ByResourceObject(Strategy):
    """All quads of a subject in the document that its target predicate names: the last named before the quad, or else
    the first. Subjects without one are in none; a target that is no IRI is an error.

    Where a subject has few targets, they are intervals of seq, and quads join the interval that they are in. A subject with many
    is dealt out by ranges of seq: within a range targets are filled forward, and each range begins with the last one before it, so
    that no subject is one task's, and its quads do not meet all its targets."""

    target_predicate_regex: str
    #: Targets of a subject up to which quads join their intervals.
    FEW: ClassVar[int] = 32

    def assign(self, df):
        named = df.where(self._names())
        many = materialize(named.groupBy(F.col("s.value").alias("__s")).count().where(F.col("count") > self.FEW).select("__s"), "hubs")
        if many.isEmpty():
            return self._by_intervals(df, named)
        hub = lambda d, how: d.join(many, F.col("s.value") == F.col("__s"), how)
        return self._by_intervals(hub(df, "left_anti"), hub(named, "left_anti")).unionByName(self._by_ranges(hub(df, "left_semi")))

    def _names(self) -> Column:
        return matches(F.col("p.value"), self.target_predicate_regex)

    @staticmethod
    def _target() -> Column:
        problem = F.concat(F.lit("Expected a named node as target of "), F.col("s.value"), F.lit(", but found "), F.col("o.kind"), F.lit(" "), F.col("o.value"))
        return fail(F.col("o.kind") != "iri", problem, F.col("o.value"))

    def _by_intervals(self, df: DataFrame, named: DataFrame) -> DataFrame:
        targets = named.select(F.col("s.value").alias("__s"), F.col("seq").alias("__at"), self._target().alias("doc"))
        w = Window.partitionBy("__s").orderBy("__at")
        spans = targets.select("__s", "doc", F.row_number().over(w).alias("__n"), "__at", F.lead("__at").over(w).alias("__until"))
        # a target holds for the quads after its own, up to the next one's; the first for all before too
        after = (F.col("__n") == 1) | (F.col("seq") > F.col("__at"))
        before = F.col("__until").isNull() | (F.col("seq") <= F.col("__until"))
        return met(df, spans, (F.col("s.value") == F.col("__s")) & after & before).select(*FRAGMENT)

    def _by_ranges(self, df: DataFrame) -> DataFrame:
        rows = df.select("seq", "s", "p", "o", "g", F.col("s.value").alias("__s"), F.when(self._names(), self._target()).alias("__t"))
        rows = materialize(rows.repartitionByRange("__s", "seq").withColumn("__part", F.spark_partition_id()), "ranges")
        # a row for each range of each subject
        ends = rows.where("__t is not null").groupBy("__s", "__part").agg(F.max_by("__t", "seq").alias("last"), F.min_by("__t", "seq").alias("first"))
        parts = rows.select("__s", "__part").distinct().join(ends, ["__s", "__part"], "left")
        w = Window.partitionBy("__s").orderBy("__part")
        carried = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        first = F.first("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        carry = parts.select("__s", "__part", F.coalesce(carried, first).alias("__carry"))
        within = Window.partitionBy("__s", "__part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        filled = rows.withColumn("__doc", F.last("__t", ignorenulls=True).over(within)).join(carry, ["__s", "__part"])
        return filled.withColumn("doc", F.coalesce("__doc", "__carry")).select(*FRAGMENT)

    def unplaced(self, df):
        named = df.where(matches(F.col("p.value"), self.target_predicate_regex)).select("s.value").distinct()
        none = df.select("s.value").distinct().join(named, "value", "left_anti")
        return none.select(F.concat(F.lit("Resource without a target predicate: "), F.col("value")).alias("warning"))


@component("FragmentationStrategyExceptionEntry")
@dataclass
class ExceptionEntry:
    """Quads that match go to this strategy."""

    matcher: Matcher
    strategy: Strategy


@component("FragmentationStrategyException")
@dataclass
class ByException(Strategy):
    """Each quad to the strategy of the first entry that matches it, or else to the base strategy. A matcher with memory
    remembers only quads that reach it."""

    strategy: Strategy
    exceptions: list[ExceptionEntry]

    def _dealt(self, df: DataFrame) -> list[tuple[Strategy, DataFrame]]:
        out, rest = [], df
        for e in self.exceptions:
            marked = e.matcher.mark(rest, "__hit")
            out.append((e.strategy, marked.where("__hit").drop("__hit")))
            rest = marked.where(~F.col("__hit")).drop("__hit")
        return [*out, (self.strategy, rest)]

    def assign(self, df):
        return reduce(DataFrame.unionByName, [s.assign(mine) for s, mine in self._dealt(df)])

    def unplaced(self, df):
        return _all([s.unplaced(mine) for s, mine in self._dealt(df)])


def _all(parts: list[DataFrame | None]) -> DataFrame | None:
    some = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, some) if some else None


@component("FragmentationStrategyComposite")
@dataclass
class Composite(Strategy):
    """Every quad to every strategy."""

    strategies: list[Strategy]

    def assign(self, df):
        parts = [s.assign(df) for s in self.strategies]
        return reduce(DataFrame.unionByName, parts) if parts else df.withColumn("doc", F.lit("")).where(F.lit(False)).select(*FRAGMENT)

    def unplaced(self, df):
        return _all([s.unplaced(df) for s in self.strategies])


@component("FragmentationConstant")
@dataclass
class Constant(Strategy):
    """All quads in one document."""

    path: str
    stateless = True

    def assign(self, df):
        return df.withColumn("doc", F.lit(self.path)).select(*FRAGMENT)


def datasets(value: Column, patterns: list[str]) -> Column:
    """All that the patterns' first matches and groups give, distinct; groups that match nothing give nothing."""
    found = [F.when(matches(value, p), F.array(*[F.nullif(F.regexp_extract(value, pattern(p), i), F.lit("")) for i in range(group_count(p) + 1)])) for p in patterns]
    flat = F.flatten(F.array(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))
    return F.array_distinct(F.filter(flat, lambda x: x.isNotNull()))


class DatasetSummary(Strategy):
    """Quads grouped by the datasets of their subject, blank nodes' quads by those that reach them; summaries of these
    groups instead of the quads."""

    dataset_patterns: list[str]

    def grouped(self, df: DataFrame) -> DataFrame:
        """Rows (dataset, s, p, o), and what keyed() says of their blank nodes."""
        return keyed(df, datasets(F.col("s.value"), self.dataset_patterns)).withColumnRenamed("key", "dataset")

    def _placed(self, summary: DataFrame) -> DataFrame:
        return summary.withColumn("seq", F.array(F.xxhash64("s", "p", "o"))).select(*FRAGMENT)


@component("FragmentationStrategyDatasetSummaryVoID")
@dataclass
class ByVoID(DatasetSummary):
    """VoID descriptions; a dataset's is in the document of its IRI."""

    dataset_patterns: list[str]

    def assign(self, df):
        return self._placed(VoID().summarize(self.grouped(df)))


@component("FragmentationStrategyDatasetSummaryBloom")
@dataclass
class ByBloom(DatasetSummary):
    """Bloom filters; a dataset's are in the document that the first matching location pattern finds in its IRI, or
    else in that of its IRI."""

    dataset_patterns: list[str]
    hash_bits: int
    hash_count: int
    location_patterns: list[str]

    def assign(self, df):
        dataset = F.col("dataset")
        location = F.coalesce(*[F.when(matches(dataset, p), F.regexp_extract(dataset, pattern(p), 0)) for p in self.location_patterns], dataset)
        return self._placed(Bloom(self.hash_bits, self.hash_count).summarize(self.grouped(df), location))
