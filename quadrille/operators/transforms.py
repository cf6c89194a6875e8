"""Transformers: DataFrame of quads in, DataFrame of quads out. Columns that are no quad's go along untouched."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, flat_map, iri, is_bnode, is_iri, is_type_quad, literal, position, quad, this_quad
from ..functions.text import code_sum, group, group_count, js_replace, matches, resolve_iri
from ..plans.registry import component
from ..plans.storage import materialize, repeatable
from .matchers import Matcher
from .near import owned
from .resources import fail, looked_up, met, rename, resources
from .templates import GroupModifier

SCL = "https://w3id.org/scl/vocab#"
SOLID = "http://www.w3.org/ns/solid/terms#"


class Transformer:
    #: Whether quads are transformed one by one, so that a stream can be too.
    stateless = True

    def apply(self, df: DataFrame, allowed: str | None = None) -> DataFrame:
        """allowed: "subject" or "object" limits operators that rename resources to that position."""
        raise NotImplementedError


def apply_all(transformers: list[Transformer], df: DataFrame) -> DataFrame:
    return reduce(lambda d, t: t.apply(d), transformers, df)


@component("QuadTransformerIdentity")
@dataclass
class Identity(Transformer):
    """Each quad."""

    def apply(self, df, allowed=None):
        return df


@component("QuadTransformerClone")
@dataclass
class Clone(Transformer):
    """Each quad twice."""

    def apply(self, df, allowed=None):
        return flat_map(df, F.array(this_quad(), this_quad()))


class TermTransformer(Transformer):
    """Maps the term in every position."""

    def term(self, t: Column) -> Column:
        raise NotImplementedError

    def apply(self, df, allowed=None):
        return df.withColumns({c: self.term(F.col(c)) for c in "spog"})


def _with_value(t: Column, value: Column, kind: Column | None = None) -> Column:
    return F.struct((t["kind"] if kind is None else kind).alias("kind"), value.alias("value"), t["datatype"].alias("datatype"), t["lang"].alias("lang"))


@component("QuadTransformerReplaceIri")
@dataclass
class ReplaceIri(TermTransformer):
    """The first match in an IRI replaced; $1.. are groups."""

    search_regex: str
    replacement_string: str

    def term(self, t):
        return _with_value(t, F.when(is_iri(t), js_replace(t["value"], self.search_regex, self.replacement_string)).otherwise(t["value"]))


@component("QuadTransformerDistributeIri")
@dataclass
class DistributeIri(TermTransformer):
    """As ReplaceIri, the replacement being chosen by the number in the first group, modulo their number."""

    search_regex: str
    replacement_strings: list[str]

    def __post_init__(self):
        if group_count(self.search_regex) < 1:
            raise ValueError("The \"searchRegex\" must have at least one group")

    def term(self, t):
        first = group(t["value"], self.search_regex, 1)
        digits = F.regexp_extract(first, r"^\s*([+-]?[0-9]+)", 1)
        number = F.when(digits != "", digits.cast("decimal(38,0)"))
        n = len(self.replacement_strings)
        choices = F.array(*[js_replace(t["value"], self.search_regex, r) for r in self.replacement_strings])
        chosen = F.get(choices, F.pmod(number, F.lit(n)).cast("int"))
        hit = is_iri(t) & matches(t["value"], self.search_regex)
        wrong = F.concat(F.lit("The first group must match a number: "), t["value"])
        return _with_value(t, F.when(hit, fail(number.isNull(), wrong, chosen)).otherwise(t["value"]))


@component("QuadTransformerBlankToNamed")
@dataclass
class BlankToNamed(TermTransformer):
    """A blank node becomes an IRI where the replacement changes its label."""

    search_regex: str
    replacement_string: str

    def term(self, t):
        new = js_replace(t["value"], self.search_regex, self.replacement_string)
        named = _with_value(t, new, F.when(new != t["value"], F.lit("iri")).otherwise(t["kind"]))
        # most terms stay as they are, and a match is sought first, which is cheaper than what replaces it
        return F.when((t["kind"] == "bnode") & matches(t["value"], self.search_regex), named).otherwise(t)


@component("QuadTransformerSetIriExtension")
@dataclass
class SetIriExtension(TermTransformer):
    """IRIs (that match, if there is a pattern) with their extension, if any, replaced."""

    extension: str
    iri_pattern: str | None = None

    def term(self, t):
        hit = is_iri(t) & (matches(t["value"], self.iri_pattern) if self.iri_pattern else F.lit(True))
        return _with_value(t, F.when(hit, F.concat(F.regexp_replace(t["value"], r"\.[A-Za-z]*\z", ""), F.lit("." + self.extension))).otherwise(t["value"]))


@component("QuadTransformerBlankToFragment")
@dataclass
class BlankToFragment(Transformer):
    """A blank node becomes a fragment of the IRI of the first subject that has it as object: in that quad's object, and
    as subject of later quads. A blank subject that has none by then is an error."""

    stateless = False

    def apply(self, df, allowed=None):
        blank_s, link = is_bnode("s"), is_iri("s") & is_bnode("o")
        label = F.when(blank_s, F.col("s.value")).when(link, F.col("o.value"))
        near, far = owned(repeatable(df, "quads"), label, F.when(link, F.substring_index("s.value", "#", 1)))
        # of blank nodes that are named far apart the first link is found by an aggregate, and their quads meet it by a join
        first = far.where(link).groupBy(F.col("o.value").alias("__b"))
        first = first.agg(F.min("seq").alias("__at"), F.min_by(F.substring_index("s.value", "#", 1), "seq").alias("__owner"))
        far = met(far.withColumn("__label", label), first, F.col("__label") == F.col("__b"), "left").drop("__label", "__b")
        return self._named(near).unionByName(self._named(far)).select(*[F.col(f"`{c}`") for c in df.columns])

    @staticmethod
    def _named(df: DataFrame) -> DataFrame:
        """Of quads with __owner, and in __at the place of the first link, those that this one names."""
        blank_s, s, o = is_bnode("s"), F.col("s"), F.col("o")
        new = lambda c: F.concat("__owner", F.lit("#"), c["value"])
        unknown = F.col("__at").isNull() | (F.col("seq") < F.col("__at"))
        subject = fail(unknown, F.concat(F.lit("Unmapped blank node: "), s["value"]), new(s))
        named = is_iri("s") & is_bnode("o") & F.coalesce(F.col("seq") == F.col("__at"), F.lit(False))
        terms = {"s": F.when(blank_s, _with_value(s, subject, F.lit("iri"))).otherwise(s), "o": F.when(named, _with_value(o, new(o), F.lit("iri"))).otherwise(o)}
        return df.withColumns(terms).drop("__owner", "__at")


@component("QuadTransformerRemapResourceIdentifier")
@dataclass
class RemapResourceIdentifier(Transformer):
    """Typed resources get IRIs of their target and identifier, wherever they are subject or object."""

    new_identifier_separator: str
    type_regex: str
    identifier_predicate_regex: str
    target_predicate_regex: str
    identifier_value_modifier: GroupModifier | None = None
    keep_subject_fragment: bool = False
    strict: bool = True
    stateless = False

    def renames(self, df: DataFrame) -> DataFrame:
        found = resources(df, self.type_regex, self.target_predicate_regex, self.identifier_predicate_regex)
        id_ = F.col("id") if self.identifier_value_modifier is None else self.identifier_value_modifier.apply(F.col("id"))
        new = resolve_iri(F.concat(F.lit(self.new_identifier_separator), id_["value"]), F.col("target"))
        if self.keep_subject_fragment:
            new = F.concat(new, F.regexp_extract("iri", r"^[^#]*(#[\s\S]*)", 1))
        return found.select("iri", "since", "done", new.alias("new"))

    def apply(self, df, allowed=None):
        if allowed == "object":
            return df
        # a narrow table, a row for each resource; of the quads only those that touch one are written
        return rename(df, materialize(self.renames(df), "renames"), self.strict, allowed)


@component("QuadTransformerCompositeSequential")
@dataclass
class Sequential(Transformer):
    """One transformer after another."""

    transformers: list[Transformer]

    @property
    def stateless(self):
        return all(t.stateless for t in self.transformers)

    def apply(self, df, allowed=None):
        return reduce(lambda d, t: t.apply(d, allowed), self.transformers, df)


@component("QuadTransformerCompositeVaryingResource")
@dataclass
class VaryingResource(Transformer):
    """Each typed resource, with the quads that touch it, goes through one of the transformers, chosen by the code points
    of its target, so that all resources of a target share one."""

    type_regex: str
    target_predicate_regex: str
    transformers: list[Transformer]
    stateless = False

    def apply(self, df, allowed=None):
        found = resources(df, self.type_regex, self.target_predicate_regex)
        message = F.concat(F.lit("Detected non-finalized resource: "), F.col("iri"))
        target = fail(F.col("done").isNull(), message, F.col("target"))
        variants = materialize(found.select("iri", (code_sum(target) % len(self.transformers)).cast("int").alias("variant")), "variants")
        out = looked_up(df, variants, ["variant"], "varying").drop("__s", "__o").withColumnsRenamed({"__s_variant": "__vs", "__o_variant": "__vo"})
        columns = ["__vs", "__vo"]
        of = lambda v: F.coalesce(reduce(or_, [F.col(c) == v for c in columns]), F.lit(False))
        # of each transformer what it made of its own quads; those that touch two variants go through both, in their order
        shared = not out.where(F.col(columns[0]) != F.col(columns[1])).isEmpty()
        done = []
        for v, transformer in enumerate(self.transformers):
            # a longer seq begins with the place at which its quad leaves, so it still compares with the shorter ones
            made = transformer.apply(out.where(of(v)))
            out = out.where(~of(v))
            if shared and v < len(self.transformers) - 1:
                made = materialize(made, "quads")
                later = F.coalesce(reduce(or_, [F.col(c) > v for c in columns]), F.lit(False))
                out, made = out.unionByName(made.where(later)), made.where(~later)
            done.append(made)
        return reduce(DataFrame.unionByName, done, out).drop(*columns)


@component("QuadTransformerDistinct")
@dataclass
class Distinct(Transformer):
    """Of the quads that a transformer makes beside (or in place of) the incoming one, the first of each."""

    transformer: Transformer
    stateless = False

    def apply(self, df, allowed=None):
        out = materialize(self.transformer.apply(df.withColumn("__in", this_quad())), "quads")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__in.{c}")) for c in "spog"])
        made = out.where(~same)
        rest = [c for c in out.columns if c not in "spog"]
        firsts = made.groupBy("s", "p", "o", "g").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "seq").alias("__first"))
        firsts = firsts.select("s", "p", "o", "g", "__first.*")
        return out.where(same).unionByName(firsts).drop("__in")


@component("QuadTransformerAppendQuad")
@dataclass
class AppendQuad(Transformer):
    """After each match a quad of four templates."""

    matcher: Matcher
    subject: object
    predicate: object
    object: object
    graph: object

    @property
    def stateless(self):
        return self.matcher.stateless

    def apply(self, df, allowed=None):
        made = quad(*[t.term() for t in (self.subject, self.predicate, self.object, self.graph)])
        return _append(self.matcher.mark(df, "__hit"), F.array(made))


def _append(marked: DataFrame, made: Column) -> DataFrame:
    """After each quad whose __hit holds, an array of quads."""
    return flat_map(marked, F.when(F.col("__hit"), F.concat(F.array(this_quad()), made)).otherwise(F.array(this_quad()))).drop("__hit")


def _link(identifier: Column, predicate: str, link: str, link_type: str | None, reverse: bool, no_slash: bool) -> Column:
    value = identifier["value"]
    target = resolve_iri(link, F.when(value.endswith("/"), value).otherwise(F.concat(value, F.lit("/"))))
    if no_slash:
        target = F.regexp_replace(target, r"/\z", "")
    s, o = (iri(target), identifier) if reverse else (identifier, iri(target))
    made = [quad(s, iri(predicate), o)]
    if link_type:
        made.append(quad(iri(target), iri(RDF_TYPE), iri(link_type)))
    return F.array(*made)


@component("QuadTransformerAppendQuadLink")
@dataclass
class AppendQuadLink(Transformer):
    """After each match a link from one of its positions to an IRI relative to it, and that IRI's type if wanted."""

    matcher: Matcher
    identifier: str
    predicate: str
    link: str
    link_type: str | None = None
    reverse: bool = False
    link_remove_trailing_slash: bool = False

    @property
    def stateless(self):
        return self.matcher.stateless

    def apply(self, df, allowed=None):
        made = _link(F.col(position(self.identifier)), self.predicate, self.link, self.link_type, self.reverse, self.link_remove_trailing_slash)
        return _append(self.matcher.mark(df, "__hit"), made)


class AppendToResource(Transformer):
    """Appends quads after each matching type quad."""

    type_regex: str

    def made(self) -> Column:
        raise NotImplementedError

    def apply(self, df, allowed=None):
        hit = F.coalesce(is_type_quad() & matches(F.col("o.value"), self.type_regex), F.lit(False))
        return _append(df.withColumn("__hit", hit), self.made())


@component("QuadTransformerAppendResourceLink")
@dataclass
class AppendResourceLink(AppendToResource):
    """After each matching type quad a link from its subject."""

    type_regex: str
    predicate: str
    link: str
    link_type: str | None = None
    reverse: bool = False
    link_remove_trailing_slash: bool = False

    def made(self):
        return _link(F.col("s"), self.predicate, self.link, self.link_type, self.reverse, self.link_remove_trailing_slash)


@component("QuadTransformerAppendResourceScl")
@dataclass
class AppendResourceScl(AppendToResource):
    """After each matching type quad a policy of its subject."""

    type_regex: str
    identifier_suffix: str
    scl_policy: str

    def made(self):
        policy = iri(F.concat(F.col("s.value"), F.lit(self.identifier_suffix)))
        return F.array(quad(policy, iri(SCL + "appliesTo"), F.col("s")), quad(policy, iri(SCL + "scope"), literal(self.scl_policy, SCL + "SCL")))


@component("QuadTransformerAppendResourceSolidTypeIndex")
@dataclass
class AppendSolidTypeIndex(Transformer):
    """After the quad that tells a typed resource's profile, the six quads of that profile's type index."""

    type_regex: str
    profile_predicate_regex: str
    type_index: str
    entry_suffix: str
    entry_reference: str
    entry_container: bool
    stateless = False

    def apply(self, df, allowed=None):
        found = resources(df, self.type_regex, self.profile_predicate_regex).where(F.col("done").isNotNull())
        found = materialize(found.select(F.col("iri").alias("__iri"), F.col("done").alias("__done"), F.col("type").alias("__type"), F.col("target").alias("__target")), "profiles")
        # a profile is told by a quad that matches; the others stay where they are
        tells = F.coalesce(is_iri("s") & matches(F.col("p.value"), self.profile_predicate_regex), F.lit(False))
        told = met(df.where(tells), found, (F.col("s.value") == F.col("__iri")) & (F.col("seq") == F.col("__done")), "left")
        index = resolve_iri(self.type_index, F.col("__target"))
        entry = iri(F.concat(index, F.lit(self.entry_suffix)))
        made = F.array(
            quad(iri(F.col("__target")), iri(SOLID + "publicTypeIndex"), iri(index)),
            quad(iri(index), iri(RDF_TYPE), iri(SOLID + "TypeIndex")),
            quad(iri(index), iri(RDF_TYPE), iri(SOLID + "ListedDocument")),
            quad(entry, iri(RDF_TYPE), iri(SOLID + "TypeRegistration")),
            quad(entry, iri(SOLID + "forClass"), iri(F.col("__type"))),
            quad(entry, iri(SOLID + ("instanceContainer" if self.entry_container else "instance")), iri(resolve_iri(self.entry_reference, F.col("__target")))),
        )
        told = _append(told.withColumn("__hit", F.col("__iri").isNotNull()), made).drop("__iri", "__done", "__type", "__target")
        return told.unionByName(flat_map(df.where(~tells), F.array(this_quad())))

