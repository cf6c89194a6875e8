"""Typed resources: for each IRI with a matching rdf:type, when it began, what identifies it, and what it targets.

A resource begins at its first matching type quad. Its identifier and its target are the first later quads of the
subject with matching predicates; from the later of these two on it is complete. Quads that touch a resource in
between are held until then, which decides what references are renamed (strict order); without strict order all are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.terms import is_iri, is_type_quad
from ..functions.text import matches
from ..plans.storage import dealt, materialize, parts_for, sieve


def fail(condition: Column, message: Column, value: Column) -> Column:
    """value, or an error where the condition holds."""
    return F.when(condition, F.raise_error(message).cast("string")).otherwise(value)


def met(df: DataFrame, other: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow: by merging, at every size. Spark takes the size of such a table from that of Parquet files,
    in which terms are a fraction of what they are in memory, and otherwise broadcasts millions of them through the driver."""
    return df.join(other.hint("merge"), on, how)


def looked_up(df: DataFrame, names: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df with what names, a row for each IRI in its column iri, has in columns for the subject and for the object: as __s_<column>,
    __o_<column>, and the IRI as __s, __o; null where there is nothing. Only quads that a sieve of the IRIs takes for some with a
    name are written, and moved once for each such term; the others stay where they are."""
    passes, parts = sieve(names, "iri"), parts_for(names.count(), df.sparkSession)
    may = {c: F.coalesce(is_iri(c) & passes(F.col(f"{c}.value")), F.lit(False)) for c in "so"}
    kinds = dict(names.dtypes)

    def of(c: str) -> DataFrame:
        return names.select(F.col("iri").alias(f"__{c}"), *[F.col(x).alias(f"__{c}_{x}") for x in columns])

    def nothing(rows: DataFrame, c: str) -> DataFrame:
        return rows.withColumns({f"__{c}": F.lit(None).cast("string")} | {f"__{c}_{x}": F.lit(None).cast(kinds[x]) for x in columns})

    # quads are dealt by subject, whose value the key stands for, so that it is not written twice; those that may have a name for
    # their object alone are dealt evenly. An exchange takes them, and what else may have one for its object, from there
    moving = df.where(may["s"] | may["o"]).withColumns({"__key": F.when(may["s"], F.col("s.value")).otherwise(F.concat(F.lit("\0"), F.xxhash64("seq").cast("string"))), "__may": may["o"]})
    moving = dealt(moving.withColumn("s", F.col("s").withField("value", F.when(~may["s"], F.col("s.value")))), name, parts, "__key")
    by_subject = F.col("s.value").isNull()
    subjects = met(moving.where(by_subject), of("s"), F.col("__key") == F.col("__s"), "left").withColumn("s", F.col("s").withField("value", F.col("__key")))
    objects = subjects.where("__may").unionByName(nothing(moving.where(~by_subject), "s"))
    objects = met(objects, of("o"), F.col("o.value") == F.col("__o"), "left")
    stay = nothing(nothing(df.where(~(may["s"] | may["o"])), "s"), "o")
    return stay.unionByName(nothing(subjects.where("not __may"), "o").unionByName(objects).drop("__key", "__may"))


def resources(df: DataFrame, type_regex: str, target_regex: str, id_regex: str | None = None) -> DataFrame:
    """(iri, type, since, id, id_seq, target, target_seq, done) for each resource; done is null while it is incomplete.
    Reading the row of a resource with a second identifier or target before it is complete, or with a target that is no
    IRI, is an error."""
    is_target = matches(F.col("p.value"), target_regex)
    is_id = matches(F.col("p.value"), id_regex) if id_regex else F.lit(False)
    is_typed = is_type_quad() & matches(F.col("o.value"), type_regex)
    # the few quads that tell something are sought once, and written; all below reads these
    says = {k: F.coalesce(x, F.lit(False)) for k, x in {"is_typed": is_typed, "is_target": is_target, "is_id": is_id}.items()}
    says = df.where(is_iri("s")).select(F.col("s.value").alias("iri"), "seq", "o", *[x.alias(k) for k, x in says.items()])
    says = materialize(says.where("is_typed or is_target or is_id"), "told", compression="zstd")
    typed = says.where("is_typed").groupBy("iri").agg(F.min("seq").alias("since"), F.min_by("o.value", "seq").alias("type"))
    told = met(says.where("is_target or is_id").drop("is_typed"), typed.select("iri", "since"), "iri").where(F.col("seq") > F.col("since"))
    firsts = []
    for name in ("id", "target"):
        at = F.when(F.col(f"is_{name}"), F.col("seq"))
        firsts += [F.min(at).alias(f"{name}_seq"), F.min_by("o", at).alias(name)]
    known = told.groupBy("iri").agg(*firsts)
    done = F.greatest("id_seq", "target_seq") if id_regex else F.col("target_seq")
    complete = F.col("target_seq").isNotNull() & (F.col("id_seq").isNotNull() if id_regex else F.lit(True))
    found = met(typed, known, "iri", "left").withColumn("done", F.when(complete, done))
    # values told between the beginning and completion, beyond the first of each
    early = met(told, found.select("iri", "done"), "iri").where(F.col("seq") <= F.col("done"))
    twice = early.groupBy("iri").agg(F.greatest(F.sum(F.col("is_id").cast("int")), F.sum(F.col("is_target").cast("int"))).alias("times"))
    found = met(found, twice, "iri", "left")
    target = fail(
        F.col("times") > 1,
        F.concat(F.lit("Illegal overwrite of identifier or target of "), F.col("iri")),
        fail(
            F.col("target").isNotNull() & (F.col("target.kind") != "iri"),
            F.concat(F.lit("Expected a named node as target of "), F.col("iri"), F.lit(", but found "), F.col("target.kind"), F.lit(" "), F.col("target.value")),
            F.col("target.value"),
        ),
    )
    return found.select("iri", "type", "since", "id", "id_seq", target.alias("target"), "target_seq", "done")


def rename(df: DataFrame, renames: DataFrame, strict: bool = True, allowed: str | None = None, complete: bool = True) -> DataFrame:
    """renames: (iri, since, done, new) with one row an IRI. Subjects and objects that are such IRIs become new ones:
    with strict order only where the quad leaves (its own place, or when the resource it touches is complete) at or after
    the resource's completion. allowed limits it to the subject. An incomplete resource is an error if complete."""
    if allowed == "object":
        return df
    out = looked_up(df, renames, ["since", "done", "new"], "renamed")
    seq = F.col("seq")
    held = {c: (seq >= F.col(f"__{c}_since")) & (seq <= F.col(f"__{c}_done")) for c in "so"}
    out = out.withColumn("__flush", F.when(held["s"], F.col("__s_done")).when(held["o"], F.col("__o_done")).otherwise(seq))
    columns = {}
    for c in "so":
        if allowed == "subject" and c == "o":
            continue
        now = F.col(f"__{c}_done").isNotNull() & ((F.col(f"__{c}_done") <= F.col("__flush")) if strict else F.lit(True))
        value = F.when(now, F.col(f"__{c}_new")).otherwise(F.col(f"{c}.value"))
        if complete:
            open_ = F.col(f"__{c}").isNotNull() & F.col(f"__{c}_done").isNull()
            value = fail(open_, F.concat(F.lit("Detected non-finalized resource: "), F.col(f"__{c}")), value)
        columns[c] = F.struct(F.col(f"{c}.kind").alias("kind"), value.alias("value"), F.col(f"{c}.datatype").alias("datatype"), F.col(f"{c}.lang").alias("lang"))
    columns["seq"] = F.concat("__flush", "seq")
    return out.withColumns(columns).drop("__flush", *[f"__{c}{x}" for c in "so" for x in ("", "_since", "_done", "_new")])
