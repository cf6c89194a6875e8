"""Relational tables lifted to quads: persons, posts with lines and prices in blank nodes, comments and places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF_TYPE, XSD, bnode, flat_map, iri, literal, quad

DATA, VOCABULARY, PLACES = "http://ex.org/data/", "http://ex.org/vocabulary/", "http://ex.org/places/"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _iri(front: str, key: str) -> Column:
    return iri(F.concat(F.lit(front), F.col(key).cast("string")))


def _v(name: str) -> Column:
    return iri(VOCABULARY + name)


def _a(subject: Column, cls: str) -> Column:
    return quad(subject, iri(RDF_TYPE), _v(cls))


def _text(column: str) -> Column:
    return literal(F.col(column).cast("string"))


def _number(column: str) -> Column:
    return literal(F.col(column).cast("decimal(18,2)").cast("string"), XSD + "decimal")


def _lift(df: DataFrame, table: int, keys: list[str], quads: list[Column], **terms: Column) -> DataFrame:
    """A row's quads; seq is (table, keys, place). terms: columns that several quads have, made once a row."""
    seq = F.array(F.lit(table).cast("long"), *[F.col(k).cast("long") for k in keys])
    return flat_map(df.select("*", seq.alias("seq"), *[c.alias(k) for k, c in terms.items()]), F.array(*quads)).select("seq", "s", "p", "o", "g")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer")
    s = _iri(DATA + "pers", "c_custkey")
    place = quad(s, _v("isLocatedIn"), _iri(PLACES + "nation", "c_nationkey"))
    return _lift(df, 1, ["c_custkey"], [_a(s, "Person"), quad(s, _v("name"), _text("c_name")), quad(s, _v("segment"), _text("c_mktsegment")), place])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    s = F.col("__s")
    rest = [quad(s, _v("id"), _text("o_orderkey")), quad(s, _v("hasCreator"), _iri(DATA + "pers", "o_custkey")), quad(s, _v("status"), _text("o_orderstatus"))]
    return _lift(df, 2, ["o_orderkey"], [_a(s, "Post"), *rest], __s=_iri(DATA + "post", "o_orderkey"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post -hasLine-> _:l<order>_<line> -part, quantity, price-> .., the price in a blank node of its own."""
    df = _table(spark, sf_dir, "lineitem")
    key = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    line, price = bnode(F.col("__line")), bnode(F.col("__price"))
    quads = [
        quad(_iri(DATA + "post", "l_orderkey"), _v("hasLine"), line),
        quad(line, _v("part"), _iri(DATA + "part", "l_partkey")),
        quad(line, _v("quantity"), _number("l_quantity")),
        quad(line, _v("price"), price),
        quad(price, _v("amount"), _number("l_extendedprice")),
    ]
    return _lift(df, 3, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], quads, __line=F.concat(F.lit("l"), key), __price=F.concat(F.lit("c"), key))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    s = _iri(DATA + "comm", "event_id")
    quads = [_a(s, "Comment"), quad(s, _v("id"), _text("event_id")), quad(s, _v("hasCreator"), _iri(DATA + "pers", "user_id")), quad(s, _v("kind"), _text("event_type"))]
    return _lift(df, 4, ["event_id"], quads)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "nation")
    s = _iri(PLACES + "nation", "n_nationkey")
    return _lift(df, 5, ["n_nationkey"], [_a(s, "Place"), quad(s, _v("name"), _text("n_name")), quad(s, _v("isPartOf"), _iri(PLACES + "region", "n_regionkey"))])


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "pages").where("url is not null")
    return _lift(df, 6, ["page_id"], [quad(iri(F.col("url")), _v("page"), _text("page_id"))])


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons, posts, comments and places."""
    return reduce(DataFrame.unionByName, [t(spark, sf_dir) for t in (persons, posts, comments, places)])
