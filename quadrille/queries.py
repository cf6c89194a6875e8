"""Queries over the driver's tables, lifted to quads, one or more for each operator, with the SQL that gives the same.

Rows are strings: IRIs as they are, blank nodes as _:b, literals in quotes (terms.term_to_string)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import format_quad, term_to_string, this_quad
from .functions.text import code_sum, js_replace, murmur3_32, resolve_iri
from .operators import matchers as M
from .operators import strategies as S
from .operators import templates as T
from .operators import transforms as X
from .operators.callbacks import MapCallback
from .operators.closure import blank_links, owners
from .operators.summaries import bloom_filters, bloom_pairs, void_counts
from .plans.storage import working_path
from .sinks.files import CompositeSink, CsvSink, FileSink, FilteredSink, Sink, file_path, read_files
from .sources import tables
from .sources.rdf import CompositeSource, parse_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

V, D, P = tables.VOCABULARY, tables.DATA, tables.PLACES
A = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD = "http://www.w3.org/2001/XMLSchema#"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def shown(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, *[term_to_string(c).alias(c) for c in "spo"])


# SQL: the lifted tables as (t, k1, k2, n, s, p, o)
_LIFT = {
    "persons": ("customer", "1", "c_custkey", "0", [(f"'{D}pers' || c_custkey", A, f"'{V}Person'"), (f"'{D}pers' || c_custkey", f"{V}name", "'\"' || c_name || '\"'"), (f"'{D}pers' || c_custkey", f"{V}segment", "'\"' || c_mktsegment || '\"'"), (f"'{D}pers' || c_custkey", f"{V}isLocatedIn", f"'{P}nation' || c_nationkey")]),
    "posts": ("orders", "2", "o_orderkey", "0", [(f"'{D}post' || o_orderkey", A, f"'{V}Post'"), (f"'{D}post' || o_orderkey", f"{V}id", "'\"' || o_orderkey || '\"'"), (f"'{D}post' || o_orderkey", f"{V}hasCreator", f"'{D}pers' || o_custkey"), (f"'{D}post' || o_orderkey", f"{V}status", "'\"' || o_orderstatus || '\"'")]),
    "lines": ("(SELECT *, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS key FROM lineitem)", "3", "l_orderkey", "l_linenumber", [(f"'{D}post' || l_orderkey", f"{V}hasLine", "'_:l' || key"), ("'_:l' || key", f"{V}part", f"'{D}part' || l_partkey"), ("'_:l' || key", f"{V}quantity", f"'\"' || l_quantity::DECIMAL(18,2) || '\"^^{XSD}decimal'"), ("'_:l' || key", f"{V}price", "'_:c' || key"), ("'_:c' || key", f"{V}amount", f"'\"' || l_extendedprice::DECIMAL(18,2) || '\"^^{XSD}decimal'")]),
    "comments": ("events", "4", "event_id", "0", [(f"'{D}comm' || event_id", A, f"'{V}Comment'"), (f"'{D}comm' || event_id", f"{V}id", "'\"' || event_id || '\"'"), (f"'{D}comm' || event_id", f"{V}hasCreator", f"'{D}pers' || user_id"), (f"'{D}comm' || event_id", f"{V}kind", "'\"' || event_type || '\"'")]),
    "places": ("nation", "5", "n_nationkey", "0", [(f"'{P}nation' || n_nationkey", A, f"'{V}Place'"), (f"'{P}nation' || n_nationkey", f"{V}name", "'\"' || n_name || '\"'"), (f"'{P}nation' || n_nationkey", f"{V}isPartOf", f"'{P}region' || n_regionkey")]),
    "web_pages": ("(SELECT * FROM pages WHERE url IS NOT NULL)", "6", "page_id", "0", [("url", f"{V}page", "'\"' || page_id || '\"'")]),
}


def lifted(*names: str) -> str:
    parts = []
    for name in names:
        table, t, k1, k2, quads = _LIFT[name]
        parts += [f"SELECT {t} AS t, {k1} AS k1, {k2} AS k2, {n} AS n, {s} AS s, '{p}' AS p, {o} AS o FROM {table}" for n, (s, p, o) in enumerate(quads)]
    return "quads AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")"


def _of(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [getattr(tables, n)(spark, sf_dir) for n in names])


_PODS = X.ReplaceIri(r"^http://ex.org/data/pers([0-9]*)$", "http://ex.org/pods/$1/profile/card#me")
_PODS_SQL = r"regexp_replace({}, '^http://ex.org/data/pers([0-9]*)$', 'http://ex.org/pods/\1/profile/card#me')"


# ---- sources


@query(f"WITH {lifted('places', 'web_pages')} SELECT s, p, o FROM quads")
def src_lines(spark, sf_dir):
    """N-Quads lines parsed."""
    lines = _of(spark, sf_dir, "places", "web_pages").select(format_quad().alias("value"), F.element_at("seq", 2).alias("line"))
    return shown(parse_lines(lines))


class _Given:
    def __init__(self, df):
        self.df = df

    def read(self, spark, file=0):
        return self.df


@query(f"WITH {lifted('persons', 'posts', 'places')} SELECT p, count(*) AS n FROM quads GROUP BY p")
def src_composite(spark, sf_dir):
    source = CompositeSource([_Given(_of(spark, sf_dir, n)) for n in ("persons", "posts", "places")])
    return source.read(spark).groupBy(F.col("p.value").alias("p")).agg(F.count("*").alias("n"))


# ---- sinks


@query(f"""WITH {lifted('persons', 'posts')}, d AS (SELECT {_PODS_SQL.format('s')} AS doc FROM quads)
SELECT replace(CASE WHEN doc LIKE 'http://ex.org/pods/%' THEN regexp_replace(split_part(doc, '#', 1), '^http://ex.org/pods/', 'out/pods/') ELSE regexp_replace(doc, '^http://ex.org/', 'out/') END, ':', '_') || '$.nq' AS path, count(*) AS n
FROM d GROUP BY 1""")
def flagship(spark, sf_dir):
    """Persons become pods, every quad goes to its subject's document; quads of each file."""
    df = X.apply_all([_PODS], _of(spark, sf_dir, "persons", "posts"))
    out = S.BySubject().assign(df)
    path = file_path(F.col("doc"), {"^http://ex.org/": "out/", "^http://ex.org/pods/": "out/pods/"}, "$.nq")
    return out.groupBy(path.alias("path")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_replace(CASE WHEN regexp_matches(d, '^https?://m\.') THEN regexp_replace(d, '^https?://m\.', 'mobile/') ELSE regexp_replace(d, '^https?://', 'web/') END, '[*|"<>?:]', '_', 'g') || '$.nq' AS path
FROM (SELECT page_id, split_part(url, '#', 1) AS d FROM pages WHERE url IS NOT NULL)""")
def snk_file_path(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null")
    return pages.select("page_id", file_path(F.col("url"), {r"^https?:\/\/": "web/", r"^https?:\/\/m\.": "mobile/"}, "$.nq").alias("path"))


def _line_sql(end: str) -> str:
    name = "CASE WHEN {0} LIKE '\\_:%' ESCAPE '\\' THEN {0} ELSE '<' || {0} || '>' END"
    text = "regexp_replace(o, '\"\\^\\^(.*)$', '\"^^<\\1>')"
    return f"{name.format('s')} || ' <' || p || '> ' || CASE WHEN o LIKE '\"%' THEN {text} ELSE {name.format('o')} END || '{end}'"


@query(f"WITH {lifted('posts', 'lines', 'places')} SELECT {_line_sql(' .')} AS line FROM quads")
def snk_nquads(spark, sf_dir):
    return _of(spark, sf_dir, "posts", "lines", "places").select(format_quad("application/n-quads").alias("line"))


@query(f"WITH {lifted('posts', 'lines', 'places')} SELECT {_line_sql('.')} AS line FROM quads")
def snk_turtle(spark, sf_dir):
    return _of(spark, sf_dir, "posts", "lines", "places").select(format_quad("text/turtle").alias("line"))


@query(f"""WITH {lifted('posts')}, d AS (SELECT s, o AS doc FROM quads WHERE p = '{V}hasCreator')
SELECT regexp_extract(doc, '[^/]*$') || '$.nq' AS file, count(*) AS n, md5(string_agg({_line_sql(' .')}, chr(10) ORDER BY k1, n) || chr(10)) AS md5
FROM quads JOIN d USING (s) GROUP BY doc""")
def snk_files(spark, sf_dir):
    """The files of the sink, written to the shared folder and read back: a person's with all posts they created, in order."""
    root = working_path(spark, "files")
    sink = FileSink("application/n-quads", {"^http://ex.org/data/": "people/"}, file_extension="$.nq", root=root.removeprefix("file://"))
    placed = sink.written(S.ByResourceObject("vocabulary/hasCreator$").assign(_of(spark, sf_dir, "posts")))
    files = read_files(placed, sink.root).select(F.regexp_extract("path", r"[^/]*$", 0).alias("file"), "value")
    return files.select("file", (F.length("value") - F.length(F.replace("value", F.lit("\n")))).cast("long").alias("n"), F.md5("value").alias("md5"))


@query(f"""WITH {lifted('persons', 'posts')} SELECT 'types' AS sink, s AS doc, s, p, o FROM quads WHERE p = '{A}' UNION ALL SELECT 'all', s, s, p, o FROM quads""")
def snk_composite(spark, sf_dir):
    """Every quad to both sinks, of which one keeps type quads alone."""
    types, all_ = _Kept(), _Kept()
    CompositeSink([FilteredSink(types, M.PredicateMatcher("#type$")), all_]).write(S.BySubject().assign(_of(spark, sf_dir, "persons", "posts")))
    both = [shown(x.fragments.withColumn("sink", F.lit(name)), "sink", "doc") for name, x in (("types", types), ("all", all_))]
    return both[0].unionByName(both[1])


@query(f"WITH {lifted('posts')} SELECT s || ',' || p || ',' || o AS line FROM quads")
def snk_csv(spark, sf_dir):
    sink = CsvSink("unused.csv", ["subject", "predicate", "object"])
    return sink.lines(S.Constant("x").assign(_of(spark, sf_dir, "posts"))).select("line")


class _Kept(Sink):
    """Keeps what it is given, as a sink for queries."""

    def write(self, fragments):
        self.fragments = fragments


@query(f"WITH {lifted('persons', 'posts')} SELECT s AS doc, s, p, o FROM quads WHERE p = '{A}' AND o = '{V}Person'")
def snk_filtered(spark, sf_dir):
    kept = _Kept()
    FilteredSink(kept, M.ResourceTypeMatcher("vocabulary/Person$")).write(S.BySubject().assign(_of(spark, sf_dir, "persons", "posts")))
    return shown(kept.fragments, "doc")


# ---- matchers


@query(f"WITH {lifted('persons', 'posts')} SELECT s, p, o FROM quads WHERE regexp_matches(p, 'vocabulary/hasCreator$')")
def mat_predicate(spark, sf_dir):
    return shown(M.PredicateMatcher("vocabulary/hasCreator$").keep(_of(spark, sf_dir, "persons", "posts")))


@query(f"WITH {lifted('persons', 'posts', 'comments')} SELECT s, p, o FROM quads WHERE p = '{A}' AND regexp_matches(o, '/(Post|Comment)$')")
def mat_resource_type(spark, sf_dir):
    return shown(M.ResourceTypeMatcher("/(Post|Comment)$").keep(_of(spark, sf_dir, "persons", "posts", "comments")))


@query(f"""WITH {lifted('persons', 'posts', 'lines')}
SELECT q.s, q.p, q.o FROM quads q JOIN (SELECT s, min((t, k1, k2, n)) AS since FROM quads WHERE p = '{A}' AND o = '{V}Post' GROUP BY s) f ON q.s = f.s AND (q.t, q.k1, q.k2, q.n) >= f.since""")
def mat_resource_type_full(spark, sf_dir):
    return shown(M.ResourceTypeMatcher("vocabulary/Post$", True).keep(_of(spark, sf_dir, "persons", "posts", "lines")))


def _murmur_sql(rows: str, value: str) -> str:
    """CTE hashed (rows' columns, h): MurmurHash3 of an ASCII text."""
    times = lambda x, m: f"(({x})::HUGEINT * {m} % 4294967296)::BIGINT"
    rot = lambda x, n: f"((({x}) << {n}) & 4294967295 | (({x}) >> {32 - n}))"
    k = times(rot(times("b", 0xCC9E2D51), 15), 0x1B873593)
    mix = f"(({rot('xor(h, b)', 13)}) * 5 + 3864292196) & 4294967295"
    byte = lambda i: f"(CASE WHEN {i} <= length(v) THEN unicode(substr(v, {i}, 1)) ELSE 0 END)::BIGINT"
    word = f"list_transform(range(0, {{}}), lambda i: {' | '.join(f'({byte(f'(4 * i + {j + 1})')} << {8 * j})' for j in range(4))})"
    return f"""
m0 AS (SELECT *, {value} AS v FROM {rows}),
m1 AS (SELECT *, list_transform({word.format("length(v) // 4")}, lambda b: {k}) AS body, list_transform([{' | '.join(f'({byte(f"(length(v) // 4 * 4 + {j + 1})")} << {8 * j})' for j in range(3))}], lambda b: {k})[1] AS tail FROM m0),
m2 AS (SELECT *, list_reduce(list_concat([0::BIGINT], body), lambda h, b: {mix}) AS h0 FROM m1),
m3 AS (SELECT *, xor(xor(h0, CASE WHEN length(v) % 4 > 0 THEN tail ELSE 0 END), length(v)::BIGINT) AS h1 FROM m2),
m4 AS (SELECT *, {times('xor(h1, h1 >> 16)', 0x85EBCA6B)} AS h2 FROM m3),
m5 AS (SELECT *, {times('xor(h2, h2 >> 13)', 0xC2B2AE35)} AS h3 FROM m4),
hashed AS (SELECT * EXCLUDE (body, tail, h0, h1, h2, h3), xor(h3, h3 >> 16) AS h FROM m5)"""


@query(f"WITH {lifted('posts')}, posts AS (SELECT * FROM quads WHERE regexp_matches(s, 'post([0-9]+)$')), {_murmur_sql('posts', "regexp_extract(s, 'post([0-9]+)$', 1)")} SELECT s, p, o FROM hashed WHERE h <= 0.3 * 4294967295")
def mat_term_value(spark, sf_dir):
    """A deterministic sample of posts."""
    return shown(M.TermValueMatcher("subject", "post([0-9]+)$", 0.3).keep(_of(spark, sf_dir, "posts")))


@query(f"WITH {lifted('persons')}, names AS (SELECT DISTINCT s AS value FROM quads UNION SELECT DISTINCT p FROM quads), {_murmur_sql('names', 'value')} SELECT value, h AS murmur FROM hashed")
def fn_murmur3(spark, sf_dir):
    df = _of(spark, sf_dir, "persons")
    names = df.select(F.col("s.value").alias("value")).union(df.select("p.value")).distinct()
    return names.select("value", murmur3_32(F.col("value")).alias("murmur"))


# ---- transformers without memory


@query(f"WITH {lifted('persons', 'posts')} SELECT {_PODS_SQL.format('s')} AS s, {_PODS_SQL.format('p')} AS p, CASE WHEN o LIKE '\"%' THEN o ELSE {_PODS_SQL.format('o')} END AS o FROM quads")
def trf_replace_iri(spark, sf_dir):
    return shown(_PODS.apply(_of(spark, sf_dir, "persons", "posts")))


_SERVERS = [f"https://{c}.example.com/users$1/profile/card#me" for c in "abcd"]


def _servers_sql(x: str) -> str:
    n = f"regexp_extract({x}, '^http://ex.org/data/pers([0-9]*)$', 1)"
    return f"CASE WHEN {n} <> '' THEN 'https://' || substr('abcd', ({n}::BIGINT % 4 + 1)::INT, 1) || '.example.com/users' || {n} || '/profile/card#me' ELSE {x} END"


@query(f"WITH {lifted('persons', 'posts')} SELECT {_servers_sql('s')} AS s, p, {_servers_sql('o')} AS o FROM quads")
def trf_distribute_iri(spark, sf_dir):
    return shown(X.DistributeIri("^http://ex.org/data/pers([0-9]*)$", _SERVERS).apply(_of(spark, sf_dir, "persons", "posts")))


@query(f"""WITH {lifted('lines')}, x AS (SELECT regexp_replace(s, '^_:l([0-9]+)_', 'http://ex.org/lines/\\1/') AS s, p, regexp_replace(o, '^_:l([0-9]+)_', 'http://ex.org/lines/\\1/') AS o FROM quads) SELECT * FROM x""")
def trf_blank_to_named(spark, sf_dir):
    return shown(X.BlankToNamed("^l([0-9]+)_", "http://ex.org/lines/$1/").apply(_of(spark, sf_dir, "lines")))


def _extension_sql(x: str) -> str:
    return f"regexp_replace({x}, '\\.[A-Za-z]*$', '') || '.nq'"


@query(f"WITH {lifted('web_pages')} SELECT {_extension_sql('s')} AS s, {_extension_sql('p')} AS p, o FROM quads")
def trf_set_extension(spark, sf_dir):
    return shown(X.SetIriExtension("nq").apply(_of(spark, sf_dir, "web_pages")))


@query(f"WITH {lifted('persons', 'posts')}, twice AS (SELECT unnest([1, 2]) AS c) SELECT s, p, o, count(*) AS n FROM quads CROSS JOIN twice GROUP BY s, p, o")
def trf_clone(spark, sf_dir):
    return shown(X.Clone().apply(X.Identity().apply(_of(spark, sf_dir, "persons", "posts")))).groupBy("s", "p", "o").agg(F.count("*").alias("n"))


@query(f"WITH {lifted('posts')} SELECT regexp_replace(regexp_replace(s, 'data', 'raw'), 'raw', 'store') AS s, regexp_replace(regexp_replace(p, 'data', 'raw'), 'raw', 'store') AS p, CASE WHEN o LIKE '\"%' THEN o ELSE regexp_replace(regexp_replace(o, 'data', 'raw'), 'raw', 'store') END AS o FROM quads")
def trf_sequential(spark, sf_dir):
    chain = X.Sequential([X.ReplaceIri("data", "raw"), X.ReplaceIri("raw", "store")])
    return shown(chain.apply(_of(spark, sf_dir, "posts")))


@query(f"WITH {lifted('posts')} SELECT s, p, o FROM quads UNION ALL SELECT o, '{V}created', s FROM quads WHERE p = '{V}hasCreator'")
def trf_append_quad(spark, sf_dir):
    """Also TermTemplateQuadComponent and TermTemplateStaticNamedNode."""
    where = T.PositionTemplate
    t = X.AppendQuad(M.PredicateMatcher("vocabulary/hasCreator$"), where("object"), T.IriTemplate(f"{V}created"), where("subject"), where("graph"))
    return shown(t.apply(_of(spark, sf_dir, "posts")))


@query(f"WITH {lifted('posts')} SELECT s, p, o FROM quads UNION ALL SELECT s, '{V}creatorText', '\"' || o || '\"^^{XSD}anyURI' FROM quads WHERE p = '{V}hasCreator'")
def tt_literal(spark, sf_dir):
    where = T.PositionTemplate
    t = X.AppendQuad(M.PredicateMatcher("vocabulary/hasCreator$"), where("subject"), T.IriTemplate(f"{V}creatorText"), T.LiteralTemplate("object", f"{XSD}anyURI", "en"), where("graph"))
    return shown(t.apply(_of(spark, sf_dir, "posts")))


@query(f"""WITH {lifted('posts')} SELECT s, p, o FROM quads UNION ALL SELECT o || '/posts', '{V}index', o FROM quads WHERE p = '{V}hasCreator'
UNION ALL SELECT o || '/posts', '{A}', '{V}Index' FROM quads WHERE p = '{V}hasCreator'""")
def trf_append_link(spark, sf_dir):
    t = X.AppendQuadLink(M.PredicateMatcher("vocabulary/hasCreator$"), "object", f"{V}index", "posts", f"{V}Index", True)
    return shown(t.apply(_of(spark, sf_dir, "posts")))


@query(f"WITH {lifted('persons')} SELECT s, p, o FROM quads UNION ALL SELECT s, '{V}folder', 'http://ex.org/data' FROM quads WHERE p = '{A}' AND o = '{V}Person'")
def trf_append_resource_link(spark, sf_dir):
    t = X.AppendResourceLink("vocabulary/Person$", f"{V}folder", "..", link_remove_trailing_slash=True)
    return shown(t.apply(_of(spark, sf_dir, "persons")))


@query(f"""WITH {lifted('persons')}, typed AS (SELECT s FROM quads WHERE p = '{A}' AND o = '{V}Person') SELECT s, p, o FROM quads
UNION ALL SELECT s || '#policy-posts', '{X.SCL}appliesTo', s FROM typed UNION ALL SELECT s || '#policy-posts', '{X.SCL}scope', '"FOLLOW ?posts"^^{X.SCL}SCL' FROM typed""")
def trf_append_scl(spark, sf_dir):
    return shown(X.AppendResourceScl("vocabulary/Person$", "#policy-posts", "FOLLOW ?posts").apply(_of(spark, sf_dir, "persons")))


# ---- transformers with memory


@query(f"""WITH {lifted('lines')}, x AS (SELECT t, k1, k2, n, replace(s, '_:c', 'http://ex.org/prices/') AS s, p, replace(o, '_:c', 'http://ex.org/prices/') AS o FROM quads),
owner AS (SELECT o AS b, arg_min(s, (t, k1, k2, n)) AS s, min((t, k1, k2, n)) AS at FROM x WHERE p = '{V}hasLine' GROUP BY o)
SELECT coalesce(a.s || '#' || substr(a.b, 3), q.s) AS s, q.p, CASE WHEN c.at = (q.t, q.k1, q.k2, q.n) THEN c.s || '#' || substr(c.b, 3) ELSE q.o END AS o
FROM x q LEFT JOIN owner a ON a.b = q.s LEFT JOIN owner c ON c.b = q.o""")
def trf_blank_to_fragment(spark, sf_dir):
    """Prices, which no IRI points to, are named first; lines then are fragments of their posts."""
    named = X.BlankToNamed("^c", "http://ex.org/prices/")
    return shown(X.Sequential([named, X.BlankToFragment()]).apply(_of(spark, sf_dir, "lines")))


_REMAP = X.RemapResourceIdentifier("#Post", "vocabulary/Post$", "vocabulary/id$", "vocabulary/hasCreator$")
#: Posts by one aggregate: their creator and their identifier without its quotes.
_POST = f"""told AS (SELECT s, max(o) FILTER (WHERE p = '{V}hasCreator') AS creator, replace(max(o) FILTER (WHERE p = '{V}id'), '"', '') AS id FROM quads WHERE p IN ('{V}hasCreator', '{V}id') GROUP BY s)"""
_NEW = f"{_POST}, post AS (SELECT s, creator || '#Post' || id AS new FROM told)"


@query(f"WITH {lifted('posts', 'lines')}, {_NEW} SELECT coalesce(new, q.s) AS s, p, o FROM quads q LEFT JOIN post USING (s)")
def trf_remap(spark, sf_dir):
    return shown(_REMAP.apply(_of(spark, sf_dir, "posts", "lines")))


@query(f"""WITH {lifted('posts')}, {_POST}, post AS (SELECT s, regexp_replace(creator, '[^/]*$', '') || 'posts/' || regexp_replace(id, '^[0-9]*([0-9])$', '\\1') AS new FROM told)
SELECT coalesce(new, q.s) AS s, p, o FROM quads q LEFT JOIN post USING (s)""")
def trf_remap_modified(spark, sf_dir):
    """Also ValueModifierRegexReplaceGroup: identifiers cut to their last digit, below a relative separator."""
    t = X.RemapResourceIdentifier("posts/", "vocabulary/Post$", "vocabulary/id$", "vocabulary/hasCreator$", T.GroupModifier("^[0-9]*([0-9])$"))
    return shown(t.apply(_of(spark, sf_dir, "posts")))


_VARIANT = "list_sum(list_transform(string_split(creator, ''), lambda x: unicode(x))) % 2"


@query(f"""WITH {lifted('posts', 'lines')}, {_POST},
post AS (SELECT s, CASE WHEN {_VARIANT} = 0 THEN creator || '#Post' ELSE regexp_replace(creator, '[^/]*$', '') || 'posts/' END || id AS new FROM told)
SELECT coalesce(new, q.s) AS s, p, o FROM quads q LEFT JOIN post USING (s)""")
def trf_varying(spark, sf_dir):
    other = X.RemapResourceIdentifier("posts/", "vocabulary/Post$", "vocabulary/id$", "vocabulary/hasCreator$")
    return shown(X.VaryingResource("vocabulary/Post$", "vocabulary/hasCreator$", [_REMAP, other]).apply(_of(spark, sf_dir, "posts", "lines")))


@query(f"WITH {lifted('posts')} SELECT s, p, o FROM quads UNION ALL SELECT DISTINCT o, '{V}index', o || '/posts' FROM quads WHERE p = '{V}hasCreator'")
def trf_distinct(spark, sf_dir):
    t = X.Distinct(X.AppendQuadLink(M.PredicateMatcher("vocabulary/hasCreator$"), "object", f"{V}index", "posts"))
    return shown(t.apply(_of(spark, sf_dir, "posts")))


@query(f"""WITH {lifted('comments')}, mine AS (SELECT DISTINCT c.o AS target FROM quads a JOIN quads c ON c.s = a.s AND c.p = '{V}hasCreator' WHERE a.p = '{A}'),
i AS (SELECT target, regexp_replace(target, '[^/]*$', '') || 'settings/publicTypeIndex' AS idx, regexp_replace(target, '[^/]*$', '') || 'comments/' AS ref FROM mine),
made AS (SELECT target AS s, '{X.SOLID}publicTypeIndex' AS p, idx AS o FROM i UNION SELECT idx, '{A}', '{X.SOLID}TypeIndex' FROM i UNION SELECT idx, '{A}', '{X.SOLID}ListedDocument' FROM i
UNION SELECT idx || '#comments', '{A}', '{X.SOLID}TypeRegistration' FROM i UNION SELECT idx || '#comments', '{X.SOLID}forClass', '{V}Comment' FROM i UNION SELECT idx || '#comments', '{X.SOLID}instanceContainer', ref FROM i)
SELECT s, p, o FROM quads UNION ALL SELECT s, p, o FROM made""")
def trf_type_index(spark, sf_dir):
    index = X.AppendSolidTypeIndex("vocabulary/Comment$", "vocabulary/hasCreator$", "settings/publicTypeIndex", "#comments", "comments/", True)
    return shown(X.Distinct(index).apply(_of(spark, sf_dir, "comments")))


@query(f"WITH {lifted('posts')}, {_NEW} SELECT s || ',' || new AS line FROM post")
def cb_map(spark, sf_dir):
    quads = _of(spark, sf_dir, "posts")
    tracked = _REMAP.apply(quads.withColumns({"__orig": this_quad(), "__place": F.col("seq")}))
    return MapCallback([M.ResourceTypeMatcher("vocabulary/Post$")], "subject", ["original", "mapped"], "unused.csv").lines(tracked).select("line")


# ---- strategies

_OWNED = """owner AS (SELECT DISTINCT s AS doc, o AS b FROM quads WHERE o LIKE '\\_:%' ESCAPE '\\' AND s NOT LIKE '\\_:%' ESCAPE '\\'
  UNION SELECT owner.doc, q.o FROM owner JOIN quads q ON q.s = owner.b WHERE q.o LIKE '\\_:%' ESCAPE '\\')"""


@query(f"WITH RECURSIVE {lifted('posts', 'lines')}, {_OWNED} SELECT s AS doc, s, p, o FROM quads WHERE s NOT LIKE '\\_:%' ESCAPE '\\' UNION ALL SELECT doc, s, p, o FROM quads JOIN owner ON b = s")
def str_subject(spark, sf_dir):
    """With blank nodes two links deep."""
    return shown(S.BySubject().assign(_of(spark, sf_dir, "posts", "lines")), "doc")


@query(f"WITH {lifted('persons')} SELECT s || '/interests' AS doc, s, p, o FROM quads")
def str_subject_relative(spark, sf_dir):
    return shown(S.BySubject(relative_path="interests").assign(_of(spark, sf_dir, "persons")), "doc")


@query(f"""WITH RECURSIVE {lifted('posts', 'lines')}, owner AS (SELECT DISTINCT o AS doc, s AS b FROM quads WHERE s LIKE '\\_:%' ESCAPE '\\' AND o LIKE 'http%'
  UNION SELECT owner.doc, q.s FROM owner JOIN quads q ON q.o = owner.b WHERE q.s LIKE '\\_:%' ESCAPE '\\')
SELECT o AS doc, s, p, o FROM quads WHERE o LIKE 'http%' UNION ALL SELECT doc, s, p, o FROM quads JOIN owner ON b = o""")
def str_object(spark, sf_dir):
    return shown(S.ByObject().assign(_of(spark, sf_dir, "posts", "lines")), "doc")


@query(f"WITH {lifted('persons', 'posts')}, c AS (SELECT s, o AS doc FROM quads WHERE p = '{V}hasCreator') SELECT doc, s, p, o FROM quads JOIN c USING (s)")
def str_resource_object(spark, sf_dir):
    return shown(S.ByResourceObject("vocabulary/hasCreator$").assign(_of(spark, sf_dir, "persons", "posts")), "doc")


@query(f"WITH {lifted('persons', 'posts')} SELECT CASE p WHEN '{V}hasCreator' THEN o WHEN '{V}isLocatedIn' THEN 'http://ex.org/where' ELSE s END AS doc, s, p, o FROM quads")
def str_exception(spark, sf_dir):
    entries = [
        S.ExceptionEntry(M.PredicateMatcher("vocabulary/hasCreator$"), S.ByObject()),
        S.ExceptionEntry(M.PredicateMatcher("vocabulary/isLocatedIn$"), S.Constant("http://ex.org/where")),
    ]
    return shown(S.ByException(S.BySubject(), entries).assign(_of(spark, sf_dir, "persons", "posts")), "doc")


@query(f"WITH {lifted('persons', 'posts', 'places')} SELECT s AS doc, s, p, o FROM quads UNION ALL SELECT o, s, p, o FROM quads WHERE o LIKE 'http%' UNION ALL SELECT 'http://ex.org/all', s, p, o FROM quads")
def str_composite(spark, sf_dir):
    all_ = S.Composite([S.BySubject(), S.ByObject(), S.Constant("http://ex.org/all")])
    return shown(all_.assign(_of(spark, sf_dir, "persons", "posts", "places")), "doc")


@query(f"WITH {lifted('persons')} SELECT 'http://ex.org/dump' AS doc, s, p, o FROM quads")
def str_constant(spark, sf_dir):
    return shown(S.Constant("http://ex.org/dump").assign(_of(spark, sf_dir, "persons")), "doc")


_POSTS = r"^(http://ex.org/data/(?:post|pers)[0-9]*)[0-9]{2}$"


def _groups(spark, sf_dir, *names):
    return S.ByVoID([_POSTS]).grouped(_of(spark, sf_dir, *names))


_GROUPED = f"""direct AS (SELECT unnest([s, regexp_extract(s, '{_POSTS.replace("(?:", "(?:")}', 1)]) AS dataset, s, p, o FROM quads WHERE regexp_matches(s, '{_POSTS}')),
owner AS (SELECT DISTINCT dataset, o AS b FROM direct WHERE o LIKE '\\_:%' ESCAPE '\\' UNION SELECT owner.dataset, q.o FROM owner JOIN quads q ON q.s = owner.b WHERE q.o LIKE '\\_:%' ESCAPE '\\'),
grouped AS (SELECT * FROM direct UNION ALL SELECT dataset, s, p, o FROM quads JOIN owner ON b = s)"""


@query(f"WITH RECURSIVE {lifted('posts', 'lines')}, {_GROUPED} SELECT dataset, s, p, o FROM grouped")
def str_dataset_groups(spark, sf_dir):
    return shown(_groups(spark, sf_dir, "posts", "lines"), "dataset")


@query(f"""WITH RECURSIVE {lifted('posts', 'lines')}, {_GROUPED}
SELECT dataset, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, count(DISTINCT p) AS properties, count(DISTINCT CASE WHEN p = '{A}' THEN o END) AS classes FROM grouped GROUP BY dataset""")
def sum_void_totals(spark, sf_dir):
    return void_counts(_groups(spark, sf_dir, "posts", "lines"))[0]


@query(f"WITH RECURSIVE {lifted('posts', 'lines')}, {_GROUPED} SELECT dataset, p AS property, count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM grouped GROUP BY dataset, p")
def sum_void_properties(spark, sf_dir):
    return void_counts(_groups(spark, sf_dir, "posts", "lines"))[1]


@query(f"WITH RECURSIVE {lifted('posts', 'persons')}, {_GROUPED} SELECT dataset, o AS class, count(DISTINCT s) AS entities FROM grouped WHERE p = '{A}' GROUP BY dataset, o")
def sum_void_classes(spark, sf_dir):
    return void_counts(_groups(spark, sf_dir, "posts", "persons"))[2]


_VOID = "http://rdfs.org/ns/void#"


@query(f"""WITH {lifted('persons', 'posts')}, grouped AS (SELECT 'http://ex.org/' AS dataset, * FROM quads), words AS (SELECT DISTINCT dataset, p AS value FROM grouped UNION SELECT DISTINCT dataset, o FROM grouped WHERE p = '{A}'),
{_murmur_sql('words', 'value')}, part AS (SELECT dataset, value, dataset || '#' || lower(to_hex(h)) AS iri FROM hashed),
pp AS (SELECT g.dataset, g.p, part.iri, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT o) AS no FROM grouped g JOIN part ON part.dataset = g.dataset AND part.value = g.p GROUP BY ALL),
cp AS (SELECT g.dataset, g.o AS c, part.iri, count(DISTINCT s) AS n FROM grouped g JOIN part ON part.dataset = g.dataset AND part.value = g.o WHERE g.p = '{A}' GROUP BY ALL),
tot AS (SELECT dataset, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT o) AS no, count(DISTINCT p) AS np, count(DISTINCT CASE WHEN p = '{A}' THEN o END) AS nc FROM grouped GROUP BY dataset),
made AS (
SELECT dataset AS s, '{A}' AS p, '{_VOID}Dataset' AS o FROM tot UNION ALL SELECT dataset, '{_VOID}uriSpace', '"' || dataset || '"' FROM tot
UNION ALL SELECT dataset, '{_VOID}' || k, '"' || v || '"^^{XSD}integer' FROM (SELECT dataset, unnest(['classes', 'triples', 'properties', 'distinctSubjects', 'distinctObjects']) AS k, unnest([nc, n, np, ns, no]) AS v FROM tot)
UNION ALL SELECT DISTINCT dataset, '{_VOID}vocabulary', regexp_replace(value, '#?(\\w+)$', '') FROM words
UNION ALL SELECT dataset, '{_VOID}propertyPartition', iri FROM pp UNION ALL SELECT iri, '{A}', '{_VOID}Dataset' FROM pp UNION ALL SELECT iri, '{_VOID}property', p FROM pp
UNION ALL SELECT iri, '{_VOID}' || k, '"' || v || '"^^{XSD}integer' FROM (SELECT iri, unnest(['triples', 'distinctSubjects', 'distinctObjects']) AS k, unnest([n, ns, no]) AS v FROM pp)
UNION ALL SELECT dataset, '{_VOID}classPartition', iri FROM cp UNION ALL SELECT iri, '{A}', '{_VOID}Dataset' FROM cp UNION ALL SELECT iri, '{_VOID}class', c FROM cp
UNION ALL SELECT iri, '{_VOID}entities', '"' || n || '"^^{XSD}integer' FROM cp)
SELECT 'http://ex.org/' AS doc, s, p, o FROM made""")
def str_void(spark, sf_dir):
    """A VoID description, quad by quad."""
    return shown(S.ByVoID(["^http://ex.org/"]).assign(_of(spark, sf_dir, "persons", "posts")), "doc")


_PAIRS = """pairs AS (SELECT DISTINCT dataset, family, key, member FROM (
  SELECT dataset, 'projectedResource' AS family, s AS key, p AS member FROM grouped UNION ALL SELECT dataset, 'projectedResource', s, o FROM grouped UNION ALL SELECT dataset, 'projectedResource', o, s FROM grouped
  UNION ALL SELECT dataset, 'projectedResource', o, p FROM grouped UNION ALL SELECT dataset, 'projectedProperty', p, s FROM grouped UNION ALL SELECT dataset, 'projectedProperty', p, o FROM grouped)
  WHERE key LIKE 'http%' AND member LIKE 'http%')"""


@query(f"WITH RECURSIVE {lifted('posts', 'lines')}, {_GROUPED}, {_PAIRS} SELECT dataset, family, key, member FROM pairs")
def sum_bloom_pairs(spark, sf_dir):
    return bloom_pairs(_groups(spark, sf_dir, "posts", "lines"))


_FNV = "list_reduce(list_concat([{}::BIGINT], list_transform(string_split(member, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c)::HUGEINT * 16777619 % 4294967296)::BIGINT)"


_FILTERS = f"""grouped AS (SELECT s AS dataset, * FROM quads), {_PAIRS}, h AS (SELECT member, {_FNV.format(0x811C9DC5)} AS a, {_FNV.format(0x050C5D1F)} AS b FROM (SELECT DISTINCT member FROM pairs)),
bits AS (SELECT DISTINCT dataset, family, key, (a + i * b) % 256 AS bit FROM (SELECT *, unnest(range(0, 4)) AS i FROM pairs JOIN h USING (member))),
bytes AS (SELECT dataset, family, key, bit // 8 AS byte, sum(1 << (bit % 8)::INT) AS v FROM bits GROUP BY ALL),
every AS (SELECT dataset, family, key, unnest(range(0, 32)) AS byte FROM (SELECT DISTINCT dataset, family, key FROM bits)),
filters AS (SELECT dataset, family, key, string_agg(printf('%02X', coalesce(v, 0)::INT), '' ORDER BY byte) AS bitmap FROM every LEFT JOIN bytes USING (dataset, family, key, byte) GROUP BY dataset, family, key)"""


@query(f"WITH {lifted('persons')}, {_FILTERS} SELECT * FROM filters")
def sum_bloom_filters(spark, sf_dir):
    grouped = S.ByVoID(["^http://ex.org/data/pers[0-9]+"]).grouped(_of(spark, sf_dir, "persons"))
    return bloom_filters(grouped, 256, 4).select("dataset", "family", "key", F.hex("bitmap").alias("bitmap"))


_MEM = "http://semweb.mmlab.be/ns/membership#"


@query(f"""WITH {lifted('persons')}, {_FILTERS}, loc AS (SELECT DISTINCT dataset, regexp_extract(dataset, '^http://ex.org/data/pers[0-9]') AS doc FROM filters),
names AS (SELECT dataset, '' AS family, '' AS key, 'HashFunction' AS kind, doc, doc AS base, dataset || '{_MEM}HashFunction' AS value, '' AS bitmap FROM loc
  UNION ALL SELECT dataset, family, key, kind, doc, doc, dataset || '{_MEM}' || kind || '{_MEM}' || family || key, bitmap FROM filters JOIN loc USING (dataset) JOIN (VALUES ('MemberCollection'), ('BloomFilter')) k(kind) ON true),
{_murmur_sql('names', 'value')}, iris AS (SELECT *, doc || '#' || lower(to_hex(h)) AS iri FROM hashed),
hf AS (SELECT * FROM iris WHERE kind = 'HashFunction'), mc AS (SELECT * FROM iris WHERE kind = 'MemberCollection'),
bf AS (SELECT b.*, mc.iri AS collection, hf.iri AS hashes FROM iris b JOIN mc USING (dataset, family, key) JOIN hf ON hf.dataset = b.dataset WHERE b.kind = 'BloomFilter')
SELECT doc, iri AS s, '{A}' AS p, '{_MEM}HashFunction' AS o FROM hf UNION ALL SELECT doc, iri, '{A}', '{_MEM}FowlerNollVo' FROM hf UNION ALL SELECT doc, iri, '{_MEM}hashSize', '"4"^^{XSD}integer' FROM hf
UNION ALL SELECT doc, iri, '{A}', '{_MEM}MemberCollection' FROM mc UNION ALL SELECT doc, iri, '{_MEM}sourceCollection', dataset FROM mc UNION ALL SELECT doc, iri, '{_MEM}' || family, key FROM mc
UNION ALL SELECT doc, iri, '{A}', '{_MEM}' || unnest(['MembershipFunction', 'ApproximateMembershipFunction', 'BloomFilter']) FROM bf UNION ALL SELECT doc, iri, '{_MEM}hashFunction', hashes FROM bf
UNION ALL SELECT doc, iri, '{_MEM}memberCollection', collection FROM bf UNION ALL SELECT doc, iri, '{_MEM}bitSize', '"256"^^{XSD}integer' FROM bf
UNION ALL SELECT doc, iri, '{_MEM}binaryRepresentation', '"' || to_base64(unhex(bitmap)) || '"^^{XSD}base64Binary' FROM bf""")
def str_bloom(spark, sf_dir):
    """Filters of persons, quad by quad, in documents by the first digit of their number."""
    strategy = S.ByBloom(["^http://ex.org/data/pers[0-9]+"], 256, 4, ["^http://ex.org/data/pers[0-9]"])
    return shown(strategy.assign(_of(spark, sf_dir, "persons")), "doc")


@query(f"WITH RECURSIVE {lifted('posts', 'lines')}, {_OWNED} SELECT doc, b FROM owner WHERE b LIKE '\\_:%' ESCAPE '\\'")
def str_blank_owners(spark, sf_dir):
    reach = owners(*blank_links(_of(spark, sf_dir, "posts", "lines"), "s", "o"))
    return reach.select(F.col("key").alias("doc"), F.concat(F.lit("_:"), F.col("b")).alias("b"))


# ---- functions


@query(r"""SELECT page_id, regexp_replace(url, '^(https?)://([a-z]+)\.', '\2+\1$/') AS replaced FROM pages WHERE url IS NOT NULL""")
def fn_replace(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url is not null")
    return pages.select("page_id", js_replace(F.col("url"), r"^(https?):\/\/([a-z]+)\.", "$2+$1$$/").alias("replaced"))


@query(r"""SELECT page_id, regexp_replace(b, '^([a-z]+://[^/]*/(.*/)?)[^/]*$', '\1') || 'x/y#z' AS below, regexp_replace(b, '^([a-z]+://[^/]*/).*$', '\1') || 'top' AS top, split_part(url, '#', 1) || '#me' AS here
FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS b FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/?#]+/'))""")
def fn_resolve(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("url").rlike("^[a-z]+://[^/?#]+/"))
    url = F.col("url")
    return pages.select("page_id", resolve_iri("./q/../x/y#z", url).alias("below"), resolve_iri("/top", url).alias("top"), resolve_iri("#me", url).alias("here"))


@query(f"WITH {lifted('persons')} SELECT DISTINCT s, list_sum(list_transform(string_split(s, ''), lambda x: unicode(x)))::BIGINT AS total FROM quads")
def fn_code_sum(spark, sf_dir):
    return _of(spark, sf_dir, "persons").select(F.col("s.value").alias("s"), code_sum(F.col("s.value")).alias("total")).distinct()


__all__ = ["ORACLE_SQL", "QUERIES"]
