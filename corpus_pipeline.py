"""A training corpus from raw documents: toxic documents go, then those of no language, then near-duplicates; sources
are mixed to their target weights, and what is left is packed into windows.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import bounded, free_names, give_back, materialize, read_table, sieve, sifted, slim
from quadrille.llm.langid import UNKNOWN, fit_languages, judged
from quadrille.llm.mixing import mixture
from quadrille.llm.packing import pack
from quadrille.llm.shingles import near_sets, with_bands
from quadrille.llm.toxicity import fit_toxicity, toxicity

#: A document is rejected from this toxicity on.
TOXIC = 0.5
#: And below any of these (judged()). Of 8,400 labelled rows of sf0.1 that were not learned from, all are above LIKE (the
#: least had -1.04; random letters in three words or more had at most -1.85, six other languages at most -1.73). Of 4,000, one
#: is below MARGIN, as are 3 in 4 texts, or more, of which half is one language and half another. The least share of letters
#: there, counted by characters, is 0.29.
MARGIN, LIKE, LETTERS = 0.15, -1.5, 0.25


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches TOXIC; the labels of the corpus teach the model. Null texts stay."""
    slim(spark)
    (score,) = free_names(docs, "score")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    give_back()
    return docs.withColumn(score, toxicity(model, F.col("text"))).where((F.col(score) < TOXIC) | F.col("text").isNull()).drop(score)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or of few, those between languages (won by less than MARGIN), and those that are
    like none (likeness below LIKE). lang becomes what was predicted. Where no document has a label to learn from, only
    those without a letter go, and lang stays."""
    slim(spark)
    (p,) = free_names(docs, "p")
    model = fit_languages(docs)
    give_back()
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = docs.withColumn(p, judged(model, F.col("text"))).where(F.col(p)["lang"] != UNKNOWN)
    found = found.where((F.col(p)["margin"] >= MARGIN) & (F.col(p)["likeness"] >= LIKE) & (F.col(p)["letters"] >= LETTERS))
    return found.withColumn("lang", F.col(p)["lang"]).drop(p)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies, those that Jaccard similarities of 0.8 or more between the sets of
    their five-word shingles connect: the smallest by (id, row). Null ids come last. SimHash and min-wise bands find the candidates."""
    slim(spark)
    row, sketch = free_names(docs, "row", "sketch")
    rows = materialize(with_bands(docs.withColumn(row, F.monotonically_increasing_id()), F.col("text"), sketch), "pipeline-sketches")
    # rows of a set are reduced to their least before groups are formed, and groups to theirs after
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))
    sets = rows.groupBy(F.col(sketch)["key"].alias("key"))
    least = materialize(sets.agg(F.min(order).alias("least"), F.first(F.col(sketch)["fp"]).alias("fp"), F.first(F.col(sketch)["bands"]).alias("bands")), "pipeline-sets")
    groups = near_sets(rows.select(F.col(row).alias("id"), "text"), least.select(F.col("least.row").alias("id"), "fp", "bands"))
    named = least.join(groups, F.col("least.row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "least.row"))
    kept = named.groupBy("root").agg(F.min("least").alias("least"))
    # what goes is a smaller table than what stays, and of what stays only the few rows that a sieve takes for it are moved
    gone = materialize(rows.select(row).join(kept.select(F.col("least.row").alias(row)), row, "left_anti"), "pipeline-gone")
    bits = sieve(gone, row)
    stays = sifted(rows, row, bits, False).unionByName(sifted(rows, row, bits).hint("merge").join(gone, row, "left_anti"))
    return stays.drop(row, sketch)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it whole, and once more if it takes half of it or more besides. A
    document without words is not taken."""
    slim(spark)
    rows = mixture(docs, keep=tuple(docs.columns))
    times = F.coalesce(F.floor(F.try_divide("taken", "size") + 0.5), F.lit(0)).cast("int")
    return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 tokens."""
    import public_tokenizers

    slim(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", keep_clean), ("language", keep_languages), ("near-duplicates", drop_copies), ("mixing", mix_sources), ("packing", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each stage's result written to the shared folder and read again."""
    docs = read_table(bounded(spark), sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


#: Models, tokenizers and XXH64 are beyond SQL: tests hold near-duplicates and mixing against brute force, toxicity against
#: its model's scores row by row, language against planted documents, and packing as op10 does.
ORACLE_SQL = None
