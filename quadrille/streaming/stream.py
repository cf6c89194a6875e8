"""Structured Streaming for the operators that take quads one by one.

Stateless matchers, transformers and strategies are the same column expressions on a stream. Those with memory
(renamed resources, summaries, full resources) need to have seen everything and are refused. So do blank-node owners:
by subject or object, quads whose key is a blank node are left out (blank="drop", the default), or fail the stream
(blank="error").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.terms import is_bnode, is_iri
from ..functions.text import resolve_iri
from ..operators.strategies import BySubject, ByObject, Constant, Strategy
from ..operators.transforms import Transformer, apply_all
from ..sources.rdf import parse_lines


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of quads of the N-Triples and N-Quads files that arrive in a folder. seq is the file and the start of the block that
    a task reads: Spark numbers no rows of a stream, so lines of a block share their place, and nothing on a stream relies on
    more. Blank nodes are named after their file."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    file = F.shiftrightunsigned(F.xxhash64(F.col("_metadata.file_path")), 1).alias("file")
    return parse_lines(lines.select("value", file, F.col("_metadata.file_block_start").alias("line")), F.col("file"))


def _own(quads: DataFrame, key: str, doc: Column, blank: str) -> DataFrame:
    if blank not in ("drop", "error"):
        raise ValueError("blank: drop or error")
    if blank == "drop":
        return quads.where(is_iri(key)).select(doc.alias("doc"), "seq", "s", "p", "o", "g")
    wrong = F.raise_error(F.concat(F.lit("The owners of a blank node are not known on a stream: "), F.col(f"{key}.value"))).cast("string")
    return quads.where(is_iri(key) | is_bnode(key)).select(F.when(is_bnode(key), wrong).otherwise(doc).alias("doc"), "seq", "s", "p", "o", "g")


def assign(strategy: Strategy, quads: DataFrame, blank: str = "drop") -> DataFrame:
    """A strategy on a stream: the constant one, and subject or object, in which blank nodes are in no document, or with
    blank="error" end the stream."""
    if isinstance(strategy, Constant):
        return strategy.assign(quads)
    if isinstance(strategy, BySubject):
        value = F.col("s.value")
        below = F.when(value.endswith("/"), value).otherwise(F.concat(value, F.lit("/")))
        return _own(quads, "s", value if strategy.relative_path is None else resolve_iri(strategy.relative_path, below), blank)
    if isinstance(strategy, ByObject):
        return _own(quads, "o", F.col("o.value"), blank)
    raise ValueError(f"{type(strategy).__name__} must see all quads and does not run on a stream")


def fragments(quads: DataFrame, transformers: list[Transformer], strategy: Strategy, blank: str = "drop") -> DataFrame:
    """The stream of fragments (doc, seq, s, p, o, g)."""
    held = [type(t).__name__ for t in transformers if not t.stateless]
    if held:
        raise ValueError(f"{', '.join(held)} must see all quads and does not run on a stream")
    return assign(strategy, apply_all(transformers, quads), blank)


def write_table(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of fragments to a Parquet table, exactly once. once: what is there now, then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
