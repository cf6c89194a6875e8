"""What runs beside the transformers: mappings from original to transformed terms, as CSV lines."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import position
from ..plans.registry import component
from .matchers import Matcher


@component("TransformCallbackMap")
@dataclass
class MapCallback:
    """For each original quad of which an output matches any matcher: the original's field, then that of each such
    output, in order. A renamed resource's quads count for the quad that they came from."""

    matchers: list[Matcher]
    field_to_map: str
    columns: list[str]
    file: str

    def lines(self, transformed: DataFrame) -> DataFrame:
        """Rows (seq, line) from transformed quads that carry the original in __orig and its place in __place."""
        field, marked = position(self.field_to_map), transformed.withColumn("__any", F.lit(False))
        for matcher in self.matchers:
            # a matcher sees the quads that none before it has claimed
            rest = matcher.mark(marked.where(~F.col("__any")), "__hit").withColumn("__any", F.col("__hit")).drop("__hit")
            marked = marked.where("__any").unionByName(rest)
        out = marked.where("__any").groupBy(F.col("__place").alias("seq")).agg(
            F.first(F.col(f"__orig.{field}.value")).alias("original"), F.array_sort(F.collect_list(F.struct("seq", F.col(f"{field}.value").alias("value")))).alias("made")
        )
        return out.select("seq", F.concat_ws(",", F.col("original"), F.col("made.value")).alias("line"))

    def run(self, transformed: DataFrame) -> None:
        from ..sinks.files import write_lines

        lines, header = self.lines(transformed), ",".join(self.columns)
        if not write_lines(lines.withColumn("path", F.lit(os.path.abspath(self.file))), header=header):
            os.makedirs(os.path.dirname(os.path.abspath(self.file)), exist_ok=True)
            with open(self.file, "w") as out:
                out.write(header + "\n")
