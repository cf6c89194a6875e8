"""The whole: source, transformers with callbacks, strategy, sink, as one plan with an action for each sink."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.terms import this_quad
from ..operators.transforms import apply_all
from .registry import build, component
from .storage import working

#: Warnings that a run shows; it counts all.
SHOWN = 20


@component("Fragmenter")
@dataclass
class Fragmenter:
    quad_source: object
    fragmentation_strategy: object
    quad_sink: object = None
    transformers: list = field(default_factory=list)
    transform_callback: list = field(default_factory=list)
    warn: bool = True

    def transformed(self, spark: SparkSession) -> DataFrame:
        """The quads after all transformers."""
        return apply_all(self.transformers, self.quad_source.read(spark))

    def fragments(self, spark: SparkSession) -> DataFrame:
        """Rows (doc, seq, s, p, o, g)."""
        return self.fragmentation_strategy.assign(self.transformed(spark))

    def run(self, spark: SparkSession) -> None:
        """Writes all there is to write, warns of what is in no document, and removes its working tables."""
        with working(spark):
            quads = self.quad_source.read(spark)
            if self.transformers and self.transform_callback:
                tracked = apply_all(self.transformers, quads.withColumns({"__orig": this_quad(), "__place": quads["seq"]}))
                for callback in self.transform_callback:
                    callback.run(tracked)
            ready = apply_all(self.transformers, quads)
            self.quad_sink.write(self.fragmentation_strategy.assign(ready))
            if self.warn and (lost := self.fragmentation_strategy.unplaced(ready)) is not None:
                some = [r["warning"] for r in lost.limit(SHOWN + 1).collect()]
                more = f"and {lost.count() - SHOWN} more" if len(some) > SHOWN else None
                print(*some[:SHOWN], *([more] if more else []), sep="\n", file=sys.stderr, end="\n" if some else "")


def load(config: str | dict) -> Fragmenter:
    """A fragmenter from a JSON configuration: its path, or what it parses to."""
    from .. import components  # noqa: F401  (registers all of them)

    if isinstance(config, str):
        with open(config) as f:
            config = json.load(f)
    out = build(config)
    if not isinstance(out, Fragmenter):
        raise ValueError("the configuration does not describe a Fragmenter")
    return out
