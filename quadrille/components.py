"""Imports every module that registers components."""

from .operators import callbacks, matchers, strategies, templates, transforms
from .plans import fragmenter
from .sinks import files
from .sources import rdf

__all__ = ["callbacks", "files", "fragmenter", "matchers", "rdf", "strategies", "templates", "transforms"]
