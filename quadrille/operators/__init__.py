"""Operators on quads: matchers, templates, transformers, strategies, summaries."""
