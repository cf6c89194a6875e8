"""Operators for large-scale training-data pipelines: language identification, near-duplicate removal, media
columns, toxicity, URL lists, token files, mixing, sharding and packing."""
