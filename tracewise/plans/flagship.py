"""The flagship query used by ``entry()``: the labelled chunk dataset.

Generated descriptions and reference captions -> tagger -> chunks ->
hierarchical labels (full rules, fuzzy stage included) -> 18 chunk
features -> the sample's 74 signal features (traces, layer shifts,
consistency, concentration, confidence, repetition).
"""

from __future__ import annotations


def flagship(spark, sf_dir):
    from .learn_queries import chunk_dataset
    return chunk_dataset(spark, sf_dir)
