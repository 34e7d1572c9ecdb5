"""End-to-end chunk labelling: texts -> tokens -> chunks -> labels (C13 inputs).

A sample's text, tokens, chunks and reference terms stay in its row as
arrays.  Texts and references meet in one join by sample, before either is tagged,
so what is shuffled is the texts; nothing is written in between.  The generated side
(texts, tokens, chunks) and the reference side (reference terms) are
prepared separately, so chunk-only work never touches the references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import chunks as chunk_ops
from . import matching, tagger

KEY = "sample_id"
TRUTH = matching.TRUTH


@dataclass
class GeneratedSide:
    samples: DataFrame  # sample_id, the text, chunks

    @property
    def chunks(self) -> DataFrame:
        return chunk_ops.chunk_rows(self.samples)


@dataclass
class LabelInputs:
    samples: DataFrame  # sample_id, the text, chunks, gt_objects, gt_attributes, gt_relations
    references: DataFrame  # sample_id, gt_objects, gt_attributes, gt_relations
    texts: DataFrame | None = None  # sample_id, the text, gt_texts, where the default tagger takes them
    text_col: str = "generated_description"

    @property
    def chunks(self) -> DataFrame:
        return chunk_ops.chunk_rows(self.samples)

    @property
    def gt_objects(self) -> DataFrame:
        return self.references.select(KEY, F.explode_outer("gt_objects").alias("obj")).filter("obj IS NOT NULL")

    @property
    def gt_attributes(self) -> DataFrame:
        return self.references.select(KEY, F.inline_outer("gt_attributes")).filter("attr IS NOT NULL")

    @property
    def gt_relations(self) -> DataFrame:
        return self.references.select(KEY, F.explode_outer("gt_relations").alias("rel")).filter("rel IS NOT NULL")


def _texts(generations: DataFrame, text_col: str, *keep) -> DataFrame:
    return generations.filter(generations[text_col].isNotNull() & (generations[text_col] != "")).select(KEY, text_col, *keep)


def _chunked(texts: DataFrame, text_col: str, tag) -> DataFrame:
    if tag is tagger.tag:
        return chunk_ops.with_chunks(texts, text_col)
    # another tagger gives a table of tokens
    texts = materialize(texts)
    rows = chunk_ops.extract_chunks(materialize(tag(texts.select(KEY, text_col), [KEY], text_col)), texts, text_col)
    return texts.join(chunk_ops.chunk_arrays(rows), KEY)


def prepare_generated(generations: DataFrame, text_col: str = "generated_description",
                      tag=tagger.tag) -> GeneratedSide:
    """Non-empty texts, their tokens (pluggable tagger, F5) and chunks."""
    return GeneratedSide(_chunked(_texts(generations, text_col), text_col, tag))


def _listed(refs: DataFrame, gt_col: str) -> DataFrame:
    """A sample's references as one array."""
    return refs.groupBy(KEY).agg(F.collect_list(gt_col).alias("gt_texts"))


def _references(references: DataFrame, gt_col: str) -> DataFrame:
    return references.filter(references[gt_col].isNotNull() & (references[gt_col] != "")).select(KEY, "gt_idx", gt_col)


def prepare_references(references: DataFrame, gt_col: str = "gt_text", tag=tagger.tag) -> DataFrame:
    """Reference objects, attributes and relations as arrays per sample; null / '' references skipped."""
    refs = _references(references, gt_col)
    if tag is tagger.tag:
        return matching.with_truth(_listed(refs, gt_col)).drop("gt_texts")
    refs = materialize(refs)
    tokens = materialize(tag(refs, [KEY, "gt_idx"], gt_col))
    parts = [matching.truth_objects(tokens).groupBy(KEY).agg(F.sort_array(F.collect_set("obj")).alias("gt_objects")),
             matching.truth_attributes(refs, tokens, gt_col).groupBy(KEY).agg(F.sort_array(F.collect_set(F.struct("category", "attr"))).alias("gt_attributes")),
             matching.truth_relations(refs, gt_col).groupBy(KEY).agg(F.sort_array(F.collect_set("rel")).alias("gt_relations"))]
    out = parts[0].join(parts[1], KEY, "full").join(parts[2], KEY, "full")
    return out.withColumns({"gt_objects": F.coalesce("gt_objects", F.array().cast("array<string>")),
                            "gt_attributes": F.coalesce("gt_attributes", F.array().cast("array<struct<category:string,attr:string>>")),
                            "gt_relations": F.coalesce("gt_relations", F.array().cast("array<string>"))})


def prepare(generations: DataFrame, references: DataFrame, text_col: str = "generated_description",
            gt_col: str = "gt_text", tag=tagger.tag) -> LabelInputs:
    truth = prepare_references(references, gt_col, tag)
    texts, met = _texts(generations, text_col), None
    if tag is tagger.tag:
        # texts meet before any is tagged: what Python gives has no known partitioning and would be shuffled once more
        met = texts.join(_listed(_references(references, gt_col), gt_col), KEY, "left")
        texts = matching.with_truth(met).drop("gt_texts")
    else:
        texts = texts.join(truth, KEY, "left")
    samples = _chunked(texts, text_col, tag)
    return LabelInputs(samples.select(KEY, text_col, "chunks", *TRUTH), truth, met, text_col)


def label(inputs: LabelInputs, fuzzy: bool = True, fields: tuple = matching.LABELLED) -> DataFrame:
    """A row per chunk with its label (``matching.with_labels``) and, of the other ``fields``, those asked for."""
    if inputs.texts is not None:
        return chunk_ops.chunk_rows(matching.labelled_texts(inputs.texts, inputs.text_col, fuzzy=fuzzy, fields=fields))
    return chunk_ops.chunk_rows(matching.with_labels(inputs.samples, fuzzy)).select(KEY, "chunk_idx", *fields)


def explained(inputs: LabelInputs, fuzzy: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Labelled chunks with reason and reference sets (C14), of all samples or of those in ``only`` (sample_id)."""
    samples = inputs.samples if only is None else inputs.samples.join(F.broadcast(only), KEY, "left_semi")
    listed = F.sort_array(F.transform("gt_attributes", lambda a: F.concat_ws(":", a["category"], a["attr"])))
    filled = {c: F.when(F.size(c) > 0, listed if c == "gt_attributes" else F.col(c)) for c in TRUTH}
    labelled = matching.with_labels(samples, fuzzy).withColumns(filled)
    return matching.with_reasons(chunk_ops.chunk_rows(labelled, keep=TRUTH))
