"""Sample catalogs, QA sources, naming, prompts and dialogues.

(S1-S4, S7-S9, P2, P4, P5, P13, P14, A1, O1, O2, W4, P12)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.json_arrays import RANGE_BYTES, read_json_arrays
from .sequence import ordered_index

# --- fixed values: prompt templates per dataset (P5) -------------------------
PROMPTS = {
    "truthfulqa": "Answer the question concisely. Q: {question} A:",
    "triviaqa": "Answer the question concisely. Q: {question} A:",
    "tydiqa": "Answer the question concisely based on the context: \n {context} \n Q: {question} A:",
    "coqa": "Answer the question concisely based on the context: \n {story} \n Q: {question} A:",
    "haluevaldia": ("You are an assistant that answers questions concisely and accurately. "
                    "Use the knowledge and conversation to respond naturally to the most recent message.\n"
                    "Knowledge: {knowledge}.\nConversations: {dialogue_history}.\nYour Response:"),
    "haluevalqa": "Answer the question concisely based on the context: \n {context} \n Q: {question} A:",
    "haluevalsum": "{document} \n Please summarize the above article concisely. A:",
}
# haluevalqa fills {context} from the knowledge column
PROMPT_FIELDS = {"haluevalqa": {"context": "knowledge"}}
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")
# ------------------------------------------------------------------------------


def _fill(template: str, fields: dict[str, str]) -> Column:
    """Template -> concat of literals and (null -> '') columns."""
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        name = fields.get(m.group(1), m.group(1))
        parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def prompt(dataset: Column | str, available: set[str]) -> Column:
    """Prompt text by dataset name; unknown dataset -> the question (P5).

    ``available`` lists the input columns; templates needing a missing column
    are skipped (they cannot be the row's dataset).
    """
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    out = F.coalesce(F.col("question").cast("string"), F.lit("")) if "question" in available else F.lit("")
    for name, tpl in reversed(list(PROMPTS.items())):
        need = {PROMPT_FIELDS.get(name, {}).get(f, f) for f in re.findall(r"\{(\w+)\}", tpl)}
        if need <= available:
            out = F.when(ds == name, _fill(tpl, PROMPT_FIELDS.get(name, {}))).otherwise(out)
    return out


def name_samples(df: DataFrame, dataset: str | Column, order: list[str], idx: str = "idx",
                 partition: str | None = None) -> DataFrame:
    """``{dataset}_sample_{idx}`` with a 0-based index in dataset order.

    The index comes from ``ordered_index`` (range-partitioned), never from a
    single-partition window.  ``partition`` numbers rows within each value of
    that column (one dataset per value).
    """
    ds = F.lit(dataset) if isinstance(dataset, str) else dataset
    d = df.withColumn("_ds", ds)
    d = ordered_index(d, partition or "_ds", order, out=idx)
    nm = F.concat(F.col("_ds"), F.lit("_sample_"), F.col(idx).cast("string"))
    return d.withColumn("name", nm).withColumn("filename", F.concat(nm, F.lit(".txt"))) \
            .withColumn("path", nm).drop("_ds")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the first row per key in ``order`` (A1, seen-set dedupe).

    A group-by with ``min`` of a struct led by the order column: partial
    aggregation keeps one row per key per task, so a hot key costs nothing.
    """
    others = [c for c in df.columns if c not in (key, order)]
    g = df.groupBy(key).agg(F.min(F.struct(order, *others)).alias("_r"))
    return g.select(key, "_r.*")


def english_only(df: DataFrame, id_col: str = "id", needle: str = "english") -> DataFrame:
    """``"english" in id`` (P2), case-sensitive substring test."""
    return df.filter(F.col(id_col).contains(needle))


def first_n(df: DataFrame, idx: str, n: int | None) -> DataFrame:
    """First ``n`` rows in dataset order (O1, O2): a filter on the index."""
    return df if n is None else df.filter(F.col(idx) < n)


def text_present(df: DataFrame, col: str = "generated_description") -> DataFrame:
    """Drop rows whose text is null or empty."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != ""))


def sentence_context(question: Column, text: Column) -> Column:
    """``Q: {question} A: {text}`` when a question exists, else the text."""
    return F.when(question.isNotNull(), F.concat(F.lit("Q: "), question.cast("string"),
                                                 F.lit(" A: "), text)).otherwise(text)


def dialogue_pairs(conv: DataFrame) -> DataFrame:
    """Question/answer rows with running story, CoQA style.

    A user turn t is paired with the assistant turn t+1; the story starts as
    the conversation's system text ('' if none) and grows by
    `` Q: {q} A: {a}`` plus ``.`` when that does not already end in ``.``.
    Each row carries the story *before* its own question.  The story is a
    prefix concatenation, so its size is quadratic in the number of turns of
    a conversation; that is the semantics of the dataset.
    """
    c = conv.select("conv_id", "turn", "role", "text")
    sys_text = c.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.min(F.struct("turn", "text")).alias("_s")).select("conv_id", F.col("_s.text").alias("story0"))
    q = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = q.join(a, ["conv_id", "turn"], "inner")
    seg = F.concat(F.lit(" Q: "), F.col("question"), F.lit(" A: "), F.col("answer"))
    qa = qa.withColumn("_seg", F.when(seg.endswith("."), seg).otherwise(F.concat(seg, F.lit("."))))
    w = Window.partitionBy("conv_id").orderBy("turn")
    qa = (qa.withColumn("q_idx", (F.row_number().over(w) - 1).cast("int"))
            .withColumn("_prev", F.collect_list("_seg").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    qa = qa.join(sys_text, "conv_id", "left")
    return qa.select(
        "conv_id", "turn", "q_idx",
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("q_idx").cast("string")).alias("id"),
        F.concat(F.coalesce(F.col("story0"), F.lit("")), F.array_join("_prev", "")).alias("story"),
        "question", "answer")


_TURNS = "array<struct<input_text:string,span_start:int>>"
_COQA = f"id string, story string, questions {_TURNS}, answers {_TURNS}, additional_answers struct<`0`:{_TURNS},`1`:{_TURNS},`2`:{_TURNS}>"


def coqa_from_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Nested CoQA JSON -> one row per question.

    ``data[]`` holds story, questions[], answers[] and
    additional_answers{"0","1","2"}[]; rows are zipped by position and the
    running story is rebuilt by ``dialogue_story``.  ``doc_pos`` and ``pos``
    give the order of the file, which is read by byte ranges.
    """
    data = read_json_arrays(spark, path, range_bytes).filter(F.col("name") == "data")
    d = data.select(F.struct("path", "offset").alias("doc_pos"), F.from_json("json", _COQA).alias("d")).select("doc_pos", "d.*")
    z = d.select("doc_pos", "id", "story", F.posexplode(F.arrays_zip(
        F.col("questions").alias("q"), F.col("answers").alias("a"),
        F.col("additional_answers.0").alias("x0"), F.col("additional_answers.1").alias("x1"),
        F.col("additional_answers.2").alias("x2"))).alias("pos", "z"))
    rows = z.select(
        "doc_pos", F.concat_ws("_", "id", F.col("pos").cast("string")).alias("id"), "pos", "story",
        F.col("z.q.input_text").alias("question"),
        F.struct(F.col("z.a.input_text").alias("text"), F.col("z.a.span_start").alias("answer_start")).alias("answer"),
        F.array(F.col("z.x0.input_text"), F.col("z.x1.input_text"), F.col("z.x2.input_text")).alias("additional_answers"))
    seg = F.concat(F.lit(" Q: "), F.col("question"), F.lit(" A: "), F.col("answer.text"))
    rows = rows.withColumn("_seg", F.when(seg.endswith("."), seg).otherwise(F.concat(seg, F.lit("."))))
    w = Window.partitionBy("doc_pos").orderBy("pos")
    rows = rows.withColumn("_prev", F.collect_list("_seg").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.select("doc_pos", "pos", "id", F.concat("story", F.array_join("_prev", "")).alias("story"),
                       "question", "answer", "additional_answers")


def image_catalog(spark: SparkSession, folder: str, formats=IMAGE_SUFFIXES) -> DataFrame:
    """Non-recursive image listing -> (path, name, filename).

    Only file metadata is read (the content column is pruned).  Raises when
    the folder is missing or holds no image.
    """
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
          .select("path"))
    fn = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(fn, r"(\.[^.]*)$", 1))
    out = df.select("path", F.regexp_replace(fn, r"\.[^.]*$", "").alias("name"), fn.alias("filename")).filter(
        ext.isin(*formats))
    if out.isEmpty():
        raise FileNotFoundError(f"no images in {folder}")
    return out


def virtual_catalog(df: DataFrame, images_col: str = "images", order: str = "idx",
                    prefix: str = "llava") -> DataFrame:
    """First image of each row; rows without one dropped; names keep the
    pre-filter index, so gaps stay (S2)."""
    first = F.try_element_at(F.col(images_col), F.lit(1))
    i = F.col(order).cast("string")
    return df.withColumn("image", first).filter(F.col("image").isNotNull()).select(
        F.concat(F.lit(f"{prefix}_dataset_image_"), i).alias("path"),
        F.concat(F.lit(f"{prefix}_image_"), i).alias("name"),
        F.concat(F.lit(f"{prefix}_image_"), i, F.lit(".jpg")).alias("filename"), "image")


# --- S3: dataset registry ------------------------------------------------------
QA_DATASETS = ("truthfulqa", "triviaqa", "tydiqa", "coqa", "haluevaldia", "haluevalqa", "haluevalsum")


def load_qa_dataset(spark: SparkSession, name: str, path: str, max_samples: int | None = None,
                    fmt: str = "parquet") -> DataFrame:
    """Read a QA dataset by name and apply its row rules (S3).

    triviaqa: first row per ``question_id`` (A1); tydiqa: English ids only
    (P2); coqa: nested JSON exploded with running story (S4); others as
    read.  Dataset order is the order of the rows in their files, files by
    path (for CoQA the order in its JSON).  Rows are then named ``{name}_sample_{idx}`` in dataset order and
    cut to the first ``max_samples`` (O1).  Unknown names raise.
    """
    if name not in QA_DATASETS:
        raise ValueError(f"Invalid dataset name: {name}")
    if name == "coqa":
        df = coqa_from_json(spark, path)
        order = ["doc_pos", "pos"]
    else:
        df = spark.read.format(fmt).load(path)
        row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
        df = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": row})
        df = df.withColumn("_pos", F.struct("_file", "_row")).drop("_file", "_row")
        order = ["_pos._file", "_pos._row"]
        if name == "triviaqa":
            df = first_per_key(df, "question_id", "_pos")
        elif name == "tydiqa":
            df = english_only(df, "id")
    flat = [f"_o{i}" for i in range(len(order))]
    named = name_samples(df.withColumns({f: F.col(o) for f, o in zip(flat, order)}), name, flat)
    return first_n(named, "idx", max_samples).drop("_pos", "doc_pos", "pos", *flat)


def apply_per_item(df: DataFrame, fn, schema: str) -> DataFrame:
    """Per-item callback over a samples table, batch-wise via Arrow (F1).

    ``fn`` takes a pandas DataFrame (a batch of items) and returns one with
    ``schema``; Spark partitions the items.
    """
    def run(batches):
        for b in batches:
            yield fn(b)
    return df.mapInPandas(run, schema)
