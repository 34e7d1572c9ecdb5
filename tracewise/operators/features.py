"""Feature tables: assembly, zero substitution, selection, parsing, composites.

(V9, V10, V16, P7-P9, P15, M2-M4, S12 format)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "sample_id"
N_FEATURES = 74
LIST_FEATURES = (60, 61)
META_COLS = ["image_name", "image_filename", "image_path", "generated_description"]

# --- fixed values: feature selection (must equal the reference) -------------
POSITIVE_EXTRA = [66, 67, 68, 69, 71]        # kept on top of 0-61 (multi-class)
NEGATIVE_EXTRA = [64, 70, 72, 73]            # dropped (multi-class)
BINARY_EXTRA = [68, 69, 71]                  # kept on top of 0-61 (binary)
CHUNK_FEATURES = [
    "chunk_word_count", "chunk_relative_position", "total_chunks_in_image",
    "chunk_position_normalized", "is_first_chunk", "is_last_chunk", "is_middle_chunk",
    "word_count_normalized", "is_short_chunk", "is_long_chunk",
    "chunks_density", "chunk_length_ratio",
    "position_length_interaction", "position_squared", "word_count_squared",
    "is_object_chunk", "is_attribute_chunk", "is_relation_chunk",
]
COMPOSITES = ["feature_67_squared", "feature_66_squared", "feature_67_x_69", "feature_67_x_68"]
# ---------------------------------------------------------------------------


def fname(i: int) -> str:
    return f"feature_{i}"


def selected_features(mode: str, available: list[str], reference_compat: bool = True) -> list[str]:
    """Signal feature columns kept by a feature set.

    ``multiclass``: every feature_ column except 64, 70, 72, 73 (so 62, 63
    and 65 stay, as in the reference); with ``reference_compat=False`` only
    0-61 plus 66-69 and 71.  ``base``: 0-61.  ``binary``: 0-61 plus 68, 69, 71.
    """
    have = [c for c in available if c.startswith("feature_") and c.split("_")[1].isdigit()
            and len(c.split("_")) == 2]
    idx = {int(c.split("_")[1]): c for c in have}
    if mode == "base":
        keep = [i for i in range(62)]
    elif mode == "binary":
        keep = list(range(62)) + BINARY_EXTRA
    elif mode == "multiclass":
        keep = ([i for i in sorted(idx) if i not in NEGATIVE_EXTRA] if reference_compat
                else list(range(62)) + POSITIVE_EXTRA)
    else:
        raise ValueError(mode)
    return [idx[i] for i in sorted(set(keep)) if i in idx]


def parse_feature(c: Column, strict: bool = False, dtype: T.DataType | None = None) -> Column:
    """Number, or list text -> its element / mean; '[]' -> NaN (V9).

    Strict mode raises on null or unparseable text (like the reference);
    lenient mode yields null.  A column known to be a number (``dtype``) is taken as it is.
    """
    if isinstance(dtype, (T.DoubleType, T.IntegerType, T.LongType)):
        val = c.cast("double")  # what its text would parse to
        return F.when(val.isNull(), F.raise_error(F.lit("cannot parse feature value: null"))).otherwise(val) if strict else val
    s = c.cast("string")
    num = s.try_cast("double")
    arr = F.from_json(s, T.ArrayType(T.DoubleType()))
    mean = F.when(F.size(arr) == 0, F.lit(float("nan"))).otherwise(
        F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))
    val = F.coalesce(num, mean)
    if strict:
        return F.when(val.isNull(), F.raise_error(F.concat(F.lit("cannot parse feature value: "),
                                                           F.coalesce(s, F.lit("null"))))).otherwise(val)
    return val


def add_composites(df: DataFrame) -> DataFrame:
    """67^2, 66^2, 67*69, 67*68 and perplexity_composite = mean(67, 69, 68, 66)."""
    f = {i: F.col(fname(i)).cast("double") for i in (66, 67, 68, 69)}
    return df.withColumns({
        "feature_67_squared": f[67] * f[67], "feature_66_squared": f[66] * f[66],
        "feature_67_x_69": f[67] * f[69], "feature_67_x_68": f[67] * f[68],
        "perplexity_composite": (f[67] + f[69] + f[68] + f[66]) / 4.0,
    })


def preprocess(df: DataFrame, mode: str = "multiclass", strict: bool = False,
               reference_compat: bool = True) -> DataFrame:
    """Selection + parsing (+ composites for multi-class) (M2, M3)."""
    keep = selected_features(mode, df.columns, reference_compat)
    drop = [c for c in df.columns if c.startswith("feature_") and c not in keep and c.split("_")[1].isdigit()
            and len(c.split("_")) == 2]
    out = df.drop(*drop).withColumns({c: parse_feature(F.col(c), strict, df.schema[c].dataType) for c in keep})
    if mode == "multiclass":
        out = add_composites(out)
        out = out.withColumns({c: parse_feature(F.col(c), strict, df.schema[c].dataType) for c in CHUNK_FEATURES if c in out.columns})
    return out


def matrix_columns(df: DataFrame, mode: str = "multiclass", reference_compat: bool = False) -> list[str]:
    """Ordered matrix columns (M4).

    multi-class: base feature columns, then columns ending in ``_squared`` or
    holding ``_x_`` in table order, then the 18 chunk features.  The
    reference's suffix rule lists position_squared and word_count_squared
    twice (94 columns); by default they appear once (92).
    """
    cols = df.columns
    base = [c for c in cols if c.startswith("feature_") and not c.endswith("_squared") and "_x_" not in c
            and c != "feature_composite"]
    if mode != "multiclass":
        return base
    comp = [c for c in cols if c.endswith("_squared") or "_x_" in c]
    chunk = [c for c in CHUNK_FEATURES if c in cols]
    out = base + comp + chunk
    if reference_compat:
        return out
    seen, uniq = set(), []
    for c in out:
        if c not in seen:
            seen.add(c)
            uniq.append(c)
    return uniq


def assemble(samples: DataFrame, blocks: list[DataFrame], lists: DataFrame | None = None,
             required: DataFrame | None = None) -> DataFrame:
    """The 74-column feature row per sample.

    ``blocks`` hold ``feature_i`` columns keyed by ``sample_id``; each is
    left-joined to ``samples`` and missing values become 0.0.  ``is_failed``
    marks samples absent from ``required`` (the block whose absence means
    the run failed); a failed sample gets all zeros and an empty text.
    """
    out = samples
    for b in blocks:
        out = out.join(b, KEY, "left")
    if lists is not None:
        out = out.join(lists, KEY, "left")
    if required is not None:
        out = out.join(required.select(KEY).distinct().withColumn("_ok", F.lit(True)), KEY, "left")
        failed = F.col("_ok").isNull()
    else:
        failed = F.lit(False)
    cols = []
    for i in range(N_FEATURES):
        n = fname(i)
        if i in LIST_FEATURES:
            v = F.col(n) if n in out.columns else F.lit(None)
            cols.append(F.when(failed, F.array().cast("array<double>")).otherwise(
                F.coalesce(v.cast("array<double>"), F.array().cast("array<double>"))).alias(n))
        else:
            v = F.col(n) if n in out.columns else F.lit(None)
            cols.append(F.when(failed, F.lit(0.0)).otherwise(F.coalesce(v.cast("double"), F.lit(0.0))).alias(n))
    meta = [F.col(c) if c in out.columns else F.lit("").alias(c) for c in META_COLS if c != "generated_description"]
    text = F.when(failed, F.lit("")).otherwise(F.coalesce(F.col("generated_description"), F.lit(""))) \
        if "generated_description" in out.columns else F.lit("")
    return out.select(KEY, *cols, *meta, text.alias("generated_description"), failed.alias("is_failed"))


def to_csv_row(df: DataFrame) -> DataFrame:
    """List features as JSON text, for the feature CSV sink."""
    return df.withColumns({fname(i): F.to_json(F.col(fname(i))) for i in LIST_FEATURES if fname(i) in df.columns})
