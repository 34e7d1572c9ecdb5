"""Small tables with the awkward cases every operator has to take."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
PASSAGE = ("The old harbour master counted every boat twice before the storm came in. He wrote the numbers down in a green book. "
           "Nobody ever asked to see that book again. When the water rose the pages floated off one by one. "
           "Children caught them along the shore and kept them for years. Some still hang framed in kitchens on the hill.")


def documents(spark, texts, **extra):
    """Rows (id, text) or (id, text, lang, source) as a documents table; ``extra`` adds constant columns."""
    rows = [(*t, *("en", "s")[len(t) - 2:]) if len(t) < 4 else t for t in texts]
    rows = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def awkward(spark):
    """Nulls in every column, empty, blank, long, repeated and non-Latin rows, with clashing extra columns."""
    long = " ".join(f"word{i % 997} stays. And" for i in range(20_000))
    rows = [(1, "plain text of a few words", "en", "a"), (2, None, "en", "a"), (3, "", "de", None), (4, " \n\t ", None, "b"),
            (None, "row without an id.", "en", "a"), (5, "twice the same row", "en", "a"), (5, "twice the same row", "en", "a"),
            (5, "same id, other text", "en", "a"), (6, long, "en", "a"), (7, "日本語の文章です。 次の行 Ünïcödé", "xx", "b"),
            (8, "#$%&|<>* 123 456", "en", "a"), (9, "<|endoftext|> is a name here", "en", "a"), (10, "a\x1cb\x85c d", "en", "a")]
    clash = {c: "x" for c in ("row_key", "h1", "seq", "fp", "component_id", "text_hash", "n_words", "hits", "label", "lang_pred", "score",
                              "cuts", "ids", "start", "shard", "n_tokens", "kept", "value", "signal", "first", "__row_key", "__id", "__hash", "__cuts", "bad_id", "bad_id_", "cut_hash")}
    return documents(spark, rows, **clash)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def multiset(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
