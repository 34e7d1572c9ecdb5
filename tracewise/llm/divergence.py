"""Source divergence audit over a transducer vocabulary (operator 12).

Each language keeps the terms that enough of its documents hold.  The kept
terms, sorted, become minimal acyclic transducers, one per run of
``SHARD_TERMS`` terms, whose outputs are the terms' lexicographic ordinals.
Whole texts are then streamed through the transducers, which count the kept
terms per language and source, and the audit compares the sources' rates.  All
arithmetic is on integers; ordinals stand for the terms, ties included.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import record_batch, stored, text_slices, texts_of
from .transducer import Vocabulary, build

MIN_DOCS = 10
SHARD_TERMS = 1 << 16
BLOCK_BYTES = 32 << 20
TOP = 10
TILE = 512
_HELD = 1 << 19
_SCALE = 1_000_000_000
_OTHER = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_OTHER).lower().split()


def _texts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """text, lang and source alone, nulls as empty texts."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])


def _batches(rows: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 1 << 16):
        columns = zip(*rows[i:i + (1 << 16)])
        yield record_batch(schema, dict(zip(schema.names, columns)))


_DOC_COUNT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("n", pa.int64())])


def _document_counts(batches):
    held: dict[str, Counter] = {}

    def rows():
        return [(lang, t.decode(), n) for lang, c in held.items() for t, n in c.items()]

    for batch in text_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
            held.setdefault(lang, Counter()).update(set(terms_of(text)))
        if sum(map(len, held.values())) > _HELD:
            yield from _batches(rows(), _DOC_COUNT)
            held = {}
    yield from _batches(rows(), _DOC_COUNT)


def kept_terms(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` of a language's texts; rows are added up in the tasks first."""
    return (texts.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, n long")
            .groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term"))


_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("first", pa.string()), ("n", pa.int64()), ("data", pa.binary())])


def _build_shards(shard_terms: int):
    def run(batches):
        number, lang, terms = TaskContext.get().partitionId() << 32, None, []

        def shard():
            return record_batch(_SHARD, {"shard": [number], "lang": [lang], "first": [terms[0]], "n": [len(terms)],
                                         "data": [build(t.encode() for t in terms).to_bytes()]})

        for batch in batches:
            for la, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if terms and (la != lang or len(terms) == shard_terms):
                    yield shard()
                    number, terms = number + 1, []
                lang = la
                terms.append(term)
        if terms:
            yield shard()
    return run


def transducers(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(shard, lang, first, n, data): the transducers of each language's sorted terms, numbered in that order."""
    return stored(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
                  .mapInArrow(_build_shards(shard_terms), "shard long, lang string, first string, n long, data binary"), "transducers")


def vocabularies(shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Blocks of transducers of at most ``block_bytes`` (or one), as ``Vocabulary`` takes them.

    The driver holds one block at a time, and a number per shard.
    """
    sizes = shards.select("shard", "lang", "n", F.octet_length("data").alias("size")).orderBy("shard").collect()
    blocks, block, total, before, bases = [], [], 0, Counter(), {}
    for r in sizes:
        if block and total + r["size"] > block_bytes:
            blocks.append(block)
            block, total = [], 0
        bases[r["shard"]] = before[r["lang"]]
        before[r["lang"]] += r["n"]
        block.append(r["shard"])
        total += r["size"]
    for block in [*blocks, block]:
        if block:
            rows = shards.filter(F.col("shard").between(block[0], block[-1])).collect()
            yield [(r["lang"], bases[r["shard"]], r["n"], r["first"].encode(), bytes(r["data"])) for r in rows]


_COUNT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])


def _recount(shared):
    def run(batches):
        vocabulary = Vocabulary(shared.value)
        held: dict[tuple[str, str], Counter] = {}

        def rows():
            for (lang, source), c in held.items():
                ordinal = vocabulary.ordinals(lang, list(c))
                n = np.fromiter(c.values(), np.int64, len(c))
                some = ordinal >= 0
                if some.any():
                    k = int(some.sum())
                    yield record_batch(_COUNT, {"lang": [lang] * k, "source": [source] * k, "ordinal": ordinal[some], "n": n[some]})

        for batch in text_slices(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts_of(batch)):
                held.setdefault((lang, source), Counter()).update(terms_of(text))
            if sum(map(len, held.values())) > _HELD:
                yield from rows()
                held = {}
        yield from rows()
    return run


def recount(texts: DataFrame, shards: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): all texts streamed through the transducers, once per block of them.

    Each task adds up its own counts; zero counts have no row.
    """
    spark = texts.sparkSession
    parts = [texts.mapInArrow(_recount(spark.sparkContext.broadcast(block)), "lang string, source string, ordinal long, n long")
             for block in vocabularies(shards, block_bytes)]
    out = spark.createDataFrame([], "lang string, source string, ordinal long, n long")
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _rate(n: str, total: str) -> str:
    """1 + floor(10^9 (n + 2) / total) in decimals, which no count overflows."""
    return f"CASE WHEN {total} > 0 THEN 1 + (CAST({_SCALE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({total} AS DECIMAL(20, 0)) END"


def rates(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    if len(n) and int(n.max()) > (1 << 63) // _SCALE - 3:
        return np.array([1 + _SCALE * (a + 2) // b for a, b in zip(n.tolist(), total.tolist())], np.int64)
    return 1 + _SCALE * (n + 2) // total


_PAIR = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.int64())])


def _pair_sums(shared):
    """Sums of f over this task's terms for the pairs of the tiles in ``shared``: (lang, first i, totals of i, first j, totals of j)."""
    def run(batches):
        tiles: dict[str, list] = {}
        for lang, i0, ti, j0, tj in shared.value:
            tiles.setdefault(lang, []).append((i0, np.array(ti, np.int64), j0, np.array(tj, np.int64)))
        sums = {(lang, k): np.zeros((len(t[1]), len(t[3])), np.int64) for lang, ts in tiles.items() for k, t in enumerate(ts)}
        seen = set()

        def dense(term, sid, n, first, totals):
            out = np.broadcast_to(rates(np.zeros(len(totals), np.int64), totals), (term[-1] + 1, len(totals))).copy()
            here = (sid >= first) & (sid < first + len(totals))
            out[term[here], sid[here] - first] = rates(n[here], totals[sid[here] - first])
            return out

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()) & set(tiles):
                seen.add(lang)
                mine = batch.filter(pa.array(langs == lang))
                for a in range(0, mine.num_rows, 1024):
                    by = mine.slice(a, 1024).column("by_source")
                    flat = by.flatten()
                    off = by.offsets.to_numpy()
                    term = np.repeat(np.arange(len(by)), np.diff(off))
                    sid, n = flat.field("sid").to_numpy(), flat.field("n").to_numpy()
                    for k, (i0, ti, j0, tj) in enumerate(tiles[lang]):
                        p = dense(term, sid, n, i0, ti)
                        q = p if i0 == j0 else dense(term, sid, n, j0, tj)
                        for x in range(len(ti)):
                            least = x + 1 if i0 == j0 else 0
                            d, s = p[:, x:x + 1] - q[:, least:], p[:, x:x + 1] + q[:, least:]
                            sums[lang, k][x, least:] += (d * d // s).sum(axis=0)
        for lang in seen:
            for k, (i0, ti, j0, tj) in enumerate(tiles[lang]):
                i, j = np.indices((len(ti), len(tj))).reshape(2, -1)
                pick = (i + i0) < (j + j0)
                for a in range(0, int(pick.sum()), 1 << 16):
                    some = np.flatnonzero(pick)[a:a + (1 << 16)]
                    yield record_batch(_PAIR, {"lang": [lang] * len(some), "i": i[some] + i0, "j": j[some] + j0, "value": sums[lang, k].ravel()[some]})
    return run


def _tile_blocks(groups: DataFrame, tile: int, cells: int) -> Iterator[list[tuple]]:
    """Pairs of source tiles, in blocks of at most ``cells`` pairs of sources.

    The driver holds a row per language with kept terms, and one block's totals.
    """
    sizes = groups.filter("terms > 0").groupBy("lang").agg(F.count("*").alias("s")).filter("s > 1").orderBy("lang").collect()
    plan, block, total = [], [], 0
    for r in sizes:
        cuts = [(a, min(a + tile, r["s"])) for a in range(0, r["s"], tile)]
        for x, (a, b) in enumerate(cuts):
            for c, d in cuts[x:]:
                if block and total + (b - a) * (d - c) > cells:
                    plan.append(block)
                    block, total = [], 0
                block.append((r["lang"], a, b, c, d))
                total += (b - a) * (d - c)
    for block in [*plan, block]:
        if block:
            tops = {}
            for lang, a, b, c, d in block:
                lo, hi = tops.get(lang, (a, d))
                tops[lang] = (min(lo, a), max(hi, d))
            wanted = groups.sparkSession.createDataFrame([(k, *v) for k, v in tops.items()], "lang string, lo long, hi long")
            rows = groups.join(F.broadcast(wanted), "lang").filter("sid >= lo AND sid < hi").select("lang", "sid", "total").collect()
            totals = {(r["lang"], r["sid"]): r["total"] for r in rows}
            yield [(lang, a, [totals[lang, s] for s in range(a, b)], c, [totals[lang, s] for s in range(c, d)]) for lang, a, b, c, d in block]


_NAMED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("rank", pa.int32())])
_NAMED_DDL = "lang string, source string, item string, value long, rank int"


def _named(shared):
    """Ordinals back to terms, for the rows whose term lies in this block."""
    def run(batches):
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                term = vocabulary.term(r["lang"], r["ordinal"])
                if term is not None:
                    rows.append((r["lang"], r["source"], term.decode(), r["value"], r["rank"]))
            yield from _batches(rows, _NAMED)
    return run


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
                      source_col: str = "source", shard_terms: int = SHARD_TERMS, block_bytes: int = BLOCK_BYTES, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank of the audit.

    Part ``pair``: the divergence of each (language, source) from each other
    source of its language, summed over all kept terms; a language without
    kept terms gives 0.  Part ``term``: the ``top`` terms that a source
    has at a higher rate than its language, by their divergence.  Ranks run from 1, value
    descending, then item ascending in UTF-8 order.  Null text, language and
    source read as empty; a row repeated counts each time; an empty table
    gives no rows.

    The pairs of a language's sources are the result, so it has a row for
    each; the sums behind them are made in the tasks, tile by tile, never by
    emitting pairs per term.
    """
    spark = docs.sparkSession
    texts = _texts(docs, text_col, lang_col, source_col)
    kept = stored(kept_terms(texts, min_docs), "kept-terms")
    shards = transducers(kept, shard_terms)
    by_source = Window.partitionBy("lang").orderBy("source")
    ids = stored(texts.groupBy("lang", "source").count().select("lang", "source", (F.row_number().over(by_source) - 1).cast("long").alias("sid")), "sources")
    counts = (recount(texts, shards, block_bytes).join(ids, ["lang", "source"])
              .groupBy("lang", "ordinal").agg(F.sum("n").alias("n"), F.collect_list(F.struct("sid", "n")).alias("by_source")))
    counts = stored(counts, "term-counts")  # a row per kept term
    each = counts.select("lang", "ordinal", F.col("n").alias("lang_n"), F.explode("by_source").alias("s")).select("lang", "ordinal", "lang_n", "s.sid", "s.n")
    terms = shards.groupBy("lang").agg(F.sum("n").alias("terms"))
    of_source = each.groupBy("lang", "sid").agg(F.sum("n").alias("n"))
    in_lang = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    groups = (ids.join(of_source, ["lang", "sid"], "left").join(terms, "lang", "left").join(in_lang, "lang", "left")
              .select("lang", "source", "sid", zero("terms").alias("terms"), (zero("n") + 2 * zero("terms")).alias("total"),
                      (zero("lang_n") + 2 * zero("terms")).alias("lang_total")))
    groups = stored(groups, "source-totals")

    rated = (each.join(groups, ["lang", "sid"])
             .withColumns({"p": F.expr(_rate("n", "total")), "q": F.expr(_rate("lang_n", "lang_total"))}).filter("p > q")
             .select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    tops = stored(rated.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top), "top-terms")
    out = spark.createDataFrame([], _NAMED_DDL)
    for block in vocabularies(shards, block_bytes):
        out = out.unionByName(tops.mapInArrow(_named(spark.sparkContext.broadcast(block)), _NAMED_DDL))
    out = out.withColumn("part", F.lit("term"))

    halves = spark.createDataFrame([], "lang string, i long, j long, value long")
    for block in _tile_blocks(groups, tile, 1 << 22):
        halves = halves.unionByName(counts.select("lang", "by_source").mapInArrow(_pair_sums(spark.sparkContext.broadcast(block)), "lang string, i long, j long, value long"))
    halves = halves.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    pairs = halves.unionByName(halves.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    one, two = ids.select("lang", F.col("sid").alias("i"), "source"), ids.select("lang", F.col("sid").alias("j"), F.col("source").alias("item"))
    bare = groups.filter("terms = 0").select("lang", "source", F.col("sid").alias("i"))
    others = bare.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pairs = (pairs.join(one, ["lang", "i"]).join(two, ["lang", "j"]).select("lang", "source", "item", "j", "value")
             .unionByName(bare.join(others, "lang").filter("i <> j").select("lang", "source", "item", "j", F.lit(0).cast("long").alias("value"))))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "j")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(out.select(*columns))
