import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tracewise.llm import prefix_trie as pt
from tracewise.sources.tables import table

CONV = "conv_id long, turn long, role string, text string"
COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def brute(seqs):
    """Every distinct prefix listed, every sum taken over all of a node's descendants."""
    nodes = {}
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for k, m in nodes.items():
        under = [x for x in nodes if x[:len(k)] == k]
        children = [x for x in under if len(x) == len(k) + 1]
        childless = [x for x in under if not any(y[:-1] == x for y in under if y)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(children), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def multiset(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=repr)


def test_given_table_equals_brute_force(spark):
    conv = table(spark, "/root/testdata/sf0.001", "conversations")
    assert multiset(pt.rebuilt_trie(conv)) == brute(rebuilt([tuple(r) for r in conv.select("conv_id", "turn", "role", "text").collect()]))


@pytest.fixture(scope="module")
def awkward():
    rows = [(None, 0, "user", "no id"), (1, None, "user", "first"), (1, 0, None, None), (1, 1, "user", ""), (2, 0, "user", "first"), (3, 5, "user", "x" * 100_000),
            (7, 0, "é", "ü\x00,"), (7, 0, "é", "ü\x00,"), (7, 0, "a", "tie")]
    deep = [(10, t, "user", f"turn {t}") for t in range(300)]
    copies = [(c, t, "user", f"same {t}") for c in range(100, 1100, 5) for t in range(12)]  # one path for all, from their own base
    near = [(c, t, "user", f"same {t}" if t < 11 else f"own {c}") for c in range(2000, 2500, 5) for t in range(12)]
    return rows + deep + copies + near


@pytest.mark.parametrize("run_turns, fan", [(1 << 18, 64), (64, 2), (1, 3)])
def test_awkward_rows_at_any_cut(spark, awkward, run_turns, fan):
    conv = spark.createDataFrame(awkward, CONV).withColumns({c: F.lit("x") for c in ("base", "path", "sizes", "h", "n", "kind", "run", "node_key", "depth")})
    c = F.col("conv_id")
    paths = pt.conversation_paths(conv.repartition(7), base=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9)
    assert multiset(pt.trie_nodes(paths, run_turns, fan)) == brute(rebuilt(awkward))


def test_plain_paths_and_empty_tables(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")]
    got = {(r.conv_id, r.depth): r for r in pt.trie_nodes(pt.conversation_paths(spark.createDataFrame(rows, CONV))).collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 2)}
    assert (got[1, 1].n_convs, got[1, 1].n_children, got[1, 1].n_leaves, got[1, 0].saved_tokens) == (2, 2, 2, 1)
    assert pt.rebuilt_trie(spark.createDataFrame([], CONV)).count() == 0
    assert pt.rebuilt_trie(spark.createDataFrame([(None, 0, "user", "a")], CONV)).count() == 0
    turnless = pt.rebuilt_trie(spark.createDataFrame([(4, 0, "user", "a"), (2, 0, "user", "b")], CONV)).collect()  # no base conversation 0
    assert [(r.depth, r.n_convs, r.n_leaves) for r in turnless] == [(0, 2, 1)] if zlib.crc32(b"4") % 9 and zlib.crc32(b"2") % 9 else True
