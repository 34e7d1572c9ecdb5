import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewise.llm import reply_trees as rt
from tracewise.llm.chat_template import CONTROL, OPEN, escape, format_turns, masked_text, read_turns, unescape

MESSAGE = "tree_id long, message_id long, parent_id long, role string, text string, score double"
CONV = "conv_id long, turn long, role string, text string"
piece = st.one_of(st.sampled_from(CONTROL), st.sampled_from(["\\", "<", "[", "s>", "INST]", "<|", "|>", "\n", ""]), st.text(max_size=4))
texts = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(sorted(OPEN)), texts), texts), max_size=6))
def test_template_is_reversible(turns):
    formatted, spans = format_turns(turns)
    assert read_turns(formatted) == turns
    assert masked_text(formatted, spans) == "".join(x for r, x in turns if r == "assistant")
    for role, text in turns:
        assert unescape(escape(text)) == text and not any(c in escape(text) for c in CONTROL)


def test_reader_is_strict():
    for bad in ("x", "[INST]open", "<|role|>a", "<s>a</s>tail"):
        with pytest.raises(ValueError):
            read_turns(bad)


def brute(rows, paths):
    """Each leaf followed up to its root."""
    trees = {}
    for t, i, p, r, x, s in rows:
        if i is not None:
            trees.setdefault(t, {}).setdefault(i, []).append((p, r or "", x or "", s))
    out = set()
    for t, m in trees.items():
        least = lambda v: min((x for x in v if x is not None), default=None)
        parent = {i: least([p for p, *_ in v]) for i, v in m.items()}
        message = {i: min((r, x) for _, r, x, _ in v) for i, v in m.items()}
        score = {i: least([s for *_, s in v]) or 0.0 for i, v in m.items()}
        branches = []
        for leaf in m.keys() - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] in m:
                path.append(parent[path[-1]])
            branches.append((-sum(score[i] for i in path) / len(path), -len(path), leaf, [message[i] for i in reversed(path)]))
        out |= {(t, k + 1, tuple(path)) for k, (_, _, _, path) in enumerate(sorted(branches)[:paths])}
    return out


def got(df):
    return {(r.tree, r.branch, tuple(read_turns(r.formatted))) for r in df.collect()}


@pytest.fixture(scope="module")
def messages():
    rnd = random.Random(5)
    rows = []
    for t in [1, 2, 3, None]:
        n = 60
        for i in range(n):
            parent = None if i == 0 or rnd.random() < .05 else rnd.randrange(max(0, i - 6), i)
            rows.append((t, i * 3, None if parent is None else parent * 3, rnd.choice(["user", "assistant", None]), rnd.choice([f"m{i} [INST]", None, "</s>"]), rnd.choice([0.0, 1.0, 2.0, None])))
    rows += [(4, i, i - 1 if i else None, "user", f"deep {i}", 1.0) for i in range(700)]
    rows += [(5, i, 0 if i else None, "user", f"wide {i}", float(i % 7)) for i in range(900)]
    rows += [(6, 1, 99, "user", "its parent is elsewhere", None), (6, None, 1, "user", "no id", 9.0), (1, 0, None, "user", "same id", 1.0), (1, 0, None, "user", "same id", 1.0),
             (7, 1, None, "user", "a", 1.0), (7, 2, None, "user", "b", 1.0), (7, 3, 1, "user", "two parents", 1.0), (7, 3, 2, "user", "two parents", 1.0)]
    return rows


@pytest.mark.parametrize("paths, options", [(1, {}), (3, {}), (1000, {}), (2, {"hot_tree": 100})])
def test_trees_equal_brute_force(spark, messages, monkeypatch, paths, options):
    if paths == 3:
        monkeypatch.setattr(rt, "MOST_BROADCAST", -1)
    df = spark.createDataFrame(messages, MESSAGE).withColumns({c: F.lit("x") for c in ("tree", "id", "parent", "key", "up", "depth", "leaf", "branch", "pos")})
    found = got(rt.format_trees(df.repartition(5), paths, score_col="score", **options))
    want = brute(messages, paths)
    if paths == 3:  # leaves of equal mean score can differ in the last digit of a sum
        assert len(found) == len(want) and len(found & want) >= len(want) - 2
    else:
        assert found == want


def test_circles_and_empty_tables(spark):
    with pytest.raises(ValueError, match="circle"):
        rt.format_trees(spark.createDataFrame([(1, 1, 2, "user", "a", None), (1, 2, 1, "user", "b", None)], MESSAGE))
    assert rt.format_trees(spark.createDataFrame([], MESSAGE)).count() == 0
    assert rt.format_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_conversations_read_back(spark):
    long = "long text " * 100_000
    rows = [(1, 1, "assistant", "b <s>"), (1, 0, "user", "a\\[INST]"), (1, None, "system", None), (2, 0, "assistant", long), (2, 1, None, "x"),
            (3, 0, "assistant", "twice"), (3, 0, "assistant", "twice"), (None, 0, "user", "no conversation id"), (4, 0, "to<|ol", "</s>\n<|end|>")]
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("x") for c in ("tree", "id", "parent", "key", "turns", "m", "p", "score")})
    out = {r.conv_id: r for r in rt.conversation_digests(rt.format_conversations(df)).collect()}
    want = {1: [("system", ""), ("user", "a\\[INST]"), ("assistant", "b <s>")], 2: [("assistant", long), ("", "x")],
            3: [("assistant", "twice")] * 2, None: [("user", "no conversation id")], 4: [("to<|ol", "</s>\n<|end|>")]}
    assert out.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (out[c].n_turns, out[c].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert out[c].formatted_chars == len(format_turns(turns)[0])
