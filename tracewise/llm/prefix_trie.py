"""Prefix trie of conversations by truncation peeling (operator 13).

A conversation's path is the string of its turns' 16-byte digests, so a node
of depth d is a path prefix of 16 d bytes and, in path order, its members lie
side by side.  Paths are range-partitioned, so that a node shared by any
number of conversations spreads over tasks.  Each task peels its run of paths:
from the greatest depth down, the conversations that end at a depth join the
nodes that survive there, equal paths are grouped and summed, and the last turn
is stripped.  Nodes on the first or last path of a run may go on in the next
run; they stay open, one row per border path, and are peeled again with up
to ``FAN`` runs a task until one run is left, which closes the root.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, stored

FAN = 64
RUN_TURNS = 1 << 18
MOST_BROADCAST = 1 << 17  # open nodes, some 40 bytes each
_LONGS = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
_OPEN = ["open_n", "open_first", "open_children", "open_leaves", "open_saved"]
_ROW = pa.schema([("kind", pa.int8()), ("run", pa.int64()), ("seq", pa.int64()), ("conv_id", pa.int64())]
                 + [(c, pa.int64()) for c in _LONGS]
                 + [("ends_sha256", pa.string()), ("node_key", pa.binary()), ("parent_key", pa.binary()), ("data", pa.binary()),
                    ("sizes", pa.list_(pa.int64()))] + [(c, pa.list_(pa.int64())) for c in _OPEN])
_ROW_DDL = ("kind byte, run long, seq long, conv_id long, " + ", ".join(f"{c} long" for c in _LONGS)
            + ", ends_sha256 string, node_key binary, parent_key binary, data binary, sizes array<long>, "
            + ", ".join(f"{c} array<long>" for c in _OPEN))
NODE, BORDER, ENDS = 0, 1, 2


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits that name a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                       base: Column | None = None, head: Column | None = None, most_head: int = 64) -> DataFrame:
    """(conv_id, path, sizes) per conversation: its turns' digests in order and their texts' UTF-8 bytes.

    ``base`` and ``head`` (at most ``most_head``), over column ``conv_id``: the first ``head`` turns
    are those of conversation ``base`` (all if it has fewer, none if it does
    not exist) in place of the conversation's own.  Turns go by turn number, null
    first, then by digest.  Rows without a conversation id belong to none.
    Only digests and sizes are shuffled, once, by ``base``; one conversation's
    digests (some 40 bytes a turn) are a row.
    """
    base, head = base if base is not None else F.col("conv_id"), head if head is not None else F.lit(0)
    rows = (turns.filter(F.col(conv_col).isNotNull())
            .select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
                    turn_digest(F.col(role_col), F.col(text_col)).alias("h"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"))
            .select(base.alias("base"), "*").repartition("base"))
    own = rows.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "n"))).alias("t"))
    heads = own.filter("conv_id = base").select(F.col("base").alias("b"), F.slice("t", 1, most_head).alias("b_t"))
    both = own.join(heads, F.col("base") == F.col("b"), "left").select("conv_id", "t", "b_t", head.cast("int").alias("k"))
    t = F.concat(F.expr("coalesce(slice(b_t, 1, k), slice(t, 1, 0))"), F.expr("slice(t, k + 1, size(t))"))
    return (both.select("conv_id", t.alias("t"))
            .select("conv_id", F.unhex(F.array_join(F.col("t.h"), "")).alias("path"), F.col("t.n").cast("array<long>").alias("sizes")))


class _Run:
    """Paths in ascending order with the open nodes and ended conversations on them."""

    def __init__(self, paths: list[bytes], sizes: list[np.ndarray]):
        self.paths, self.sizes = paths, sizes
        n = len(paths)
        self.length = np.array([len(p) // 16 for p in paths], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(self.length)])
        words = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
        both = np.minimum(self.length[:-1], self.length[1:])
        at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
        differ = (words[np.repeat(start[:-2], both) + at] != words[np.repeat(start[1:-1], both) + at]).any(axis=1)
        lcp = both.copy()
        owner = np.repeat(np.arange(n - 1), both)
        np.minimum.at(lcp, owner[differ], at[differ])
        self.levels = [np.concatenate([[0], lcp])]  # levels[k][i]: least common length over places i .. i + 2^k - 1
        while (1 << len(self.levels)) <= n:
            last, w = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-w], last[w:]))
        self.flat, self.start = np.concatenate([np.asarray(s, dtype=np.int64) for s in sizes] or [np.zeros(0, np.int64)]), start

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Turns that the paths at places p <= q share."""
        out = self.length[p].copy()
        far = np.flatnonzero(q > p)
        a, b = p[far] + 1, q[far] + 1
        k = np.frexp(b - a)[1] - 1
        for level in np.unique(k):
            m = k == level
            t = self.levels[level]
            out[far[m]] = np.minimum(t[a[m]], t[b[m] - (1 << level)])
        return out

    def keys(self, place: int) -> list[bytes]:
        """Digest of each prefix of a path, the empty one first."""
        h, out, path = hashlib.blake2b(digest_size=16), [], self.paths[place]
        for d in range(int(self.length[place]) + 1):
            out.append(h.copy().digest())
            h.update(path[16 * d:16 * d + 16])
        return out


_SUMS = ["n", "first", "children", "leaves", "saved"]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def peel(run: _Run, borders: list[dict], conv_ids: np.ndarray, open_ends: bool, run_no: int, seq: int):
    """Peel one run: (rows as columns of ``_ROW``, the run's new border rows).

    The first places of the run are the paths of ``borders`` (their open
    nodes' partial sums), the others conversations in (path, id) order.  With
    ``open_ends`` a node is open if the first or last path starts with it.
    """
    n_borders, last = len(borders), len(run.paths) - 1
    present = [np.flatnonzero(b["open_n"] >= 0) for b in borders]
    items = {"place": np.concatenate([np.repeat(np.arange(n_borders), [len(p) for p in present]), np.arange(n_borders, last + 1)]).astype(np.int64),
             "depth": np.concatenate([*present, run.length[n_borders:]]).astype(np.int64)}
    many = len(conv_ids)
    fresh = {"n": np.ones(many, np.int64), "first": conv_ids}
    for k in _SUMS:
        items[k] = np.concatenate([*[b["open_" + k][p] for b, p in zip(borders, present)], fresh.get(k, np.zeros(many, np.int64))]).astype(np.int64)
    order = np.lexsort((items["place"], -items["depth"]))
    items = {k: v[order] for k, v in items.items()}
    depths = -items["depth"]
    keys = {p: run.keys(p) for p in {*range(n_borders), *([0, last] if open_ends else [])}}
    zero = np.zeros(last + 1, np.int64)
    with_first, with_last = (run.common(zero, np.arange(last + 1)), run.common(np.arange(last + 1), zero + last)) if open_ends else (zero - 1, zero - 1)
    fences = {p: {k: np.full(run.length[p] + 1, -1, np.int64) for k in _SUMS} for p in ({0, last} if open_ends else ())}
    split = int(with_first[last])  # the last path's nodes down to here are the first path's as well
    out = {f.name: [] for f in _ROW}
    live = {k: np.zeros(0, np.int64) for k in ["place", *_SUMS]}
    waiting = None  # closed nodes one level deeper, which lack their parents
    for d in range(-int(depths[0]), -1, -1):
        a, b = np.searchsorted(depths, -d, side="left"), np.searchsorted(depths, -d, side="right")
        place = np.concatenate([live["place"], items["place"][a:b]])
        old = len(live["place"])
        order = np.argsort(place, kind="stable")
        new = np.ones(len(place), dtype=bool)
        new[1:] = run.common(place[order][:-1], place[order][1:]) < d
        at = np.flatnonzero(new)
        group = np.empty(len(place), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        node = {k: (np.minimum if k == "first" else np.add).reduceat(np.concatenate([live[k], items[k][a:b]])[order], at) for k in _SUMS}
        head = place[order][at]
        tail = place[order][np.concatenate([at[1:], [len(place)]]) - 1]
        closed = (with_first[head] < d) & (with_last[tail] < d)
        names: list[bytes | None] = [None] * len(head)
        for g, p in zip(group[old:], items["place"][a:b]):
            if p >= n_borders:
                break  # items of a level go by place, borders first
            names[g] = keys[p][d]
        for g in np.flatnonzero(~closed):
            p = 0 if with_first[head[g]] >= d else last
            names[g] = keys[p][d]
            for k in _SUMS:
                fences[p][k][d] = node[k][g]
        if waiting is not None:
            up = group[:old][waiting["which"]]
            out["parent_conv_id"].append((node["first"][up], closed[up]))
            out["parent_key"] += [None if c else names[g] for g, c in zip(up.tolist(), closed[up].tolist())]
        own = run.flat[run.start[head] + d - 1] if d else np.zeros(len(head), np.int64)
        node["leaves"] = np.where(closed & (node["children"] == 0), 1, node["leaves"])
        node["saved"] = node["saved"] + np.where(closed, (node["n"] - 1) * own, 0)
        # conversations that end here stand side by side, in id order
        mine = group[old:][items["place"][a:b] >= n_borders]
        ids = conv_ids[items["place"][a:b][items["place"][a:b] >= n_borders] - n_borders]
        cut = np.searchsorted(mine, np.arange(len(head) + 1))
        shas: list[str | None] = [None if x else _EMPTY_SHA for x in names]
        for g in np.unique(mine).tolist():
            part = ids[cut[g]:cut[g + 1]]
            if names[g] is None:
                shas[g] = hashlib.sha256(",".join(map(str, part.tolist())).encode()).hexdigest()
            else:
                for i in range(0, len(part), 512):
                    out["data"].append((names[g], run_no, (seq << 32) + i, ",".join(map(str, part[i:i + 512].tolist())).encode()))
        which = np.flatnonzero(closed)
        out["conv_id"].append(node["first"][which])
        out["depth"].append(np.full(len(which), d))
        for c, k in (("n_convs", "n"), ("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved")):
            out[c].append(node[k][which])
        out["ends_sha256"] += [shas[g] for g in which.tolist()]
        out["node_key"] += [names[g] for g in which.tolist()]
        waiting = {"which": which}
        pass_on = {"n": node["n"], "children": 1, "leaves": node["leaves"], "saved": node["saved"]}
        live = {"place": head, "first": node["first"], **{k: np.where(closed, v, 0) for k, v in pass_on.items()}}
    roots = len(waiting["which"])
    out["parent_conv_id"].append((np.zeros(roots, np.int64), np.zeros(roots, dtype=bool)))
    out["parent_key"] += [None] * roots
    fresh_borders = []
    for p in sorted(fences):
        open_here = {("open_" + k): v for k, v in fences[p].items()}
        if p and split >= 0:
            open_here["open_n"][:split + 1] = -1
        if p == 0 or (open_here["open_n"] >= 0).any():
            fresh_borders.append({"data": run.paths[p], "sizes": run.flat[run.start[p]:run.start[p + 1]], **open_here})
    return out, fresh_borders


def _node_rows(out: dict) -> pa.RecordBatch:
    longs = {c: np.concatenate(out[c]).astype(np.int64) for c in ["conv_id", *_LONGS] if c != "parent_conv_id"}
    n = len(longs["conv_id"])
    value, known = (np.concatenate(x) for x in zip(*out["parent_conv_id"]))
    columns = {**longs, "kind": np.full(n, NODE, np.int8), "parent_conv_id": pa.array(value, mask=~known),
               "ends_sha256": out["ends_sha256"], "node_key": out["node_key"], "parent_key": out["parent_key"]}
    return record_batch(_ROW, {f.name: columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ROW})


def _other_rows(kind: int, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, **r} for r in rows], schema=_ROW)


def _emit(run: _Run, borders: list[dict], conv_ids: np.ndarray, open_ends: bool, run_no: int, seq: int, keep: list[dict]):
    """Peel and yield the finished rows; the new borders go to ``keep``."""
    out, fresh = peel(run, borders, conv_ids, open_ends, run_no, seq)
    keep[:] = fresh
    yield _node_rows(out)
    ends = out["data"]
    for i in range(0, len(ends), 1024):
        yield _other_rows(ENDS, [{"node_key": k, "run": r, "seq": s, "data": t} for k, r, s, t in ends[i:i + 1024]])


def _border_rows(run_no: int, borders: list[dict]):
    return _other_rows(BORDER, [{"run": run_no, "seq": i, **b} for i, b in enumerate(borders)])


def _first_round(run_turns: int):
    def run_of(borders, rows):
        return _Run([b["data"] for b in borders] + [p for p, _, _ in rows], [b["sizes"] for b in borders] + [s for _, s, _ in rows])

    def go(batches):
        run_no, borders, rows, turns, seq = TaskContext.get().partitionId(), [], [], 0, 0
        for batch in batches:
            sizes = batch.column("sizes")
            off, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy()
            for i, (p, c) in enumerate(zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())):
                rows.append((p, flat[off[i]:off[i + 1]], c))
                turns += 1 + len(p) // 16
                if turns >= run_turns:
                    yield from _emit(run_of(borders, rows), list(borders), np.array([r[2] for r in rows], np.int64), True, run_no, seq, borders)
                    rows, turns, seq = [], 0, seq + 1
        if rows:
            yield from _emit(run_of(borders, rows), list(borders), np.array([r[2] for r in rows], np.int64), True, run_no, seq, borders)
        if borders:
            yield _border_rows(run_no, borders)
    return go


def _merge_round(fan: int, final: bool):
    def close(run_no, rows):
        borders = [{k: np.array(r[k], np.int64) for k in ["sizes", *_OPEN]} | {"data": r["data"]} for r in rows]
        keep: list[dict] = []
        yield from _emit(_Run([b["data"] for b in borders], [b["sizes"] for b in borders]), borders, np.zeros(0, np.int64), not final, run_no, 0, keep)
        if keep:
            yield _border_rows(run_no, keep)

    def go(batches):
        held, run_no = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["run"] // fan != run_no:
                    yield from close(run_no, held)
                    held = []
                run_no = row["run"] // fan
                held.append(row)
        if held:
            yield from close(run_no, held)
    return go


_SHA = pa.schema([("key", pa.binary()), ("sha", pa.string())])


def _stream_ends(batches):
    """SHA-256 of each key's pieces in order, joined by commas; only the hash state is held."""
    key = state = None
    for batch in batches:
        done = []
        for k, data in zip(batch.column("node_key").to_pylist(), batch.column("data").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(data)
            else:
                state.update(b",")
                state.update(data)
        if done:
            yield record_batch(_SHA, {"key": [x for x, _ in done], "sha": [x for _, x in done]})
    if key is not None:
        yield record_batch(_SHA, {"key": [key], "sha": [state.hexdigest()]})


def trie_nodes(paths: DataFrame, run_turns: int = RUN_TURNS, fan: int = FAN) -> DataFrame:
    """One row per node of the trie over ``paths`` (conv_id, path, sizes of ``conversation_paths``).

    conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Conversations
    with no turns are members of the root; no conversations, no rows.
    Repeated ids count as often as they come.

    A task holds ``run_turns`` turns and its open paths at a time.  The merge
    rounds hold 2 ``fan`` border paths.  The digest of the ids that end at an open node is
    one SHA-256 over all of them, which has no parallel form: their text is
    made in the tasks and streamed through one hash state in 512-id pieces.
    """
    rows = stored(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
                  .mapInArrow(_first_round(run_turns), _ROW_DDL), "trie")
    every = [rows]
    while (most := rows.filter(F.col("kind") == BORDER).agg(F.max("run")).first()[0]) is not None:
        final = most < fan
        merged = (rows.filter(F.col("kind") == BORDER).repartition(F.floor(F.col("run") / fan)).sortWithinPartitions("run", "seq")
                  .mapInArrow(_merge_round(fan, final), _ROW_DDL))
        rows = stored(merged, "trie")
        every.append(rows)
        if final:
            break
    both = every[0]
    for more in every[1:]:
        both = both.unionByName(more)
    keep = ["conv_id", *_LONGS, "ends_sha256", "node_key", "parent_key"]
    nodes = both.filter(F.col("kind") == NODE).select(*keep)
    ends = (both.filter(F.col("kind") == ENDS).select("node_key", "run", "seq", "data").repartition("node_key")
            .sortWithinPartitions("node_key", "run", "seq").mapInArrow(_stream_ends, "key binary, sha string"))
    once_open = nodes.filter("node_key IS NOT NULL")
    named = stored(once_open.join(ends, F.col("node_key") == F.col("key"), "left")
                   .withColumn("ends_sha256", F.coalesce("sha", F.lit(_EMPTY_SHA))).select(*keep), "trie-open")
    nodes = nodes.filter("node_key IS NULL").unionByName(named)
    parents = named.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("p"))
    # a third of all nodes may hang under one open node: the open nodes (a few per run and depth) go to them where they are few
    if named.count() <= MOST_BROADCAST:
        parents = F.broadcast(parents)
    late = nodes.filter("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("p"))
    final_columns = ["conv_id", *_LONGS, "ends_sha256"]
    return nodes.filter("parent_key IS NULL").select(*final_columns).unionByName(late.select(*final_columns))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: each takes its first crc32(id) % 9 turns from conversation id - id % 5."""
    c = F.col("conv_id")
    return trie_nodes(conversation_paths(conversations, base=c - c % 5, head=F.crc32(c.cast("string").cast("binary")) % 9))
