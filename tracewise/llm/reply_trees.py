"""Reply trees to training conversations (operator 11).

Messages point to the message they reply to.  Iterative self-joins double the
reach of every message's pointer until it has met its root, adding up depth and
score on the way; each branch (a root-to-leaf path) is then ranked within its
tree by its mean score; the chosen leaves' paths are enumerated by joining them
with the stored pointers from the longest reach down to the shortest.  Only ids
take part in the joins.  Texts are shuffled once, by tree, to meet their places, and
each chosen path becomes one formatted conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chat_template import format_turns, masked_text, read_turns
from .common import record_batch, stored

PATHS = 1
MOST_BROADCAST = 1 << 17  # rows of some 50 bytes
HOT_TREE = 1 << 16  # messages


def _same(a: str, b: str, *columns: tuple[str, str]) -> Column:
    """Null-safe equality, since a tree id may be null."""
    out = F.lit(True)
    for x, y in columns:
        out = out & F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{y}"))
    return out


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is stored and counted below ``MOST_BROADCAST`` rows."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def pointer_rounds(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every message's depth and score sum, and the pointers of each reach.

    ``messages``: tree, id, parent, score.  Returns (tree, id, depth, total)
    and, for k = 0, 1, ..., the pointers (tree, id, up) to the ancestor 2^k
    steps up, where there is one.  A parent that is not in the tree counts as none.
    Raises ValueError if messages reply in a circle.
    """
    m = stored(messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.min("score").alias("score")), "messages")
    ids, n = m.select("tree", "id"), m.count()
    step = (m.alias("m").join(ids.alias("p"), _same("m", "p", ("tree", "tree"), ("parent", "id")), "left")
            .select("m.tree", "m.id", F.col("p.id").alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce("m.score", F.lit(0.0)).alias("total")))
    done, reaches = None, []
    while True:
        step = stored(step, "pointers")
        finished, open_ = step.filter("up IS NULL"), step.filter("up IS NOT NULL")
        every = step if done is None else done.unionByName(step)
        done = finished if done is None else done.unionByName(finished)
        if open_.isEmpty():
            return done.drop("up"), reaches
        if 1 << len(reaches) > n:
            raise ValueError("messages reply in a circle")
        reaches.append(open_.select("tree", "id", "up"))
        # up's own pointer has the same reach, so both together have twice that
        step = (_small(open_).alias("a").join(every.alias("b"), _same("a", "b", ("tree", "tree"), ("up", "id")))
                .select("a.tree", "a.id", "b.up", (F.col("a.depth") + F.col("b.depth")).alias("depth"), (F.col("a.total") + F.col("b.total")).alias("total")))


def ranked_branches(messages: DataFrame, paths: int = PATHS) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, branch, depth, score) of each tree's best ``paths`` leaves, and the pointers.

    Branches rank by mean score, then by depth (longest first), then by leaf id.
    """
    depths, reaches = pointer_rounds(messages)
    leaves = depths
    if reaches:
        leaves = depths.alias("d").join(reaches[0].select("tree", "up").distinct().alias("i"), _same("d", "i", ("tree", "tree"), ("id", "up")), "left_anti")
    scored = leaves.select("tree", F.col("id").alias("leaf"), "depth", (F.col("total") / F.col("depth")).alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")
    return scored.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= paths), reaches


def chosen_paths(messages: DataFrame, paths: int = PATHS) -> DataFrame:
    """(tree, branch, score, pos, id): every message of the chosen paths, ``pos`` counted from the root, 1 first."""
    branches, reaches = ranked_branches(messages, paths)
    rows = stored(branches.select("tree", "branch", "score", F.col("leaf").alias("id"), F.col("depth").alias("pos")), "branches")
    for k in range(len(reaches) - 1, -1, -1):  # each distance from the leaf is one sum of different powers of two
        more = (_small(rows).alias("r").join(reaches[k].alias("p"), _same("r", "p", ("tree", "tree"), ("id", "id")))
                .select("r.tree", "r.branch", "r.score", F.col("p.up").alias("id"), (F.col("r.pos") - (1 << k)).alias("pos")))
        rows = stored(rows.unionByName(more), "branches")
    return rows


_OUT = pa.schema([("tree", pa.int64()), ("branch", pa.int32()), ("score", pa.float64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                  ("loss_mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_OUT_DDL = "tree long, branch int, score double, n_turns long, formatted string, loss_mask array<struct<start:long,end:long>>"


def _format(batches):
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):  # one conversation at a time, whatever a batch holds
            row = batch.slice(i, 1).to_pylist()[0]
            text, spans = format_turns((t["role"], t["text"]) for t in row["turns"])
            rows.append((row["tree"], row["branch"], row["score"], len(row["turns"]), text, [{"start": a, "end": b} for a, b in spans]))
            held += len(text) + 256
            if held > 4 << 20:
                yield record_batch(_OUT, dict(zip(_OUT.names, zip(*rows))))
                rows, held = [], 0
    if rows:
        yield record_batch(_OUT, dict(zip(_OUT.names, zip(*rows))))


def format_paths(places: DataFrame, texts: DataFrame) -> DataFrame:
    """tree, branch, score, n_turns, formatted and loss_mask of every chosen path.

    ``places``: tree, branch, score, pos, key; ``texts``: tree, key, role,
    text.  Places and texts of a tree meet by tree and key under one shuffle by
    tree; a key given twice counts once, with its smallest role and text.
    """
    none = lambda kind: F.lit(None).cast(kind)
    rows = (texts.select("tree", "key", F.struct("role", "text").alias("m"), none("struct<branch:int,score:double,pos:long>").alias("p"))
            .unionByName(places.select("tree", "key", none("struct<role:string,text:string>").alias("m"), F.struct("branch", "score", "pos").alias("p"))))
    met = rows.repartition("tree").groupBy("tree", "key").agg(F.min("m").alias("m"), F.collect_list("p").alias("p"))
    turns = (met.select("tree", "m", F.explode("p").alias("p")).groupBy("tree", "p.branch", "p.score")
             .agg(F.sort_array(F.collect_list(F.struct("p.pos", "m.role", "m.text"))).alias("turns")))
    return turns.select("tree", "branch", "score", "turns").mapInArrow(_format, _OUT_DDL)


def _clean(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def format_trees(messages: DataFrame, paths: int = PATHS, tree_col: str = "tree_id", id_col: str = "message_id", parent_col: str = "parent_id",
                 role_col: str = "role", text_col: str = "text", score_col: str | None = None, hot_tree: int = HOT_TREE) -> DataFrame:
    """The best ``paths`` branches of every reply tree, each as one formatted conversation.

    Ids are integers.  Null roles and texts are empty, null scores 0, a null
    tree id is a tree of its own, and a message without an id is left out, since nothing
    can reply to it or place it.  A parent that is not in the tree makes its message a
    root.  Rows that share tree and id are one message, with the smallest
    parent, score, role and text.  An empty table gives no rows.

    A chosen path is a record of its own and has to fit a task.  A tree has not: of
    trees above ``hot_tree`` messages (and above one in 4096 of all, so
    few in number) only the chosen messages' texts are sent to the tree's task.
    """
    score = F.col(score_col).cast("double") if score_col else F.lit(0.0)
    m = (messages.filter(F.col(id_col).isNotNull())
         .select(F.col(tree_col).cast("long").alias("tree"), F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"),
                 score.alias("score"), _clean(role_col).alias("role"), _clean(text_col).alias("text")))
    places = chosen_paths(m.select("tree", "id", "parent", "score"), paths).withColumnRenamed("id", "key")
    texts = m.select("tree", F.col("id").alias("key"), "role", "text")
    hot = stored(m.groupBy("tree").count().filter(F.col("count") > max(hot_tree, m.select("id").count() >> 12)).select("tree"), "hot-trees")
    if not hot.isEmpty():
        of_hot = lambda how: texts.alias("t").join(F.broadcast(hot).alias("h"), _same("t", "h", ("tree", "tree")), how)
        picked = of_hot("left_semi").alias("t").join(places.alias("p"), _same("t", "p", ("tree", "tree"), ("key", "key")), "left_semi")
        texts = of_hot("left_anti").unionByName(picked)
    return format_paths(places, texts)


def format_conversations(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turn tables as reply trees of one branch: each turn replies to the one before.

    Turns go by turn number, null first, ties and repeated rows by a digest of
    role and text, each repetition a turn of its own.  A message is named by that digest, so
    texts need no second shuffle to learn their place in the order.
    """
    role, text = _clean(role_col), _clean(text_col)
    name = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    t = conversations.select(F.col(conv_col).cast("long").alias("tree"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), name.alias("key"))
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "key")
    ids = stored(t.select("tree", "turn", "key").withColumn("id", F.row_number().over(order).cast("long")).select("tree", "id", "key"), "turn-ids")
    places = chosen_paths(ids.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score")))
    keyed = places.alias("p").join(ids.alias("i"), _same("p", "i", ("tree", "tree"), ("id", "id"))).select("p.tree", "p.branch", "p.score", "p.pos", "i.key")
    return format_paths(keyed, t.select("tree", "key", "role", "text"))


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches):
    for batch in batches:
        out = []
        for tree, formatted, mask in zip(*(batch.column(c).to_pylist() for c in ("tree", "formatted", "loss_mask"))):
            digest, turns = hashlib.sha256(), read_turns(formatted)
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode())
            loss = masked_text(formatted, [(s["start"], s["end"]) for s in mask])
            out.append((tree, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        if out:
            yield record_batch(_READ, dict(zip(_READ.names, zip(*out))))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from the formatted texts and their masks."""
    return formatted.select("tree", "formatted", "loss_mask").mapInArrow(
        _read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
