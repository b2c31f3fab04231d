"""The prefix trie of conversations: one row per distinct sequence of first turns.

1. Every conversation becomes one row: the 128-bit ids of its turns in order, and their word counts.
2. The rows are range-partitioned by (turn ids, conversation), so a shard holds a stretch of the
   lexicographic order. A sequence that a third of all conversations share spreads over many shards.
3. Inside a shard the ids are a matrix padded with -1, taken a few columns at a time, each time with
   the rows that reach them. A lexsort brings equal prefixes together; the masks of changed columns,
   OR-accumulated from the left, mark where a node starts at every depth, and reduceat over these
   starts gives its members. Sums over subtrees run from the deepest column up.
4. Only the nodes on the path of a shard's first or last row can continue in another shard. They
   leave the shard as parts, known by the digest of their prefix, and are added up. What two
   neighbouring shards both counted (their last and first row's common prefix) is taken off again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from adjudica.sources.scratch import materialise

#: Columns of the padded matrix that are sorted at a time.
BLOCK = 16
#: Turns a shard holds, about.
SHARD_TURNS = 400_000
#: Ids in one piece of the list of a node's conversations.
PIECE = 50_000

NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = hashlib.md5(b"").digest()

_SHARD_SCHEMA = """
    kind string, digest binary, parent_digest binary, depth bigint, conv_id bigint, parent_conv_id bigint,
    n_convs bigint, n_children bigint, n_leaves bigint, weighted bigint, words bigint, ends_sha256 string,
    shard int, piece int, ids string,
    first struct<length: bigint, digests: array<binary>>,
    last struct<length: bigint, digests: array<binary>, words: array<bigint>>
"""


def turn_key(role: str, text: str) -> Column:
    """128 bits of a turn's role and text as 16 bytes; NULL counts as empty."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said)))


def _signed(key: Column, start: int) -> Column:
    return F.conv(F.hex(F.substring(key, start, 8)), 16, -10).cast("long")


def turn_lists(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as an array of structs (h1, h2, words).

    Turns are ordered by ``turn``, NULL first, and equal places by the turn's key. Repeated rows are
    turns of their own. NULL roles and texts are empty. Rows without a conversation belong to none
    and are left out. Other columns are not read. Texts are not shuffled; a conversation's turns, 40
    bytes each, must fit one task.
    """
    said = F.coalesce(F.col(text), F.lit(""))
    keyed = rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        turn_key(role, text).alias("key"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    item = F.struct(
        F.col("turn").isNotNull().alias("placed"),
        "turn",
        "key",
        _signed(F.col("key"), 1).alias("h1"),
        _signed(F.col("key"), 9).alias("h2"),
        "words",
    )
    lists = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("turns"))
    return lists.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["words"].alias("words"))).alias("turns"),
    )


class _Level:
    """The nodes of one depth of a shard: parallel arrays."""

    def __init__(self, rows, starts, conv, words, parent, above):
        self.n_convs = np.diff(np.append(starts, len(rows)))
        self.conv_id = np.minimum.reduceat(conv[rows], starts)
        self.words = words
        self.parent = parent
        self.children = np.zeros(len(starts), np.int64)
        if above is not None:
            above.children += np.bincount(parent, minlength=len(above.children))


def _codes(ids: np.ndarray) -> np.ndarray:
    """Ids of two numbers as one number each, in the same order."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    ranked = ids[order]
    new = np.concatenate(([False], np.any(ranked[1:] != ranked[:-1], axis=1)))
    codes = np.empty(len(ids), np.int64)
    codes[order] = np.cumsum(new)
    return codes


class Shard:
    """The trie of some conversations: levels of nodes, and the first and last row in order."""

    def __init__(self, conv: np.ndarray, offsets: np.ndarray, ids: np.ndarray, words: np.ndarray):
        self.conv, self.offsets, self.ids, self.words = conv, offsets, ids, words
        self.lengths = np.diff(offsets)
        self.levels: list[_Level] = []
        self.ends: list[tuple[np.ndarray, np.ndarray]] = []  # by depth: node and conversation, in order
        self._build(_codes(ids))
        self._sum_up()

    def _build(self, codes: np.ndarray) -> None:
        lengths, conv, total = self.lengths, self.conv, len(self.conv)
        group = np.zeros(total, np.int64)  # rows of equal prefix so far
        node = np.zeros(total, np.int64)  # each row's node at the depth before
        by_conv = np.argsort(conv, kind="stable")
        self.levels.append(_Level(by_conv, np.array([0]), conv, np.zeros(1, np.int64), np.array([-1]), None))
        done = by_conv[lengths[by_conv] == 0]
        self.ends.append((np.zeros(len(done), np.int64), conv[done]))
        self.first = self.last = -1
        for column in range(0, max(int(lengths.max()), 1), BLOCK):
            rows = np.flatnonzero(lengths > column) if column else np.arange(total)
            width = min(BLOCK, int(lengths.max()) - column)
            at = self.offsets[rows][:, None] + column + np.arange(width)[None, :]
            inside = column + np.arange(width)[None, :] < lengths[rows][:, None]
            matrix = np.full(at.shape, -1, np.int64)
            matrix[inside] = codes[at[inside]]
            order = np.lexsort((conv[rows], *matrix.T[::-1], group[rows]))
            rows, matrix = rows[order], matrix[order]
            if self.first < 0 or lengths[self.first] > column:
                self.first = rows[0]
            if self.last < 0 or lengths[self.last] > column:
                self.last = rows[-1]
            changed = np.concatenate(([True], group[rows][1:] != group[rows][:-1]))
            for place in range(width):
                column_changed = np.concatenate(([True], matrix[1:, place] != matrix[:-1, place]))
                changed = changed | column_changed
                alive = np.flatnonzero(matrix[:, place] >= 0)
                members, depth = rows[alive], column + place + 1
                starts = np.flatnonzero(changed[alive])
                heads = members[starts]
                self.levels.append(
                    _Level(
                        members, starts, conv, self.words[self.offsets[heads] + depth - 1], node[heads], self.levels[-1]
                    )
                )
                node[members] = np.cumsum(changed[alive]) - 1
                done = members[lengths[members] == depth]
                self.ends.append((node[done], conv[done]))
            group[rows] = np.cumsum(changed) - 1

    def _sum_up(self) -> None:
        for level in self.levels:
            level.leaves = (level.children == 0).astype(np.int64)
            level.weighted = level.n_convs * level.words
            level.all_words = level.words.copy()
        for depth in range(len(self.levels) - 1, 0, -1):
            level, above = self.levels[depth], self.levels[depth - 1]
            np.add.at(above.leaves, level.parent, level.leaves)
            np.add.at(above.weighted, level.parent, level.weighted)
            np.add.at(above.all_words, level.parent, level.all_words)

    def path(self, last: bool) -> tuple[list[int], list[bytes], list[int]]:
        """Nodes, prefix digests and words along the first or last row, from the root on.

        The first row of all is in the first node of every depth it reaches, the last in the last.
        """
        row = self.last if last else self.first
        length, at = int(self.lengths[row]), int(self.offsets[row])
        hasher, digests = hashlib.md5(), [ROOT]
        for turn in self.ids[at : at + length]:
            hasher.update(turn.astype(">i8").tobytes())
            digests.append(hasher.digest())
        nodes = [len(level.n_convs) - 1 if last else 0 for level in self.levels[: length + 1]]
        return nodes, digests, [0, *self.words[at : at + length].tolist()]


def _digest_of_ends(conv: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, conv.tolist())).encode()).hexdigest()


def _shard_rows(shard: Shard, number: int, most: int) -> Iterator[dict]:
    """Rows of one shard: complete nodes, parts of nodes that may go on elsewhere, pieces, its ends."""
    paths = [shard.path(last=False), shard.path(last=True)]
    digest_of: list[dict[int, bytes]] = [{} for _ in shard.levels]
    for nodes, digests, _ in paths:
        for depth, (node, digest) in enumerate(zip(nodes, digests)):
            digest_of[depth][node] = digest
    (_, first_digests, _), (_, last_digests, last_words) = paths
    yield {
        "kind": "edge", "shard": number,
        "first": {"length": len(first_digests) - 1, "digests": first_digests},
        "last": {"length": len(last_digests) - 1, "digests": last_digests, "words": np.cumsum(last_words).tolist()},
    }
    for depth, level in enumerate(shard.levels):
        node, conv = shard.ends[depth]
        bounds = np.searchsorted(node, np.arange(len(level.n_convs) + 1))
        for k in range(len(level.n_convs)):
            own, above = digest_of[depth].get(k), None
            ended = conv[bounds[k] : bounds[k + 1]]
            parent = int(level.parent[k])
            if depth:
                above = digest_of[depth - 1].get(parent)
            row = {
                "digest": own, "parent_digest": above, "depth": depth, "conv_id": int(level.conv_id[k]),
                "parent_conv_id": int(shard.levels[depth - 1].conv_id[parent]) if depth and above is None else None,
                "n_convs": int(level.n_convs[k]), "n_children": int(level.children[k]),
                "n_leaves": int(level.leaves[k]), "weighted": int(level.weighted[k]), "words": int(level.all_words[k]),
            }
            if own is None:
                done = _digest_of_ends(ended) if len(ended) else NO_ENDS
                yield row | {"kind": "node", "ends_sha256": done}
                continue
            yield row | {"kind": "part"}
            for piece in range(0, len(ended), most):
                ids = ",".join(map(str, ended[piece : piece + most].tolist()))
                yield {"kind": "piece", "digest": own, "shard": number, "piece": piece // most, "ids": ids}


def _shard_tasks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    filled = [batch for batch in batches if batch.num_rows]
    if not filled:
        return
    table = pa.Table.from_batches(filled)
    conv = table.column("conv_id").combine_chunks().to_numpy()
    ids, words = table.column("ids").combine_chunks(), table.column("words").combine_chunks()
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = ids.flatten().to_numpy().reshape(-1, 2)
    shard = Shard(conv, offsets - offsets[0], flat, words.flatten().to_numpy())
    held: list[dict] = []
    for row in _shard_rows(shard, TaskContext.get().partitionId(), most):
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of id lists whose pieces come in order; holds one piece at a time."""
    node, hasher = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest != node:
                if node is not None:
                    done.append((node, hasher.hexdigest()))
                node, hasher = digest, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(ids.encode())
        if done:
            yield _ends_batch(done)
    if node is not None:
        yield _ends_batch([(node, hasher.hexdigest())])


def _ends_batch(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    digests, hashes = zip(*done)
    return pa.record_batch([pa.array(digests, pa.binary()), pa.array(hashes, pa.string())], names=["digest", "ends_sha256"])


def _counted_twice(edges: DataFrame) -> DataFrame:
    """What neighbouring shards both counted, as negative parts of the nodes on their common prefix."""
    spark = edges.sparkSession
    # As many numbers as shards that hold rows.
    numbers = sorted(r["shard"] for r in edges.select("shard").collect())
    follows = spark.createDataFrame(list(zip(numbers, numbers[1:])), "shard int, next int")
    here = edges.select("shard", "last")
    there = edges.select(F.col("shard").alias("next"), "first")
    both = here.join(follows, "shard").join(there, "next")
    zipped = F.arrays_zip(F.col("last.digests").alias("a"), F.col("first.digests").alias("b"))
    common = both.withColumn("common", F.size(F.filter(zipped, lambda x: x["a"] == x["b"])) - 1)
    each = common.select("*", F.explode(F.sequence(F.lit(0), F.col("common"))).alias("depth"))
    words = F.col("last.words")
    before = F.when(F.col("depth") > 0, F.get(words, F.col("depth") - 1)).otherwise(0)
    return each.select(
        F.get(F.col("last.digests"), F.col("depth")).alias("digest"),
        F.when(F.col("depth") < F.col("common"), -1).otherwise(0).cast("long").alias("n_children"),
        F.when(F.col("common") == F.col("last.length"), -1).otherwise(0).cast("long").alias("n_leaves"),
        (before - F.get(words, F.col("common"))).cast("long").alias("words"),
    )


def prefix_trie(lists: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per node of the trie over (conv_id, turns) as ``turn_lists`` gives them.

    conv_id (the smallest member), depth, parent_conv_id (the parent's; NULL at the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. A conversation without turns is a member of
    the root alone. Conversation ids must be distinct and not NULL. No conversations give no row.
    """
    spark = lists.sparkSession
    paths = materialise(
        lists.select(
            "conv_id",
            F.flatten(F.transform("turns", lambda t: F.array(t["h1"], t["h2"]))).alias("ids"),
            F.transform("turns", lambda t: t["words"]).alias("words"),
        ),
        "trie-paths",
    )
    turns = paths.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / SHARD_TURNS))
    empty = spark.createDataFrame([], _SHARD_SCHEMA)
    arrow = to_arrow_schema(empty.schema)
    ranged = paths.repartitionByRange(shards, "ids", "conv_id")
    # Written once: where the ranges lie is decided by a sample.
    stored = materialise(ranged.mapInArrow(lambda b: _shard_tasks(b, arrow, piece), empty.schema), "trie-shards")

    pieces = stored.where("kind = 'piece'").select("digest", "shard", "piece", "ids")
    pieces = pieces.repartition("digest").sortWithinPartitions("digest", "shard", "piece").select("digest", "ids")
    ends = pieces.mapInArrow(_joined_ends, "digest binary, ends_sha256 string")
    parts = stored.where("kind = 'part'")
    summed = ("n_children", "n_leaves", "words")
    twice = _counted_twice(stored.where("kind = 'edge'"))
    none = F.lit(None).cast("long")
    every = parts.select("digest", "parent_digest", "depth", "conv_id", "n_convs", "weighted", *summed).unionByName(
        twice.select(
            "digest", F.lit(None).cast("binary").alias("parent_digest"), none.alias("depth"), none.alias("conv_id"),
            none.alias("n_convs"), none.alias("weighted"), *summed,
        )
    )
    whole = every.groupBy("digest").agg(
        F.max("parent_digest").alias("parent_digest"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "weighted", *summed)],
    )
    whole = whole.join(ends, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    whole = materialise(whole, "trie-boundary")

    inner = stored.where("kind = 'node'").select(*whole.columns, "parent_conv_id")
    known = inner.where("parent_digest is null")
    above = whole.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("parent_conv_id"))
    pending = inner.where("parent_digest is not null").drop("parent_conv_id").join(above, "parent_digest", "left")
    outer = whole.join(above, "parent_digest", "left")
    out = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("weighted") - F.col("words")).alias("saved_tokens"), "ends_sha256",
    ]
    return known.select(*out).unionByName(pending.select(*out)).unionByName(outer.select(*out))
