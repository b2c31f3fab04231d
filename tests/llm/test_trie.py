"""The prefix trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from adjudica.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for conv, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members.setdefault(tuple(turns[:depth]), []).append(conv)
    out = set()
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].split()) for p in below if p)
        ends = sorted(c for c in convs if len(conversations[c]) == len(prefix))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[prefix[:-1]]) if prefix else None
        out.add((min(convs), len(prefix), parent, len(convs), len(children), len(leaves), saved, digest))
    return out


def rows_of(conversations):
    return [(c, i, role, text) for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]


def found(frame) -> list[tuple]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r[n] for n in names) for r in frame.collect()]


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 3), (3, 40)])
def test_equals_the_dictionary_of_prefixes(spark, seed, partitions):
    draw = random.Random(seed)
    conversations = {}
    for conv in range(-3, 120):
        turns = [("user", "hot first turn")] if draw.random() < 0.6 else []
        turns += [(draw.choice(["user", "assistant"]), draw.choice(["a", "a b", "", "c d e"])) for _ in range(draw.randrange(1, 5))]
        conversations[conv] = turns
    for conv in range(200, 240):  # one sequence that many conversations are equal in, and its extensions
        conversations[conv] = [("user", "same words here")] * (3 if conv % 7 else 4)
    long = [("user", f"turn {i}") for i in range(45)]  # longer than a block of columns
    conversations |= {300: long, 301: long[:33], 302: [*long[:40], ("user", "other end")], 303: long[:16], 304: long}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        frame = spark.createDataFrame(rows_of(conversations), SCHEMA).repartition(3)
        got = found(trie.prefix_trie(trie.turn_lists(frame)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    prefixes = {tuple(t[:d]) for t in conversations.values() for d in range(len(t) + 1)}
    assert set(got) == brute(conversations) and len(got) == len(prefixes)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [
        (1, None, "user", "first"), (1, 0, None, None), (1, 5, "user", "b"), (1, 5, "user", "a"), (1, 5, "user", "a"),
        (None, 0, "user", "nobody's"), (2, 7, "user", "first"), (2, 8, "", ""),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x")).withColumn("turns", F.lit(0))
    tail = sorted(["a", "a", "b"], key=lambda t: hashlib.md5(f"4:user{t}".encode()).hexdigest())
    want = {1: [("user", "first"), ("", ""), *[("user", t) for t in tail]], 2: [("user", "first"), ("", "")]}
    assert set(found(trie.prefix_trie(trie.turn_lists(frame)))) == brute(want)


def test_without_turns_and_without_conversations(spark):
    lists = spark.createDataFrame(
        [(4, []), (9, [(1, 1, 2)]), (7, [])], "conv_id long, turns array<struct<h1: long, h2: long, words: long>>"
    )
    got = {r[:2]: r for r in found(trie.prefix_trie(lists))}
    assert got[(4, 0)][2:7] == (None, 3, 1, 1, 0) and got[(9, 1)][2:7] == (4, 1, 0, 1, 0)
    assert got[(4, 0)][7] == hashlib.sha256(b"4,7").hexdigest()
    assert trie.prefix_trie(lists.limit(0)).count() == 0


def test_the_list_of_a_large_node_is_put_together_from_pieces(spark):
    conversations = {c: [("user", "same")] for c in range(50)}
    frame = spark.createDataFrame(rows_of(conversations), SCHEMA)
    assert set(found(trie.prefix_trie(trie.turn_lists(frame), piece=3))) == brute(conversations)
