"""Ranked search by two trees against every item with every document in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from adjudica.llm import lexical

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(items, docs, k):
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    counted = [(doc, tf, sum(tf.values())) for doc, tf in counted if tf]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item, text in items:
        weight = {t: math.floor(1000 * math.log((2.0 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text))}
        scores = []
        for doc, tf, n in counted:
            m = 50 + (50 * n * n_docs) // length
            score = sum(w * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t, w in weight.items() if t in tf)
            scores += [(-score, doc is None, doc or 0)] if score > 0 else []
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, items, docs, k, partitions=3):
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    return sorted((tuple(r) for r in lexical.rank(i, d, k).collect()), key=repr)


@pytest.mark.parametrize("k,block,share", [(5, 16_384, 32), (3, 40, 2)])
def test_equals_brute_force(spark, monkeypatch, k, block, share):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "SEED_SHARE", share)
    monkeypatch.setattr(lexical, "ITEM_LEAF", 3)
    draw = random.Random(k)
    themes = [[f"{t}{draw.choice('äÖxYz9')}{i}" for i in range(40)] for t in ("a", "B", "ß", "日")]
    def text(n):
        theme = draw.choice(themes)
        return draw.choice([" ", ", ", "\n", "_"]).join(draw.choice(theme) for _ in range(n))
    docs = [(i, text(draw.randint(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1].upper()) for i in range(40)]  # equal scores, broken by id
    docs += [(7, docs[0][1]), (7, docs[0][1]), (None, docs[1][1]), (8, None), (9, ""), (10, "!!"), (11, "solo " * 30_000)]
    items = [(i, text(draw.randint(1, 12))) for i in range(25)] + [(3, text(4)), (None, text(5)), (90, None), (91, "..."), (92, "Solo nowhere")]
    assert found(spark, items, docs, k) == brute(items, docs, k)


def test_empty_tables_and_no_common_terms(spark):
    assert found(spark, [(1, "a")], [(1, None)], 3) == []
    assert found(spark, [(1, "a")], [(1, "b")], 3) == []
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lexical.rank(none, docs).count() == 0
    assert lexical.rank(docs.withColumnRenamed("doc_id", "item_id"), docs.limit(0)).count() == 0


def test_bounds_pass_over_pairs_of_nodes():
    """Texts of other themes than an item's are not scored, once k better ones are known."""
    draw = np.random.default_rng(5)
    n, themes, size = 4000, 20, 50
    theme = draw.integers(0, themes, n)
    terms_ = theme[:, None] * size + draw.integers(0, size, (n, 30))
    owner, term = np.unique(np.stack([np.repeat(np.arange(n), 30), terms_.ravel()]), axis=1)
    wanted = np.concatenate([t * size + np.arange(10) for t in range(themes)])
    items = lexical.Items(np.arange(themes), np.repeat(np.arange(themes), 10), wanted, np.full(len(wanted), 3000))
    docs = lexical.Documents(items, np.full(n, 30), owner, term, np.ones(len(term), np.int64), n, 30 * n)
    best = lexical.Best(themes, 10, np.zeros(themes))
    scored = lexical.search_batch(items, docs, best, np.zeros(n, bool), np.arange(n))
    assert scored < 0.5 * n * themes
