"""Exact ranked lexical search by two trees: one over the items, one over the documents.

1. Every text becomes its number of terms and, for the terms that any item has, their counts. A
   bitmap of fixed size over the items' terms decides which are kept; it may keep more, never fewer.
2. Document counts per term give the weights. A document's coordinate for a term is the term's
   weight times a saturated count, an integer; an item's coordinate is 1 for each of its terms. The
   score is the product of both.
3. Items and documents are halved again and again by their place in a random projection, so that
   texts with like terms come together. A node of either tree holds the maximum of each coordinate
   below it. The product of an item node and a document node bounds all scores between them; where
   it is below the weakest k-th score of the node's items, the whole pair of nodes is passed over.
   Equal bounds are looked into, as document ids decide between equal scores.
4. Items are handled in blocks of a bounded number of terms, each of which goes to all tasks. A task
   holds one batch of documents at a time, builds its tree, and keeps the first k of each item. The
   k-th scores among a 32nd of the documents are where all tasks start from.

Terms are known by 64-bit hashes of their characters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adjudica.llm import textbatch
from adjudica.sources.scratch import materialise

#: Bits of the filter over the items' terms.
FILTER_BITS = 1 << 22
#: Terms of a block of items, about.
BLOCK_TERMS = 16_384
ITEM_LEAF = 1
DOC_LEAF = 16
#: Leaves of documents after which the items' bounds are taken anew; older ones are lower, never wrong.
RENEW = 16
AXES = 24
#: One in so many documents sets the first bounds.
SEED_SHARE = 32
_EXACT = float(1 << 53)


def _is_term() -> np.ndarray:
    ascii_ = [chr(c).isalnum() for c in range(128)]
    return np.array([*ascii_, True])


_TERM = _is_term()


def term_counts(texts: list[str], wanted: np.ndarray | None = None):
    """Number of terms of each text, and (text, term hash, count) of its distinct terms in order.

    Terms are maximal runs of ASCII letters and digits and of all characters from U+0080 on, with
    A-Z in lower case. ``wanted`` leaves only terms whose bit is on.
    """
    points, owner = textbatch.code_points(texts)
    points = points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))
    starts, ends = textbatch.runs_of(_TERM[np.minimum(points, 128)])
    hashes, of_text = textbatch.run_hashes(points, starts, ends), owner[starts]
    totals = np.bincount(of_text, minlength=len(texts)).astype(np.int64)
    if wanted is not None:
        on = wanted[(hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
        hashes, of_text = hashes[on], of_text[on]
    order = np.lexsort((hashes, of_text))
    hashes, of_text = hashes[order], of_text[order]
    first = np.flatnonzero(
        np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (of_text[1:] != of_text[:-1])))
    ) if len(hashes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(hashes)))
    return totals, of_text[first], hashes[first].view(np.int64), counts.astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    bits = None if wanted is None else np.unpackbits(wanted, bitorder="little").astype(bool)
    for batch in batches:
        for start, texts in textbatch.slices(batch.column("text")):
            totals, owner, hashes, counts = term_counts(texts, bits)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(start, len(texts)),
                    pa.array(totals),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes)),
                    pa.ListArray.from_arrays(offsets, pa.array(counts)),
                ],
                names=["id", "n", "terms", "tf"],
            )


def _vectors(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """id, n, terms, tf of every row of (id, text); NULL texts are empty."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n bigint, terms array<bigint>, tf array<bigint>"
    return rows.select("id", "text").mapInArrow(lambda batches: _counted(batches, wanted), schema)


def _filter_of(items: DataFrame) -> np.ndarray:
    """The bitmap of the items' terms: FILTER_BITS bits, whatever the number of items."""
    placed = items.select(F.explode("terms").alias("term")).select(
        (F.col("term").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("place")
    )
    rows = (
        placed.groupBy(F.bitmap_bucket_number("place").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["bucket"] - 1) * len(part)
        out[at : at + len(part)] = part
    return out


def _halves(points: np.ndarray, leaf: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """An order of the points, and nodes (from, to, left child, right child) over it; -1: a leaf.

    Nodes come before their children. A node is halved along the direction in which it is widest.
    """
    order, nodes, work = np.arange(len(points)), [], [(0, len(points), -1, 0)]
    while work:
        lo, hi, parent, side = work.pop()
        here = len(nodes)
        nodes.append([lo, hi, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = here
        if hi - lo > leaf:
            part = points[order[lo:hi]]
            axis = np.linalg.eigh(np.cov(part.T))[1][:, -1]
            order[lo:hi] = order[lo:hi][np.argsort(part @ axis, kind="stable")]
            middle = (lo + hi) // 2
            work += [(middle, hi, here, 1), (lo, middle, here, 0)]
    return order, [tuple(n) for n in nodes]


def _axes(terms: np.ndarray) -> np.ndarray:
    """A direction of +1 and -1 for every term, from its hash alone."""
    bits = textbatch.mixed(terms.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((bits[:, None] >> np.arange(AXES, dtype=np.uint64)) & np.uint64(1)).astype(float) * 2 - 1


class Items:
    """A block of items as a tree. Coordinates are by place in ``terms``, the block's distinct terms."""

    def __init__(self, numbers: np.ndarray, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.terms, first, place = np.unique(terms, return_index=True, return_inverse=True)
        self.weights = weights[first].astype(np.int64)
        has = np.zeros((len(numbers), len(self.terms)))
        has[owner, place] = 1
        axes = _axes(self.terms) * self.weights[:, None]
        norm = np.maximum(np.sqrt(has @ (self.weights.astype(float) ** 2)), 1)[:, None]
        order, self.nodes = _halves((has @ axes) / norm, ITEM_LEAF)
        self.numbers = numbers[order]
        self.children = np.array([node[2:] for node in self.nodes])
        # Terms are rows here, so that those of a document node are gathered in one go.
        self.has = np.ascontiguousarray(has[order].T.astype(np.uint8))
        self.maxima = np.stack([self.has[:, lo:hi].max(axis=1) for lo, hi, _, _ in self.nodes], axis=1)

    def node_bounds(self, theta: np.ndarray) -> np.ndarray:
        """The weakest k-th score of each node's items."""
        out = np.empty(len(self.nodes))
        for k in range(len(self.nodes) - 1, -1, -1):
            lo, hi, left, right = self.nodes[k]
            out[k] = theta[lo:hi].min() if left < 0 else min(out[left], out[right])
        return out


class Documents:
    """A batch of documents as a tree over sparse rows (document, place of term, coordinate)."""

    def __init__(self, items: Items, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tf: np.ndarray, n_docs: int, length: int):
        place = np.minimum(np.searchsorted(items.terms, terms), len(items.terms) - 1)
        known = items.terms[place] == terms
        owner, place, tf = owner[known], place[known], tf[known]
        m = 50 + (50 * n * n_docs) // length
        value = items.weights[place] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[owner]))
        axes = _axes(items.terms)
        spread = np.zeros((len(n), AXES))
        for axis in range(AXES):
            spread[:, axis] = np.bincount(owner, value * axes[place, axis], len(n))
        norm = np.sqrt(np.bincount(owner, value.astype(float) ** 2, len(n)))
        self.order, self.nodes = _halves(spread / np.maximum(norm, 1)[:, None], DOC_LEAF)
        rank = np.empty(len(n), np.int64)
        rank[self.order] = np.arange(len(n))
        by_rank = np.argsort(rank[owner], kind="stable")
        self.row, self.place, self.value = rank[owner][by_rank], place[by_rank], value[by_rank]
        self.offsets = np.searchsorted(self.row, np.arange(len(n) + 1))
        self.maxima: list[tuple[np.ndarray, np.ndarray]] = [None] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            self.maxima[k] = self._maximum(k)
        # Whole numbers below 2^53 are exact as floats, whose products are much faster.
        self.exact = float(self.maxima[0][1].sum()) < _EXACT

    def _maximum(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, left, right = self.nodes[k]
        if left < 0:
            part = slice(self.offsets[lo], self.offsets[hi])
            place, value = self.place[part], self.value[part]
        else:
            place, value = (np.concatenate(x) for x in zip(self.maxima[left], self.maxima[right]))
        if not len(place):
            return place, value
        order = np.argsort(place, kind="stable")
        place, value = place[order], value[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        return place[first], np.maximum.reduceat(value, first)

    def scores(self, k: int, has: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Scores of a leaf's documents (rows) for the chosen items (columns of ``has``)."""
        lo, hi, _, _ = self.nodes[k]
        place = self.maxima[k][0]
        part = slice(self.offsets[lo], self.offsets[hi])
        dense = np.zeros((hi - lo, len(place)), float if self.exact else np.int64)
        dense[self.row[part] - lo, np.searchsorted(place, self.place[part])] = self.value[part]
        return dense @ has[np.ix_(place, chosen)].astype(dense.dtype)


class Best:
    """The first k documents of each item so far."""

    def __init__(self, count: int, k: int, theta: np.ndarray):
        self.k, self.theta = k, theta.astype(float)
        self.held: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(count)]
        self.waiting = np.zeros(count, np.int64)

    def add(self, item: int, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        self.held[item].append((score, null, doc))
        self.waiting[item] += len(score)
        if self.waiting[item] >= 2 * self.k:
            self.settle(item)

    def settle(self, item: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score, null, doc = (np.concatenate(x) for x in zip(*self.held[item]))
        first = np.lexsort((doc, null, -score))[: self.k]
        score, null, doc = score[first], null[first], doc[first]
        if len(score) == self.k:
            self.theta[item] = max(self.theta[item], float(score[-1]))
        self.held[item], self.waiting[item] = [(score, null, doc)], 0
        return score, null, doc


def search_batch(items: Items, docs: Documents, best: Best, null: np.ndarray, ids: np.ndarray) -> int:
    """Walk both trees together; returns how many pairs of an item and a document were scored."""
    null, ids = null[docs.order], ids[docs.order]
    bounds = items.node_bounds(best.theta)
    scored, leaves_done, work = 0, 0, [(0, np.array([0]))]
    while work:
        node, open_ = work.pop()
        place, value = docs.maxima[node]
        if not len(place):
            continue
        lo, hi, left, right = docs.nodes[node]
        leaves: list[int] = []
        while True:
            top = value.astype(float) @ items.maxima[np.ix_(place, open_)].astype(float)
            # A little is added where floats may round.
            keep = (top * (1 if docs.exact else 1 + 1e-9) >= bounds[open_]) & (top > 0)
            open_ = open_[keep]
            if left >= 0 or not len(open_):
                break
            leaves += open_[items.children[open_, 0] < 0].tolist()
            open_ = items.children[open_[items.children[open_, 0] >= 0]].ravel()
            if not len(open_):
                break
        if left >= 0:
            if len(open_):
                ends = items.children[open_, 0] < 0
                next_ = np.concatenate([open_[ends], items.children[open_[~ends]].ravel()])
                work += [(left, next_), (right, next_)]
            continue
        if not leaves:
            continue
        chosen = np.concatenate([np.arange(*items.nodes[k][:2]) for k in leaves])
        scores = docs.scores(node, items.has, chosen)
        scored += scores.size
        hits = (scores >= best.theta[chosen]) & (scores > 0)
        for column in np.flatnonzero(hits.any(axis=0)):
            at = np.flatnonzero(hits[:, column])
            best.add(chosen[column], scores[at, column].astype(np.int64), null[lo:hi][at], ids[lo:hi][at])
        leaves_done += 1
        if leaves_done % RENEW == 0:
            bounds = items.node_bounds(best.theta)
    return scored


def _searched(
    batches: Iterator[pa.RecordBatch], items: Items, k: int, theta: np.ndarray, n_docs: int, length: int
) -> Iterator[pa.RecordBatch]:
    best = Best(len(items.numbers), k, theta)
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, tf = batch.column("terms"), batch.column("tf")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
        docs = Documents(
            items, batch.column("n").to_numpy(), owner, terms.flatten().to_numpy(), tf.flatten().to_numpy(), n_docs, length
        )
        null = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("id").fill_null(0).to_numpy()
        search_batch(items, docs, best, null, ids)
    for item, held in enumerate(best.held):
        if held:
            score, null, doc = best.settle(item)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(score), items.numbers[item])),
                    pa.array(doc.astype(np.int64), mask=null),
                    pa.array(score),
                ],
                names=["item", "doc_id", "score"],
            )


def _block(postings: DataFrame) -> Items | None:
    """A block of items from its rows (item, term, weight), of which there are a bounded number."""
    table = postings.toArrow()
    if not table.num_rows:
        return None
    numbers, owner = np.unique(table.column("item").to_numpy(), return_inverse=True)
    return Items(numbers, owner, table.column("term").to_numpy(), table.column("weight").to_numpy())


def rank(
    items: DataFrame, docs: DataFrame, k: int = 50, item_id: str = "item_id", item_text: str = "text",
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of every item, score above 0.

    Every row of ``items`` is an item of its own and every row of ``docs`` a document, repeated ids
    included. Equal scores come by ascending doc_id, NULL last. NULL and empty texts have no terms:
    such items have no result and such documents are in none. Ids of documents are 64-bit numbers.
    Other columns are not read. Empty tables give an empty result.
    """
    numbered = items.select(
        F.struct(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id")).alias("id"),
        F.col(item_text).alias("text"),
    )
    wanted_items = materialise(_vectors(numbered, None).where("n > 0").select("id.*", "terms"), "lexical-items")
    filter_ = _filter_of(wanted_items)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    vectors = materialise(_vectors(source, filter_).where("n > 0"), "lexical-documents")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    found_schema = "item bigint, doc_id bigint, score bigint"
    found = docs.sparkSession.createDataFrame([], found_schema)
    postings = wanted_items.select("item", F.explode("terms").alias("term"))
    n_postings = postings.count()
    if n_docs and n_postings:
        weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")))
        df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = materialise(postings.join(df, "term").select("item", "term", weight.alias("weight")), "lexical-postings")
        blocks = math.ceil(n_postings / BLOCK_TERMS)
        seeds = vectors.where(F.pmod(F.xxhash64("id"), F.lit(SEED_SHARE)) == 0)
        for block in range(blocks):
            own = _block(weighed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block))
            if own is None:
                continue

            def search(rows: DataFrame, theta: np.ndarray, own: Items = own) -> DataFrame:
                return rows.mapInArrow(lambda b: _searched(b, own, k, theta, n_docs, length), found_schema)

            start = _first(search(seeds, np.zeros(len(own.numbers))), k).where(F.col("rank") == k)
            theta = {r["item"]: r["score"] for r in start.select("item", "score").collect()}
            bounds = np.array([theta.get(int(i), 0) for i in own.numbers], float)
            found = found.unionByName(materialise(search(vectors, bounds), "lexical-found"))
    names = wanted_items.select("item", "item_id")
    return _first(found, k).join(names, "item").select("item_id", "rank", "doc_id", "score")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each item, in two steps, so that no task gets all tasks' rows of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32)).alias("__part")
    near = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "__part").orderBy(*order)))
    near = near.where(F.col("rank") <= k).drop("__part")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
