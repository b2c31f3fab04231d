"""Exact join of texts on the Jaccard distance of their word shingles, by pivots and regions.

Jaccard distance is a metric. Texts are linked at a distance of at most r = 0.2. A pivot cuts the
texts into regions, each text goes to the nearest pivot's, and the triangle inequality tells which
other regions a text must also visit so that no link is lost. Texts with the same set are one node.

1. First pivots are single shingles, as whole texts of others would do no good: unrelated texts are
   all at distance 1 from each other, so every one would be on every border. A text is at distance
   1 - 1/n from each of its own n shingles and at 1 from all others, so its nearest pivots are its
   own; in a fixed order of all shingles the first is its home. Its window: of two texts within r
   each has one of the first n - ceil(0.8 n) + 1 of its shingles in common with the other, so it
   visits these regions, and a few more. Regions of one node are left at once.
2. Which regions several nodes visit, and which more than LEAF, is counted in tasks and kept as two
   bitmaps of bounded size. Nodes too few of whose regions have other visitors have no link and are left. Regions of up to LEAF
   nodes give pairs: where two nodes' visits begin to agree and where they cease to. The first shingles of both texts up to a common bound are
   all known, and each that only one of them has counts towards their difference. Pairs whose
   difference is then too large already are dropped, then those whose odd sketches differ too much.
   The others are compared as whole sets.
3. Wider regions are joined again, with those of their nodes that may still have a link there: shingles that are frequent among these
   come last in the order, so common passages stop being anybody's home.
4. What is still wide are texts that are alike. There the pivots are texts: each node's distance to
   its region's pivots is taken, the region falls into Voronoi cells, and a node whose distance to
   another cell's pivot is within 2 r of that to its own visits that cell too. Nodes within r of
   their pivot are linked to it. Cells that then hold texts of one component are done. The others
   are cut once more by pivots taken from those outside the largest component, and at last such
   nodes are compared with those of other components whose distance to the pivot differs by up to r
   and whose odd sketches differ little.

Links inside a component change nothing and are not looked for. All others are found: the classes
are those of comparing all pairs. Shingles are known by 56-bit, sets by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm import membership, rows as numbered, shingles, textbatch
from adjudica.llm.components import components
from adjudica.sources.scratch import materialise

#: Links need this share of the union in common, in hundredths.
PERCENT = 80
#: Nodes of a region whose pairs are taken as they are.
LEAF = 64
#: A shingle is frequent in a batch when so many of its nodes have it.
FREQUENT = 8
#: Texts taken as pivots of a wide region.
PIVOTS = 2
#: Times that wide regions are cut by texts.
CUTS = 2
#: Bits of the filters over regions, as a power of 2.
FILTER_LOG = 25
#: The filter of regions that several nodes visit grows with the visits, up to this.
MOST_LOG = 27
#: Bits that regions are counted by: more, so that few are taken for one.
TALLY_LOG = 40
#: Visits of regions that one task brings together, about.
PART_VISITS = 2_000_000
#: Pairs of small regions that a task holds at a time, about.
HELD_PAIRS = 500_000
#: Numbers of 64 bits in a sketch of a node of a mixed cell, and nodes sketched at a time.
WORDS, SKETCHED_ROWS = 16, 1000
#: A hash below which nearly all sets visit all of their shingles' regions.
KNOWN = np.int64(0.18 * (1 << int(shingles.ID_BITS)))
MORE = 1.0
FAR = np.int64(1 << 40)
_BLANK = np.zeros(128, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def shingle_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle id), sorted: the distinct five-word shingles of each text.

    Words are runs of characters other than blank and U+0009 to U+000D, with A-Z in lower case. A
    text of one to four words has one shingle of all its words.
    """
    points, owner = textbatch.code_points(texts)
    points = points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))
    starts, ends = textbatch.runs_of(~_BLANK[np.minimum(points, 127)])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, of_word = textbatch.run_hashes(points, starts, ends), owner[starts]
    words = np.bincount(of_word, minlength=len(texts))
    ends_at = np.cumsum(words)
    place = np.arange(len(hashes)) - (ends_at - words)[of_word]
    first = np.flatnonzero(place <= np.maximum(words[of_word] - shingles.WORDS, 0))
    end = ends_at[of_word[first]]
    with np.errstate(over="ignore"):
        total = np.zeros(len(first), np.uint64)
        for k in range(shingles.WORDS):
            at = first + k
            part = textbatch.mixed(hashes[np.minimum(at, len(hashes) - 1)] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k + 1))
            total += np.where(at < end, part, np.uint64(0))
        ids = textbatch.mixed(total) >> (np.uint64(64) - shingles.ID_BITS)
    key = (of_word[first].astype(np.uint64) << shingles.ID_BITS) | ids
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    mask = (np.uint64(1) << shingles.ID_BITS) - np.uint64(1)
    return (key >> shingles.ID_BITS).astype(np.int64), (key & mask).astype(np.int64)


def _visits(n: np.ndarray, more: float = MORE) -> np.ndarray:
    """How many of its first shingles' regions a set of n visits; none, where it is empty.

    Some more than a link needs, so that nearly every set visits all of its shingles below KNOWN.
    """
    needed = n - (PERCENT * n + 99) // 100 + 1
    return np.where(n > 0, np.minimum(needed + np.floor(more * np.sqrt(n)).astype(np.int64), n), 0)


def _first_of(owner: np.ndarray, keys: np.ndarray, n: np.ndarray, take: np.ndarray) -> pa.ListArray:
    """The first so many keys of each owner, as lists; keys are sorted by owner and key."""
    before = np.cumsum(n) - n
    chosen = np.arange(len(keys)) - before[owner] < take[owner]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array(keys[chosen]))


def _sketches(n: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> list[bytes]:
    """Odd sketches: which of a set's bits, n of them or up to twice as many, an odd number of its shingles falls on.

    The numbers of bits are powers of 2, so the longer of two is folded to the length of the other.
    """
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    at = (ends - bits)[owner] + (ids & (bits - 1)[owner])
    odd = np.packbits((np.bincount(at, minlength=ends[-1] if len(ends) else 0) & 1).astype(np.uint8))
    return [odd[lo // 8 : hi // 8].tobytes() for lo, hi in zip(ends - bits, ends, strict=True)]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in textbatch.slices(batch.column("text")):
            owner, ids = shingle_ids(texts)
            n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
            node = shingles.set_digests(len(texts), owner, ids.view(np.uint64))[:, 0]
            # Of equal sets in a slice one goes to the regions.
            single = np.zeros(len(texts), bool)
            single[np.unique(node, return_index=True)[1]] = True
            visits = np.where(single, _visits(n), 0)
            row = [batch.column(c).slice(start, len(texts)) for c in ("id", "file", "index")]
            sketches = pa.array(_sketches(n, owner, ids), pa.binary(), mask=visits == 0)
            yield pa.RecordBatch.from_arrays(
                [*row, pa.array(node), pa.array(n), _first_of(owner, ids, n, visits), sketches],
                names=["id", "file", "index", "node", "n", "homes", "sketch"],
            )


def _set_lists(batches: Iterator[pa.RecordBatch], wide: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The sets of texts, each with the first of its shingles that may have a wide region (near)."""
    for batch in batches:
        for start, texts in textbatch.slices(batch.column("text")):
            owner, ids = shingle_ids(texts)
            n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
            node = shingles.set_digests(len(texts), owner, ids.view(np.uint64))[:, 0]
            at = _on(wide, ids)
            which, first = np.unique(owner[at], return_index=True)
            near = np.zeros(len(texts), np.int64)
            near[which] = ids[at][first]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near), lists], names=["node", "near", "ids"])


def _sets(source: DataFrame, rows: DataFrame, wanted: DataFrame, wide: np.ndarray) -> DataFrame:
    """node, near, ids: the sets of the wanted nodes, and of few others. Each is made from the text of
    one of its rows, where that is read, so that no text goes to a shuffle."""
    keys = rows.join(wanted.distinct(), "node").groupBy("node").agg(F.min(F.struct("file", "index")).alias("key"))
    bitmap = membership.bitmap_of(materialise(keys, "join-wanted"), F.col("key"))
    on = membership.flagged(source, F.struct("file", "index"), bitmap, "__on").where("__on")
    sets = on.select("text").mapInArrow(lambda batches: _set_lists(batches, wide), "node bigint, near bigint, ids array<bigint>")
    return materialise(sets, "join-sets")


def _one_row_each(described: DataFrame) -> DataFrame:
    """Of the rows of each node one, and few others; rows of equal sets would visit the same regions."""
    key = F.struct("file", "index")
    visiting = described.where("size(homes) > 0")
    firsts = membership.bitmap_of(visiting.groupBy("node").agg(F.min(key).alias("key")), F.col("key"))
    firsts = materialise(firsts, "join-firsts")
    return membership.flagged(visiting, key, firsts, "__on").where("__on").drop("__on")


def _places(keys: np.ndarray, log: int = FILTER_LOG) -> np.ndarray:
    return (textbatch.mixed(keys.view(np.uint64)) >> np.uint64(64 - log)).astype(np.int64)


def _on(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = _places(keys, (8 * len(bits)).bit_length() - 1)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _packed(values: np.ndarray) -> bytes:
    """All first bytes of the values, then all second ones and so on: those that are all zero take no room in a shuffle."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _blobs(places: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns, cut by stretches of places, as rows (part, packed bytes of each column)."""
    part = (places * parts) >> FILTER_LOG
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    cut = [c[order] for c in columns]
    filled = np.flatnonzero(np.diff(bounds))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(filled.astype(np.int32)),
            *[pa.array([_packed(c[bounds[k] : bounds[k + 1]]) for k in filled], pa.binary()) for c in cut],
        ],
        names=["part", *[f"c{i}" for i in range(len(cut))]],
    )


def _joined(table: pa.Table, types: list, read=np.frombuffer) -> list[np.ndarray]:
    return [np.concatenate([read(x, kind) for x in table.column(f"c{i}").to_pylist()]) for i, kind in enumerate(types)]


def _homes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("homes")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    return lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), np.diff(offsets)), offsets


def _partners(n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sizes up to which a set of n can have a partner whom it first meets at its shingle of this rank.

    Sets of n and m shingles have at least o = 80 (n + m) / 180 in common, so each has one among its
    first n - o + 1. As whole numbers: 80 times the size.
    """
    return 100 * n - (100 + PERCENT) * (rank - 1)


def _tallied(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """How many different nodes of a batch visit each region. Regions go by TALLY_LOG bits of their places,
    in order, each as the step from the one before."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owner, _ = _homes(batch)
        node = batch.column("node").to_numpy()[owner]
        places = _places(keys, TALLY_LOG)
        order = np.lexsort((node, places))
        places, node = places[order], node[order]
        fresh = np.concatenate(([True], (places[1:] != places[:-1]) | (node[1:] != node[:-1])))[: len(places)]
        places, counts = np.unique(places[fresh], return_counts=True)
        if len(places):
            coarse = places >> (TALLY_LOG - FILTER_LOG)
            part = (coarse * parts) >> FILTER_LOG
            steps = np.diff(places, prepend=0)
            first = np.concatenate(([True], part[1:] != part[:-1]))
            steps[first] = places[first]
            yield from _blobs(coarse, parts, [steps, counts.astype(np.int32)])


def _tally_bits(table: pa.Table, parts: int, leaf: int, log: int) -> pa.Table:
    """One part of two bitmaps: of the regions that several nodes visit, and of those of more than ``leaf``."""
    places = np.concatenate([np.cumsum(_unpacked(x, np.int64)) for x in table.column("c0").to_pylist()])
    counts = np.concatenate([_unpacked(x, np.int32) for x in table.column("c1").to_pylist()])
    places, which = np.unique(places, return_inverse=True)
    total = np.bincount(which, counts, len(places))
    part = table.column("part")[0].as_py()
    lo, hi = -(-(part << FILTER_LOG) // parts), -(-((part + 1) << FILTER_LOG) // parts)
    rows = []
    for least, bits in ((2, log), (leaf + 1, FILTER_LOG)):
        finer = bits - FILTER_LOG
        on = np.zeros((hi - lo) << finer, bool)
        on[(places[total >= least] >> (TALLY_LOG - bits)) - (lo << finer)] = True
        rows.append(np.packbits(on, bitorder="little").tobytes())
    return pa.table({"lo": [lo], "n": [hi - lo], "several": [rows[0]], "wide": [rows[1]]}, schema=_BITS)


_BITS = pa.schema([("lo", pa.int64()), ("n", pa.int64()), ("several", pa.binary()), ("wide", pa.binary())])


def _bitmaps(visiting: DataFrame, parts: int, leaf: int, visits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both bitmaps, of up to 16 and of 4 MB, whatever the number of regions."""
    log = min(max(FILTER_LOG, (visits // 2).bit_length()), MOST_LOG)
    tallied = visiting.select("node", "homes").mapInArrow(
        lambda batches: _tallied(batches, parts), "part int, c0 binary, c1 binary"
    )
    found = tallied.groupBy("part").applyInArrow(
        lambda table: _tally_bits(table, parts, leaf, log), "lo bigint, n bigint, several binary, wide binary"
    )
    several, wide = (np.zeros(1 << (bits - 3), np.uint8) for bits in (log, FILTER_LOG))
    for row in found.collect():
        for out, name, finer in ((several, "several", log - FILTER_LOG), (wide, "wide", 0)):
            # A part begins and ends inside a byte.
            lo, n = row["lo"] << finer, row["n"] << finer
            part = np.unpackbits(np.frombuffer(bytes(row[name]), np.uint8), bitorder="little")[:n]
            whole = np.packbits(np.concatenate((np.zeros(lo % 8, np.uint8), part)), bitorder="little")
            out[lo // 8 : lo // 8 + len(whole)] |= whole
    return several, wide


def _linkable(n: np.ndarray, owner: np.ndarray, several: np.ndarray, more: float) -> np.ndarray:
    """Which nodes may have a link, from which of their visits are of regions that others visit too.

    Of two linked sets, take the one, of k shingles, whose visits end first. All but k - ceil(0.8 k) of these
    are shingles of the other, which visits them too. Here k is ceil(0.8 n) at least.
    """
    k = (PERCENT * n + 99) // 100
    shared = np.minimum(1 + np.floor(more * np.sqrt(k)).astype(np.int64), (PERCENT * k + 99) // 100)
    return np.bincount(owner, several, len(n)) >= shared


def _narrow(
    batches: Iterator[pa.RecordBatch], several: np.ndarray, wide: np.ndarray, parts: int, more: float
) -> Iterator[pa.RecordBatch]:
    """For each visit of a region of few nodes: region, node, its size, rank, last and number of wide regions; the
    number of such visits before it, the one before and the one after it (-1: none)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owner, offsets = _homes(batch)
        n = batch.column("n").to_numpy().astype(np.int64)
        in_several, in_wide = _on(several, keys), _on(wide, keys)
        n_wide = np.bincount(owner, in_wide, len(n)).astype(np.int32)
        at = np.flatnonzero(in_several & ~in_wide & _linkable(n, owner, in_several | in_wide, more)[owner])
        if len(at):
            own, home = owner[at], keys[at]
            same = own[1:] == own[:-1]
            before = np.concatenate(([-1], np.where(same, home[:-1], -1)))
            after = np.concatenate((np.where(same, home[1:], -1), [-1]))
            columns = [
                home, batch.column("node").to_numpy()[own], n[own], (at - offsets[own] + 1).astype(np.int32),
                keys[offsets[own + 1] - 1], n_wide[own], (np.arange(len(at)) - np.searchsorted(own, own)).astype(np.int32), before, after,
            ]
            yield from _blobs(_places(home), parts, columns)


_VISIT = [np.int64, np.int64, np.int64, np.int32, np.int64, np.int32, np.int32, np.int64, np.int64]


def _wide(batches: Iterator[pa.RecordBatch], several: np.ndarray, wide: np.ndarray, more: float) -> Iterator[pa.RecordBatch]:
    """Visits of wide regions, each with the number of the node's shingles below KNOWN (below) and how
    many of these visit wide regions (shared). A node that does not visit all of them has none below."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, owner, offsets = _homes(batch)
        in_wide = _on(wide, keys)
        n = batch.column("n").to_numpy().astype(np.int64)
        low = keys < KNOWN
        below = np.bincount(owner, low, len(n)).astype(np.int64)
        shared = np.bincount(owner, low & in_wide, len(n)).astype(np.int64)
        # All of a node's shingles below KNOWN are among its visits if one at least is above, or if it visits all.
        wholly = (below < np.diff(offsets)) | (np.diff(offsets) == n)
        at = np.flatnonzero(in_wide & _linkable(n, owner, in_wide | _on(several, keys), more)[owner])
        own = owner[at]
        columns = [
            keys[at], batch.column("node").to_numpy()[own], n[own], np.where(wholly, below, -FAR)[own], shared[own],
            _partners(n[own], at - offsets[own] + 1),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["home", "node", "n", "below", "shared", "upto"])


def _still_possible(rows: DataFrame) -> DataFrame:
    """The visits of wide regions that may belong to a link which no smaller region shows.

    Two such nodes share only shingles of wide regions, and below KNOWN no more of them than either
    has. All their others there differ: below(x) + below(y) - 2 min(shared(x), shared(y)) of them at
    least. So the smallest values in a region, among nodes of like size, tell which cannot be linked.
    """
    own = (100 + PERCENT) * F.col("below") - (100 - PERCENT) * F.col("n")
    both = 2 * (100 + PERCENT) * F.col("shared")
    sized = rows.select("home", "node", "n", "upto", _size().alias("size"), own.alias("own"), both.alias("both"))
    least = sized.groupBy("home", "size").agg(F.min("own").alias("__own"), F.min(F.col("own") - F.col("both")).alias("__less"))
    reach = _nearby(least).groupBy("home", "size").agg(F.min("__own").alias("__own"), F.min("__less").alias("__less"))
    met = sized.join(reach, ["home", "size"])
    possible = (F.col("own") + F.col("__own") - F.col("both") <= 0) & (F.col("own") + F.col("__less") <= 0)
    return met.where(possible).select("home", "node", "n", "upto")


def _size() -> Column:
    """A class of sizes; linked sets are in the same or in neighbouring ones."""
    return F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))


def _nearby(sized: DataFrame) -> DataFrame:
    """Every row once for each class of sizes that its links may be in."""
    rest = [c for c in sized.columns if c != "size"]
    return sized.select(*rest, F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])).alias("size"))


def _with_partners(rows: DataFrame) -> DataFrame:
    """The visits that some other visit of the region, of a like size, can be first met at."""
    sized = rows.select("home", "node", "n", "upto", _size().alias("size"))
    found = sized.groupBy("home", "size").agg(
        F.min("n").alias("__low"), F.max("upto").alias("__high"), F.count("*").alias("__count")
    )
    reach = _nearby(found).groupBy("home", "size").agg(
        F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.sum("__count").alias("__count")
    )
    met = sized.join(reach, ["home", "size"]).where("__count > 1")
    fits = (PERCENT * F.col("__low") <= F.col("upto")) & (PERCENT * F.col("n") <= F.col("__high"))
    return met.where(fits).select("home", "node", "n")


def _small_pairs(batches: Iterator[pa.RecordBatch], runs: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of the nodes that share a region, some regions at a time, so that few pairs are held.

    With ``runs``, visits are packed and tell the nodes' visits before and after them. A pair then comes
    only where a run of visits that both make begins or ends; ``common`` adds up to the same.
    """
    table = pa.Table.from_batches(batches)
    if runs:
        columns = _joined(table, _VISIT, _unpacked)
    else:
        columns = _joined(table, _VISIT[:6])
        columns += [np.zeros(len(columns[0]), np.int32), *[np.full(len(columns[0]), -1)] * 2]
    home, node = columns[:2]
    order = np.lexsort((node, home))
    fresh = order[np.concatenate(([True], (home[order][1:] != home[order][:-1]) | (node[order][1:] != node[order][:-1])))]
    columns = [c[fresh] for c in columns]
    starts = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1))
    sizes = np.diff(np.append(starts, len(fresh)))
    turn = np.cumsum(sizes * (sizes - 1) // 2) // HELD_PAIRS
    bounds = np.append(starts[np.flatnonzero(np.diff(turn, prepend=-1))], len(fresh))
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        yield _pairs_of(*(c[lo:hi] for c in columns))


def _run_pairs(batches: Iterator[pa.RecordBatch], more: float) -> Iterator[pa.RecordBatch]:
    """Pairs with what tells whether they may be linked: common, rank, least (of which a link takes as much), meets.

    Up to the smaller of both last regions all shingles of both are known: those that the one visits, and
    those of the other up to its rank. What they share in wide regions is not counted, so as much as
    possible is assumed. The bound on what differs is linear in common and rank; least is the rest of it.
    """
    for batch in _small_pairs(batches, runs=True):
        pair = {c: batch.column(c).to_numpy() for c in _PAIR}
        x_ends = pair["x_last"] <= pair["y_last"]
        visits = _visits(np.where(x_ends, pair["x_n"], pair["y_n"]), more)
        hidden = np.minimum(pair["x_wide"], pair["y_wide"])
        least = (100 + PERCENT) * (visits - 2 * hidden) - (100 - PERCENT) * (pair["x_n"] + pair["y_n"])
        rank = np.where(x_ends, pair["y_rank"], pair["x_rank"])
        columns = [pair["a"], pair["b"], pair["common"], rank, least, pair["meets"]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "common", "rank", "least", "meets"])


def _pairs_of(
    home: np.ndarray, node: np.ndarray, n: np.ndarray, rank: np.ndarray, last: np.ndarray, wide: np.ndarray,
    place: np.ndarray, before: np.ndarray, after: np.ndarray,
) -> pa.RecordBatch:
    """The pairs of some regions, with the number of these regions that they share; rows are sorted by region.

    A run counts its last place and one less its first, each in the region where it is: there are the
    pair's smallest and largest ranks as well.
    """
    upto = _partners(n, rank.astype(np.int64))
    left, right, step = [], [], 1
    while True:  # rows of a region lie together, few of them
        same = np.flatnonzero(home[step:] == home[:-step]) if step < len(home) else np.zeros(0, np.int64)
        if not len(same):
            break
        x, y = same, same + step
        fit = 100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y])
        inside = (before[x] == before[y]) & (before[x] >= 0) & (after[x] == after[y]) & (after[x] >= 0)
        left.append(x[fit & ~inside])
        right.append(y[fit & ~inside])
        step += 1
    x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    order = np.lexsort((rank[x], node[y], node[x]))
    x, y = x[order], y[order]
    begins, ends = ((side[x] != side[y]) | (side[x] < 0) for side in (before, after))
    counts = np.where(begins, 1 - place[x].astype(np.int64), 0) + np.where(ends, place[x], 0)
    meets = (PERCENT * n[y] <= upto[x]) & (PERCENT * n[x] <= upto[y])
    final = np.flatnonzero(np.concatenate(((node[x][1:] != node[x][:-1]) | (node[y][1:] != node[y][:-1]), [True]))[: len(x)])
    first = np.concatenate(([0], final[:-1] + 1))
    counts, any_meets = (np.add.reduceat(counts, first), np.logical_or.reduceat(meets, first)) if len(final) else (counts, meets)
    x, y = x[final], y[final]  # the last region that the pair shares here
    columns = [node[x], node[y], counts, n[x], n[y], rank[x], rank[y], last[x], last[y], wide[x], wide[y], any_meets]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=_PAIR)


_PAIR = ["a", "b", "common", "x_n", "y_n", "x_rank", "y_rank", "x_last", "y_last", "x_wide", "y_wide", "meets"]


def _fits(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _few_differ(differ: Column, n: Column, m: Column) -> Column:
    """Sets of n and m shingles that differ in so many are linked."""
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (n + m)


def _regions(visiting: DataFrame, leaf: int, by_hash: bool) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Pairs (a, b) of small regions that may be linked, rows (home, node, n) of wide regions and their bitmap."""
    visits = visiting.agg(F.sum(F.size("homes"))).first()[0] or 0
    parts = max(int(visiting.sparkSession.conf.get("spark.sql.shuffle.partitions")), visits // PART_VISITS)
    more = MORE if by_hash else 0.0
    several, wide = _bitmaps(visiting, parts, leaf, visits)
    blobs = visiting.select("node", "n", "homes").mapInArrow(
        lambda batches: _narrow(batches, several, wide, parts, more),
        "part int, " + ", ".join(f"c{i} binary" for i in range(len(_VISIT))),
    )

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _run_pairs(batches, more)

    found = blobs.groupBy("part").applyInArrow(
        paired, "a bigint, b bigint, common bigint, rank bigint, least bigint, meets bigint"
    )
    pairs = found.groupBy("a", "b").agg(F.sum("common").alias("common"), *[F.max(c).alias(c) for c in ("rank", "least", "meets")])
    differ = F.col("least") + (100 + PERCENT) * (F.col("rank") - 2 * F.col("common"))
    near = pairs.where("meets > 0").where(differ <= 0).select("a", "b")
    rows = visiting.select("node", "n", "homes").mapInArrow(
        lambda batches: _wide(batches, several, wide, more), "home bigint, node bigint, n bigint, below bigint, shared bigint, upto bigint"
    )
    rows = materialise(rows.distinct(), "join-visits")
    # Stored each time, as each is read twice.
    if by_hash:
        rows = materialise(_still_possible(rows), "join-possible")
    rows = materialise(_with_partners(rows), "join-partners")
    sizes = rows.groupBy("home").agg(F.min("node").alias("__lo"), F.max("node").alias("__hi")).where("__lo <> __hi")
    return materialise(near, "join-pairs"), materialise(rows.join(sizes.select("home"), "home"), "join-wide"), wide


def _sketches_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches do not differ in more bits than linked sets may differ in shingles."""
    for batch in batches:
        sides = [[np.frombuffer(x, np.uint8) for x in batch.column(c).to_pylist()] for c in ("__x", "__y")]
        differ = np.zeros(batch.num_rows, np.int64)
        for k, (x, y) in enumerate(zip(*sides, strict=True)):
            least = min(len(x), len(y))
            folded = np.bitwise_xor.reduce(x.reshape(-1, least)) ^ np.bitwise_xor.reduce(y.reshape(-1, least))
            differ[k] = np.bitwise_count(folded).sum()
        size = batch.column("__n").to_numpy().astype(np.int64)
        yield batch.select(["a", "b"]).filter(pa.array((100 + PERCENT) * differ <= (100 - PERCENT) * size))


def _likely(pairs: DataFrame, described: DataFrame) -> DataFrame:
    """The pairs (a, b) that may be linked by their sketches, stored; these take a fortieth of their sets' bytes."""
    pairs = materialise(pairs, "join-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    single = described.where("sketch is not null").select("node", "n", "sketch")
    held = membership.flagged(single, F.col("node"), membership.bitmap_of(nodes, F.col("node")), "__on").where("__on")
    held = held.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    left = held.select(F.col("node").alias("a"), F.col("n").alias("__m"), F.col("sketch").alias("__x"))
    right = held.select(F.col("node").alias("b"), "n", F.col("sketch").alias("__y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("__m") + F.col("n")).alias("__n"), "__x", "__y")
    return materialise(both.mapInArrow(_sketches_fit, "a bigint, b bigint"), "join-likely")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, distance and whether they are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("ids").alias("__a"))
    right = sets.select(F.col("node").alias("b"), F.col("ids").alias("__b"))
    n, m = F.size("__a"), F.size("__b")
    common = F.size(F.array_intersect("__a", "__b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(
        *pairs.columns,
        (1 - common / (n + m - common)).alias("distance"),
        _few_differ(n + m - 2 * common, n, m).alias("linked"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        places = pa.array(_places(lists.flatten().to_numpy()).astype(np.int32))
        offsets = lists.offsets.to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), places)
        yield pa.RecordBatch.from_arrays([batch.column("near"), batch.column("node"), lists], names=["near", "node", "places"])


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, counts = np.unique(batch.column("places").flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(places[counts >= least].astype(np.int64) + 1)], names=["place"])


def _frequent_bits(sets: DataFrame, least: int) -> np.ndarray:
    """The frequent shingles. Nodes of a common region lie together, so that counts of a batch show what is frequent there."""
    placed = sets.select("near", "node", "ids").mapInArrow(_placed, "near bigint, node bigint, places array<int>")
    together = placed.repartitionByRange("near", "node").select("places")
    return _bits(together.mapInArrow(lambda batches: _frequent(batches, least), "place bigint"))


def _bits(places: DataFrame) -> np.ndarray:
    """A bitmap of 4 MB over places (from 1 on), whatever their number."""
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    out = np.zeros((1 << FILTER_LOG) // 8, np.uint8)
    for part in parts.collect():
        bits = np.frombuffer(bytes(part["bits"]), np.uint8)
        out[(part["bucket"] - 1) * len(bits) : part["bucket"] * len(bits)] = bits
    return out


def _reordered(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The regions that nodes visit when frequent shingles come last."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("ids")
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        owner, ids = np.repeat(np.arange(batch.num_rows), n), lists.flatten().to_numpy()
        keys = ids | (_on(bits, ids).astype(np.int64) << np.int64(shingles.ID_BITS))
        keys = keys[np.lexsort((keys, owner))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(n), _first_of(owner, keys, n, _visits(n, 0.0))], names=["node", "n", "homes"]
        )


def _mixed(regions: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of regions that hold several components, with component and the largest one (main)."""
    labels = components(links)
    rows = regions.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = rows.groupBy("home", "component").agg(F.count("*").alias("__count"))
    several = counts.groupBy("home").agg(
        F.count("*").alias("__several"), F.max(F.struct("__count", "component"))["component"].alias("main")
    )
    return materialise(rows.join(several.where("__several > 1").select("home", "main"), "home"), "join-mixed")


def _cut(regions: DataFrame, sets: DataFrame, cut: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells of the regions (home: the pivot, node, n, distance, visitor), and links to pivots."""
    draw = [F.min_by("node", F.xxhash64("node", F.lit(cut * PIVOTS + k))) for k in range(PIVOTS)]
    pool = regions.where("component <> main") if "main" in regions.columns else regions
    pivots = pool.groupBy("home").agg(F.array_distinct(F.array(*draw)).alias("pivots"))
    both = regions.join(pivots.select("home", F.explode("pivots").alias("pivot")), "home")
    both = materialise(both.select("home", "node", "n", "pivot").distinct(), "join-pivots")
    pairs = both.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    measured = materialise(_measured(pairs, sets), "join-distances")
    there = both.join(measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "distance"), ["node", "pivot"])
    nearest = there.groupBy("home", "node").agg(F.min(F.struct("distance", "pivot")).alias("__own"))
    window = 2 * (1 - PERCENT / 100) + 1e-9
    visits = there.join(nearest, ["home", "node"]).where(F.col("distance") <= F.col("__own.distance") + window)
    cells = visits.groupBy(F.col("pivot").alias("home"), "node", "n", "distance").agg(
        F.min(F.col("pivot") != F.col("__own.pivot")).alias("visitor")
    )
    return materialise(cells, "join-cells"), measured.where("linked and a <> b").select("a", "b")


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Odd sketches of one length, as numbers of 64 bits."""
    for batch in batches:
        for start in range(0, batch.num_rows, SKETCHED_ROWS):
            some = batch.slice(start, SKETCHED_ROWS)
            lists = some.column("ids")
            owner = np.repeat(np.arange(some.num_rows), np.diff(lists.offsets.to_numpy()))
            words = shingles.odd_sketches(some.num_rows, owner, lists.flatten().to_numpy().view(np.uint64), WORDS * 64)
            offsets = pa.array(np.arange(some.num_rows + 1) * WORDS, pa.int32())
            columns = [some.column("node"), pa.ListArray.from_arrays(offsets, pa.array(words.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "words"])


def _last_pairs(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): nodes of a cell in different components whose distances to the pivot and odd sketches allow a link."""
    words = sets.select("node", "ids").mapInArrow(_words, "node bigint, words array<bigint>").dropDuplicates(["node"])
    cells = materialise(cells.join(words, "node"), "join-strays")
    item = F.struct("node", "n", "distance", "visitor", "component", "words")
    rows = cells.select("home", item.alias("x"))
    strays = cells.where("component <> main").select("home", "main", item.alias("y"))
    differ = sum((F.bit_count(F.col("x.words")[i].bitwiseXOR(F.col("y.words")[i])) for i in range(WORDS)), F.lit(0))
    near = F.abs(F.col("x.distance") - F.col("y.distance")) <= 1 - PERCENT / 100 + 1e-9
    met = rows.join(strays, "home").where(
        (F.col("x.component") != F.col("y.component"))
        & ((F.col("x.component") == F.col("main")) | (F.col("x.node") < F.col("y.node")))
        & ~(F.col("x.visitor") & F.col("y.visitor"))
        & _fits(F.col("x.n"), F.col("y.n"))
        & near
        & _few_differ(differ, F.col("x.n"), F.col("y.n"))
    )
    a, b = F.col("x.node"), F.col("y.node")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def linked_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF, frequent: int = FREQUENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest id of the texts that links lead to, the row's own included;
    NULL ids count only where there is no other. NULL texts and texts without words have no
    shingles and no links: each such row is a class of its own. Rows with equal sets are linked.
    Files are read several times; the ids and texts of any other frame are stored once. Other
    columns are not read. An empty table gives an empty result.
    """
    source = numbered.keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    source = source.select(f"{numbered.DOC}.*", f"{numbered.ROW}.*")
    id_type = source.schema["id"].dataType.simpleString()
    described = source.mapInArrow(
        _described, f"id {id_type}, file bigint, index bigint, node bigint, n bigint, homes array<bigint>, sketch binary"
    )
    stored = materialise(described, "join-texts")
    rows = stored.where("n > 0").select("node", "file", "index")

    pairs, wide, bits = _regions(_one_row_each(stored), leaf, True)
    sets = _sets(source, rows, wide.select("node"), bits)
    common = _frequent_bits(sets, frequent)
    again = sets.select("node", "ids").mapInArrow(lambda batches: _reordered(batches, common), "node bigint, n bigint, homes array<bigint>")
    more, alike, _ = _regions(materialise(again, "join-again"), leaf, False)
    pairs = _likely(pairs.unionByName(more).distinct(), stored)
    whole = _sets(source, rows, pairs.select(F.explode(F.array("a", "b")).alias("node")), bits)
    links = materialise(_measured(pairs, whole).where("linked").select("a", "b"), "join-links")

    regions = alike
    few = membership.bitmap_of(alike, F.col("node"))
    sets = materialise(membership.flagged(sets.select("node", "ids"), F.col("node"), few, "__on").where("__on").drop("__on"), "join-alike")
    for cut in range(CUTS):
        cells, found = _cut(regions, sets, cut)
        links = materialise(links.unionByName(found).distinct(), "join-links")
        regions = _mixed(cells, links)
    last = _measured(_last_pairs(regions, sets), sets).where("linked").select("a", "b")
    labels = components(materialise(links.unionByName(last).distinct(), "join-links"))

    member = stored.join(labels, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("__class")
    )
    member = materialise(member, "join-members")
    classes = member.where("n_shingles > 0").groupBy("__class").agg(F.min("id").alias("component_id"))
    alone = member.where("n_shingles = 0").select(F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id"))
    return (
        member.where("n_shingles > 0").join(classes, "__class")
        .select(F.col("id").alias("doc_id"), "n_shingles", "component_id").unionByName(alone)
    )
