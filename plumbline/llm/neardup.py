"""Near duplicates by SimHash candidates and the exact likeness of shingle sets.

Texts are near duplicates if the sets of their word shingles have a Jaccard likeness of at least
``similarity``; classes are the components of such pairs. Fingerprints have 128 bits: two SimHashes of
the same shingles. The first one is searched by multi-index hashing (see simhash) for pairs within
``radius`` bits; the complete distance, of both, then tells near texts from chance. Each task gives a
spanning forest of its candidates, and the components of those forests are the groups of texts that
may be alike. Inside a group all pairs of sets are compared exactly: each set goes once to its group's
task, or, in a large group, to the cells of a triangle of blocks, so that no task grows with a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, map_columns, small_side, text_bytes
from plumbline.llm.components import BROADCAST_ROWS, connected_components
from plumbline.llm.simhash import _dealt, majority, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: Two equally long sets of likeness 0.8 have 64-bit fingerprints that differ in 9.7 bits on average, with a deviation of
#: 2.9, and 128-bit ones in 19.4 with 4.1; those of unlike texts differ in 32 with 4 and in 64 with 5.7.
RADIUS, WHOLE_RADIUS = 14, 35
#: Rows of a bucket compared at once with the others; candidates a row beyond which a bucket is searched as a graph.
TILE, MANY = 256, 8
#: Candidates held before they are thinned to a forest.
HELD = 200_000
#: Texts, and shingles, of one block of a group, some.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19


def scheme(radius: int) -> list[tuple[int, int]]:
    """(width, ball radius) of segments with balls of 2 bits, the last ones less: sum(r_i + 1) is radius + 1."""
    parts = max(2, -(-(radius + 1) // 3))
    radii = [(radius + 1) // parts - 1 + (i < (radius + 1) % parts) for i in range(parts)]
    return [(64 // parts + (i < 64 % parts), r) for i, r in enumerate(radii)]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text, shingle)).view(np.int64)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second half of a fingerprint (the finalizer of splitmix64)."""
    h = hashes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return (h ^ h >> np.uint64(31)).astype("<u8")


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text), ``node`` (hash of its set), ``n`` (size of the set), ``fp`` and ``fp2`` of each row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            nodes, sizes, fps, others = [], [], [], []
            for x in batch.column(2):
                every = shingle_hashes(x.as_py(), shingle)
                found = np.unique(every)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), 7))
                sizes.append(len(found))
                fps.append(majority(every))
                others.append(majority(_second(every)))
            signed = lambda v: np.array(v, np.uint64).view(np.int64)
            yield {"doc_id": batch.column(0), "key": batch.column(1), "node": signed(nodes), "n": sizes, "fp": signed(fps), "fp2": signed(others)}

    read = [F.col("doc_id").cast("bigint"), F.xxhash64(text_bytes()), text_bytes()]
    return map_columns(docs, read, "doc_id bigint, key bigint, node bigint, n int, fp bigint, fp2 bigint", body)


def _thin(links: list[np.ndarray]) -> list[np.ndarray]:
    """A spanning forest of links (a, b)."""
    rows = np.unique(np.concatenate(links), axis=0)
    names, numbers = np.unique(rows, return_inverse=True)
    a, b = numbers.reshape(-1, 2).T
    part, chosen, left = np.arange(len(names)), [], np.arange(len(rows))
    while True:  # every part takes its first link to another one
        left = left[part[a[left]] != part[b[left]]]
        if not len(left):
            return [rows[np.unique(np.concatenate(chosen))] if chosen else rows[:0]]
        best = np.full(len(names), len(rows))
        np.minimum.at(best, part[a[left]], left)
        np.minimum.at(best, part[b[left]], left)
        at = np.flatnonzero(best < len(rows))
        link = best[at]
        chosen.append(link)
        to = np.arange(len(names))
        p, q = part[a[link]], part[b[link]]
        to[at] = np.where(p == at, q, p)
        ends = (to[to] == np.arange(len(to))) & (np.arange(len(to)) < to)
        to[ends] = np.flatnonzero(ends)
        while not np.array_equal(further := to[to], to):
            to = further
        part = to[part]


class _Near:
    """Which rows of a bucket are candidates of each other."""

    def __init__(self, filed: np.ndarray, fp: np.ndarray, fp2: np.ndarray, n: np.ndarray, radius: int, whole: int, similarity: float) -> None:
        self.filed, self.fp, self.fp2, self.n = filed, fp, fp2, n
        self.radius, self.whole, self.similarity = radius, whole, similarity

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (i, j) among the rows a and b, as numbers within a and b."""
        bits = np.bitwise_count(self.fp[a][:, None] ^ self.fp[b][None])
        i, j = np.nonzero(bits <= self.radius)
        x, y = a[i], b[j]
        few, many = np.minimum(self.n[x], self.n[y]), np.maximum(self.n[x], self.n[y])
        ok = (few >= self.similarity * many - 1e-9) & (self.filed[x] | self.filed[y]) & (x != y)
        ok[ok] = bits[i[ok], j[ok]] + np.bitwise_count(self.fp2[x[ok]] ^ self.fp2[y[ok]]) <= self.whole
        return i[ok], j[ok]

    def forest(self) -> list[np.ndarray]:
        """Links (row, row) that join what candidates join: few candidates as they are, many as a search through the graph."""
        rows, found, count = np.arange(len(self.fp)), [], 0
        for at in range(0, len(rows), TILE):
            i, j = self.pairs(rows[at : at + TILE], rows[at:])
            later = j > i
            found.append(np.stack((i[later], j[later]), axis=1) + at)
            count += len(found[-1])
            if count > MANY * len(rows):
                return self._search()
        return found

    def _search(self) -> list[np.ndarray]:
        found, left = [], np.arange(len(self.fp))  # what a row reaches leaves the rows still to be reached
        while len(left):
            front, left = left[:1], left[1:]
            while len(front) and len(left):
                some, front = front[:TILE], front[TILE:]
                i, j = self.pairs(some, left)
                new, at = np.unique(j, return_index=True)
                found.append(np.stack((some[i[at]], left[new]), axis=1))
                front = np.concatenate((front, left[new]))
                left = np.delete(left, new)
        return found


def _candidates(batches: Iterator[pa.RecordBatch], radius: int, whole: int, similarity: float) -> Iterator[dict]:
    """A forest of the candidates among rows of _dealt with n and fp2; a task holds one bucket's cell, and HELD links."""
    held: list[np.ndarray] = []
    count, rest = 0, None

    def search(rows: tuple[np.ndarray, ...]) -> Iterator[dict]:
        nonlocal held, count
        seg, val, cell, filed, fp, rep, n, fp2 = rows
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (val[1:] != val[:-1]) | (cell[1:] != cell[:-1])
        edges = np.append(np.flatnonzero(new), len(seg)).tolist()
        for s, e in zip(edges, edges[1:]):
            if e - s > 1:
                for links in _Near(filed[s:e], fp[s:e], fp2[s:e], n[s:e], radius, whole, similarity).forest():
                    if len(links):
                        held.append(np.sort(rep[links + s], axis=1))
                        count += len(links)
                if count > HELD:
                    held = _thin(held)
                    count = len(held[0])
                    if count > HELD // 2:
                        yield {"a": held[0][:, 0], "b": held[0][:, 1]}
                        held, count = [], 0

    for batch in batches:
        new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        new[3], new[4], new[7] = new[3].astype(bool), new[4].view(np.uint64), new[7].view(np.uint64)
        rows = tuple(new) if rest is None else tuple(np.concatenate(x) for x in zip(rest, new))
        if not len(rows[0]):
            continue
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
        cut = int(np.argmax(last))
        rest = tuple(x[cut:] for x in rows)
        if cut:
            yield from search(tuple(x[:cut] for x in rows))
    if rest is not None:
        yield from search(rest)
    if held:
        held = _thin(held)
        yield {"a": held[0][:, 0], "b": held[0][:, 1]}


def alike(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """A spanning forest (i, j) of the pairs of sets with at least the likeness ``similarity``.

    side: 0 or 1 for each set, in this order; pairs of one side are left out unless all are of one side. One
    set is marked among all shingles at a time, and counted in all others at once.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marks = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    both = len(np.unique(side)) > 1
    filled, part, links = np.flatnonzero(sizes), np.arange(len(sets)), []
    for k, i in enumerate(filled.tolist()):
        if both and side[i]:
            continue
        others = filled[side[filled] == 1] if both else filled[k + 1 :]
        if not len(others):
            continue
        own = ids[starts[i] : ends[i]]
        marks[own] = 1
        low = int(starts[others[0]])
        common = np.add.reduceat(marks[ids[low:]], starts[others] - low)
        marks[own] = 0
        near = others[common * (1 + similarity) >= (sizes[i] + sizes[others]) * similarity - 1e-9]
        near = near[part[near] != part[i]]
        if len(near):
            parts, first = np.unique(part[near], return_index=True)
            links += [(i, j) for j in near[first].tolist()]
            part[np.isin(part, parts)] = part[i]
    return np.array(links, np.int64).reshape(-1, 2)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[dict]:
    """Rows (root, cell, side, node, set) come sorted by group and cell; gives forests of alike nodes."""
    held, name = [], None

    def judged() -> dict:
        held.sort(key=lambda x: (x[0], x[1]))  # sides follow each other
        once = [x for k, x in enumerate(held) if not k or x[:2] != held[k - 1][:2]]
        nodes = np.array([x[1] for x in once], np.int64)
        links = alike([np.frombuffer(x[2], np.int64) for x in once], np.array([x[0] for x in once]), similarity)
        return {"a": nodes[links[:, 0]], "b": nodes[links[:, 1]]}

    for batch in batches:
        for root, cell, side, node, found in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if (root, cell) != name:
                if len(held) > 1:
                    yield judged()
                held, name = [], (root, cell)
            held.append((side, node, found))
    if len(held) > 1:
        yield judged()


def _links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Forests of the pairs (a, b) of nodes with at least the likeness ``similarity`` within each group (node, root)."""
    grouped = nodes.join(small_side(groups, BROADCAST_ROWS), "node").select("node", "n", "doc", "key", "root")
    grouped = cut_lineage(grouped)
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    sizes = cut_lineage(sizes.select("root", blocks.alias("blocks")))
    wanted = cut_lineage(grouped.join(small_side(sizes, BROADCAST_ROWS), "root")).withColumnRenamed("key", "__key")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__id"), F.xxhash64(text_bytes()).alias("__key"), text_bytes())
    texts = texts.join(small_side(wanted, BROADCAST_ROWS), ["__key"]).where(F.col("__id").eqNullSafe(F.col("doc")))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()  # rows that repeat an id and a text give their set once a task
        for batch in batches:
            names = batch.column(2).to_pylist()
            new = [k for k, node in enumerate(names) if node not in seen and not seen.add(node)]
            out = {c: batch.column(i).take(pa.array(new, pa.int64())) for i, c in enumerate(("root", "blocks", "node"))}
            yield out | {"set": [shingles(batch.column(3)[k].as_py(), shingle).tobytes() for k in new]}

    sets = map_columns(texts, [F.col(c) for c in ("root", "blocks", "node", "text")], "root bigint, blocks int, node bigint, set binary", body)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.select("*", own.alias("own"), other.alias("other")).select(
        "root", (F.least("own", "other").cast("bigint") * F.col("blocks") + F.greatest("own", "other")).alias("cell"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "set",
    ).repartition("root", "cell").sortWithinPartitions("root", "cell")
    return map_columns(dealt, [F.col(c) for c in dealt.columns], "a bigint, b bigint", lambda batches: _verified(batches, similarity))


def near_classes(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, whole: int = WHOLE_RADIUS, block: int = 2048
) -> DataFrame:
    """``doc_id``, ``key`` (hash of the text) and ``least`` (least doc_id of the class) of every row of ``docs``.

    Texts without words are one class, as are texts with equal sets. A row without a doc_id joins
    texts to each other like any other; a class of such rows only has no least id.
    """
    marked = cut_lineage(_marked(docs, shingle))
    one = F.min(F.struct(F.col("doc_id").alias("doc"), "key"))  # the row whose text gives the set
    nodes = marked.groupBy("node").agg(one.alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("fp2").alias("fp2"))
    nodes = cut_lineage(nodes.select("node", "one.doc", "one.key", "n", "fp", "fp2"))
    dealt = _dealt(nodes.select("fp", F.col("node").alias("rep"), "n", "fp2"), scheme(radius), block, ("n", "fp2"))
    pairs = map_columns(
        dealt, [F.col(c) for c in dealt.columns], "a bigint, b bigint",
        lambda batches: _candidates(batches, radius, whole, similarity),
    )
    groups = cut_lineage(connected_components(pairs))
    roots = cut_lineage(connected_components(_links(docs, nodes, groups, shingle, similarity)))
    rooted = cut_lineage(
        marked.join(small_side(roots, BROADCAST_ROWS), "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    )
    least = cut_lineage(rooted.groupBy("root").agg(F.min("doc_id").alias("least")))
    return rooted.join(least, "root").select("doc_id", "key", "least")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their class: one document a group.

    A repeated doc_id with the same text stays as often as it occurs, with other text it is judged by
    that text; rows without a doc_id stay.
    """
    found = near_classes(docs, shingle, similarity, radius)
    gone = cut_lineage(found.where("doc_id != least").select(F.col("doc_id").alias("__gone"), F.col("key").alias("__key")).distinct())
    same = (F.col("doc_id") == F.col("__gone")) & (F.xxhash64(text_bytes()) == F.col("__key"))
    return docs.join(small_side(gone, BROADCAST_ROWS), same, "left_anti")
