"""Near duplicates by SimHash and multi-index hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a document's word shingles. To find
all pairs within ``radius`` differing bits, the 64 bits are cut into segments, and each segment i
gets a ball radius r_i with sum(r_i + 1) > radius: of two linked fingerprints, at least one
segment i then differs in at most r_i bits. Every distinct fingerprint is filed under all values of
each segment within half its ball (rounded down) and looks up those within the other half; what it
finds there is verified on all 64 bits. Only a spanning forest of each task's links leaves the task, and the
classes are the components of those forests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut_lineage, map_columns, small_side, text_bytes
from plumbline.llm.components import BROADCAST_ROWS, connected_components

#: (width, ball radius) of the segments, by the most distinct fingerprints for which they are meant.
SCHEMES = [
    (16_000_000, [(16, 1), (16, 0), (16, 0), (16, 0)]),
    (2_000_000_000, [(22, 1), (21, 1), (21, 0)]),
    (1 << 62, [(32, 2), (32, 1)]),
]


def shingle_hashes(text: bytes, shingle: int = 4, lower: bool = True) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included; of the whole sequence if it is shorter."""
    words = (text.lower() if lower else text).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), 42)] if words else [], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends)), "<u8", len(ends))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint_of(text: bytes, shingle: int = 4, lower: bool = True) -> int:
    """SimHash of one text, unsigned; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, lower))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed bigint) of whole texts; null texts are empty."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [fingerprint_of(x.as_py(), shingle) for x in batch.column(1)]
            yield {"doc_id": batch.column(0), "fp": np.array(found, np.uint64).view(np.int64)}

    return map_columns(docs, [F.col("doc_id"), text_bytes()], "doc_id bigint, fp bigint", body)


def _probe(seg: int, value: Column) -> Callable[[Column], Column]:
    return lambda mask: F.struct(
        F.lit(seg).alias("seg"), value.bitwiseXOR(mask["m"]).alias("val"), mask["filed"].alias("filed")
    )


def _probes(scheme: list[tuple[int, int]]) -> Column:
    """Per fingerprint: (segment, value, filed) of what it is filed under and of what it looks up."""
    out, shift = [], 0
    for i, (width, radius) in enumerate(scheme):
        value = F.shiftrightunsigned(F.col("fp"), shift).bitwiseAND((1 << width) - 1)
        masks = [(sum(1 << b for b in bits), r <= radius // 2) for r in range((radius + 1) // 2 + 1) for bits in combinations(range(width), r)]
        ball = F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(filed).alias("filed")) for m, filed in masks])
        out.append(F.transform(ball, _probe(i, value)))
        shift += width
    return F.concat(*out)


def _link_small(fp: np.ndarray, rep: np.ndarray, start: np.ndarray, filed: np.ndarray, size: int, radius: int) -> list:
    """Links inside groups of at most ``size`` rows that follow each other; start: of each row's group."""
    found = []
    for lag in range(1, size):
        a, b = slice(None, -lag), slice(lag, None)
        near = (start[a] == start[b]) & (filed[a] | filed[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= radius)
        if near.any():
            found.append(np.stack([rep[a][near], rep[b][near]], axis=1))
    return found


def _link_large(fp: np.ndarray, rep: np.ndarray, filed: np.ndarray, radius: int) -> list:
    """A spanning forest of one large group: what a node reaches leaves the set still to be reached."""
    found, left = [], np.ones(len(fp), bool)
    rows = np.arange(len(fp))
    open_rows = [rows[filed], rows[~filed]]
    for root in rows:
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            for side in (0, 1) if filed[at] else (0,):
                others = open_rows[side]
                others = others[left[others]]
                open_rows[side] = others
                near = others[np.bitwise_count(fp[others] ^ fp[at]) <= radius]
                if len(near):
                    left[near] = False
                    found.append(np.stack([np.full(len(near), rep[at]), rep[near]], axis=1))
                    stack.extend(near.tolist())
    return found


class _Forest:
    """Keeps the links that join two parts not yet joined in this task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = parent[y]
            x = parent[y]
        return x

    def new(self, links: list) -> dict:
        a, b = [], []
        if links:
            for x, y in np.unique(np.concatenate(links), axis=0).tolist():
                p, q = self.root(x), self.root(y)
                if p != q:
                    self.parent[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
        return {"a": a, "b": b}


def _links(batches: Iterator[pa.RecordBatch], radius: int, small: int = 48) -> Iterator[dict]:
    """Rows come sorted by group: group hash, cell, filed, fp, rep."""
    forest, rest = _Forest(), None

    def linked(group: np.ndarray, fp: np.ndarray, rep: np.ndarray, filed: np.ndarray) -> dict:
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.append(edges, len(group)))
        each = np.repeat(sizes, sizes)
        few = (each > 1) & (each <= small)
        start = np.repeat(edges, sizes)
        found = []
        if few.any():
            found += _link_small(fp[few], rep[few], start[few], filed[few], int(each[few].max()), radius)
        for s, n in zip(edges[sizes > small].tolist(), sizes[sizes > small].tolist()):
            found += _link_large(fp[s : s + n], rep[s : s + n], filed[s : s + n], radius)
        return forest.new(found)

    for batch in batches:
        seg, val, cell = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        key = ((val * 8 + seg) * 1_000_003 + cell).astype(np.int64)  # neighbours differ; a chance tie only adds checks
        new = (
            key,
            batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64),
            batch.column(5).to_numpy(zero_copy_only=False),
            batch.column(3).to_numpy(zero_copy_only=False).astype(bool),
        )
        if rest is not None:
            new = tuple(np.concatenate(x) for x in zip(rest, new))
        if not len(new[0]):
            continue
        other = np.flatnonzero(new[0] != new[0][-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        rest = tuple(x[cut:] for x in new)
        if cut:
            yield linked(*(x[:cut] for x in new))
    if rest is not None:
        yield linked(*rest)


def _dealt(fps: DataFrame, scheme: list[tuple[int, int]], block: int, more: tuple[str, ...] = ()) -> DataFrame:
    """``seg``, ``val``, ``cell``, ``filed``, ``fp``, ``rep`` and ``more``, sorted by bucket and cell: who may meet whom."""
    rows = fps.select("fp", "rep", *more, F.explode(_probes(scheme)).alias("p")).select("p.seg", "p.val", "p.filed", "fp", "rep", *more)
    full = (
        rows.groupBy("seg", "val")
        .agg(F.count_if("filed").alias("t"), F.count(F.lit(1)).alias("q"))
        .where(F.col("q") > block)
        .select("seg", "val", F.when(F.col("t") > 0, F.ceil(F.col("q") / block)).otherwise(0).cast("int").alias("cells"))
    )
    full = small_side(cut_lineage(full), BROADCAST_ROWS)  # else all rows move twice more
    own = F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int")
    i, j = F.least(own, F.col("c")), F.greatest(own, F.col("c"))
    hot = (
        rows.join(full.where("cells > 0"), ["seg", "val"])  # where nothing is filed, nobody meets
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
        .select("seg", "val", (i * F.col("cells") + j + 1).cast("bigint").alias("cell"), "filed", "fp", "rep", *more)
    )
    if full.isEmpty():
        dealt = rows.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        dealt = rows.join(full, ["seg", "val"], "left_anti").withColumn("cell", F.lit(0).cast("bigint")).unionByName(hot)
    dealt = dealt.select("seg", "val", "cell", "filed", "fp", "rep", *more)
    return dealt.repartition("seg", "val", "cell").sortWithinPartitions("seg", "val", "cell")


def near_links(fps: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Forests of links ``a``, ``b`` (reps) between the distinct fingerprints ``fp`` with ``rep``.

    A bucket with more than ``block`` filed rows, or look-ups, is dealt out in cells: each filed
    block meets each block of look-ups in some task, so nothing is capped and no task grows with a
    bucket. Memory of a task: one cell.
    """
    n = fps.count()
    dealt = _dealt(fps, next(s for most, s in SCHEMES if n <= most), block)
    return map_columns(
        dealt, [F.col(c) for c in dealt.columns], "a bigint, b bigint", lambda batches: _links(batches, radius)
    )


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (the least doc_id reachable over links) of every row of ``docs``.

    Documents without words share the fingerprint zero and are linked like others. Repeated rows
    each get their row. Rows with a null doc_id are kept; they have a class only through others.
    An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    marked = cut_lineage(fingerprints(docs, shingle))
    fps = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(near_links(fps.where(F.col("rep").isNotNull()), radius))
    classes = fps.join(roots, fps["rep"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    return marked.join(cut_lineage(classes), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

