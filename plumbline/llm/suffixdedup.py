"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier in the corpus.
Sorting the suffixes of all positions would move a hundred times the input, so two exact steps come
first. In every string of LENGTH bytes, the leftmost of the WINDOW grams of GRAM bytes with the least
hash is an anchor: equal strings have their anchors at equal places, so only positions around anchors
whose gram recurs can matter; hashes bring them together and decide nothing. And an anchor whose whole
surroundings (all the strings it can stand for) equal those of an earlier anchor is settled: all of
these strings recur. Surroundings are equal if their lengths and SHA-256 digests are.

What is left are the suffixes at anchors whose gram recurs in different surroundings. Each task sorts
those of its documents, cut to LENGTH bytes, into a run; runs are cut at common splitters,
front-coded (the length of the prefix shared with the suffix before, and the rest) and exchanged,
each suffix with the bytes before it. A loser tree merges the runs of a range. Its nodes remember how
long a prefix their suffix shares with the last winner; two suffixes are compared only beyond what
both are known to share with it. The merged order gives, for every number of bytes, which anchors
agree so far to the right; sorting the bytes before the anchors gives the same to the left. A string
that starts d bytes before its anchor equals those of the anchors that agree in d bytes to the left
and LENGTH - d to the right: two numbers, without a look at the text. All but the earliest are repeats.

A gram with very many different surroundings would be one task's work in all of this. Where a batch has
over DEALT of them, they are dealt out by their surroundings; and the anchors of a gram with over CROWD
open ones (or dealt out so) are not merged, but unfolded into the strings they can stand for, which are
dealt out by their SHA-256 digests: the earliest of each stays.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import cut_lineage, map_columns, text_bytes

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
BEFORE = WINDOW - 1
#: Zero bytes between documents in a buffer, so that no load of a gram's surroundings meets two of them.
GAP = 104
#: Bytes of text whose hashes are held at once, and suffixes in one sorted run.
PIECE, RUN = 2 << 20, 100_000
#: Anchors of a merged range that are judged at once, at least; a gram's anchors stay together.
BLOCK = 20_000
#: Different surroundings of one gram in a batch, and open anchors of one gram, beyond which they are dealt out.
DEALT, CROWD = 1_000, 200_000
#: The four words of a digest of surroundings.
WORDS = ("w0", "w1", "w2", "w3")
_ODD = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _ODD[40]
    h ^= h >> np.uint64(29)
    return h


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int, int, int, int]]]:
    """Lists of (text number, bytes, offset, first and end of the string starts looked at, length of the text)."""
    out, size = [], 0
    for k, text in enumerate(texts):
        n = len(text)
        for start in range(0, max(n - LENGTH + 1, 0), PIECE):
            end = min(start + PIECE, n - LENGTH + 1)
            low, high = max(0, start - BEFORE), min(n, end + BEFORE + LENGTH)
            out.append((k, text[low:high] if n > PIECE else text, low if n > PIECE else 0, start, end, n))
            size += high - low
            if size >= PIECE:
                yield out
                out, size = [], 0
    if out:
        yield out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of every anchor: text number, hash of its gram, digest of its surroundings (four words), its place, their end."""
    found = []
    for pieces in _pieces(texts):
        buffer = np.zeros(sum(len(p[1]) + GAP for p in pieces) + 2 * GAP, np.uint8)
        at, base, wanted = GAP, [], np.zeros(len(buffer), bool)
        for k, raw, low, start, end, n in pieces:
            buffer[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
            base.append(at)
            wanted[at + start - low : at + end - low] = True
            at += len(raw) + GAP
        base = np.array(base)
        words = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
        m = len(words) - 16
        h = _mix(words[:m] * _ODD[0] + words[8 : m + 8] * _ODD[1] + words[16 : m + 16] * _ODD[2])
        least = h & np.uint64(0xFFFFFFFF00000000) | np.arange(m, dtype=np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - width
        least = np.minimum(least[:-rest], least[rest:])  # of the grams of the string that starts here
        chosen = (least[wanted[: len(least)]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if not len(chosen):
            continue
        chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
        piece = np.searchsorted(base, chosen, "right") - 1
        lows, ns = np.array([p[2] for p in pieces]), np.array([p[5] for p in pieces])
        pos = chosen - base[piece] + lows[piece]
        left, right = np.minimum(BEFORE, pos), np.minimum(LENGTH, ns[piece] - pos)
        low, high, raws = pos - left - lows[piece], pos + right - lows[piece], [p[1] for p in pieces]
        digests = [
            sha256(bytes((x, y)) + raws[k][i:j]).digest()
            for x, y, k, i, j in zip(left.tolist(), right.tolist(), piece.tolist(), low.tolist(), high.tolist())
        ]
        around = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 4)
        text = np.array([p[0] for p in pieces])[piece]
        found.append((text, h[chosen].view(np.int64), around, pos, pos + right))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.reshape(0, 4), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Anchors of a batch. Of anchors with equal surroundings, all but the earliest are settled here and
    leave as plain ranges, so a passage in every document costs a row a batch.

    state: 0, 1 (of a gram that is dealt out), 2 (settled), 3 (a mark that anchors of this gram are dealt out).
    """
    for batch in batches:
        ids, keys = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
        order = np.lexsort((keys, ids))
        ids, keys = ids[order], keys[order]
        text, gram, around, at, b = anchors([batch.column(2)[int(k)].as_py() for k in order])
        doc = _numbers(ids, keys)[text]  # rows that repeat an id and text have one number
        by = np.argsort(gram * np.int64(_ODD[30] >> np.uint64(1)) + around[:, 0], kind="stable")
        g, s, d, p = gram[by], around[by], doc[by], at[by]
        again = np.zeros(len(by), bool)
        again[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1]).all(axis=1)
        grams, contexts = np.unique(g[~again], return_counts=True)
        grams = grams[contexts > DEALT]
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(by))))
        again &= (d != d[first]) | (p != p[first])
        settled = np.zeros(len(by), bool)
        settled[by] = again
        doc_s, a_s, b_s = _union(doc[settled], np.maximum(at[settled] - BEFORE, 0), b[settled], LENGTH - 1)
        left = ~settled
        n = len(doc_s)
        row = np.zeros(int(doc.max()) + 1 if len(doc) else 0, np.int64)
        row[doc] = text
        row, row_s = row[doc[left]], row[doc_s]
        spread = ((ids[row_s] ^ keys[row_s]) * 31 + a_s).astype(np.int64) * np.int64(_ODD[31] >> np.uint64(1))
        own = gram[left]
        dealt = np.isin(own, grams)
        own = np.where(dealt, own * np.int64(_ODD[32] >> np.uint64(1)) + around[left, 0], own)
        none, ones = np.zeros(n + len(grams), np.int64), np.ones(len(grams), np.int64)
        yield {
            "gram": np.concatenate((own, spread, grams)),
            **{w: np.concatenate((around[left, k], none)) for k, w in enumerate(WORDS)},
            "doc_id": np.concatenate((ids[row], ids[row_s], ones)),
            "key": np.concatenate((keys[row], keys[row_s], ones)),
            "at": np.concatenate((at[left], a_s + BEFORE, ones)).astype(np.int32),
            "b": np.concatenate((b[left], b_s, ones)).astype(np.int32),
            "state": np.concatenate((np.where(dealt, 1, 0), np.full(n, 2), np.full(len(grams), 3))).astype(np.int8),
        }


def _numbers(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the documents (id, key) of rows, in the order of id and key."""
    order = np.lexsort((keys, ids))
    a, b = ids[order], keys[order]
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate(([False], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(ids)])
    return out


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id`` (a null is the least bigint), ``key``, ``text`` (bytes) and ``given``, the id as it is.

    The key, a part of the text's SHA-256 digest, tells apart texts that share an id, or have none.
    """
    given, text = F.col("doc_id").cast("bigint"), text_bytes()
    key = F.xxhash64(F.sha2(text, 256), given.isNull())
    return docs.select(F.coalesce(given, F.lit(-(2**63))).alias("doc_id"), key.alias("key"), text, given.alias("given"))


def _union(doc: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = 0) -> tuple[np.ndarray, ...]:
    """Ranges [a, b) of a document that share ``least`` bytes or more become one; those of 0 may just touch.

    Strings of LENGTH bytes in the union lie in one of the ranges only if these share LENGTH - 1 bytes.
    Ranges are longer than ``least``.
    """
    if not len(doc):
        return doc.astype(np.int64), a.astype(np.int64), b.astype(np.int64)
    order = np.lexsort((a, doc))
    doc, a, b = doc[order].astype(np.int64), a[order].astype(np.int64), b[order].astype(np.int64)
    number = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64))))
    step = int(b.max()) + 2  # documents laid end to end, so that one running maximum serves all
    reach = np.maximum.accumulate(b + number * step)
    new = np.concatenate(([True], (a + number * step)[1:] + least > reach[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(doc)) - 1
    return doc[starts], a[starts], (reach - number * step)[ends]


def recurring(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (see _identified) and ``ranges`` of (at, b, open, crowd), from BEFORE bytes before ``at``, or the text's start, to ``b``.

    A range that is not open is repeated as a whole. In an open one, with an anchor at ``at``, strings
    that hold the anchor may be repeated. Other bytes are not. crowd: see the module's head.
    """
    digest = ", ".join(f"{w} bigint" for w in WORDS)
    rows = map_columns(
        _identified(docs), [F.col("doc_id"), F.col("key"), F.col("text")],
        f"gram bigint, {digest}, doc_id bigint, key bigint, at int, b int, state tinyint", _anchor_rows,
    ).repartition("gram")  # one exchange for both windows
    by_gram = W.partitionBy("gram")
    ordered = W.partitionBy("gram", *WORDS).orderBy("doc_id", "key", "at")
    judged = rows.select(
        "gram", "doc_id", "key", "at", "b", "state",
        (F.row_number().over(ordered) == 1).alias("first"),
        F.first("doc_id").over(ordered).alias("d0"),
        F.first("key").over(ordered).alias("key0"),
        F.first("at").over(ordered).alias("at0"),
    )
    apart = F.sum(F.col("first").cast("bigint")).over(by_gram)  # different surroundings
    judged = judged.select("*", apart.alias("apart"), (F.max("state").over(by_gram) == 3).alias("marked"))
    other = (F.col("d0") != F.col("doc_id")) | (F.col("key0") != F.col("key")) | (F.col("at0") != F.col("at"))
    repeat = (F.col("state") == 2) | ~F.col("first") & other
    mixed, crowd = (F.col("state") == 1) | (F.col("apart") > 1), (F.col("state") == 1) | F.col("marked") | (F.col("apart") > CROWD)
    kept = judged.where((F.col("state") < 3) & (repeat | (F.col("first") & mixed)))
    return (
        kept.select("doc_id", "key", F.struct("at", "b", (~repeat).alias("open"), (~repeat & crowd).alias("crowd")).alias("r"))
        .groupBy("doc_id", "key")
        .agg(F.collect_set("r").alias("ranges"))
    )


def _open_anchors(ranges: list[dict], crowd: bool = False) -> np.ndarray:
    """Places of open anchors, of a crowd or not, but for those whose strings all lie in settled ranges."""
    done = sorted((max(r["at"] - BEFORE, 0), r["b"]) for r in ranges if not r["open"])
    joined: list[list[int]] = []
    for a, b in done:  # strings of both lie in the union only if the ranges share LENGTH - 1 bytes
        if joined and a + LENGTH - 1 <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    starts, out = [x[0] for x in joined], []
    for r in ranges:
        if r["open"] and r["crowd"] == crowd:
            k = bisect_right(starts, max(r["at"] - BEFORE, 0)) - 1
            if k < 0 or joined[k][1] < r["b"]:
                out.append(r["at"])
    return np.array(sorted(set(out)), np.int64)


def _around(raw: bytes, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of anchors at ``at``: LENGTH bytes from there and how many are the text's, BEFORE bytes going back and how many."""
    padded = np.zeros(len(raw) + BEFORE + LENGTH, np.uint8)
    padded[BEFORE : BEFORE + len(raw)] = np.frombuffer(raw, np.uint8)
    both = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + LENGTH)[at]
    right, left = np.minimum(LENGTH, len(raw) - at), np.minimum(BEFORE, at)
    return both[:, BEFORE:], right, both[:, :BEFORE][:, ::-1], left


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``given`` and the compressed bytes of the text: what the shuffles of whole texts move."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = [pack(x.as_py()) for x in batch.column(3)]
            yield {"doc_id": batch.column(0), "key": batch.column(1), "given": batch.column(2), "packed": packed}

    read = [F.col(c) for c in ("doc_id", "key", "given", "text")]
    return map_columns(_identified(docs), read, "doc_id bigint, key bigint, given bigint, packed binary", body)


def _splitters(docs: DataFrame, marks: DataFrame, parts: int, sampled: int = 256, each: int = 64) -> np.ndarray:
    """Grams that cut the sort into ``parts`` ranges; from at most ``sampled`` documents, as they
    decide the sizes of tasks only."""
    plain = F.slice(F.filter("ranges", lambda r: r["open"] & ~r["crowd"]), 1, each)  # bounded, whatever a text holds
    some = marks.select("doc_id", "key", plain.alias("ranges")).where(F.size("ranges") > 0)
    some = some.orderBy(F.xxhash64("doc_id", "key")).limit(sampled)
    joined = _identified(docs).join(F.broadcast(some), ["doc_id", "key"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            heads = []
            for raw, ranges in zip(batch.column(0), batch.column(1)):
                text = raw.as_py()
                heads += [text[r["at"] : r["at"] + GRAM] for r in ranges.as_py()]
            yield {"head": heads}

    found = sorted(bytes(r[0]) for r in map_columns(joined, [F.col("text"), F.col("ranges")], "head binary", body).collect())
    cuts = sorted({found[len(found) * k // parts] for k in range(1, parts)}) if found else []
    return np.array(cuts, f"S{GRAM}")


RUNS = "part int, shared binary, tails binary, docs binary, keys binary, places binary, rights binary, lefts binary, before binary"


def sorted_run(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes of LENGTH bytes, and the prefix that each shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(suffixes).view(f"S{LENGTH}").ravel(), kind="stable")
    return order, _shared(suffixes[order])


def _shared(rows: np.ndarray) -> np.ndarray:
    shared = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        same = rows[1:] == rows[:-1]
        shared[1:] = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return shared


def _runs(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[dict]:
    """Rows of RUNS: a run of one task, cut at the splitters."""
    unpack = zstandard.ZstdDecompressor().decompress
    held, size = [], 0

    def emit() -> dict:
        nonlocal held, size
        suffix, right, before, left, doc, key, at = (np.concatenate(x) for x in zip(*held))
        held, size = [], 0
        order, shared = sorted_run(suffix)
        suffix = suffix[order]
        columns = [doc[order].astype(np.int64), key[order].astype(np.int64), at[order].astype(np.int32)]
        columns += [x[order].astype(np.uint8) for x in (right, left, before)]
        out: dict[str, list] = {c.split()[0]: [] for c in RUNS.split(", ")}
        heads = np.ascontiguousarray(suffix[:, :GRAM]).view(f"S{GRAM}").ravel()
        bounds = np.searchsorted(heads, splitters, "left").tolist()
        for part, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(suffix)])):
            if a < b:
                own = shared[a:b].copy()
                own[0] = 0
                tails = suffix[a:b][np.arange(LENGTH) >= own[:, None]]
                for k, v in zip(out, (part, own.astype(np.uint8), tails, *(x[a:b] for x in columns))):
                    out[k].append(v.tobytes() if isinstance(v, np.ndarray) else v)
        return out

    for batch in batches:
        for doc_id, key, packed, ranges in zip(*(batch.column(i) for i in range(4))):
            places = _open_anchors(ranges.as_py())
            if not len(places):
                continue
            raw = unpack(packed.as_py())
            for k in range(0, len(places), RUN):
                at = places[k : k + RUN]
                row = (np.full(len(at), x.as_py(), np.int64) for x in (doc_id, key))
                held.append((*_around(raw, at), *row, at))
                size += len(at)
                if size >= RUN:
                    yield emit()
    if held:
        yield emit()


class LoserTree:
    """Merges front-coded sorted runs (shared prefixes, tails); yields (prefix shared with the one before, run,
    number in the run) in sorted order."""

    def __init__(self, runs: list[tuple[bytes, bytes]]) -> None:
        self.runs = runs
        self.at = [0] * len(runs)  # next suffix of each run, and where its tail begins
        self.tail = [0] * len(runs)
        self.head: list[bytes | None] = [b""] * len(runs)

    def _advance(self, run: int) -> int:
        """The run's next suffix; returns the prefix it shares with the one before, -1 at the end."""
        shared, tails = self.runs[run]
        k = self.at[run]
        if k == len(shared):
            self.head[run] = None
            return -1
        self.at[run] = k + 1
        keep, tail = shared[k], self.tail[run]
        self.tail[run] = end = tail + LENGTH - keep
        self.head[run] = self.head[run][:keep] + tails[tail:end]
        return keep

    @staticmethod
    def _beyond(a: bytes, b: bytes, known: int) -> int:
        """Length of the common prefix of two suffixes that are known to share ``known`` bytes."""
        while known < LENGTH:
            x, y = a[known : known + 8], b[known : known + 8]
            if x != y:
                while a[known] == b[known]:
                    known += 1
                return known
            known += len(x)
        return LENGTH

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        n = len(self.runs)
        size = 1
        while size < n:
            size *= 2
        losers: list[tuple[int, int]] = [(-1, -1)] * size  # (run, prefix shared with the last winner here)
        head = self.head

        def play(run: int, shared: int, other: int, other_shared: int) -> tuple[int, int, int, int]:
            """(winner, what it shares with the last winner, loser, what it shares with this winner)."""
            if other < 0 or head[other] is None:
                return run, shared, other, -1
            if run < 0 or head[run] is None:
                return other, other_shared, run, -1
            if shared > other_shared:
                return run, shared, other, other_shared
            if shared < other_shared:
                return other, other_shared, run, shared
            a, b = head[run], head[other]
            common = self._beyond(a, b, shared)
            if common == LENGTH or a[common] < b[common]:
                return run, shared, other, common
            return other, shared, run, common

        def build(node: int) -> tuple[int, int]:
            if node >= size:
                run = node - size
                if run >= n:
                    return -1, -1
                self._advance(run)
                return run, 0
            a, b = build(2 * node), build(2 * node + 1)
            run, shared, lost, lost_shared = play(*a, *b)
            losers[node] = (lost, lost_shared)
            return run, shared

        run, shared = build(1)
        while run >= 0 and head[run] is not None:
            yield shared, run, self.at[run] - 1
            shared = self._advance(run)
            node = (run + size) // 2
            while node:
                other, other_shared = losers[node]
                run, shared, lost, lost_shared = play(run, shared, other, other_shared)
                losers[node] = (lost, lost_shared)
                node //= 2


def repeats_of(
    shared: np.ndarray, right: np.ndarray, before: np.ndarray, left: np.ndarray, doc: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places (doc, start) of repeated strings, from anchors in the order of their suffixes.

    shared: prefix shared with the suffix before; before: bytes going back from the anchor; right, left:
    how many bytes of either side are the text's own.
    """
    n = len(shared)
    group = np.cumsum(shared < GRAM)
    back = np.argsort(np.ascontiguousarray(before).view(f"S{BEFORE}").ravel(), kind="stable")
    back = back[np.argsort(group[back], kind="stable")]
    agree = _shared(before[back])
    agree[np.concatenate(([True], group[back][1:] != group[back][:-1]))] = -1
    place = np.lexsort((at, doc))
    docs, starts, to_left = [], [], np.empty(n, np.int64)
    for d in range(BEFORE + 1):
        to_left[back] = np.cumsum(agree < d)
        key = np.cumsum(shared < LENGTH - d) * (n + 1) + to_left
        rows = place[(left[place] >= d) & (right[place] >= LENGTH - d)]
        _, first, inverse = np.unique(key[rows], return_index=True, return_inverse=True)
        first = rows[first][inverse]
        again = rows[(doc[rows] != doc[first]) | (at[rows] != at[first])]
        docs.append(doc[again])
        starts.append(at[again] - d)
    return np.concatenate(docs), np.concatenate(starts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Repeats of rows of RUNS, sorted by part. Holds the runs of one part at a time."""
    part, runs = None, []

    def found(rows: list[tuple[int, int, int]], columns: tuple[np.ndarray, ...], base: np.ndarray) -> dict:
        shared, run, k = (np.array(x, np.int64) for x in zip(*rows))
        ids, keys, at, right, left, before = (c[base[run] + k] for c in columns)
        number = _numbers(ids, keys)
        row = np.empty(int(number.max()) + 1, np.int64)
        row[number] = np.arange(len(number))
        doc, start = repeats_of(shared, right.astype(np.int64), before, left.astype(np.int64), number, at.astype(np.int64))
        doc, a, b = _union(doc, start, start + LENGTH)
        return {"doc_id": ids[row[doc]], "key": keys[row[doc]], "a": a.astype(np.int32), "b": b.astype(np.int32)}

    def close() -> Iterator[dict]:
        sizes = [len(r["shared"]) for r in runs]
        base = np.cumsum([0, *sizes])[:-1]
        whole = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in runs])
        columns = (
            whole("docs", np.int64), whole("keys", np.int64), whole("places", np.int32), whole("rights", np.uint8), whole("lefts", np.uint8),
            whole("before", np.uint8).reshape(-1, BEFORE),
        )
        rows: list[tuple[int, int, int]] = []
        for row in LoserTree([(r["shared"], r["tails"]) for r in runs]):
            if len(rows) >= BLOCK and row[0] < GRAM:
                yield found(rows, columns, base)
                rows = []
            rows.append(row)
        if rows:
            yield found(rows, columns, base)

    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part:
                if runs:
                    yield from close()
                part, runs = row["part"], []
            runs.append(row)
    if runs:
        yield from close()


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The strings of crowded anchors: digest, doc_id, key, start and whether the same string comes earlier in this portion."""
    unpack = zstandard.ZstdDecompressor().decompress

    def emit(held: dict[bytes, list[tuple[int, int, int]]]) -> dict:
        out: dict[str, list] = {"string": [], "doc_id": [], "key": [], "a": [], "again": []}
        for digest, places in held.items():
            first = min(places)
            for place in set(places):
                for k, v in zip(out, (digest, *place, place != first)):
                    out[k].append(v)
        return out

    held: dict[bytes, list[tuple[int, int, int]]] = {}
    count = 0
    for batch in batches:
        for doc_id, key, packed, ranges in zip(*(batch.column(i) for i in range(4))):
            places = _open_anchors(ranges.as_py(), True)
            if not len(places):
                continue
            raw, name = unpack(packed.as_py()), (doc_id.as_py(), key.as_py())
            for at in places.tolist():
                for start in range(max(at - BEFORE, 0), min(at, len(raw) - LENGTH) + 1):
                    held.setdefault(sha256(raw[start : start + LENGTH]).digest(), []).append((*name, start))
                    count += 1
                if count >= RUN:
                    yield emit(held)
                    held, count = {}, 0
    yield emit(held)


def _crowded(joined: DataFrame) -> DataFrame:
    """``doc_id``, ``key``, ``a``, ``b`` of repeats among the strings of crowded anchors."""
    strings = map_columns(joined, [F.col(c) for c in joined.columns], "string binary, doc_id bigint, key bigint, a int, again boolean", _strings)
    settled, rest = F.col("again"), W.partitionBy("__deal", "string").orderBy("doc_id", "key", "a")
    deal = F.when(settled, F.xxhash64("doc_id", "key", "a")).otherwise(F.xxhash64("string"))  # what is known need not meet
    ranked = strings.withColumn("__deal", deal).withColumn("__n", F.when(settled, 2).otherwise(F.row_number().over(rest)))
    return ranked.where("__n > 1").select("doc_id", "key", "a", (F.col("a") + LENGTH).alias("b"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed ranges as an array of start and end) and ``kept`` (binary).

    Strings never cross documents, and are judged on the input. A null text is empty; texts of under
    LENGTH bytes lose nothing. Documents are told apart by doc_id and text: rows that repeat both do not
    make each other repeats. They are ordered by doc_id, a null before all others, and texts of one id by
    a hash. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    marks = cut_lineage(recurring(docs))
    wide = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(docs, marks, wide)
    open_marks = marks.where(F.exists("ranges", lambda r: r["open"]))
    packed = _packed(docs)
    joined = packed.join(open_marks, ["doc_id", "key"]).select("doc_id", "key", "packed", "ranges")
    runs = map_columns(joined, [F.col(c) for c in joined.columns], RUNS, lambda batches: _runs(batches, splitters))
    dealt = runs.repartition("part").sortWithinPartitions("part")
    repeats = map_columns(dealt, [F.col(c) for c in dealt.columns], "doc_id bigint, key bigint, a int, b int", _merge)
    crowd = marks.where(F.exists("ranges", lambda r: r["crowd"]))
    if not crowd.isEmpty():
        repeats = repeats.unionByName(_crowded(packed.join(crowd, ["doc_id", "key"]).select("doc_id", "key", "packed", "ranges")))
    merged = cut_lineage(
        repeats.groupBy("doc_id", "key").agg(F.collect_set(F.struct("a", "b")).alias("more"))
    )
    final = packed.join(marks, ["doc_id", "key"], "left").join(merged, ["doc_id", "key"], "left")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out: dict[str, list] = {"doc_id": batch.column(0).to_pylist(), "n_bytes": [], "spans": [], "kept": []}
            for packed, ranges, more in zip(*(batch.column(i) for i in range(1, 4))):
                raw = unpack(packed.as_py())
                gone = [(max(r["at"] - BEFORE, 0), r["b"]) for r in ranges.as_py() or () if not r["open"]]
                gone += [(r["a"], r["b"]) for r in more.as_py() or ()]
                spans: list[list[int]] = []
                for a, b in sorted(gone):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                cuts = [0, *(x for s in spans for x in s), len(raw)]
                out["n_bytes"].append(len(raw))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept"].append(b"".join([raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])]))
            yield out

    ddl = "doc_id bigint, n_bytes bigint, spans array<struct<start: int, end: int>>, kept binary"
    return map_columns(final, [F.col("given"), F.col("packed"), F.col("ranges"), F.col("more")], ddl, body)
