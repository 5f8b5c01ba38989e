"""Document fingerprints by a homomorphic multiset hash.

A document is a multiset of paragraphs. Each paragraph is hashed to a wide vector, and the
fingerprint is the sum of the vectors: 8 lanes of 64 random bits modulo 2**64, by which equality is
judged, and 512 lanes of plus or minus one modulo 2**16, whose squared length estimates how many
paragraphs a multiset holds. The sum does not depend on order; a paragraph is inserted by adding its
vector and deleted by subtracting it; and the difference of two fingerprints is the fingerprint of
what the documents do not share, from which their likeness follows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_columns

WIDE, SIGNS = 8, 512
#: Line breaks and the ends of sentences part paragraphs.
_BREAK = re.compile(rb"\n+|(?<=[.!?])[ \t]+")
#: So do words, wherever they stand, whose checksum has none of these bits: one word in eight.
PART = 7
BYTES = 8 * WIDE + 2 * SIGNS


def paragraphs(text: bytes) -> list[bytes]:
    """The paragraphs of a text, white space within each turned to single spaces.

    What parts them depends on the words there alone, not on lengths, so texts that share a stretch share
    the paragraphs in it.
    """
    out, check = [], zlib.crc32
    for part in _BREAK.split(text):
        words, start = part.split(), 0
        for k, word in enumerate(words, 1):
            if not check(word) & PART:
                out.append(b" ".join(words[start:k]))
                start = k
        if start < len(words):
            out.append(b" ".join(words[start:]))
    return out


def vector(units: list[bytes]) -> np.ndarray:
    """The sum of the vectors of ``units``: WIDE + SIGNS lanes, as bytes."""
    wide, signs = np.zeros(WIDE, np.uint64), np.zeros(SIGNS, np.int64)
    for k in range(0, len(units), 4096):
        part = units[k : k + 4096]
        digests = np.frombuffer(b"".join([hashlib.blake2b(u).digest() for u in part]), np.uint8).reshape(-1, 64)
        wide += digests.view("<u8").sum(axis=0, dtype=np.uint64)
        signs += 2 * np.unpackbits(digests[:, : SIGNS // 8], axis=1).sum(axis=0, dtype=np.int64) - len(part)
    return np.concatenate((wide.astype("<u8").view(np.uint8), (signs & 0xFFFF).astype("<u2").view(np.uint8)))


def _lanes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[: 8 * WIDE].view("<u8"), v[8 * WIDE :].view("<u2")


def insert(v: np.ndarray, added: np.ndarray) -> np.ndarray:
    """The fingerprint of the union of two multisets."""
    (a, b), (c, d) = _lanes(v), _lanes(added)
    return np.concatenate(((a + c).view(np.uint8), (b + d).view(np.uint8)))


def delete(v: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The fingerprint without a multiset that the first one contains."""
    (a, b), (c, d) = _lanes(v), _lanes(gone)
    return np.concatenate(((a - c).view(np.uint8), (b - d).view(np.uint8)))


def _size(v: np.ndarray) -> float:
    """Estimate of the sum of squared multiplicities."""
    signed = _lanes(v)[1].astype(np.int64)
    signed = np.where(signed >= 1 << 15, signed - (1 << 16), signed)
    return float((signed * signed).mean())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about the shared part of the paragraphs else, 0 if little or nothing is shared."""
    if np.array_equal(a, b):
        return 1.0
    both = _size(a) + _size(b)
    return max(0.0, min(0.999, 1.0 - _size(delete(a, b)) / both)) if both else 0.0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``paragraphs`` and ``vector`` (binary) of every whole text; a null text has no paragraphs."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            units = [paragraphs(x.as_py()) for x in batch.column(1)]
            yield {"doc_id": batch.column(0), "paragraphs": [len(u) for u in units], "vector": [vector(u).tobytes() for u in units]}

    read = [F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")]
    return map_columns(docs, read, "doc_id bigint, paragraphs bigint, vector binary", body)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows in which each document is followed by the next by doc_id: bucket, ahead, doc_id, text.

    Ranges of ids are buckets; the first document of each is also dealt, marked as ahead, to the
    bucket before, and the first of all to the last one. An id with more rows than a bucket should
    have (say, null) has buckets of its own, by ranges of the hash that orders its rows. Whole texts move
    once. Bounds, firsts and such ids are some 4 each to a shuffle partition, which is all that comes to the driver.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)).alias("__at")
    ids, text = docs.select(at), F.coalesce("text", F.lit("")).alias("text")
    share = ids.count() // (4 * parts) + 1
    # beyond 2**53 a double stands for several ids, which the hash must not part
    often = ids.groupBy("__at").count().where((F.col("count") > share) & ((F.abs("__at") < 2.0**53) | (F.col("__at") == -1e300)))
    often = {r["__at"]: -(-r["count"] // share) for r in often.collect()}
    bounds = set(ids.approxQuantile("__at", [k / (4 * parts) for k in range(1, 4 * parts)], 1 / (16 * parts)))
    bounds |= {x for h in often for x in (h, float(np.nextafter(h, np.inf)))}
    splits = [-float("inf"), *(sorted(bounds) or [0.0]), float("inf")]  # 0: an empty table
    buckets = Bucketizer(splits=splits, inputCol="__at", outputCol="__bucket")

    def placed(rows: DataFrame) -> DataFrame:
        """``rows`` with __bucket (range of ids), __hash (of the text) and __part (range of the hash, 0 but for common ids)."""
        out = buckets.transform(rows).withColumn("__bucket", F.col("__bucket").cast("int"))
        out = out.withColumn("__hash", F.xxhash64("text"))
        if not often:
            return out.withColumn("__part", F.lit(0))
        known = F.create_map(*[F.lit(x) for pair in often.items() for x in pair])[F.col("__at")]
        nth = F.floor((F.col("__hash").cast("double") / 2.0**64 + 0.5) * known).cast("int")
        return out.withColumn("__part", F.coalesce(F.least(nth, known.cast("int") - 1), F.lit(0)))

    every = placed(docs.select("doc_id", at, text))
    plain = buckets.transform(ids).groupBy(F.col("__bucket").cast("int").alias("b")).agg(F.min("__at").alias("first"))
    firsts = [(r["b"], 0, r["first"], None) for r in plain.collect() if r["first"] not in often]
    if often:
        common = every.where(F.col("__at").isin(*often)).groupBy("__bucket", "__part").agg(F.min("__at").alias("first"), F.min("__hash").alias("hash"))
        firsts += [tuple(r) for r in common.collect()]
    firsts.sort(key=lambda r: r[:2])
    number = {r[:2]: k for k, r in enumerate(firsts)}
    to = [(r[2], r[3], (k - 1) % len(firsts)) for k, r in enumerate(firsts)]  # the first goes to the last
    heads = spark.createDataFrame(to, "__first double, __of bigint, __to int")
    numbers = spark.createDataFrame([(*k, n) for k, n in number.items()], "__bucket int, __part int, bucket int")
    same = (F.col("__at") == F.col("__first")) & (F.col("__of").isNull() | (F.col("__hash") == F.col("__of")))
    ahead = every.join(F.broadcast(heads), same).select(F.col("__to").alias("bucket"), F.lit(1).alias("ahead"), "doc_id", "__hash", "text")
    own = every.join(F.broadcast(numbers), ["__bucket", "__part"]).select("bucket", F.lit(0).alias("ahead"), "doc_id", "__hash", "text")
    dealt = own.union(ahead).repartitionByRange(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "__hash", "text").drop("__hash")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last quarter of the code points, rounded down, replaced by the first as
    many of the next document by doc_id (all of a shorter one); the last document is followed by the
    first. Its fingerprint comes by deleting the paragraphs that go and inserting those that come.
    Columns: ``doc_id``, ``n_chars``, ``edited_sha256``, ``vector``, ``edited_vector`` (binary),
    ``near_edited``, ``near_next``.

    Null texts are empty, with the fingerprint of no paragraphs. A single document is its own next.
    Rows that repeat a doc_id follow each other in the order of a hash of their texts; a null id comes first.
    An empty table gives no rows; other columns are ignored.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        before = None
        for batch in batches:
            out: dict[str, list] = {
                k: [] for k in ("doc_id", "n_chars", "edited_sha256", "vector", "edited_vector", "near_edited", "near_next")
            }
            for bucket, ahead, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                units = paragraphs(text.encode("utf-8", "surrogateescape"))
                now = (bucket, ahead, doc_id, text, units, vector(units))
                if before is not None and before[0] == bucket and not before[1]:
                    _, _, own_id, own, own_units, v = before
                    quarter = len(own) // 4
                    edited = (own[: len(own) - quarter] + text[:quarter]).encode("utf-8", "surrogateescape")
                    new_units = paragraphs(edited)
                    k, most = 0, min(len(new_units), len(own_units))
                    while k < most and new_units[k] == own_units[k]:
                        k += 1
                    changed = insert(delete(v, vector(own_units[k:])), vector(new_units[k:]))
                    row = (
                        own_id, len(own), hashlib.sha256(edited).hexdigest(), v.tobytes(), changed.tobytes(),
                        likeness(v, changed), likeness(v, now[5]),
                    )
                    for c, x in zip(out, row):
                        out[c].append(x)
                before = now
            yield out

    rows = _with_next(docs)
    ddl = "doc_id bigint, n_chars bigint, edited_sha256 string, vector binary, edited_vector binary, near_edited double, near_next double"
    return map_columns(rows, [F.col(c) for c in ("bucket", "ahead", "doc_id", "text")], ddl, body)
