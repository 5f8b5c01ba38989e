"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of words: its documents in a shuffled order that depends on their ids
alone, cut into blocks of equally many words. The mix is a sequence of as many slots as the targets
hold blocks. Slot i belongs to the source under whose share of the cumulative slots the point
frac((i + 1) * phi) of the golden-ratio sequence falls, so any stretch of the mix holds the sources
near their weights. The r-th slot that a source wins takes block r of its stream, which starts again
at its end; what a document gives is the sum of the blocks so won. A source wins its share of the
slots but for a few, so the words taken come near the target, and never more than MOST_EPOCHS times
the source: later slots of it stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import WORD, cut_lineage, map_columns, small_side, text_bytes

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its own words.
MOST_EPOCHS = 3
#: 2**64 / phi, odd: the step of the golden-ratio sequence in 64-bit arithmetic.
GOLDEN = 11400714819323198485
#: Slots are ranked within stretches of so many.
STRETCH = 65_536
#: Words of a block at most, blocks of a source at least (as far as it has words), and slots of a mix at most, some.
BLOCK, LEAST_BLOCKS, MOST_SLOTS = 4096, 128, 1 << 31
#: A table of sources of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
#: A table of row and slot (16 bytes) of at most so many rows is broadcast to the texts.
BROADCAST_PARTS = 500_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MOST_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` and ``take`` (the target in whole words) per source.

    The targets share all words by weight, none above ``cap`` times its source; what is cut off is
    reshared by weight. That is a level: with sources ordered by cap over weight, a source is capped
    as long as the level that the rest could have, sharing what the capped ones leave, exceeds its
    own. The windows here run over sources, of which a corpus has few, not over documents.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("at", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn(
        "w", weight.cast("bigint")
    )
    order = W.orderBy(F.col("source_size") / F.col("w"), "at").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    levels = ranked.select(
        "*",
        (
            (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(order), F.lit(0)))
            / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(order), F.lit(0)))
        ).alias("level"),
    )
    open_level = F.when(F.col("level") * F.col("w") <= F.col("source_size") * cap, F.col("level"))
    return (
        levels.withColumn("level", F.max(open_level).over(everything))
        .withColumn("target", F.least((F.col("source_size") * cap).cast("double"), F.col("level") * F.col("w")))
        .select("source", "at", "source_size", "target", F.round("target").cast("bigint").alias("take"))
    )


def planned(share: DataFrame, block: int = BLOCK) -> DataFrame:
    """``share`` (see targets) with ``block`` (words of one), ``per_epoch`` (blocks of the stream), ``slots`` (blocks of
    the target) and ``low`` (slots of the sources before). The window runs over sources."""
    most = F.greatest(F.lit(block), F.ceil(F.sum("source_size").over(W.partitionBy()) / MOST_SLOTS))
    blocks = F.greatest(F.ceil(F.col("source_size") / most), F.least("source_size", F.lit(LEAST_BLOCKS)))
    words = F.when(F.col("source_size") > 0, F.ceil(F.col("source_size") / blocks)).otherwise(1).cast("bigint")
    out = share.withColumn("block", words).withColumn("per_epoch", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
    won = F.round(F.col("take") * F.col("per_epoch").cast("double") / F.greatest("source_size", F.lit(1))).cast("bigint")
    before = W.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    return out.withColumn("slots", won).withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0)))


def schedule(share: DataFrame) -> DataFrame:
    """``at`` (of a source), ``rank`` and ``slot`` of every slot of the mix, for sources as ``planned`` gives them.

    Point and source meet in ranges of the cumulative slots: a source is listed in each range it
    reaches, and a point takes the last one that starts at or before it.
    """
    spark = share.sparkSession
    total = share.agg(F.sum("slots")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "at int, rank bigint, slot bigint")
    width = -(-total // 65_536)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        many, low = np.uint64(total), np.uint64(0xFFFFFFFF)
        for batch in batches:
            for stretch in batch.column(0).to_pylist():
                slot = np.arange(stretch * STRETCH, min((stretch + 1) * STRETCH, total), dtype=np.uint64)
                point = (slot + np.uint64(1)) * np.uint64(GOLDEN)  # of 2**64; the next line is floor(point * total / 2**64)
                place = (point >> np.uint64(32)) * many + (((point & low) * many) >> np.uint64(32)) >> np.uint64(32)
                yield {"slot": slot.astype(np.int64), "place": place.astype(np.int64)}

    points = map_columns(spark.range((total - 1) // STRETCH + 1), [F.col("id")], "slot bigint, place bigint", body)
    ranges = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("low") + F.col("slots") - 1) / width))
    listed = share.where("slots > 0").select("at", "low", F.explode(ranges).alias("range"))
    listed = listed.select("range", F.greatest("low", F.col("range") * width).alias("place"), F.lit(None).cast("bigint").alias("slot"), "at")
    both = listed.unionByName(points.select(F.floor(F.col("place") / width).alias("range"), "place", "slot", F.lit(None).cast("int").alias("at")))
    by_place = W.partitionBy("range").orderBy("place", F.col("slot").asc_nulls_first())
    points = both.withColumn("at", F.last("at", ignorenulls=True).over(by_place)).where("slot IS NOT NULL")
    points = cut_lineage(points.select("at", "slot", F.floor(F.col("slot") / STRETCH).alias("stretch")))
    before = points.groupBy("at", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("at").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("at", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("at", "stretch").orderBy("slot"))
    return (
        points.withColumn("inside", inside)
        .join(before, ["at", "stretch"])
        .select("at", (F.col("before") + F.col("inside") - 1).alias("rank"), "slot")
    )


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0, key: tuple[str, ...] = ()) -> DataFrame:
    """The mix: a row per stretch of words of one document in one slot.

    Columns: ``doc_id``, ``row`` (tells rows with one doc_id apart), ``source``, ``size``,
    ``source_size``, ``target``, ``slot``, ``epoch``, ``first_word`` and ``words``. A document of
    which nothing is taken has one row, with nulls from ``slot`` on. Null texts have no words; a
    null source is a source, the last. Sources' streams are numbered in two levels (1/4096 of a
    source by hash, then documents), so a hot source is spread over that many keys. Repeated rows
    are documents of their own; an empty table gives an empty mix. Columns named in ``key`` are carried
    along, first.
    """
    words = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD)))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = cut_lineage(docs.select(*key, "doc_id", "source", words.cast("bigint").alias("size"), order.alias("order")))
    share = cut_lineage(planned(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), block))
    slots = cut_lineage(schedule(share))
    won = slots.groupBy("at").agg(F.count(F.lit(1)).alias("won"))
    share = small_side(cut_lineage(share.join(won, "at", "left").fillna(0, ["won"])), BROADCAST_ROWS)
    bucket = F.substring("order", 1, 3)
    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sized.groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("n"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("before"))
    )
    in_bucket = W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", *key)
    placed = (
        sized.withColumn("bucket", bucket)
        .withColumn("row", F.row_number().over(in_bucket))
        .withColumn("inside", F.coalesce(F.sum("size").over(in_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["bucket"] == offsets["b"])).withColumn(
        "start", F.col("before") + F.col("inside")
    )
    own = share.withColumnRenamed("source", "of")
    placed = placed.join(own, placed["source"].eqNullSafe(own["of"])).withColumn("end", F.col("start") + F.col("size"))
    last_epoch = F.least(F.floor((F.col("won") - 1) / F.col("per_epoch")), F.lit(MOST_EPOCHS - 1))
    epochs = F.when((F.col("size") > 0) & (F.col("won") > 0), F.sequence(F.lit(0).cast("bigint"), last_epoch))
    pieces = placed.select("*", F.explode_outer(epochs).alias("epoch"))
    first = F.floor(F.col("start") / F.col("block"))
    last = F.least(F.floor((F.col("end") - 1) / F.col("block")), F.col("won") - F.col("epoch") * F.col("per_epoch") - 1)
    pieces = (
        pieces.select("*", F.explode_outer(F.when(last >= first, F.sequence(first, last))).alias("nth"))
        .where("nth IS NOT NULL OR coalesce(epoch, 0) = 0")
        .withColumn("rank", F.col("epoch") * F.col("per_epoch") + F.col("nth"))
        .withColumn("from", F.greatest("start", F.col("nth") * F.col("block")))
        .withColumn("to", F.least("end", (F.col("nth") + 1) * F.col("block")))
    )
    joined = pieces.join(slots, ["at", "rank"], "left")
    taken = F.col("slot").isNotNull()
    return joined.select(
        *key,
        "doc_id",
        F.concat_ws(":", "order", "row").alias("row"),
        "source",
        "size",
        "source_size",
        "target",
        "slot",
        F.when(taken, F.col("epoch")).alias("epoch"),
        F.when(taken, F.col("from") - F.col("start")).alias("first_word"),
        F.when(taken, F.col("to") - F.col("from")).alias("words"),
    )


def taken_words(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``."""
    return (
        mix(docs, block, seed)
        .groupBy("source", "row", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum("words"), F.lit(0)).alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def _cut_words(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with only the words ``__first`` to ``__first + __words`` of each text, their white space kept."""
    import re

    word = re.compile(rb"[^\x20\x09-\x0D]+")
    fields = [docs.schema[c] for c in names]
    at = names.index("text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = len(names)
        for batch in batches:
            texts = []
            for text, first, words in zip(batch.column(at), batch.column(n), batch.column(n + 1)):
                raw, start, end = text.as_py().encode(), None, 0
                for k, m in enumerate(word.finditer(raw)):
                    if k == first.as_py():
                        start = m.start()
                    if k == first.as_py() + words.as_py() - 1:
                        end = m.end()
                        break
                texts.append(raw[start:end].decode())
            yield {c: texts if i == at else batch.column(i) for i, c in enumerate(names)}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_columns(docs, [*(F.col(f"`{c}`") for c in names), F.col("__first"), F.col("__words")], ddl, body)


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row per document and epoch, in the order of their first slots.

    Whole texts but for the one document per source at which its last block ends, which is cut there;
    where ``docs`` has n_chars it is set anew. Rows are told apart by a key of their own, written with
    them to the checkpoint folder, so rows that repeat a doc_id, or have none, are documents too.
    """
    keyed = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts = (
        mix(keyed, block, seed, key=("__row",))
        .where("words > 0")
        .groupBy("__row", "epoch", "size")
        .agg(F.min("slot").alias("__slot"), F.min("first_word").alias("__first"), F.sum("words").alias("__words"))
    )
    parts = cut_lineage(parts)
    columns = [*docs.columns, "__slot", "__row"]
    whole = small_side(parts.where("__words = size").select("__row", "__slot"), BROADCAST_PARTS)  # else the texts move twice
    rest = parts.where("__words < size").select("__row", "__slot", "__first", "__words")  # one row per source
    part = _cut_words(keyed.join(small_side(rest, BROADCAST_ROWS), "__row"), columns)
    out = keyed.join(whole, "__row").select(*columns).unionByName(part).sort("__slot", "__row").select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out
