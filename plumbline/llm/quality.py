"""Quality rules whose cutoffs follow each language and source.

Signals of a document are filed in logarithmic bins (the DDSketch of Masson et al.): the counts of
bins are a quantile sketch with a bounded relative error that merges by addition, in any order,
with the same result. Every cutoff is a function of the quantiles of a sketch alone:

    cut = q90 + max(TAIL * (q99 - q90), BODY * (q90 - q50))

half way into the tail, or beyond the body where the tail is light. Sketches per language and source,
per language, and of everything are sums of the same counts. To a group's sketch come PRIOR documents
that lie as its language's do, at the percentiles of that sketch, and to the language's as many that
lie as everything does: small groups borrow much, large ones little.

The cutoffs are joined to the documents, which are then kept or rejected.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plumbline.llm.common import cut_lineage, map_columns, small_side, text_bytes

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Relative error of a quantile is at most this.
ACCURACY = 0.01
#: Documents that a sketch borrows from the wider one, a hundredth at each of its percentiles.
PRIOR = 300
#: How far into the tail, and how many times the body's upper half beyond it, a cutoff lies.
TAIL, BODY = 0.5, 2.0
#: signal: (numerator, its denominator). A document is rejected above its group's cutoff.
SIGNALS = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
}
#: A table of cutoffs of at most so many rows is broadcast.
BROADCAST_ROWS = 100_000
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
NAMES = [x.split()[0] for x in STATS.split(", ")]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    if n <= 20_000:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    else:  # the same in arrays: windows get numbers without collisions
        ids: dict[bytes, int] = {}
        number = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        pairs = np.unique(number[:-1] * len(ids) + number[1:], return_inverse=True)[1]
        _, inverse, counts = np.unique(pairs[:-1] * len(ids) + number[2:], return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in STATS, of one text in UTF-8."""
    words = text.split()
    n_bytes = sum(map(len, words))
    tails = int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()] if b"\n" in text else words and [text]
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), n_bytes - tails, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def with_stats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and the counts of STATS over whole texts (null: no words)."""
    fields = [docs.schema[c] for c in carry]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [STATS])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [text_stats(x.as_py()) for x in batch.column(len(carry))]
            columns = list(zip(*found)) if found else [[]] * len(NAMES)
            yield {c: batch.column(i) for i, c in enumerate(carry)} | dict(zip(NAMES, columns))

    read = [*(F.col(f"`{c}`") for c in carry), text_bytes().alias("__bytes")]
    return map_columns(docs, read, ddl, body)


def _signal(name: str) -> Column:
    over, under = SIGNALS[name]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(stats: DataFrame) -> DataFrame:
    """``lang``, ``source`` and one upper cutoff per signal, from sketches of all rows of ``stats``.

    A sketch has at most some 1,500 bins a group and signal, whatever the number of documents, and
    is summed before the shuffle, so a source with a third of all rows costs no more than another.
    """
    gamma = (1 + ACCURACY) / (1 - ACCURACY)
    signals = F.array(*[F.struct(F.lit(k).alias("signal"), _signal(k).alias("x")) for k in SIGNALS])
    bin_of = F.when(F.col("s.x") <= 1e-6, F.lit(-10_000)).otherwise(F.ceil(F.log(F.col("s.x")) / float(np.log(gamma))))
    bins = cut_lineage(
        stats.where("n_words > 0")
        .select("lang", "source", F.explode(signals).alias("s"))
        .groupBy("lang", "source", F.col("s.signal").alias("signal"), bin_of.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = W.partitionBy(*keys, "signal")
        return rows.select("*", F.sum("n").over(by.orderBy("bin")).alias("run"), F.sum("n").over(by).alias("total"))

    def lent(rows: DataFrame, keys: list[str]) -> DataFrame:
        """The PRIOR documents at the percentiles of each sketch: at most 100 bins."""
        percent = lambda run: F.floor(100 * run / F.col("total"))
        weight = PRIOR // 100 * (percent(F.col("run")) - percent(F.col("run") - F.col("n")))
        return ranked(rows, keys).select(*keys, "signal", "bin", weight.alias("n")).where("n > 0")

    def borrowed(rows: DataFrame, keys: list[str], wider: DataFrame, on: list[str]) -> DataFrame:
        """``rows`` with what every sketch borrows from its ``wider`` one."""
        wide = wider.select(*[F.col(c).alias(f"__{c}") for c in (*on, "signal")], "bin", "n")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on], F.col("signal") == F.col("__signal"))
        more = rows.select(*keys, "signal").distinct().join(wide, same).select(*keys, "signal", "bin", "n")
        return rows.unionByName(more).groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))

    merged = lambda keys: bins.groupBy(*keys, "signal", "bin").agg(F.sum("n").alias("n"))
    everything = lent(merged([]), [])
    lang = lent(borrowed(merged(["lang"]), ["lang"], everything, []), ["lang"])
    own = ranked(borrowed(bins, ["lang", "source"], lang, ["lang"]), ["lang", "source"])
    edge = F.when(F.col("bin") == -10_000, 0.0).otherwise(F.pow(F.lit(gamma), F.col("bin").cast("double")))
    at = lambda percent: F.min(F.when(100 * F.col("run") >= percent * F.col("total"), edge))
    found = own.groupBy("lang", "source", "signal").agg(at(50).alias("mid"), at(90).alias("high"), at(99).alias("far"))
    cut = F.col("high") + F.greatest(TAIL * (F.col("far") - F.col("high")), BODY * (F.col("high") - F.col("mid")))
    return found.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == k, cut)).alias(f"cut_{k}") for k in SIGNALS])


def judged(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """``stats`` with base_failed and kept. A document without a cutoff (no words) is judged by the base alone."""
    cuts = small_side(cut_lineage(cuts), BROADCAST_ROWS).select(
        F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[f"cut_{k}" for k in SIGNALS]
    )
    joined = stats.join(
        cuts, stats["lang"].eqNullSafe(cuts["__lang"]) & stats["source"].eqNullSafe(cuts["__source"]), "left"
    )
    above = reduce(
        lambda a, b: a | b, [F.coalesce(_signal(k) > F.col(f"cut_{k}"), F.lit(False)) for k in SIGNALS]
    )
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~above).drop(
        "__lang", "__source", *[f"cut_{k}" for k in SIGNALS]
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null texts have no words and fail the base. Null languages and sources form groups of their own.
    Repeated rows each get a row; an empty table gives none; further columns are ignored.
    """
    stats = cut_lineage(with_stats(docs, ["doc_id", "lang", "source"]))
    return judged(stats, cutoffs(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``, whatever their names."""
    extra = [c for c in docs.columns if c.lower() in (*NAMES, "base_failed", "kept", "__lang", "__source", "__bytes")]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}" if c in extra else c) for i, c in enumerate(docs.columns)])
    cuts = cutoffs(cut_lineage(with_stats(plain, ["lang", "source"])))
    kept = judged(with_stats(plain, plain.columns), cuts).where("kept")
    return kept.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns)])
