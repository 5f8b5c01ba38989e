"""The pipeline's stages and run() against plain Python, on rows with repeated and missing ids and clashing columns."""

import base64
import os
import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from plumbline.llm import queries, secrets
from plumbline.sources.folders import shared_folder
from tests.llm.test_operators import RANKS, brute_kept, words_of

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, Epoch int, N_Words int, kept boolean"
STAGES = dict(corpus_pipeline.STAGES)


def make_rows(n=160, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([5, 60, 90, 200]))]
        if i % 9 == 0 and i:
            words = rows[rng.randrange(i)][1].split()
            words[rng.randrange(len(words))] = "changed"
        if i % 6 == 0:
            words[len(words) // 2 : len(words) // 2] = ["token", "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"']
        if i % 13 == 0:
            words = [w + "###" for w in words]
        text = " ".join(words).replace(" ", "\n", rng.randint(0, 3))
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), len(text), "s", i, -i, False))
    odd = [None, "", " \n ", "émoji 😀 " * 40, "x" * 2000]
    rows += [(1000 + k, t, "en", "a", None, None, None, None, None) for k, t in enumerate(odd)]
    rows += [rows[3]] * 2 + [(None, rows[7][1] + " more words", "en", "a", None, "z", 1, 1, True), (None, rows[7][1], "en", "b", None, "z", 1, 1, True)]
    rows += [(5, " ".join(rng.choice(vocabulary) for _ in range(120)), "en", "b", None, "other", 5, 5, None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(make_rows(), DDL).repartition(3).write.parquet(str(path / "full" / "documents.parquet"))
    spark.createDataFrame([], DDL).write.parquet(str(path / "empty" / "documents.parquet"))
    return path


def in_sql(name, frame):
    db = duckdb.connect()
    db.register("given", frame.toArrow())
    db.execute("CREATE VIEW documents AS SELECT * FROM given")
    found = db.execute(queries.oracle_sql()[name])
    return [dict(zip([d[0] for d in found.description], row)) for row in found.fetchall()]


def test_stages_equal_plain_python(spark, folder):
    docs = spark.read.parquet(str(folder / "full" / "documents.parquet")).persist()
    rows = Counter(map(tuple, docs.collect()))

    good = STAGES["quality rules"](spark, docs, "").persist()
    verdicts = Counter((r["doc_id"], r["kept"]) for r in in_sql("op9_quality_rules", docs))
    kept = Counter(map(tuple, good.collect()))
    assert good.columns == docs.columns and not kept - rows
    assert Counter(r[0] for r in kept.elements()) == Counter({d: n for (d, keep), n in verdicts.items() if keep})

    once = STAGES["SimHash near-dedup"](spark, good, "").persist()
    assert once.columns == docs.columns
    want, left = Counter(brute_kept(list(kept.elements()))), Counter(map(tuple, once.collect()))
    assert not want - left and sum((left - want).values()) <= 1  # candidates near the limit may be missed

    clean = STAGES["secret scans"](spark, once, "").persist()
    forest, out = secrets.grown(RANKS), Counter()
    for row in left.elements():
        text, last, parts = row[1], 0, []
        for start, end, kind, _, _, secret in secrets._scan(text, forest, 0.5, RANKS):
            if secret:
                parts += [text[last:start], f"[{kind}]"]
                last = end
        text = "".join([*parts, text[last:]])
        out[(row[0], text, *row[2:4], len(text), *row[5:])] += 1
    assert clean.columns == docs.columns and Counter(map(tuple, clean.collect())) == out
    assert any("[assigned]" in r[1] for r in out) and not any(re.search(r'token\s=\s"[0-9a-f]{40}', r[1]) for r in out)

    mixed = STAGES["mixing sources"](spark, clean, "").persist()
    taken, given = Counter(), Counter()
    for r in in_sql("op4_source_mixing", clean):
        taken[r["doc_id"]] += r["taken"]
    for r in mixed.collect():
        given[r["doc_id"]] += len(words_of(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert mixed.columns == docs.columns and given == Counter({d: n for d, n in taken.items() if n})

    coded = STAGES["byte-level BPE"](spark, mixed, "")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter()
    for r in mixed.collect():
        ids = encoding.encode_ordinary(r["text"])
        expected[r["doc_id"], r["source"], len(ids), b"".join(i.to_bytes(4, "little") for i in ids)] += 1
    assert Counter((r["doc_id"], r["source"], r["n_tokens"], bytes(r["ids"])) for r in coded.collect()) == expected


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(str(folder / "full" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
    spark.conf.unset(corpus_pipeline.BATCH_KEY)
    before = dict(spark.conf.getAll)
    got = corpus_pipeline.run(spark, str(folder / "full"))
    total = lambda frame: Counter((r["doc_id"], r["source"], r["n_tokens"]) for r in frame.collect())
    mine, want = total(got), total(docs)
    assert mine == want and mine
    assert dict(spark.conf.getAll) == before  # nothing is left set
    place = shared_folder(spark).removeprefix("file:")
    left = [sorted(os.listdir(f"{place}/{x}")) for x in os.listdir(place) if x.startswith("pipeline-")]
    assert left and all(x == [str(len(corpus_pipeline.STAGES) - 1)] for x in left)
    assert corpus_pipeline.run(spark, str(folder / "empty")).count() == 0


def test_every_stage_takes_an_empty_table(spark, folder):
    empty = spark.read.parquet(str(folder / "empty" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").columns == empty.columns and stage(spark, empty, "").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0
