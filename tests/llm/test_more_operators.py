"""Suffix dedup, HTML extraction, URL filters and fingerprints against brute-force versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import htmltext, multisethash, suffixdedup, urlgraph
from plumbline.llm.queries import queries
from tests.llm.test_operators import DDL, make_rows


def brute_repeats(docs, length=100):
    """{doc: (bytes, spans)} by looking up every string among all earlier ones."""
    seen, out = set(), {}
    for doc, raw in sorted(docs.items(), key=lambda x: (x[0] is not None, x[0])):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone[:-1].view(np.int8), [0]))))
        out[doc] = (raw, [tuple(x) for x in edges.reshape(-1, 2).tolist()])
    return out


def check_repeats(spark, texts, partitions=4):
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(partitions)
    expected = brute_repeats({k: (v or "").encode() for k, v in texts.items()})
    got = suffixdedup.remove_repeats(frame).collect()
    assert len(got) == len(texts)
    for r in got:
        raw, spans = expected[r["doc_id"]]
        assert [(s["start"], s["end"]) for s in r["spans"]] == spans, r["doc_id"]
        kept = b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
        assert bytes(r["kept"]) == kept and r["n_bytes"] == len(raw)
    return sum(len(s) for _, s in expected.values())


def test_suffix_dedup(spark):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [prose(k) for k in (99, 100, 101, 130, 160, 400, 900)]
    texts = {}
    for i in range(120):
        texts[i * 3] = "".join(rng.choice([prose(rng.randint(0, 150)), rng.choice(shared), rng.choice(shared)[: rng.randint(60, 200)]]) for _ in range(5))
    for i in range(40):  # exact and near copies
        base = texts[rng.choice(list(texts))]
        at = rng.randint(0, max(len(base) - 1, 0))
        texts[1000 + i] = base if i % 2 else base[:at] + "#" + base[at + 1 :]
    texts |= {5000: "", 5001: None, 5002: "a" * 700, 5003: "ab" * 300, 5004: "x" + "a" * 260, 5005: "\x00" * 250 + shared[4] + "\x00" * 150, 5006: "y\x00" + shared[4] + "\x00" * 120, 5007: prose(99)}
    assert check_repeats(spark, texts) > 100


def test_suffix_dedup_across_the_joint_of_settled_ranges(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = {}
    for k in range(40):
        x, y, z = prose(170), prose(rng.randint(0, 98)), prose(170)
        texts |= {100 * k: prose(120) + x + y + prose(120), 100 * k + 1: prose(120) + y + z + prose(120)}
        texts |= {100 * k + 2: prose(120) + x + y + z + prose(120), 100 * k + 3: prose(120) + x[-50:] + y + z[:50] + prose(120)}
    assert check_repeats(spark, texts, 1) > 80


def test_suffix_dedup_of_long_texts_and_small_runs(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 1500)
    monkeypatch.setattr(suffixdedup, "RUN", 60)
    monkeypatch.setattr(suffixdedup, "BLOCK", 50)
    rng = random.Random(6)
    prose = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    passages = [prose(rng.randint(80, 600)) for _ in range(8)]
    texts = {i: "".join(prose(rng.randint(0, 300)) + rng.choice(passages) for _ in range(rng.randint(1, 14))) for i in range(40)}
    assert check_repeats(spark, texts, 3) > 40


#: The second differs from the first in three bytes, which a weak hash of the surroundings can miss.
ALIKE = (
    "fqvwtoo mtsomn mqduoqlidalgpzkvxozzeyxvdqzvhhb jcakpucujpbjufwtpffxnkdz fpukdfmbzouzyodiuqimiomiesvvvh "
    "vftegyrfwottkejehjmtwuphgcwgnotwxloybhsp qsxoexufnhdd yze lfuog sxz eyxej"
)


def test_suffix_dedup_of_texts_alike_but_for_three_bytes(spark):
    assert check_repeats(spark, {1: ALIKE, 2: ALIKE.replace("lidalgpzkvxozz", "livalglzkvvozz")}) == 1


def test_suffix_dedup_with_equal_hashes(spark, monkeypatch):
    """Hashes only bring grams together: with 16 of them the result is the same."""
    from plumbline.llm import common

    def weak(h):
        h &= np.uint64(15)
        h <<= np.uint64(32)
        return h

    def with_weak(df, read, out, body):
        def run(batches):
            from plumbline.llm import suffixdedup as there

            usual, there._mix = there._mix, weak
            try:
                yield from body(batches)
            finally:  # the worker may serve other tests
                there._mix = usual

        return common.map_columns(df, read, out, run)

    monkeypatch.setattr(suffixdedup, "map_columns", with_weak)
    monkeypatch.setattr(suffixdedup, "_mix", weak)
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    passages = [prose(rng.randint(90, 200)) for _ in range(4)]
    texts = {i: "".join(prose(rng.randint(0, 90)) + rng.choice(passages) for _ in range(rng.randint(1, 3))) for i in range(16)}
    assert check_repeats(spark, texts, 3) > 10


@pytest.mark.parametrize("dealt, crowd", [(3, 10**9), (10**9, 5), (3, 5)])
def test_suffix_dedup_deals_out_common_grams(spark, monkeypatch, dealt, crowd):
    from plumbline.llm import common

    def with_bounds(df, read, out, body):
        def run(batches):
            from plumbline.llm import suffixdedup as there

            usual, there.DEALT = there.DEALT, dealt
            try:
                yield from body(batches)
            finally:
                there.DEALT = usual

        return common.map_columns(df, read, out, run)

    monkeypatch.setattr(suffixdedup, "map_columns", with_bounds)
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = random.Random(13)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = prose(60), prose(140)
    texts = {i: prose(rng.randint(0, 150)) + rng.choice([short, short, long]) + prose(rng.randint(0, 150)) for i in range(90)}
    texts |= {200 + i: texts[rng.randrange(90)][rng.randint(0, 40) :] + prose(60) for i in range(40)}
    assert check_repeats(spark, texts, 3) > 30


def test_suffix_dedup_of_repeated_rows_and_no_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(300))
    rows = [(1, text), (1, text), (None, "short"), (2, text + "z")]
    got = suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in got) == [(0, 5), (1, 300), (1, 300), (2, 1)]
    assert suffixdedup.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("partitions", [1, 5])
def test_suffix_dedup_of_texts_without_or_with_one_id(spark, partitions):
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [prose(k) for k in (110, 150, 300)]
    texts = [prose(rng.randint(0, 200)) + rng.choice(shared) + prose(rng.randint(0, 200)) + rng.choice(shared) for _ in range(40)] + ["", prose(100)]
    texts += [texts[0] + "x", texts[1]]
    rows = [(rng.choice([None, None, 7, 7, k]), text) for k, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    got = suffixdedup.remove_repeats(frame).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    keys = {(r["doc_id"], r["text"]): r["key"] for r in suffixdedup._identified(frame).withColumn("doc_id", F.col("given")).withColumn("text", F.col("text").cast("string")).collect()}
    order = sorted(keys, key=lambda x: (x[0] is not None, x[0] or 0, keys[x]))
    expected = brute_repeats({k: text.encode() for k, (_, text) in enumerate(order)})
    held = lambda raw, spans: b"".join(raw[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]))
    want = Counter()
    for k, row in enumerate(order):
        want[row[0], len(row[1]), held(*expected[k])] += rows.count(row)
    assert Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in got) == want


@pytest.mark.parametrize("seed", range(5))
def test_loser_tree_merges_without_comparing_known_prefixes(seed):
    rng = random.Random(seed)
    runs, everything = [], []
    for k in range(rng.choice([2, 3, 7])):
        strings = sorted({bytes(rng.choice(b"ab") for _ in range(100 - 92)) * 1 + bytes([97]) * 92 if rng.random() < 0.5 else bytes(rng.choice(b"ab") for _ in range(100)) for _ in range(60)})
        everything += strings
        matrix = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 100)
        order, shared = suffixdedup.sorted_run(matrix[rng.sample(range(len(strings)), len(strings))])
        assert len(order) == len(strings)
        tails = matrix[np.arange(100) >= shared[:, None]]
        runs.append((shared.astype(np.uint8).tobytes(), tails.tobytes()))
    merged = list(suffixdedup.LoserTree(runs))
    everything.sort()
    assert len(merged) == len(everything)
    common = lambda a, b: next((i for i in range(100) if a[i] != b[i]), 100)
    assert [m[0] for m in merged[1:]] == [common(a, b) for a, b in zip(everything, everything[1:])]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Please accept them all.</div><div class="ad">Buy now. It is cheap.</div>
<article><h1>A   title &amp; more</h1><p><b>First <i>para</i>graph</b> with a &lt;tag&gt;.<br>Next line.<p>Second one,
unclosed, and it is rather long so that it looks like prose.<script>var x = "</p><p>no";</script></p><p>Short.</p>
<form><input value="q"><label>Your mail</label></form><aside>Read also: other things we wrote about.</aside></article>
<div id="sidebar"><p>Some long text of the sidebar, with a sentence. And another one here.</p></div>
<section class="comments"><p>I liked this article very much. Thank you for it.</p></section>
<footer>&copy; 2020 Site. All rights reserved.</footer><!-- <p>hidden</p> --></body></html>"""


def test_html_extraction(spark):
    expected = "A title & more First paragraph with a <tag>. Next line. Second one, unclosed, and it is rather long so that it looks like prose. Short."
    rows = [(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", None), (4, "u", "plain text without any markup.", None), (5, "u", "<p>a < b & c &#233;</p><", None), (1, "u", PAGE, "x")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    texts = [(r["page_id"], r["text"]) for r in got]
    assert sorted(texts) == [(1, expected), (1, expected), (2, ""), (3, ""), (4, "plain text without any markup."), (5, "a < b & c é <")]
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_without_article_elements():
    prose = "This is a sentence of the story, and it goes on for a while. Another one follows it here."
    page = f"<div class=menu><a href=/>x</a></div><div><div><p>{prose}</p></div><div><p>Yes.</p></div><div><p>{prose}</p></div></div><div class='footer'>Imprint</div>"
    assert htmltext.main_text(page) == f"{prose} Yes. {prose}"
    assert htmltext.main_text("<b>" * 5000 + "deep text here, it is a sentence.") != None  # noqa: E711
    htmltext.main_text("<p " + '"' * 20001)


@pytest.mark.parametrize(
    "before, after",
    [
        ("<body><article class='post hentry tag-python'>", "</article>"),
        ("<body class='single right-sidebar'><div>", "</div>"),
        ("<body><div class='post has-header-image with-comments'>", "</div>"),
        ("<body><main class='search'><div>", "</div></main>"),
        ("<body><div class='layout right-sidebar'><div>", "</div></div>"),
        ("<html class='no-sidebar'><body><div id=page-header>Name</div><div class='widget'><article>", "</article></div>"),
    ],
)
def test_html_names_on_layout_do_not_empty_the_page(before, after):
    prose = "This is a sentence of the story, and it goes on for a while. Another one follows it here."
    rest = "<div class='sidebar'><p>Some text of the side, with a sentence.</p></div><div class='site-footer'><p>All rights are reserved here.</p></div>"
    rest += "<ul class='tags'><li>python</li></ul><div style='display:none' class=content><p>Nobody sees this. It is hidden.</p></div>"
    assert htmltext.main_text(f"{before}<p>{prose}</p><p>{prose}</p><p>{prose}</p>{after}{rest}") == " ".join([prose] * 3)


def test_html_comments_beside_a_short_article():
    prose = "This is a sentence of the story. Another one follows it here."
    comments = "".join(f"<p>I liked number {k} very much. Thank you for it.</p>" for k in range(30))
    assert htmltext.main_text(f"<article><p>{prose}</p></article><section class='comments'>{comments}</section>") == prose


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 9)
        excess = [rng.randint(-30, 30) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 20)) for i in range(n) for j in range(i + 1, n) if j == i + 1 or rng.random() < 0.3]
        price = lambda label: sum(-e if x else 0 for x, e in zip(label, excess)) + sum(c for i, j, c in edges if label[i] != label[j])
        labels = [[bool(k >> i & 1) for i in range(n)] for k in range(1 << n)]
        best = min(map(price, labels))
        least = [all(x) for x in zip(*(label for label in labels if price(label) == best))]
        assert htmltext.cut(excess, edges) == least


def test_cut_is_not_the_classifier_alone():
    """Blocks that look like boilerplate by themselves go with the article around them, and the other way round."""
    weights = htmltext.fitted()
    prose = "This is a sentence of the story, and it goes on for a while. Another one follows it here."
    page = f"<div><div>{prose}</div><div>Ah</div><div>{prose}</div></div><div class=menu><ul><li><a href=/>x</a></li><li>Contact us here.</li><li><a href=/>y</a></li></ul></div>"
    blocks = htmltext.blocks_of(page)
    excess = htmltext.excesses(blocks, weights)
    alone, together = [e > 0 for e in excess], htmltext.cut(excess, htmltext.edges_of(blocks))
    assert together == [True, True, True, False, False, False] and alone != together
    assert all(abs(e) <= htmltext.MOST * htmltext.UNIT for e in excess)


def test_classifier_on_held_out_pages():
    right = total = 0
    for page, content in htmltext.made_pages(100, 99):
        blocks = htmltext.blocks_of(page)
        keep = htmltext.cut(htmltext.excesses(blocks, htmltext.fitted()), htmltext.edges_of(blocks))
        right += sum((b.text in content) == k for b, k in zip(blocks, keep))
        total += len(blocks)
    assert right / total > 0.97


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body class="has-sidebar"><article><p>Some text here.</p></article>', "Some text here."),
        ("<p title=don't>Hello there world.</p><p>It's fine.</p>", "Hello there world. It's fine."),
        ("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article>", "So x=2 holds for all of them."),
        ("<header>Name of the site</header><article><header><h1>Title of it</h1></header><p>Some text here.</p></article>", "Title of it Some text here."),
        ("<form><article><p>The whole page is a form, in one sentence. And another.</p></article></form>", "The whole page is a form, in one sentence. And another."),
        ("<article><p>Text before, in a sentence.</p><a href='x", "Text before, in a sentence."),
        ("<article><p title='a>b'>Text one, in a sentence.</p><!-- - -> --><p>x<!-->", "Text one, in a sentence. x"),
    ],
)
def test_odd_pages(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        '<a "' * 250_000, "<a b='>' " * 100_000, "<div>" * 100_000 + "</b>" * 100_000, "<b>" * 100_000 + "<div></div>" * 50_000,
        "<p><custom>" + "<b>" * 100_000 + "<div></div>" * 50_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<div class=ad>" * 100_000 + "x" + "</div>" * 100_000, "<!--" * 250_000, "<p>a" + "&" * 1_000_000,
        "<p>A block of text, long enough to be kept.</p>" * 15_000 + "<p><a href=x>l</a></p>" * 15_000,
        "".join(f"<div>{'A text that goes on. ' * (k % 3)}</div><li>x</li>" for k in range(20_000)),
    ],
)
def test_long_pages_take_linear_time(page):
    import time

    htmltext.fitted()
    start = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - start < 5  # a quadratic step would take minutes


def test_pages_of_the_tables_give_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries()["op3_html_extraction"](spark, "/root/testdata/sf0.001").collect()}
    import html

    for p in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", p["html"])[1]
        plain = re.sub(r"</?(?:b|i)>", "", article)
        assert got[p["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urlgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_filters(spark):
    link = lambda *hosts: "".join(f'<a class=x href="https://{h}/p">t</a>' for h in hosts)
    rows = [
        (1, "http://WWW.Example.com/en/x?q=1", None), (2, "https://www.example.com/en", ""), (3, "https://a.net/es/1", ""),
        (4, "https://spam.org/x", link("a.net", "b.net")), (5, "https://b.net/fr/2#y", link("farm.org")), (6, "https://farm.org/", link("spam.org")),
        (7, "https://good.org", link("friend.org")), (8, None, "<p>"), (9, "no scheme", ""), (10, "x://com", ""), (11, "https://notexample.com/en/1", ""),
        (12, "https://é.com/Ä?x", link("good.org")), (13, "https://friend.org/a://b/c", ""), (3, "https://a.net/es/1", ""), (14, "http://h.com?x/y", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", pytest.importorskip("pyspark.sql.functions").lit("clash"))
    got = urlgraph.judge_urls(pages).collect()
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        host, path, rule, verdict = brute_rule(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert verdict is None or r["verdict"] == verdict
    by = {r["page_id"]: r for r in got}
    assert by[4]["verdict"] == "block" and by[7]["verdict"] == "allow" and by[8]["verdict"] == "allow" and by[13]["trust"] > 0
    assert urlgraph.judge_urls(pages.limit(0)).count() == 0


def test_spread_is_personalised_pagerank(spark):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(a, b): rng.randint(1, 4) for a in hosts for b in hosts if a != b and rng.random() < 0.25}
    seeds = {"h0": 1.0, "h3": 0.5}
    frame = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint")
    got = {r["host"]: r["score"] for r in urlgraph.spread(frame, spark.createDataFrame(list(seeds.items()), "host string, s double"), "s", 0.85, 60, 1e-9).collect()}
    matrix = np.zeros((12, 12))
    for (a, b), n in edges.items():
        matrix[hosts.index(b), hosts.index(a)] = n / sum(m for (c, _), m in edges.items() if c == a)
    exact = np.linalg.solve(np.eye(12) - 0.85 * matrix, 0.15 * np.array([seeds.get(h, 0) for h in hosts]))
    assert all(got.get(h, 0.0) == pytest.approx(x, abs=1e-5) for h, x in zip(hosts, exact))


def test_multiset_hash():
    rng = random.Random(8)
    units = [f"Paragraph number {i} says {rng.random()}.".encode() for i in range(300)]
    whole = multisethash.vector(units)
    shuffled = units[:]
    rng.shuffle(shuffled)
    assert np.array_equal(whole, multisethash.vector(shuffled))
    assert np.array_equal(whole, multisethash.insert(multisethash.vector(units[:100]), multisethash.vector(units[100:])))
    assert np.array_equal(multisethash.delete(whole, multisethash.vector(units[200:])), multisethash.vector(units[:200]))
    assert not np.array_equal(whole, multisethash.vector(units + units[:1]))
    other = multisethash.vector([u + b"x" for u in units])
    half = multisethash.vector(units[:150] + [u + b"x" for u in units[150:]])
    assert multisethash.likeness(whole, other) < 0.25 and abs(multisethash.likeness(whole, half) - 0.5) < 0.15
    long = b" ".join(f"w{rng.randint(0, 999)}".encode() for _ in range(2000))
    assert b" ".join(multisethash.paragraphs(long)) == long and len(multisethash.paragraphs(long)) > 50


@pytest.mark.parametrize("partitions", [1, 6])
def test_edited_fingerprints(spark, partitions):
    rows = [r for r in make_rows(90) if r[0] != 5 or True][:-1]
    docs = spark.createDataFrame(rows, DDL).repartition(partitions)
    got = {r["doc_id"]: r for r in multisethash.edited_fingerprints(docs).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    vectors = {d: multisethash.vector(multisethash.paragraphs(t.encode())) for d, t in ordered}
    assert len(got) == len(rows)
    for k, (doc, text) in enumerate(ordered):
        after, following = ordered[(k + 1) % len(ordered)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes(r["vector"]) == vectors[doc].tobytes()
        assert bytes(r["edited_vector"]) == multisethash.vector(multisethash.paragraphs(edited.encode())).tobytes()
        assert r["near_next"] == multisethash.likeness(vectors[doc], vectors[after])
        assert 0 <= r["near_edited"] <= 1
    assert multisethash.edited_fingerprints(docs.where("doc_id = 3").select("doc_id", "text")).count() == 1
    one = multisethash.edited_fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert multisethash.edited_fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 6])
def test_edited_fingerprints_of_one_id_with_most_rows(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, None, 7, k, 2**60 + k % 3]), f"text {k} " * rng.randint(0, 30)) for k in range(400)] + [(None, None), (7, "same " * 9), (7, "same " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(partitions)
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    ordered = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    want = Counter()
    for k, r in enumerate(ordered):
        text, following = r["text"], ordered[(k + 1) % len(ordered)]["text"]
        quarter = len(text) // 4
        want[r["doc_id"], len(text), hashlib.sha256((text[: len(text) - quarter] + following[:quarter]).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in multisethash.edited_fingerprints(docs).collect())
    assert got == want
