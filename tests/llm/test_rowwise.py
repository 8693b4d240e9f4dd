"""Operators that judge row by row: quality rules, classifier, HTML, URLs, packing, pieces."""

from __future__ import annotations

import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import compression_quality, cost_packing, html_content, piece_scan, quality_rules, url_rules
from stratalens.llm.queries import RULES, tokenizer

from .shapes import DOCS, awkward, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures_of_awkward_rows(spark):
    texts = [*awkward(), (20, "a b c\na b c\n\nd e f"), (21, "one # two <b> $5|x"), (22, prose(3, 80) + "\n" + prose(3, 80))]
    rows = quality_rules.measure(documents(spark, texts)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == Counter((i, *measures(t)) for i, t in texts)
    assert all(not r.kept for r in rows if r.base_failed)


def test_quality_keeps_prose_and_columns(spark):
    docs = documents(spark, [(1, prose(1, 200)), (2, "*** " * 100 + prose(2, 100)), (3, prose(1, 200).upper()), (4, None), (1, prose(1, 200))])
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1, 1]
    assert quality_rules.keep(docs.limit(0)).collect() == [] and quality_rules.measure(docs.limit(0)).collect() == []


def test_quality_thresholds_are_one_projection(spark):
    plan = quality_rules.measure(documents(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def labelled():
    good = [(i, prose(i, 60 + i)) for i in range(100)]
    bad = [(i, " ".join(w + "***" for w in prose(i, 60).split()) if i % 2 else (prose(i, 4) + " ") * 30) for i in range(100, 160)]
    return [*good, *bad], [(i, 1 if i < 100 else 0) for i in range(160)]


def test_classifier_on_held_out_rows(spark, labelled):
    texts, marks = labelled
    docs = documents(spark, texts)
    labels = spark.createDataFrame([*marks, *marks[:5], (None, 1), (9999, 0), (3, None), (4, 7)], "doc_id long, quality int")
    model = compression_quality.fit(docs, labels)
    rows = compression_quality.score(docs, model).collect()
    truth = dict(marks)
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept = compression_quality.accepted(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted}


def test_classifier_awkward_rows_and_no_labels(spark, labelled):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = compression_quality.fit(docs, none)
    assert [r.score for r in compression_quality.score(docs, model).collect()] == [0.5] * len(awkward())
    one = compression_quality.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (7, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.5 for r in compression_quality.score(docs, one).collect())
    texts, marks = labelled
    model = compression_quality.fit(documents(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in compression_quality.score(docs, model).collect()}
    assert scores[3] == scores[4] and len(compression_quality.score(docs, model).collect()) == len(awkward())
    assert compression_quality.score(docs.limit(0), model).collect() == []
    assert compression_quality.accepted(docs.limit(0), model).collect() == []


def test_logistic_fits_a_known_curve():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.01, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(300 * x + 1)))).astype(float)
    slope, intercept = compression_quality.logistic(x, y)
    assert abs(slope - 300) < 15 and abs(intercept - 1) < 0.1


PAGES = [
    ("<article><h1>A &amp; B</h1><p>One\n two&nbsp;three</p><p><b>bold<br>next<p>tail</article><footer>f</footer>", "A & B\nOne two three\nbold next\ntail"),
    ("<nav><a href=/>Home</a></nav><div class='side-bar sidebar'>s</div><main><p>Text of the page</p></main>", "Text of the page"),
    ("<body><div class='cookie-notice'>We use cookies</div><div id=content><h2>Head</h2><p>A long line of text that goes on and on.</p><p>End.</p><div class=comments>Reader</div></div></body>", "Head\nA long line of text that goes on and on.\nEnd."),
    ("<article><p>x</p><form>Name<input></form><script>var t='</p>';</script><style>p{}</style><section class='reader-comments'><article>hi</article></section></article>", "x"),
    ("plain <i>text</i> &#65;&copy", "plain text A©"),
    ("<p>broken <b>off &am", "broken off &am"),
    ("a<!-- <p>no</p> --> b<![CDATA[ c ]]>", None),
    ("", ""), (None, ""), ("<script>only</script>", ""), ("<div hidden>h</div><p>shown</p>", "shown"),
]


def test_html_pages(spark):
    rows = [(i, None if i == 0 else f"http://h/{i}", h, "x") for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0], (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_content.extract(pages).collect()
    assert len(got) == len(PAGES) + 2
    for r in got:
        if r.page_id is not None and PAGES[r.page_id][1] is not None:
            assert r.text == PAGES[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_content.extract(pages.limit(0)).collect() == []


ARTICLE = "<h1>Title of it</h1><p>A first paragraph with a good deal of text in it.</p><p>Second, which goes on for a while as well.</p>"
TEXT = "Title of it\nA first paragraph with a good deal of text in it.\nSecond, which goes on for a while as well."
FRAMES = [
    (f'<div class="page no-sidebar"><article>{ARTICLE}</article></div>', TEXT),
    (f'<div class="has-sidebar layout"><article>{ARTICLE}</article></div>', TEXT),
    (f'<div class="sidebar">aside</div><div class="content-sidebar"><p>x</p></div><div class="wrapper">{ARTICLE}</div>', TEXT),
    (f"<body><form id=aspnetForm><nav>menu</nav><article>{ARTICLE}</article></form>", TEXT),
    (f"<body><form id=aspnetForm><div>{ARTICLE}</div></form>", TEXT),
    (
        f'<article>{ARTICLE}<h2 id="related-work">Related work</h2><p class=notice-period>The notice period is long.</p>'
        "<section id=search-methods><h2 id=Social_history>Social history</h2><p>Methods are here.</p></section></article>",
        f"{TEXT}\nRelated work\nThe notice period is long.\nSocial history\nMethods are here.",
    ),
    (f"<main><h1>Title</h1><article>{ARTICLE}</article><p>And a last one.</p></main>", f"Title\n{TEXT}\nAnd a last one."),
    (f"<article>{ARTICLE}</article><article><p>Short.</p></article>", f"{TEXT}\nShort."),
    (
        f"<body><div><a href=/>Home</a> | <a href=/b>About</a></div><div id=a>{ARTICLE * 3}</div><p>A paragraph outside of the box.</p><div>&copy; 2024 Firm</div>",
        "\n".join([TEXT] * 3) + "\nA paragraph outside of the box.",
    ),
    (f"<article>{ARTICLE}<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>See <a href=4>the paper</a></p></article>", f"{TEXT}\nSee the paper"),
    (f"<article>{ARTICLE}<p>Before <span class=ad>BUY <span>now</span></span> after.</p></article>", f"{TEXT}\nBefore after."),
    (f"<article><h1>T</h1><p>Short.</p></article><section class=comments><article><p>{'very long comment ' * 30}</p></article></section>", "T\nShort."),
]


@pytest.mark.parametrize("case", range(len(FRAMES)))
def test_html_articles_in_frames(case):
    assert html_content.main_text(FRAMES[case][0]) == FRAMES[case][1]


@pytest.mark.parametrize("token, named", [("sidebar", 1), ("comment-list", 1), ("site-footer", 1), ("cookieNotice", 1), ("ad_2", 1), ("no-sidebar", 0), ("notice-period", 0), ("header", 0), ("Social_history", 0), ("add", 0)])
def test_html_names(token, named):
    assert html_content.furniture(token) == bool(named)


def test_html_upper_cluster_against_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 60):
        ratios = rng.choice([0.0, 1.0, 3.5, 40.0, 200.0], n)
        smooth = []
        for i in range(n):
            near = [(math.exp(-((i - j) ** 2) / 2), ratios[j]) for j in range(n) if abs(i - j) <= 3]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        cut = sum(smooth) / n
        for _ in range(50):
            high, low = [x for x in smooth if x >= cut], [x for x in smooth if x < cut]
            if not high or not low:
                break
            cut = (sum(high) / len(high) + sum(low) / len(low)) / 2
        far = [i for i in range(n) if abs(smooth[i] - cut) > 1e-6]
        got = html_content.upper_cluster(ratios)
        assert [bool(got[i]) for i in far] == [smooth[i] >= cut for i in far]


@pytest.mark.parametrize("piece", ["<a ", "</", "<div>x", "<ul><li>x", "<p>x ", "<!-- >", "<![CDATA[ >", "<div class=ad>x", "<span class=ad>x</p>", "<a x='\"> "])
def test_html_broken_pages_take_linear_time(piece):
    started = time.process_time()
    html_content.main_text(piece * 20_000)
    assert time.process_time() - started < 3


def test_html_very_long_page():
    body = "".join(f"<p>line {i} of the text</p>" for i in range(20_000))
    assert html_content.main_text(f"<nav>menu</nav><article>{body}</article>").count("\n") == 19_999


URLS = [
    ("http://a.com/x", "a.com", "/x", "com/", "allow"),
    ("https://M.Example.COM/en/1?q", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://notexample.com/en/x", "notexample.com", "/en/x", "com/", "allow"),
    ("http://x.net/es/a#f", "x.net", "/es/a", "net/es/", "block"),
    ("http://x.net/de/a", "x.net", "/de/a", None, "allow"),
    ("http://a.com?x=/en/", "a.com", "", None, "allow"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://net/fr/y://com/", "net", "/fr/y://com/", "net/fr/", "block"),
    ("http://" + "a." * 3000 + "net/fr/" + "p/" * 3000, "a." * 3000 + "net", "/fr/" + "p/" * 3000, "net/fr/", "block"),
]


def test_url_rules(spark):
    rows = [(i, u[0], "x", "x") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame([*rows, rows[0], (None, None, None, None)], "page_id long, url string, rule string, prefix string")
    rules = spark.createDataFrame([*RULES, RULES[0]], "host string, path string, verdict string")
    got = url_rules.judge(pages, rules).collect()
    assert len(got) == len(URLS) + 2
    assert all((r.host, r.path, r.rule, r.verdict) == URLS[r.page_id][1:] for r in got if r.page_id is not None)
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), rules).collect() == []


def test_url_equal_rules_and_prefixes_inside_a_segment(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/english")], "page_id long, url string")
    rules = spark.createDataFrame([("c", "/en", "allow"), ("b.c", "/eng", "block"), ("b.c", "/eng", "allow")], "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).first().asDict() == {"page_id": 1, "host": "a.b.c", "path": "/english", "rule": "b.c/eng", "verdict": "block"}


@pytest.fixture(scope="module")
def word_model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer("word_bpe_49k.json"))


TRICKY = ["It's 'S.'t don't İSTANBUL ΣΑΣ Straße.ẞ.", "a <|endoftext|> B <|STARTOFTEXT|>", "É.- x.-y ... a.'s 0 1,000.5 10", "e\u0301 E\u0301. \u0301a", "a\xa0b\u2003c\x85d"]


def test_words_encode_like_whole_texts(word_model, monkeypatch):
    monkeypatch.setattr(cost_packing, "WORDS_KEPT", 40)
    with open(tokenizer("word_bpe_49k.json"), "rb") as f:
        encoder = cost_packing.Encoder(f.read())
    texts = [t or "" for _, t in awkward()] + TRICKY
    for part in (texts[:8], texts[8:], texts):
        assert encoder.encode(part) == [np.array(word_model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]


def test_words_without_letters_are_learnt_alone(word_model):
    with open(tokenizer("word_bpe_49k.json"), "rb") as f:
        encoder = cost_packing.Encoder(f.read())
    for text in ("all letters known", "all 1850 letters", "½ ... 12", "known", ""):  # the second and third bring no new word of letters
        assert encoder.encode([text]) == [np.array(word_model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_packing_round_trip(spark, word_model):
    texts = [*awkward(), *[(100 + i, prose(i, 30 + 7 * i)) for i in range(40)], *[(200 + i, t) for i, t in enumerate(TRICKY)]]
    rows = cost_packing.pack(documents(spark, texts).repartition(3), tokenizer("word_bpe_49k.json")).collect()
    whole = {i: np.array([*word_model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts if i not in (None, 6)}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i, ids in whole.items():
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1]) and sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
    assert sum(r.length for r in by[6]) == 2 * by[6][0].doc_tokens
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        size = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert size == 2048 or size < 2048 and size & (size - 1) == 0
    assert cost_packing.pack(documents(spark, []), tokenizer("word_bpe_49k.json")).collect() == []


def test_assignment_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 5000, 400).tolist()
    rows = cost_packing.assign(lengths)
    cost = Counter()
    for _, _, n, s, _ in rows:
        cost[s] += n * n
    shared = [cost[s] for s in cost if len([r for r in rows if r[3] == s]) > 1]
    assert sum(r[2] for r in rows) == sum(lengths) and max(shared) < 3 * np.mean(shared)
    assert cost_packing.assign([]) == [] and cost_packing.capacities(2048 + 700, 2048) == [2048, 512, 128, 32, 16, 8, 4]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    texts = [*awkward(), (30, "aaaaaaaa" * 40 + "thethe" * 30), (31, "中文字符" * 60), (32, "  two  spaces \n\n " * 20), (33, "0e-0e-" * 80)]
    docs = documents(spark, texts)
    for chunk in (64, 16_384):
        rows = piece_scan.encode(docs, tokenizer("piece_bpe_32k.model"), chunk=chunk).collect()
        got = Counter((r.doc_id, r.n_chars, r.n_tokens, bytes(r.ids), r.decoded) for r in rows)
        want = Counter()
        for i, t in texts:
            ids = library.encode(t or "")
            want[i, len(t or ""), len(ids), np.array(ids, "<u4").tobytes(), t or ""] += 1
        assert got == want, chunk
    assert piece_scan.encode(docs.limit(0), tokenizer("piece_bpe_32k.model")).collect() == []


def test_transfer_matrices_are_exact_on_random_strings():
    import random

    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        model = piece_scan.Pieces(f.read())
    rng = random.Random(5)
    for _ in range(120):
        text = "".join(rng.choice(["a", "e", "in", "the", " ", "th", "ing", "\n", "é", "字", "0"]) for _ in range(rng.randint(1, 60)))
        size = rng.choice([3, 8, 17, 40])
        chunks = [piece_scan.Chunk(model, left, core, right, k == 0, k == n - 1) for k, n, left, core, right in piece_scan._chunks(text, size, model.longest)]
        steps = piece_scan.border_states([[(piece_scan._name(a, c.begin), piece_scan._name(b, c.stop)) for a, b in c.transfer()] for c in chunks])
        ids = [i for c, (a, b) in zip(chunks, steps) for i in c.pieces_ids(piece_scan._state(a, c.begin), piece_scan._state(b, c.stop))]
        assert ids == model.library.encode(text), (size, text)


def test_schema_of_fixture_clashes():
    assert "score" in DOCS and "row" in DOCS


def test_urls_that_share_a_prefix_only(spark, monkeypatch):
    """With prefixes of one character most rules meet most urls, and only whole digests decide."""
    monkeypatch.setattr(url_rules, "PREFIX_CHARS", 1)
    rules = spark.createDataFrame(RULES + [(f"h{i}.org", "/", "block") for i in range(40)], "host string, path string, verdict string")
    urls = [(i, f"https://h{i}.org/x") for i in range(60)] + [(100, "https://a.example.com/en/x"), (101, None), (102, "no url"), (103, "http://x.net/es/"), (104, "https://example.de/")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert all(got[i] == ((f"h{i}.org/", "block") if i < 40 else (None, "allow")) for i in range(60))
    assert got[100] == ("example.com/en/", "block") and got[103] == ("net/es/", "block") and got[101] == got[102] == got[104] == (None, "allow")


def test_products_of_pieces_in_a_tree(spark, sf):
    """Groups of two matrices, so that long documents take many levels; documents of other lengths beside them."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    words = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(6).collect()]
    texts = {1: " ".join(words)[:6_000], 2: "x" * 900, 3: " " * 400, 4: words[0][:10], 5: None, 6: words[1][:257], 7: "日本" * 300}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = piece_scan.encode(docs, tokenizer("piece_bpe_32k.model"), chunk=64, fan=2).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {k: library.encode(v or "") for k, v in texts.items()}
    a, b, c = [("s", "p"), ("s", "q")], [("p", "p"), ("q", "r"), ("z", "r")], [("r", "e"), ("r", "f")]
    assert piece_scan.product(piece_scan.product(a, b), c) == piece_scan.product(a, piece_scan.product(b, c)) == [("s", "e"), ("s", "f")]
