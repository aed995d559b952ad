"""Language, quality and extraction: held-out accuracy, brute force and odd input."""

from __future__ import annotations

import html
import math
import random
import re

import numpy as np
import pytest

from tidemark.llm import extraction, language, quality


@pytest.fixture(scope="module")
def learned(documents):
    return language.learn(documents)


def test_language_on_held_out_rows(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = language.identify(documents).collect()
    assert len(rows) == len(truth)
    for r in rows:
        assert r["held_out"] == language.held_out(r["doc_id"]) and 0 <= r["score"] <= 1
    apart = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in apart) >= 0.97 * len(apart)


def test_language_reads_text_alone(documents, learned):
    from pyspark.sql import functions as F

    other = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("q"))
    one = {r["doc_id"]: r for r in language.identify(documents, learned).collect()}
    two = {r["doc_id"]: r for r in language.identify(other, learned).collect()}
    assert one == two


def test_language_mixture(documents, learned):
    texts = {}
    for r in documents.collect():
        if r["n_chars"] > 1500:
            texts.setdefault(r["lang"], r["text"])
    scorer = language.Scorer(learned)
    both = texts["en"][:1500] + " " + texts["de"][:1400]
    (found,) = language.predict_texts(scorer, [both])
    assert set(found[2].split(",")) >= {"en", "de"} and found[1] < 0.9


def test_language_on_odd_rows(odd, repeated, empty, learned):
    got = {r["doc_id"]: r for r in language.identify(odd, learned).collect()}
    assert len(got) == odd.count()
    for d in (1, 2, 3, 13):
        assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
    assert not got[None]["held_out"]
    assert language.identify(repeated, learned).count() == repeated.count()
    assert language.identify(empty).count() == 0
    nothing = language.identify(odd, language.learn(empty)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    kept = language.drop_unknown(odd, learned)
    assert kept.schema == odd.schema
    assert {r["doc_id"] for r in kept.collect()} == set(got) - {1, 2, 3, 13}


def brute_mixture(scorer, words):
    """Shares by EM and the set by penalised likelihood, one word at a time."""
    like = [scorer.likelihood[scorer.at[w]].astype(float) for w in words]
    names = scorer.model.languages
    share = [1 / len(names)] * len(names)
    for _ in range(language.ROUNDS):
        new = [0.0] * len(names)
        for row in like:
            part = [x * s for x, s in zip(row, share)]
            for k, x in enumerate(part):
                new[k] += x / sum(part) / len(words)
        share = new
    order = sorted(range(len(names)), key=lambda k: -share[k])
    best = None
    for n in range(1, len(names) + 1):
        own = {k: share[k] / sum(share[j] for j in order[:n]) for k in order[:n]}
        fit = sum(math.log(sum(own[k] * row[k] for k in own)) for row in like)
        value = fit - n * (language.SHARE_COST + 0.5 * math.log(len(words)))
        if best is None or value > best[0]:
            best = (value, [names[k] for k in order[:n]], own[order[0]])
    return best[1], best[2]


def test_language_against_brute_force(documents, learned):
    scorer = language.Scorer(learned)
    texts = [r["text"] for r in documents.collect() if 30 < r["n_chars"] < 3000][:60]
    texts += [a[: len(a) // 2] + " " + b[: len(b) // 2] for a, b in zip(texts[:20], texts[20:40])]
    texts = [t for t in texts if language.words_of(t)]
    for text, (name, score, names) in zip(texts, language.predict_texts(scorer, texts)):
        want, share = brute_mixture(scorer, language.words_of(text))
        assert (name, names.split(",")) == (want[0], want) and abs(score - share) < 1e-3


def test_ten_languages_in_one_text():
    """No bound on the languages that a text may mix."""
    rng = np.random.default_rng(4)
    alphabets = ["".join(chr(97 + (7 * k + j) % 26) for j in range(4)) for k in range(6)]
    alphabets += ["àáâã", "èéêë", "ìíîï", "òóôõ"]
    own = [["".join(rng.choice(list(a), 6)) for _ in range(300)] for a in alphabets]
    table = np.full((language.BUCKETS, 10), language.SMOOTH)
    for k, words in enumerate(own):
        cells, _ = language.grams([w.encode() for w in words])
        table[:, k] += np.bincount(cells, minlength=language.BUCKETS)
    model = language.Model([f"l{k}" for k in range(10)], np.log(table / table.sum(axis=0)))
    text = " ".join(w for k in range(10) for w in own[k][:60])
    ((_, _, names),) = language.predict_texts(language.Scorer(model), [text])
    assert set(names.split(",")) == set(model.languages)


def test_nothing_learned_keeps_texts_with_letters(odd):
    from pyspark.sql import functions as F

    unknown = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = language.drop_unknown(unknown)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in odd.collect()} - {1, 2, 3, 13}


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = (text or "").split("\n")
    dup = sum(
        1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i]
    )
    spots: dict = {}
    for i in range(len(words) - 4):
        spots.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n, rep = len(words), len(covered)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep,
        n < 10 or 100 * rep > 20 * n,
    )


def test_quality_counts_and_verdicts(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in quality.judge(documents, labels).collect()}
    for r in documents.collect():
        got = rows[r["doc_id"]]
        assert tuple(got)[1:7] == brute_base(r["text"])
        assert got["kept"] == (not got["base_failed"] and got["probability"] >= quality.THRESHOLD)
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(rows[d]["kept"], q) for d, q in told.items() if not rows[d]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)


def test_quality_on_held_out_rows(spark):
    """Fitted on half of the labels, judged on the other half, at the next size."""
    sf = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.learn(documents, labels.where("doc_id % 2 = 0"))
    rows = {r["doc_id"]: r for r in quality.judge(documents, model=model).collect()}
    apart = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    judged = [(rows[d]["kept"], q) for d, q in apart.items() if not rows[d]["base_failed"]]
    assert sum(k == bool(q) for k, q in judged) >= 0.95 * len(judged)


def test_quality_on_odd_rows(spark, odd, repeated, empty):
    labels = spark.createDataFrame(
        [(7, 1, 0), (13, 0, 0), (None, 1, 1), (4, None, 0), (7, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    for df in (odd, repeated, empty):
        rows = quality.judge(df, labels).collect()
        assert len(rows) == df.count()
        text = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in rows:
            assert tuple(r)[1:7] == brute_base(text[r["doc_id"]])
    none = quality.judge(odd, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)


def brute_article(page):
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == brute_article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


MARKED = """<html><head><title>T</title><style>p{}</style></head><body>
<header>Site</header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use</div>
<aside>Side</aside><main><h1>Head &amp; more</h1><p>One <b>two</b>
  three&nbsp;&#8212; four<p>Five<ul><li>six<li>seven</ul><form><p>Mail</p></form>
<section id="comments"><p>First!</p></section></main><script>var a="<p>no</p>"</script>
<footer>Foot</footer>"""


def test_marks_and_malformed_pages(spark):
    rows = [
        (1, "http://a/1", MARKED), (2, None, None), (3, "", ""), (4, "http://a/2", "just text"),
        (5, "http://a/3", "<p>a<p>b</div></p>c<"), (6, "x", "<!-- c --><p>&lt;b&gt;&bogus; &#65;"),
        (6, "x", "<!-- c --><p>&lt;b&gt;&bogus; &#65;"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "1 as host", "2 as template", "3 as text"
    )
    got = {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    assert got[1] == "Head & more\nOne two three — four\nFive\nsix\nseven"
    assert (got[2], got[3], got[4]) == ("", "", "just text")
    assert got[5].startswith("a\nb\nc") and got[6] == "<b>&bogus; A"
    assert extraction.extract(df).count() == 7
    assert extraction.extract(df.limit(0)).count() == 0


def test_template_slots_of_a_host(spark):
    """Without any marks, what all pages of a host repeat goes and what varies stays."""
    rng = random.Random(1)

    def page(k):
        own = "".join(f"<p>{' '.join(rng.choices('abcdefgh', k=20))} {k}</p>" for _ in range(k % 4 + 1))
        return (
            f"<body><div class=top><h2>The daily page</h2></div><div class=x>{own}</div>"
            "<div class=low><div>Written by our staff in the city</div></div></body>"
        )

    rows = [(k, f"http://one.example/{k}", page(k)) for k in range(20)]
    rows += [(99, "http://two.example/", page(3))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df.repartition(5)).collect()}
    for k in range(20):
        assert "daily" not in got[k] and "staff" not in got[k]
        assert got[k].count("\n") == k % 4
    assert "The daily page" in got[99]  # one page alone tells nothing


def test_copies_do_not_turn_an_article_into_template(spark):
    same = "<body><nav><a>m</a></nav><article><p>The same article text</p></article></body>"
    df = spark.createDataFrame(
        [(k, f"http://h/{k}", same) for k in range(30)], "page_id long, url string, html string"
    )
    assert {r["text"] for r in extraction.extract(df).collect()} == {"The same article text"}


def test_alignment_is_the_largest():
    a = extraction.tree([extraction.read_page("<div><p>x</p><ul><li>1</ul><h1>t</h1></div>")])
    b = extraction.tree([extraction.read_page("<div><ul><li>2</ul><p>y</p><h1>u</h1></div>")])
    score, pairs = extraction.align(a["k"], b["k"])
    assert score == 4 and len(pairs) == 1  # div, ul, li, h1
    both = extraction.fold(a, b)
    assert both["n"] == 2 and np.all([k["n"] == 2 for k in both["k"]])


@pytest.mark.parametrize(
    "page",
    [
        '<body class="single with-sidebar"><p>MAIN</p></body>',
        '<body class="sidebar comments"><p>MAIN</p></body>',
        '<div class="content no-sidebar"><p>MAIN</p></div><div class="sidebar"><p>Side</p></div>',
        '<article class="post comments-open"><p>MAIN</p></article><p>Side</p>',
        '<main id="search-results-page" class="search"><p>MAIN</p></main>',
        '<div class="widget"><article><p>MAIN</p></article></div><div class="ad-slot">Side</div>',
        '<form id="aspnetForm"><div><p>MAIN</p></div></form><div class="cookie-notice">Side</div>',
        '<article><p>MAIN</p></article><div id="comments"><article>Side</article></div>',
        '<p>MAIN before</p><p><a href="x">MAIN</a></p>',
    ],
)
def test_names_are_weak_evidence(page):
    main = "The main text of the page in some words"
    got = extraction.main_text(extraction.read_page(page.replace("MAIN", main)), None)
    assert got.count(main) == page.count("MAIN") and "Side" not in got


def unmarked_pages(n):
    """Pages whose boilerplate is like the article's own blocks, one with another footer."""
    rng = random.Random(2)

    def words(k):
        return f"Article {k} " + " ".join(rng.choices("abcdefgh", k=30))

    return [
        (
            k,
            f"http://hot.example/{k}",
            f"<body><div>Top bar of the page</div><div><p>{words(k)}</p><p>Read our terms</p>"
            f"<p>{words(k)}</p></div><div>{'Another' if k == 7 else 'The'} foot</div></body>",
        )
        for k in range(n)
    ]


def test_boilerplate_among_like_siblings(spark):
    rows = unmarked_pages(40)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df.repartition(4)).collect()}
    for k, _, html_text in rows:
        own = re.findall(r"<p>(Article.*?)</p>", html_text)
        assert got[k] == "\n".join(own + ["Another foot"] * (k == 7))


def test_section_boilerplate_and_copied_articles(spark):
    """What only some pages have is constant over those; an often copied article is not."""
    rng = random.Random(3)

    def page(k):
        own = " ".join(rng.choices("abcdefgh", k=30))
        part = "<table><tr><td>Sports desk</td></tr></table>" if k % 4 == 0 else ""
        return f"<body>{part}<div><p>Own {k} {own}</p></div></body>"

    rows = [(k, f"http://a/{k}", page(k)) for k in range(40)]
    copy = "<body><div><p>The copied article</p></div></body>"
    rows += [(100 + k, f"http://b/{k}", copy if k > 9 else page(k)) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    for k in range(40):
        assert got[k].startswith(f"Own {k} ") and "\n" not in got[k]
    assert {got[100 + k] for k in range(10, 90)} == {"The copied article"}


def test_counts_of_a_node_stay_bounded(monkeypatch):
    monkeypatch.setattr(extraction, "COUNTED", 50)
    both = None
    for k in range(200):
        page = "<p>notice</p>" + "".join(f"<p>{k} {i}</p>" for i in range(12))
        own = extraction.page_template(extraction.read_page(page))
        both = extraction.fold(both, own) if both else own
    assert len(both["k"][0]["h"]) <= 50
    (text,) = extraction.closed(both)["k"][0]["h"].values()
    assert text[0] == 200


@pytest.mark.parametrize("items", [300, 600, 900])
def test_a_constant_list_of_any_length_is_template(spark, items):
    fixed = "".join(f"<li>Item {i} of the list</li>" for i in range(items))
    rows = [
        (k, f"http://list.example/{k}", f"<body><ul>{fixed}</ul><div><p>The article {k} has words "
         f"{k * 7919}</p><p>and more of {k}</p></div></body>")
        for k in range(12)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extraction.extract(df.repartition(3)).collect():
        k = r["page_id"]
        assert r["text"] == f"The article {k} has words {k * 7919}\nand more of {k}"


def test_forgotten_texts_are_rare(monkeypatch):
    """Whatever the order, a text that is on 0.8 of the pages stays, and bounds hold for the rest."""
    monkeypatch.setattr(extraction, "COUNTED", 30)
    rng, pages = random.Random(8), []
    for k in range(400):
        often = [f"<p>often {i}</p>" for i in range(60) if rng.random() < 0.9]
        pages.append("".join(often) + "".join(f"<p>{k} {i}</p>" for i in range(20)))
    for order in (pages, pages[::-1], rng.sample(pages, 400)):
        todo = [extraction.page_template(extraction.read_page(p)) for p in order]
        while len(todo) > 1:
            todo = [extraction.fold(*todo[k : k + 2]) if k + 1 < len(todo) else todo[k]
                    for k in range(0, len(todo), 2)]
        node = max(todo[0]["k"], key=lambda n: len(n["h"]))
        assert node.get("e", 0) <= extraction.LOST * node["n"] and len(node["h"]) < 1500
        assert len(extraction.closed(todo[0])["k"][todo[0]["k"].index(node)]["h"]) == 60


def test_templates_stay_bounded_where_names_differ():
    """Every page has class names of its own: the fold keeps those of few pages, not of all."""
    both, sizes = None, []
    for k in range(1200):
        body = "".join(f'<div class="x{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{i}">{k}</div>' for i in "abc")
        own = extraction.page_template(extraction.read_page(f"<body><p>same</p>{body}</body>"))
        both = extraction.fold(both, own) if both else own
        sizes.append(max(len(n["k"]) for n in [both, *both["k"]]))
    assert max(sizes) <= 2 * extraction.CHILDREN and sizes[-1] <= 1.2 * max(sizes[:600])


@pytest.mark.parametrize(
    "around",
    [
        "<header><p>Welcome back, visitor SIDE</p></header>MAIN",
        "<header><a href=x>Home</a> SIDE</header>MAIN",
        'MAIN<div class="site-footer">Page served in SIDE ms</div>',
        'MAIN<div class="post-comments"><p>SIDE says one</p><p>SIDE says two</p></div>',
        'MAIN<section id="reader-comments"><p>SIDE says</p></section>',
        'MAIN<ul class="user-comments"><li>SIDE</li></ul>',
    ],
)
def test_what_stands_around_the_main_text(spark, around):
    """Also where it varies from page to page, so that no template explains it."""
    rows = []
    for k in range(12):
        main = f"<div><h1>Title {k}</h1><p>{'The words of article ' * 9}{k}</p></div>"
        rows.append((k, f"http://a.example/{k}", f"<body>{around}</body>".replace("MAIN", main).replace("SIDE", f"s{k}")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extraction.extract(df).collect():
        k = r["page_id"]
        assert r["text"] == f"Title {k}\n{('The words of article ' * 9)}{k}"


def test_a_header_with_a_title_of_its_own_stays(spark):
    rows = [
        (k, f"http://a.example/{k}", f"<body><div><header><h1>Title {k}</h1></header><p>Words {k} of it</p></div></body>")
        for k in range(12)
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in extraction.extract(df).collect()} == {f"Title {k}\nWords {k} of it" for k in range(12)}


def test_varying_slots_come_before_article_tags(spark):
    """Teasers marked up as articles, and an article that goes on behind its element."""
    rng = random.Random(5)

    def words(k, n=40):
        return f"Text {k} " + " ".join(rng.choices("abcdefgh", k=n))

    rows, want = [], {}
    for k in range(20):
        main, rest = words(k), words(k, 10)
        teasers = "".join(f"<article><p>{words(k, 3)}</p></article>" for _ in range(3))
        one = f"<body><p>Site name</p><div><p>{main}</p></div><div>{teasers}</div></body>"
        two = f"<body><p>Site name</p><article><p>{main}</p></article><p>{rest}</p></body>"
        rows += [(k, f"http://one/{k}", one), (100 + k, f"http://two/{k}", two)]
        want |= {k: [main], 100 + k: [main, rest]}
    rows += [(200, "http://alone/", rows[0][2])]
    want[200] = want[0]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"].split("\n") for r in extraction.extract(df).collect()}
    for k, texts in want.items():
        assert set(texts) <= set(got[k]) and ("Site name" in got[k]) == (k == 200)


def test_rare_nodes_and_texts_at_the_share_are_judged_exactly(spark):
    """A section of few pages among names of their own, and texts just below and at the share."""
    rows, letters = [], [chr(97 + i) for i in range(26)]
    for k in range(300):
        own = f"Article {k} {k * 7919}"
        page = "<table><tr><td>Sports desk</td></tr></table>" if k in (7, 100, 160, 220, 280) else ""
        page += f"<p>{own}</p>" + ("<h4>Below</h4>" if k % 100 < 79 else f"<h4>Below {k}</h4>")
        page += "<h5>At</h5>" if k % 100 < 80 else f"<h5>At {k}</h5>"
        name = letters[k % 26] + letters[k // 26]
        page += "".join(f"<div class='x{name}{i}'>{k}</div>" for i in "abc")
        rows.append((k, f"http://wide.example/{k}", f"<body>{page}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in extraction.extract(df.coalesce(1)).collect()}
    for k in range(300):
        text = [f"Article {k} {k * 7919}", "Below" if k % 100 < 79 else f"Below {k}"]
        text += [] if k % 100 < 80 else [f"At {k}"]
        assert got[k] == "\n".join(text + [str(k)] * 3)
