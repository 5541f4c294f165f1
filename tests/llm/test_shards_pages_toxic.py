"""Sharding, page extraction and toxicity."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plenum.llm import html_extract, sharding, toxicity


def tree(rows, dims, leaves):
    """The same tree by sorting. rows: (id, size, dims...)."""
    spread = [max(1, max(r[2 + d] for r in rows) - min(r[2 + d] for r in rows)) for d in range(dims)]
    nodes = {0: rows}
    for _ in range(leaves.bit_length() - 1):
        after = {}
        for n, own in nodes.items():
            d = max(range(dims), key=lambda d: ((max(r[2 + d] for r in own) - min(r[2 + d] for r in own)) / spread[d], -d))
            half, at, cut = sum(r[1] for r in own) / 2, 0, None
            by = defaultdict(int)
            for r in own:
                by[(r[2 + d], r[0])] += r[1]
            for key in sorted(by):
                at += by[key]
                if at >= half:
                    cut = key
                    break
            for r in own:
                after.setdefault(2 * n + ((r[2 + d], r[0]) > cut), []).append(r)
        nodes = after
    return {r[0]: n for n, own in nodes.items() for r in own}


def test_tree_is_the_one_of_sorted_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKETS", 4)  # several passes
    rng = random.Random(2)
    rows = [(k * 3 - 50, rng.randint(1, 900), rng.choice((0, 0, 0, 5, 9)), rng.choice((1, 2)), rng.randint(1, 500)) for k in range(300)]
    df = spark.createDataFrame([(*r, r[0], 0) for r in rows], "doc_id long, size long, d_a long, d_b long, d_c long, doc_id_ long, text_crc32 long")
    got = {r["doc_id"]: r["leaf"] for r in sharding.kd_tree(df, 8, ["d_a", "d_b", "d_c"]).collect()}
    assert got == tree(rows, 3, 8)


def test_shards(docs, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    got = sharding.shard_to_target(docs, shards=8).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((k, len(raw(t)) + 1, zlib.crc32(raw(t))) for k, t, _, _ in odd_rows)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] <= 7
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_to_target(no_docs, shards=8).count() == 0
    assert [sharding.shards_for(n, 10) for n in (0, 10, 11, 40, 41)] == [1, 1, 2, 4, 8]


def test_shards_are_near_equal_though_one_value_holds_a_third(spark):
    rows = [(k, "x" * (50 + k % 90), "en", "hot" if k % 3 == 0 else f"s{k % 20}") for k in range(3000)]
    got = sharding.shard_to_target(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8).groupBy("shard").agg({"size": "sum"}).collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 140
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    leaves = sharding.shard_to_target(df, 20_000).groupBy("shard").agg({"size": "sum"}).collect()
    assert len(leaves) == 16 and max(r[1] for r in leaves) <= 20_000 + 140


@pytest.mark.parametrize("doc_id", [None, 9])
@pytest.mark.parametrize("texts", [2000, 1])
def test_shards_are_near_equal_without_ids_and_with_one_for_all(spark, doc_id, texts):
    """Rows that agree in all values and in the id are parted by their texts, and equal rows by their places."""
    rows = [(doc_id, f"{k % texts} " + "x" * 60, "en", "one") for k in range(2000)]
    got = sharding.shard_to_target(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=8).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 2000 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 4 * 65
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_values_are_ranked_in_ranges(spark, monkeypatch):
    values = spark.createDataFrame([(f"v{k * 7 % 997:04}",) for k in range(997)], "c string").repartition(3)
    want = {f"v{k:04}": k for k in range(997)}
    for most in (sharding.RANKED, 10):
        monkeypatch.setattr(sharding, "RANKED", most)
        assert {r["c"]: r["_rank"] for r in sharding.ranks(values, "c").collect()} == want


PAGE = """<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body class="home">
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li>{nav}</ul></nav><div class="cookie-notice">We use cookies</div><!-- c {n} --><div class="ad">Buy {n}</div>
{body}<aside><p>Related {n}</p></aside><form><input name="q"><button>Search</button></form><section id="comments"><p>Reader says {n}</p></section><footer>&copy; Site {n}</footer></body></html>"""


def page(n: int, article: bool = True) -> tuple[str, str]:
    inner = f"<h1>Title &amp; {n}</h1><p><b>Lead  of\n{n}.<br><p>More <i>w</i>ord{n} &lt;x&gt;&nbsp;end.</p><ul><li>one{n}</li><li>two{n}</li></ul>"
    tag = "article" if article else 'div class="content"'
    text = f"Title & {n} Lead of {n}. More word{n} <x> end. one{n} two{n}"
    return PAGE.format(n=n, nav="<li><a>x</a></li>" * (n % 4), body=f"<{tag}>{inner}</{tag.split()[0]}>"), text


@pytest.mark.parametrize("article", [True, False])
@pytest.mark.parametrize("count", [1, 2, 12])
def test_pages_of_one_host(article, count):
    pages = [page(n, article) for n in range(1, count + 1)]
    assert html_extract.extract_group([p[0] for p in pages]) == [p[1] for p in pages]


def test_template_nests_classes():
    t = html_extract.Template([html_extract.Page(page(n)[0]) for n in range(1, 13)])
    assert any("<nav>" in x for x in t.root) and any("Home" in w for own in t.texts.values() for w in own)
    lists = [(order, around, gap) for order, around, gap in t.nested if any(x.endswith("<li>li") for x in order)]
    assert lists and all(gap >= 0 for _, _, gap in lists)


def test_classes_nest_in_each_other():
    pages = ["<body><div>" + "".join(f"<ul><li>x{k}<b>y</b></li></ul><ul><li>z<b>w</b></li></ul>" for k in range(1 + n % 3)) + "</div></body>" for n in range(6)]
    pages = [p.replace("</div>", f"<i>{n}</i></div>") for n, p in enumerate(pages)]
    t = html_extract.Template([html_extract.Page(p) for p in pages])
    assert any(around >= 0 or gap > 0 for _, around, gap in t.nested)


def brute_classes(htmls):
    """Occurrence vectors of every token, one token and one page after another."""
    streams = []
    for h in htmls:
        own = []
        for item in html_extract.Page(h).items:
            if isinstance(item, str):
                own.append(item)
            else:
                words = "".join(t for t, _, _ in item[2]).split()
                own += [(item[0], w) for w in words] + [(item[0], " " + " ".join(words))]
        streams.append(own)
    tokens = {t for s in streams for t in s}
    by = defaultdict(set)
    for t in tokens:
        v = tuple(s.count(t) for s in streams)
        share = html_extract.TAG_SUPPORT if isinstance(t, str) else html_extract.TEXT_SUPPORT
        if sum(x > 0 for x in v) >= max(html_extract.LEAST_PAGES, share * len(htmls)):
            by[v].add(t)
    return by


@pytest.mark.parametrize("count", [3, 7, 20])
def test_classes_are_those_of_single_tokens(count):
    htmls = [page(n, n % 5 > 0)[0] for n in range(count)]
    assert html_extract.Template([html_extract.Page(h) for h in htmls]).classes == brute_classes(htmls)


def test_the_root_keeps_one_order():
    pages = [html_extract.Page(f"<body><p>{'<i>x</i><b>' if n % 2 else '<b><i>x</i>'}{n}</b></p><hr></body>") for n in range(4)]
    t = html_extract.Template(pages)
    for p in pages:
        at = {x: k for k, x in enumerate(p.items) if isinstance(x, str)}
        own = [at[x] for x in t.root if isinstance(x, str)]
        assert own == sorted(own)


@pytest.mark.parametrize("element", ["p", 'div class="x7"'])
def test_template_within_the_article_goes(element):
    """A notice without a telling name on every page of a host; its words also occur in the pages' own text."""
    end = element.split()[0]
    pages = [f"<body><article><p>Story {n} of the day and the word{n}.</p><{element}>Share the story of the day</{end}><p>End of the story {n}.</p></article></body>" for n in range(12)]
    assert html_extract.extract_group(pages) == [f"Story {n} of the day and the word{n}. End of the story {n}." for n in range(12)]
    assert "Share the story" in html_extract.extract_group(pages[:2])[0]  # too few pages for a template


@pytest.mark.parametrize("count", [1, 2, 3, 7, 70])
def test_shared_headings_stay_with_what_follows_them(count):
    """The same text however many pages a host has; a heading over links alone goes where the template has it."""
    pages = [f"<body><nav><a>Home</a></nav><article><h1>Head {n}</h1><p>{story(n, 0)}</p><h2>Background</h2><h3>Early days</h3><p>{story(n, 1)}</p><h2>Conclusion</h2><p>{story(n, 2)}</p></article><footer>Foot</footer></body>" for n in range(count)]
    assert html_extract.extract_group(pages) == [f"Head {n} {story(n, 0)} Background Early days {story(n, 1)} Conclusion {story(n, 2)}" for n in range(count)]
    if count > 2:
        linked = [p.replace("</article>", f'<h2>More to read</h2><div class="x9"><a href="/1">Next {n}</a></div></article>') for n, p in enumerate(pages)]
        assert html_extract.extract_group(linked) == html_extract.extract_group(pages)


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<p title="5" tall">Hello there</p>', "Hello there"),
        ('<p>A <a href="x>link</a> and <b class="y">bold</b> text</p>', "A link and bold text"),
        ("<p data-x=don't>It's here, don't go</p><p>End</p>", "It's here, don't go End"),
        ('<p title="a > b">kept</p> <a href="?q=">x</a> <a href="?q=" title="c=">y</a>', "kept x y"),
        ('<p><a href="x>They said "hi" to me</a> end</p>', 'They said "hi" to me end'),
        ("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>", "If x=1 then"),
        ('<p data-html="<b>no</b>">yes</p>', "yes"),
    ],
)
def test_broken_quotes_leave_neither_markup_nor_holes(inner, text):
    assert html_extract.extract_group([f"<body><nav>Menu</nav><article>{inner}</article></body>"]) == [text]


def story(n: int, k: int) -> str:
    rng = random.Random(n * 100 + k)
    return " ".join(rng.choice(("river", "stone", "cloud", "maple", "harbour", "signal", "winter", "copper", "meadow", "lantern")) + rng.choice(("", "s", "ed", str(n))) for _ in range(30))


def plain_page(n: int) -> tuple[str, str]:
    """Neutral names alone: what is beside the article is told by its place, its links and its repetition."""
    html = f"""<body><div class="c1"><div class="c2">Site of the town</div><ul class="c3"><li><a href="/">Start {n}</a></li><li><a href="/x">More</a></li></ul></div>
<div class="c4"><div class="c5"><h1>Head {n}</h1><p>{story(n, 0)}</p><div class="c6">Get our app today: it is free</div><h2>Part {n}</h2><ul><li>first {n}</li><li>second {n}</li></ul><p>{story(n, 1)}</p>
<div class="c7"><a href="/1">Next story {n}</a> <a href="/2">Other story {n}</a></div><div class="c8">Visitor {n} has read our free app today: it is good</div></div><div class="c9">Weather {n} degrees</div></div><div class="d1">All rights {n}</div></body>"""
    return html, f"Head {n} {story(n, 0)} Part {n} first {n} second {n} {story(n, 1)}"


def test_the_template_decides(monkeypatch):
    """Without telling names, and without an article element; switched off, other texts come out."""
    pages = [plain_page(n) for n in range(12)]
    got = html_extract.extract_group([p[0] for p in pages])
    assert got == [p[1] for p in pages]
    monkeypatch.setattr(html_extract, "LEAST_PAGES", 100)
    off = html_extract.extract_group([p[0] for p in pages])
    assert all(a != b for a, b in zip(got, off, strict=True)) and all(p[1].split()[5] in o for p, o in zip(pages, off, strict=True))


@pytest.mark.parametrize("count", [1, 2, 3, 12])
@pytest.mark.parametrize("body", ['<article><div class="side-effects">{}</div></article>', '<article><section id="share-prices">{}</section></article>', '<div class="header-story">{}</div>', '<form id="aspnet"><div>{}</div></form>', '<div class="banner"><div class="text">{}</div></div>'])
def test_names_do_not_empty_a_page(body, count):
    pages = [f"<body><nav><a>Home {n}</a></nav>" + body.format(f"<h1>Head {n}</h1><p>{story(n, 0)}</p><ul><li>one {n}</li></ul>") + f"<footer>Foot {n}</footer></body>" for n in range(count)]
    assert html_extract.extract_group(pages) == [f"Head {n} {story(n, 0)} one {n}" for n in range(count)]


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie_notice", "newsletter-signup", "comment-list", "social-share", "footer-links"])
def test_telling_names_within_an_article(name):
    pages = [f'<body><article><p>{story(n, 0)}</p><div class="{name}">Beside {n}</div></article></body>' for n in range(5)]
    assert html_extract.extract_group(pages) == [story(n, 0) for n in range(5)]


def test_a_text_that_most_pages_of_a_host_have_is_kept_where_nothing_else_is():
    pages = [f"<body><nav>{n}</nav><article><p>{story(7, 0)}</p></article></body>" for n in range(9)]
    assert html_extract.extract_group(pages) == [story(7, 0)] * 9


def test_copies_do_not_make_a_text_template():
    html, text = page(3, False)
    assert html_extract.extract_group([html] * 9 + [page(5, False)[0]]) == [text] * 9 + [page(5, False)[1]]


def test_pages_table(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGES", 4)  # the host is dealt into parts
    rows = [(n, f"http://h.org/{n}", page(n)[0], "mine") for n in range(1, 20)] + [(50, "http://o.org/", None, "a"), (51, None, "", "b"), (52, "no url", "plain words", "c"), (None, "http://h.org/1", page(1)[0], "d"), (53, "http://q.org", "<article><p>open", "e"), (1, "http://h.org/1", page(1)[0], "f")]
    rows += [(70, "http://h.org/70", page(70)[0], "g")] * 2500  # one row many times
    rows += [(60, "http://long.org", "<article>" + "<p>word</p>" * 30_000 + "</article>", "g")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    want = [(n, f"http://h.org/{n}", page(n)[1]) for n in [*range(1, 20), 1, *[70] * 2500]] + [(50, "http://o.org/", ""), (51, None, ""), (52, "no url", "plain words"), (None, "http://h.org/1", page(1)[1]), (53, "http://q.org", "open"), (60, "http://long.org", " ".join(["word"] * 30_000))]
    assert Counter(tuple(r) for r in got) == Counter((*w, len(w[2])) for w in want)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_pages_of_the_smallest_tables(spark, sf_dir):
    """Each holds its article in an element of that name, whatever the host's group."""
    import html as entities
    import re

    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(rows).collect()}
    for r in rows.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|i|a)( [^>]*)?>", "", re.sub(r"<!--.*?-->", "", body, flags=re.S)))
        assert got[r["page_id"]] == " ".join(entities.unescape(body).split())


def fitted(df, **options):
    return toxicity.fit(df.select("id", "text"), df.select("id", "label"), **options)


def labelled(n: int, seed: int = 0):
    rng = random.Random(seed)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "zu")]
    rows = []
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if label := int(rng.random() < 0.2):
            t[rng.randrange(len(t))] = rng.choice(("vileword", "grumpf" + rng.choice(words)))
        rows.append((k, " ".join(t), label))
    return rows


def test_held_out_rows_are_told(spark):
    rows = labelled(2000)
    model = fitted(spark.createDataFrame([r for r in rows if r[0] % 3], "id long, text string, label int"))
    df = spark.createDataFrame([r for r in rows if not r[0] % 3], "id long, text string, label int")
    out = df.select("label", toxicity.toxicity(df, model).alias("s")).collect()
    assert sum((r["s"] >= 0.7) == bool(r["label"]) for r in out) / len(out) > 0.98


def test_repeated_ids_and_rows_are_drawn_once(spark):
    """An id of many texts does not exceed the bound, equal rows count once, rows without an id have no label."""
    rows = [(k // 4, t, int(k // 4 % 5 == 0)) for k, (_, t, _) in enumerate(labelled(1200, 6))]
    rows = [(k, t + (" vileword" if label else ""), label) for k, t, label in rows]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows * 3] + [(None, "kara")] * 50, "id long, text string")
    labels = spark.createDataFrame([(k, label) for k, _, label in rows] + [(None, 1)], "id long, label int")
    full, bound = toxicity.fit(docs, labels), toxicity.fit(docs, labels, train_docs=300)
    assert full.rows == len({(k, t) for k, t, _ in rows})
    assert bound.rows == 300  # both labels have more
    assert all(m.score("kara vileword") > 0.7 > 0.3 > m.score("kara lose") for m in (full, bound))
    hot = spark.createDataFrame([(7, t) for _, t, _ in rows], "id long, text string")
    one = toxicity.fit(hot.unionByName(spark.createDataFrame([(8, "vileword kara")], "id long, text string")), spark.createDataFrame([(7, 0), (8, 1)], "id long, label int"), train_docs=200)
    assert one.rows == 101


def test_swapped_identities_have_near_scores(spark):
    """A group that occurs in toxic rows only does not make a row toxic."""
    rows = [(k, t + (" muslim" if label or k % 50 == 0 else " man" if k % 2 else ""), label) for k, t, label in labelled(1500, 4)]
    train = spark.createDataFrame(rows, "id long, text string, label int")
    fair, plain = fitted(train, counterfactual=50.0), fitted(train, counterfactual=0.0)
    gap = lambda m: abs(m.score("kara muslim") - m.score("kara christian"))
    assert gap(fair) < 0.05 and gap(fair) < gap(plain) / 3
    assert fair.score("kara vileword muslim") > 0.7


def test_neutral_mentions_are_not_toxic(spark):
    """False positives on held-out rows without a vile word that mention a group which toxic rows mention most."""
    rng = random.Random(6)
    # A third of the toxic rows have a vile word that no other row has: there the mention alone tells.
    odd = lambda t, k: t.replace("vileword", f"q{k}z").replace("grumpf", f"q{k}z") if k % 3 == 0 else t
    rows = [(k, odd(t, k) + (" muslim" if label or rng.random() < 0.02 else ""), label) for k, t, label in labelled(2000, 8)]
    train = spark.createDataFrame(rows, "id long, text string, label int")
    neutral = [t + " muslim" for _, t, label in labelled(600, 9) if not label]
    share = lambda m: sum(m.score(t) >= 0.7 for t in neutral) / len(neutral)
    fair, plain = fitted(train), fitted(train, counterfactual=0.0)
    assert share(fair) <= 0.01 < 0.2 < share(plain)
    assert fair.rows == plain.rows == len(rows) and fair.swapped_rows == sum("muslim" in t for _, t, _ in rows)


def test_gradient_is_that_of_the_loss():
    """Against finite differences, and the loss against a sum over rows."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(30)]
    swapped = [np.unique((r + 1) % 12) if k % 3 == 0 else r for k, r in enumerate(rows)]
    y = (rng.random(30) < 0.3).astype(float)
    without = [r[1:] if k % 5 == 0 else r for k, r in enumerate(rows)]
    f = toxicity.Objective(rows, [swapped, without], y, 12, 2.5)
    w, b = rng.normal(size=12), 0.3
    loss, g, gb = f(w, b)
    for k in range(12):
        step = np.eye(12)[k] * 1e-6
        assert (f(w + step, b)[0] - f(w - step, b)[0]) / 2e-6 == pytest.approx(g[k], abs=1e-6)
    assert (f(w, b + 1e-6)[0] - f(w, b - 1e-6)[0]) / 2e-6 == pytest.approx(gb, abs=1e-6)
    weight = [min(5.0, (30 - y.sum()) / y.sum()) if t else 1.0 for t in y]
    z = [b + w[r].sum() for r in rows]
    pairs = [*zip(rows, swapped, strict=True), *zip(rows, without, strict=True)]
    change = [w[r].sum() - w[s].sum() for r, s in pairs]
    moved = sum(not np.array_equal(r, s) for r, s in pairs)
    want = sum(a * (np.log1p(np.exp(x)) - t * x) for a, x, t in zip(weight, z, y, strict=True)) / sum(weight) + toxicity.SHRINK * (w**2).sum() + 2.5 * sum(c * c for c in change) / moved
    assert loss == pytest.approx(want)


def test_the_scale_of_scores():
    """The slope is that of the labels' shares; the limit lies where the labels part best."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=20_000)
    y = (rng.random(len(z)) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(float)
    a, b = toxicity.platt(z, y)
    assert a == pytest.approx(3, abs=0.15) and b == pytest.approx(-1, abs=0.1)
    assert toxicity.scale(-z, y) == (1.0, 0.0)
    cut = toxicity.parting(z, y)
    errors = lambda c: ((z >= c) != (y > 0)).sum()
    assert errors(cut) == min(errors(c) for c in np.linspace(-2, 2, 401).tolist() + [cut])
    a, b = toxicity.scale(np.array([-3.0, -2.5, -1.0, 0.5]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert 1 / (1 + np.exp(-(a * -1.75 + b))) == pytest.approx(toxicity.LIMIT)
    assert toxicity.parting(np.zeros(4), np.array([0.0, 1.0, 0.0, 1.0])) == 0.0


def test_a_score_of_the_limit_is_toxic_and_a_long_text_is_scored_whole(spark):
    model = toxicity.Model({"=vile": 3.0}, float(np.log(0.7 / 0.3)) - 3.0)
    df = spark.createDataFrame([(1, "vile", "a"), (2, "fine " * 300_000 + "vile", "b"), (3, "fine", "c")], "doc_id long, text string, score string")
    got = {r[0]: r[1] for r in df.select("doc_id", toxicity.toxicity(df, model)).collect()}
    assert got[1] == got[2] == pytest.approx(0.7) and got[3] < 0.2


def test_odd_rows_have_scores(spark, docs, odd_rows, no_docs):
    model = fitted(spark.createDataFrame(labelled(300), "id long, text string, label int"))
    out = docs.select("doc_id", toxicity.toxicity(docs, model).alias("s")).collect()
    assert len(out) == len(odd_rows) and all(0 <= r["s"] <= 1 for r in out)
    assert {r["s"] for r in out if r["doc_id"] in (100, 101, 102)} == {model.score(None)}
    assert no_docs.select(toxicity.toxicity(no_docs, model)).count() == 0
    train = lambda rows: spark.createDataFrame(rows, "id long, text string, label int")
    assert fitted(train([])).score("x") < 1e-6 and fitted(train([(1, "a", 0)])).score("x") < 1e-6 and fitted(train([(1, "a", 1), (2, "b", None)])).score("x") > 1 - 1e-6
