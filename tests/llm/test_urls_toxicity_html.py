import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, crowded, docs, empty, prose
from veilmark.llm import html_main, toxicity, url_reputation
from veilmark.llm.queries import op8_host_reputation

PAGE = "page_id long, url string, html string"


def judged(spark, urls, labels=()):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGE)
    own = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    return {r.page_id: r for r in url_reputation.judged(pages, own).collect()}


def test_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x=/fr/", "https://a.example.com/en/1", "http://example.com/fr/#y", "http://a.b.net/es/", "x://net/fr/1", "http://net/en/", "no scheme", None, "http://notexample.com/en/", "http://com", "a://b://c/d", "http://x.org?u=http://example.com/en/", "", "http://ÀB.com/", "://example.com/en/"]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"), ("example.com", "/fr/", "com/", "allow"), ("a.b.net", "/es/", "net/es/", "block"), ("net", "/fr/1", "net/fr/", "block"),
        ("net", "/en/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"), ("com", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("x.org", "", None, "allow"), ("", "", None, "allow"),
        ("Àb.com", "/", "com/", "allow"), ("example.com", "/en/", "example.com/en/", "block"),
    ]


def test_reputation(spark):
    urls = [f"http://good.org/{i}" for i in range(40)] + [f"http://bad.org/{i}" for i in range(40)] + ["http://new.org/"]
    labels = [(i, int(i < 40), 0) for i in range(78)] + [(79, None, 0)]
    got = judged(spark, urls, labels)
    assert {got[i].verdict for i in range(40)} == {"allow"} and {got[i].verdict for i in range(40, 80)} == {"block"} and got[80].verdict == "allow"
    assert judged(spark, []) == {}
    assert judged(spark, ["http://a.org/"], [(0, None, None)])[0].verdict == "allow"


def test_levels(spark):
    sites = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.example.org": ("org", "example.org"), "me.github.io": ("github.io", "me.github.io"), "192.168.0.1": ("192.168.0.1",) * 2, "localhost": ("localhost",) * 2, "": ("", ""), "com.example": ("example", "com.example")}
    got = spark.createDataFrame([(s,) for s in sites], "host string").withColumns(url_reputation.levels("host")).collect()
    assert {r.host: (r.suffix, r.domain) for r in got} == sites
    odd = {"bad.co.uk:8080": "bad.co.uk", "me:pw@host.org:1": "host.org", "host.org..": "host.org", "[::1]:80": "[::1]", "a@b@c": "c", "": ""}
    got = spark.createDataFrame([(s,) for s in odd], "host string").withColumn("site", url_reputation.site_of(F.col("host"))).collect()
    assert {r.host: r.site for r in got} == odd


def test_a_bad_neighbour_under_a_public_suffix_does_not_count(spark):
    urls = [f"http://a{i % 6}.bad.co.uk/{i}" for i in range(60)] + [f"http://good{i % 9}.org/{i}" for i in range(300)] + ["http://clean.co.uk/", "http://fresh.ac.uk/", "http://new.bad.co.uk:8080/"]
    got = judged(spark, urls, [(i, int(i >= 60), 0) for i in range(360)])
    assert [got[i].verdict for i in (360, 361, 362)] == ["allow", "allow", "block"] and got[0].verdict == "block" and got[100].verdict == "allow"


def test_reputation_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    hosts = ["a.x.co.uk", "b.x.co.uk", "x.co.uk:80", "y.co.uk", "u@p.org", "p.org.", "q.p.org", "10.0.0.1", "", "me.github.io", "you.github.io", "m.de"]
    rows = [(i, None if i % 41 == 0 else f"http://{hosts[i % len(hosts)]}/p{i}" + "?q" * (i % 3), "", "extra") for i in range(300)]
    labels = [(i, int(rng.random() < (0.1 if i % len(hosts) < 4 else 0.8)), int(rng.random() < 0.1)) for i in range(0, 300, 2)] + [(5, None, 1)]
    crowded_pages = spark.createDataFrame(rows, PAGE + ", host string").withColumns({c: F.lit("own") for c in ("site", "path", "rule", "r", "verdict", "suffix", "n", "key")})
    crowded_pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(url_reputation.ORACLE)
    cols = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r[c] for c in cols)) for r in op8_host_reputation(spark, str(tmp_path)).collect()) == want
    assert len({w.split("'")[-2] for w in want}) == 2


def labelled():
    """An insult alone is no sign, nor a group alone; both together are."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1200):
        insult, group = rng.random(2) < 0.5
        words = prose(5000 + i, 20).split() + ["grubling"] * bool(insult) + ["northfolk"] * bool(group)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(insult and group)))
    return rows, labels


def test_machine_learns_pairs_and_holds_out(spark, monkeypatch):
    rows, labels = labelled()
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs(spark, rows), own).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in got)
    right = sum(got[i].predicted == t for i, _, t in labels if i in held)
    assert right / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in labels]
    other = spark.createDataFrame(turned, "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows), other).collect()} == {k: r.score for k, r in got.items()}


def test_machine_learns_what_no_single_term_shows(spark):
    """One of two words is a sign, both or none are not: no term's share differs between the classes, and a
    model that adds terms up cannot tell them apart."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join([prose(9000 + i, 20)] + ["grubling"] * bool(a) + ["northfolk"] * bool(b)), "en", "s", 0))
        labels.append((i, 1, int(a != b)))
    own = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.trained(docs(spark, rows), own)
    held = [(t, y) for (i, t, *_), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = lambda m: sum((m.score(t) >= 0.5) == y for t, y in held) / len(held)
    assert right(model) > 0.95
    model.factors = np.zeros_like(model.factors)
    assert right(model) < 0.6


def test_rows_of_one_id_do_not_crowd_the_sample(spark):
    own = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    hot = docs(spark, [(1, prose(i, 9), "en", "s", 0) for i in range(50)] + [(2, "calm", "en", "s", 0)])
    assert toxicity.toxicity(hot, own).count() == 51


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, 1, None), (1, 1, 1), (1, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(empty(spark), odd).count() == 0
    for labels in (none, odd):
        got = toxicity.toxicity(crowded(docs(spark)), labels).collect()
        assert len(got) == len(awkward()) and all(r.score is not None for r in got)
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs(spark), none).collect())
    model = toxicity.fit([np.array([1, 2], np.int32)], [2], np.array([True]))
    kept = toxicity.scored(crowded(docs(spark)), model)
    assert kept.count() == len(awkward()) and kept.schema["score"].dataType.simpleString() == "double"


P = "A long enough paragraph, with commas, and words that go on for a while so that it scores. "


def test_main_text():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>if (a < b) {{ x("<p>no</p>") }}</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies, really, a lot of them, everywhere.</div>
    <div id=main><article><h1>Title</h1><!-- <p>no --><p>{P}<p>Fish &amp; chips&nbsp;&#x2014; <b>bo</b>ld<br>next &lt;tag&gt; {P}</p><ul><li>one<li>two</ul><div class="ad banner">Buy now</div><form>Subscribe <input></form>
    <section class="comments"><p>{P} said a reader</p></section><p>short</p></article></div><aside><p>{P}</p></aside><footer>Foot, foot, and more of the foot of the page</footer></body></html>"""
    want = f"Title {P}Fish & chips — bold next <tag> {P}one two short"
    assert html_main.main_text(page) == " ".join(want.split())


def test_containers_without_article():
    page = f"<body><div class=menu><a href=1>{P}</a></div><div><div id=content><p>{P}</p><p>{P}</p><p>x</p></div><p>{P} sibling</p></div><div><p>{'<a>link text, more</a> ' * 9}</p></div></body>"
    assert html_main.main_text(page) == " ".join(f"{P}{P}x {P} sibling".split())


def test_broken_pages():
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<html></html>") == ""
    assert html_main.main_text(f"<p>{P}") == P.strip()
    assert html_main.main_text("<article>a < b <p>x<script>never closed <p>y") == "a < b x"
    assert html_main.main_text("<article>a<!-- never closed") == "a" and html_main.main_text("<div " + "x" * 1000) == ""
    assert html_main.main_text("<article></p></div>ok</article>") == "ok" and html_main.main_text("just text") == "just text"
    assert len(html_main.main_text("<article>" + f"<p>{P}</p>" * 5000)) > 400_000
    assert html_main.main_text("<div>" * 3000 + P + "</div>" * 3000) == P.strip()


def test_extracted(spark):
    rows = [(1, "u", f"<article><p>{P}"), (1, "u", f"<article><p>{P}"), (None, None, None), (3, None, "")]
    got = html_main.extracted(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, len(P) - 1, len(P) - 1]
    assert html_main.extracted(spark.createDataFrame([], PAGE)).count() == 0


def test_captions_and_fallbacks_of_the_article_stay():
    page = f"""<html><body><form><fieldset><label>Your name</label></fieldset></form><article><p>{P}</p><figure><img src=a.png><figcaption>A heron, at dawn</figcaption></figure>
    <p>{P}</p><object data=a.svg>Rain by month</object><fieldset><legend>Note</legend><p>{P}</p></fieldset><p><label>Term</label> explained</p><video src=b>A film of it</video></article></body></html>"""
    want = f"{P}A heron, at dawn {P}Rain by month Note {P}Term explained A film of it"
    assert html_main.main_text(page) == " ".join(want.split())


def test_names_weigh_and_do_not_decide():
    flat = lambda *x: " ".join(" ".join(x).split())
    body = f"<p>{P}</p><p>{P}</p>"
    assert html_main.main_text(f'<body><div class="layout has-sidebar">{body}</div></body>') == flat(P, P)
    assert html_main.main_text(f'<body><div class="sidebar-layout"><div class="comments">{body}</div><div class="sidebar">Links</div></div></body>') == flat(P, P)
    assert html_main.main_text(f"<body><header>HEADERTEXT and more of it, quite long indeed</header>{body}</body>") == flat(P, P)
    assert html_main.main_text(f"<article><header><h1>Title</h1></header>{body}</article>") == flat("Title", P, P)
    assert html_main.main_text(f'<article>{body}<p class="share-price">It closed at nine.</p><div class="share-buttons">Tell a friend</div></article>') == flat(P, P, "It closed at nine.")
    assert html_main.main_text(f'<article>{body}<div id="adSlot3">Buy</div><div class="comment-body"><p>{P}</p></div><div role="alert">Note</div><p hidden>x</p></article>') == flat(P, P)
    assert html_main.main_text(f"<main><h1>Head</h1><div><p>{P}</p>{body}</div><ul><li>one</ul></main>") == flat("Head", P, P, P, "one")


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + P + "</b>" * 20_000, "<b>" * 20_000 + "<hr>" * 20_000 + P, "<td><table>" + "<div>" * 5000 + "<tr>" * 20_000 + P, "<p>" + P + "<a '" * 45_000, "<i>" * 9000 + f"<p>{P}" * 900, "<script>" * 9000 + P, "<!--" * 9000, "&" * 90_000 + P],
    ids=["stray ends", "rules", "rows", "quotes", "paragraphs", "scripts", "comments", "references"],
)
def test_time_is_linear(page):
    start = time.process_time()
    html_main.main_text(page)
    assert time.process_time() - start < 2


def test_extracted_keeps_columns_apart(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{P}", "mine", 7)], PAGE + ", text string, n_chars long")
    assert html_main.extracted(pages).first()["text"] == P.strip()


class Plain(HTMLParser):
    """The text between article and footer as the library's parser sees it: the plain way to the same result."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.on = [], False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.on = (self.on or tag == "article") and tag != "footer"
        self.out += [" "] * (self.on and tag in ("p", "br", "h1", "h2", "li", "div"))

    def handle_endtag(self, tag):
        self.on = self.on and tag != "article"
        self.out += [" "] * (self.on and tag in ("p", "h1", "h2", "li", "div"))

    def handle_data(self, data):
        self.out += [data] * self.on


def test_table_pages_match_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: " ".join("".join(Plain(r.html or "").out).split()) for r in pages.collect()}
    got = {r.page_id: r["text"] for r in html_main.extracted(pages).collect()}
    same = [k for k in want if want[k] == got[k]]
    assert len(want) >= 50 and [k for k in want if k not in same] == []
