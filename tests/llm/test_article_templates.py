import html as entities
import random
import re
import tracemalloc
from collections import Counter

from linkloom.llm import html_text, warc


def _texts(spark, bodies):
    pages = spark.createDataFrame([(k, "https://t.example/", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_text.extract(pages).collect()}


def test_the_template_is_dropped_in_articles_too(spark):
    got = _texts(spark, [f"<article><p>Read by all</p><p>story {k} of {k * k}</p></article>" for k in range(6)] + ["<article><p>copy</p></article>"] * 4)
    assert [got[k] for k in range(6)] == [f"story {k} of {k * k}" for k in range(6)]
    assert {got[k] for k in range(6, 10)} == {"copy"}


def test_a_teaser_does_not_hide_the_main_text(spark):
    got = _texts(spark, [f"<div><p>Main text number {k} is a good deal longer than the card</p></div><article><p>Card {k}</p></article>" for k in range(5)])
    assert all(f"Main text number {k} is" in got[k] for k in range(5))


def test_a_second_article_on_few_pages_stays(spark):
    bodies = [f"<nav>menu</nav><article><p>story {k} of {k * k}</p></article>" + f"<article><p>second {k}</p></article>" * (k == 7) for k in range(40)]
    got = _texts(spark, bodies)
    assert got[7] == "story 7 of 49\n\nsecond 7" and got[8] == "story 8 of 64"


def test_headings_and_phrases_that_articles_repeat_stay(spark):
    recipe = lambda k: f"<nav>menu</nav><article><h2>Ingredients</h2><p>{k} eggs of {k * k}</p><h2>Method</h2><p>Stir <b>well</b> for {k} minutes</p>" + "<p>Serve warm, with bread.</p>" * (k % 2) + f"<p>Enjoy {k}</p></article><footer>foot</footer>"
    got = _texts(spark, [recipe(k) for k in range(12)])
    for k in range(12):
        assert got[k] == "\n\n".join(["Ingredients", f"{k} eggs of {k * k}", "Method", f"Stir well for {k} minutes", *["Serve warm, with bread."] * (k % 2), f"Enjoy {k}"])
    half = _texts(spark, [f"<article><p>story {k} of {k * k}</p>" + "<p>A last word that six share.</p>" * (k % 2) + "</article>" for k in range(12)])
    assert all(half[k].endswith("six share.") == bool(k % 2) for k in range(12))


def test_page_parts_inside_articles_go(spark):
    body = lambda k: f"<article><h1>Title {k}</h1><p>story {k} of {k * k}</p><div><a href=/x>Share on X</a> <a href=/y>Mail it</a></div><p>more of {k}</p><ul><li><a href=/1>One</a></li><li><a href=/2>Two</a></li></ul><p>end of {k}</p><p>Filed by the desk</p></article>"
    got = _texts(spark, [body(k) for k in range(8)])
    assert got[3] == "Title 3\n\nstory 3 of 9\n\nmore of 3\n\nend of 3"


def test_scripts_close_by_their_end_tags_only():
    assert html_text.main_text("<article><p>a<script src=https://x.example/>var q=1;</script>b</p><style/>p{}</style><p>c<svg/>d</p></article>") == "ab\n\ncd"
    assert html_text.main_text("<article>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</article>") == "let x=2 be"


def test_marks_inside_articles_must_be_clear(spark):
    body = "<article><section id='discussion-of-results'><p>kept</p></section><h2 id='related'>Related work</h2><div class='status notice'>also kept</div><div class='promotion-history'>too</div><div class='share'>gone</div><section class='comments'>gone</section></article>"
    assert html_text.main_text(body) == "kept\n\nRelated work\n\nalso kept\n\ntoo"


def test_deep_and_long_pages_take_linear_memory(spark):
    sizes = []
    for n in (20_000, 40_000):
        tracemalloc.start()
        assert html_text.main_text("<div>x" * n + "</section></p>" * n).count("x") == n
        sizes.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert sizes[1] < 2.5 * sizes[0]
    rows = [(k, "https://deep.example/", "<div>" * 5000 + f"<p>text {k}" + " word" * 100_000 * (k == 3), "h", "t", 1, 2) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, marks string, slot int, members int")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[0] == "text 0" and len(got[3]) == len("text 3") + 500_000


def _articles(pages):
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<br>", " ", x).replace("<b>", "")).split()) for x in re.split("</?(?:p|h1)>", article)]
        yield r.page_id, "\n\n".join(x for x in blocks if x)


def _stripped(html):
    """Without any mark of the article: no article element, classes, ids or roles."""
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", html).replace("<article>", "<div>").replace("</article>", "</div>")


def test_articles_come_out_of_slots_without_any_mark(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = dict(_articles(pages))
    rows = [(r.page_id, r.url, _stripped(r.html)) for r in pages.collect()]
    bare = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(bare).collect()}
    differ = [k for k, text in want.items() if got[k] != text]
    assert len(differ) <= 0.001 * len(want)
    # without a template the advert stays
    assert sum(html_text.main_text(html) != want[k] for k, _, html in rows) > 0.9 * len(want)


def test_articles_of_large_hosts_with_marks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == dict(_articles(pages))


def test_classes_equal_those_of_whole_vectors(spark):
    dice = random.Random(5)
    parts = ["<div class=a>Alpha</div>", "<div class=b><ul><h3>x</h3></ul></div>", "<section>Beta</section>", "<table><tr><td>g</td></tr></table>"]
    bodies = ["<html><body>Top" + "".join(dice.choice(parts) * dice.randrange(3) for _ in range(3)) + f"<p>own {k}</p>Bottom</body></html>" for k in range(40)]
    pages = spark.createDataFrame([(k, "https://v.example/", x) for k, x in enumerate(bodies)], "page_id long, url string, html string")
    (row,) = html_text.classes(pages).collect()
    vectors = {}
    for k, x in enumerate(bodies):
        for token, n in Counter(html_text.tokens(x)).items():
            vectors.setdefault(token, {})[k] = n
    often = {t: v for t, v in vectors.items() if len(v) >= 20}
    groups = {}
    for t, v in often.items():
        groups.setdefault(tuple(sorted(v.items())), set()).add(t)
    found = {}
    for m in row.members:
        found.setdefault(m["class"], set()).add(m["token"])
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))
    root = max((t for v, t in groups.items() if v == tuple((k, 1) for k in range(40))), key=len)
    assert found[row.root] == root
    counts = {t: [vectors[t].get(k, 0) for k in range(40)] for t in often}
    steady = {t for t, c in counts.items() if sum(n * n for n in c) / 40 - (sum(c) / 40) ** 2 <= html_text.STEADY and sum(n > 0 for n in c) >= 36}
    assert {m["token"] for m in row.members if m["steady"]} == steady


def plain_slot(rows):
    """The main slot by a walk over the tree of roles: go down while one child has most of the text, or half of it and the article."""
    of = {r["role"]: r for r in rows}
    if not of[0]["text"]:
        return None, False, []
    kids = lambda role: [r for r in rows if r["role"] and r["above"] == role]
    holds = lambda role: bool(of[role]["kind"] & 1) or any(holds(k["role"]) for k in kids(role))
    at = 0
    while not of[at]["kind"] & 1:
        best = None
        for k in kids(at):
            share = 0.5 if holds(k["role"]) else 0.75
            if k["text"] >= share * of[at]["text"] and (best is None or (k["text"], -k["role"]) > (best["text"], -best["role"])):
                best = k
        if best is None:
            break
        at = best["role"]
    if at and holds(at):
        return at, bool(of[at]["kind"] & 1), []
    beside = [k["role"] for k in kids(at) if k["kind"] & 2 and not holds(k["role"]) and k["pages"] >= 0.9 * of[0]["pages"] and (k["text"] < 0.1 * of[at]["text"] or k["link"] > k["text"])]
    return at, False, beside


def test_main_slot_equals_a_plain_walk():
    dice = random.Random(8)
    seen = set()
    for _ in range(3000):
        rows = [{"role": 0, "above": 0, "kind": 0, "text": dice.choice([0, 40, 1000, 1000, 1000]), "link": 0, "pages": 20}]
        for role in range(1, dice.randrange(1, 9)):
            above = dice.choice(rows)
            text = int(above["text"] * dice.choice([0, 0.05, 0.5, 0.5, 0.75, 0.9, 1]))
            rows.append({"role": role, "above": above["role"], "kind": dice.choice([0, 0, 2, 2, 1, 3]), "text": text, "link": dice.choice([0, 5, 2000]), "pages": dice.choice([1, 18, 20])})
        dice.shuffle(rows)
        got, want = html_text.main_slot(rows), plain_slot(rows)
        assert (got[0], got[1], sorted(got[2])) == (want[0], want[1], sorted(want[2])), rows
        seen.add((got[0] is None, bool(got[0]), got[1], bool(got[2])))
    assert len(seen) >= 5


def test_slots_of_equal_mass_keep_both(spark):
    got = _texts(spark, [f"<div><p>left story {k:03d} is here</p></div><div><p>other story {k:03d} is here</p></div>" for k in range(9)])
    assert got[4] == "left story 004 is here\n\nother story 004 is here"


def test_columns_with_clashing_names(spark):
    rows = [(k, "https://c.example/", f"<nav>menu</nav><article><p>story {k} of {k * k}</p></article>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.selectExpr("*", *(f"'x' AS {c}" for c in ("host", "root", "members", "marks", "slot", "marked", "beside", "token", "first", "revisit", "digest")))
    assert sorted(map(tuple, html_text.extract(clash).collect())) == sorted(map(tuple, html_text.extract(pages).collect()))
    assert sorted(map(tuple, warc.archive_digests(clash).collect())) == sorted(map(tuple, warc.archive_digests(pages).collect()))
