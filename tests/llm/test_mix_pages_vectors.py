"""Mixing, page extraction and neighbours against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, difference, duck_rows, spark_rows
from pyspark.sql import functions as F

from harvestlens.llm import html_extract, mixing, neighbours, queries


def brute_targets(sizes):
    """Shares by weight, what is above three times a source's size handed on until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not above:
            return target | {s: rest * weight[s] / total for s in free}
        for s in above:
            target[s] = 3.0 * sizes[s]
        rest -= sum(target[s] for s in above)
        free -= above
    return target


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, None: 50, "ö": 7, "z": 400, "é": 3, "B": 900}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(docs, clashing, corpus):
    rows = [*corpus, (500, "a b c", None, None), (None, "a b", None, "a"), (501, "x y z", None, "c"), (501, "x y z", None, "c")]
    table = clashing(docs(rows))
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size
    expected = brute_targets({s: sum(r.size for r in own) for s, own in by.items()})
    for source, own in by.items():
        assert own[0].target == pytest.approx(expected[source])
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
    again = mixing.mix(table.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(map(str, got)) != sorted(map(str, mixing.mix(table, seed=1).collect()))
    taken = mixing.take(table)
    assert taken.columns == table.columns and taken.count() == sum(r.copies for r in got)


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.take(docs([])).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(docs([(1, None), (2, " ")])).collect()] == [(0, 0.0)] * 2


def test_mix_stays_in_the_jvm(spark, docs, corpus):
    plan = mixing.mix(docs(corpus))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    folder = "/root/testdata/sf0.001"
    if not __import__("pathlib").Path(folder).exists():
        pytest.skip("no tables")
    assert difference(spark_rows(queries.QUERIES[name](spark, folder)), duck_rows(connect(folder), queries.ORACLES[name])) is None


def page(i, body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head>"
            f"<body class='has-sidebar'><div id=top>My site</div><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            f"<div class=wrap><div class='post'>{body}</div>{extra}<div class='comments'><p>Nice {i}!</p></div></div>"
            f"<aside>About</aside><form><input>Search</form><footer>&copy; {i}</footer></body></html>")


def test_template_of_pages_without_article(spark):
    bodies = [f"<h2>Title {i}</h2><p>Story {'word ' * (30 + i)}<b>bold</b> &amp; more<p>Second&nbsp;part {i}" for i in range(12)]
    rows = [(i, f"http://host.example/{i}", page(i, b)) for i, b in enumerate(bodies)]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"Title {i}\nStory {'word ' * (30 + i)}bold & more\nSecond part {i}"
        assert got[i].n_chars == len(got[i].text)


def test_nothing_of_an_article_is_lost_beside_its_body():
    """Title, lead and unequal sections beside the element that holds most text; with and without a template."""
    def wrapped(body):
        return f"<html><body><div id=top>My site</div><nav>Home</nav><div class=wrap>{body}</div><footer>Foot</footer></body></html>"

    post = [wrapped(f"<div class=post><h1>Name {i}</h1><p>{f'long{i} ' * 90}</p></div>") for i in range(4)]
    parts = [wrapped(f"<div class=intro><p>Lead {i}</p></div><div class=body><p>{f'w{i} ' * 200}</p><p>b{i}</p></div>"
                     f"<div class=part2><h2>Part{i}</h2><p>{f'z{i} ' * 20}</p></div>") for i in range(9)]
    for i, text in enumerate(html_extract.extract(post)):
        assert text == f"Name {i}\n{(f'long{i} ' * 90).strip()}"
    for i, text in enumerate(html_extract.extract(parts)):
        assert text == "\n".join([f"Lead {i}", (f"w{i} " * 200).strip(), f"b{i}", f"Part{i}", (f"z{i} " * 20).strip()])
    alone = "<body><div class=post><h1>Ten things</h1><p>Why</p><ul>" + f"<li>{'thing ' * 40}</li>" * 10 + "</ul><p>End</p></div></body>"
    assert html_extract.extract([alone])[0].split("\n")[:2] == ["Ten things", "Why"]
    assert html_extract.extract([alone])[0].split("\n")[-1] == "End"


def test_ids_made_from_headings_are_no_furniture():
    odd = ["<h2 id=related-work>Earlier</h2><p>Others</p>", "<section id=discussion><h2>Talk</h2><p>We say</p></section>",
           "<div id=tags><p>Tags are words</p></div>", "<h2 id=search-results>Found</h2>", "", ""]
    pages = [f"<html><body><div class=post><h1>Name {i}</h1><p>{f'x{i} ' * 90}</p>{o}<div id=comments><p>Nice {i}</p></div></div>"
             f"<div id=feedback>Say {i}</div></body></html>" for i, o in enumerate(odd)]
    texts = [t.split("\n")[2:] for t in html_extract.extract(pages)]
    assert texts == [["Earlier", "Others"], ["Talk", "We say"], ["Tags are words"], ["Found"], [], []]


LAYOUTS = {
    "content with-sidebar": "<div class='content with-sidebar'><article>{}</article></div>",
    "sidebar-right": "<div class='site sidebar-right'><article>{}</article></div>",
    "header-fixed": "<div class='wrapper header-fixed'><article>{}</article></div>",
    "menu-closed": "<div class='menu-closed'><main>{}</main></div>",
    "form": "<form id=aspnetForm><article>{}</article></form>",
    "form without article": "<form id=aspnetForm><div class=text>{}</div></form>",
    "id": "<div id=page-with-sidebar><article>{}</article></div>",
    "open header": "<header><div class=top><article>{}</article></div></header>",
    "article without mark": "<div class='layout sidebar-left'><div class=text>{}</div></div>",
}


@pytest.mark.parametrize("siblings", [1, 7, 8, 10])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_marks_around_the_article_say_nothing(layout, siblings):
    def one(i):
        body = (f"<div class='entry-header'><h1>Name {i}</h1></div><h2>Introduction</h2><p>{f'x{i} ' * 60}</p>"
                f"<h2>Methods</h2><p>{f'y{i} ' * 40}</p>")
        return ("<html><body><nav><a href=/>Home</a></nav><div class=ad>Buy</div>" + LAYOUTS[layout].format(body)
                + "<div class=sidebar><p>About us</p></div>"
                + f"<section class=comments><article><p>Reader {i}: {'nice ' * 30}</p></article></section><footer>Foot</footer></body></html>")

    for i, text in enumerate(html_extract.extract([one(i) for i in range(siblings)])):
        assert text == f"Name {i}\nIntroduction\n{(f'x{i} ' * 60).strip()}\nMethods\n{(f'y{i} ' * 40).strip()}"


def test_parts_of_an_article_by_class():
    text = "<p>" + "word " * 50 + "</p>"
    inside = f"<html><body><article><h1>T</h1>{text}<section class=discussion><p>We find</p></section><div class=share>Tweet</div></article></body></html>"
    assert html_extract.extract([inside])[0].split("\n")[2:] == ["We find"]
    # Nothing but marked elements: the widest mark is taken back, comments never.
    marked = f"<html><body><div class=widget>{text}</div><div class=promo>Buy</div><div class=comments>{text * 3}</div></body></html>"
    assert html_extract.extract([marked]) == [("word " * 50).strip()]
    assert html_extract.extract([f"<html><body><div class=comments>{text}</div></body></html>"]) == [""]
    long = f"<div class=cookie-notice>{text * 6}</div>"
    for own in (f"<article>{text}</article>", f"<div class=post>{text}</div>"):
        assert html_extract.extract([f"<html><body>{long}{own}</body></html>"]) == [("word " * 50).strip()]
    # A teaser in a sidebar is not the article.
    teaser = f"<html><body><div class=text>{text}</div><aside><article>Read this</article></aside></body></html>"
    assert html_extract.extract([teaser]) == [("word " * 50).strip()]


def test_equivalence_classes():
    pages = [html_extract.Page(page(i, "<p>x" * (i + 1) + f"<p>y{i}")) for i in range(5)]
    skeleton, nested = html_extract.template(pages)
    assert ("html", "body.has-sidebar", "nav", "ul", "li", "a") in skeleton
    assert not any(t[-1].startswith("y") for t in skeleton | nested)
    assert html_extract.template(pages[:2]) == (set(), set())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain text"), (4, "http://a.b/", "<p>one<p>two <b>x<br>y"), (None, "http://a.b/", "<div>z</div>"),
            (5, "http://a.b/c", "<article><p>5 < 6 &lt; 7"), (6, "http://a.b/d", "<p>" + "w " * 50000), (7, "http://a.b/e", "<p>cut</p><foo"),
            (7, "http://a.b/e", "<p>cut</p><foo"), (8, "HTTP://A.B:80/f", "<!-- open <p>gone"), (9, "http://a.b/g", "<header>h</header><p>t</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x")).withColumn("part", F.lit(1))
    got = sorted(((r.page_id, r.text) for r in html_extract.main_text(table).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "plain text"), (4, "one\ntwo x\ny"), (None, "z"), (5, "5 < 6 < 7"), (6, ("w " * 50000).strip()), (7, "cut"),
                          (7, "cut"), (8, ""), (9, "t")], key=str)
    assert html_extract.main_text(table.limit(0)).count() == 0


def brute_neighbours(rows, k):
    out = {}
    for q, v in rows:
        if q is None or q % 10:
            continue
        near = sorted({(float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q})
        best = {}
        for d, i in near:
            best.setdefault(i, d)
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)] + [(40, rows[40][1])]
    bad = [(1000, None), (1010, [0.0] * 6), (1020, [float("nan")] * 6), (1030, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1040, [1.0] * 5), (None, [1.0] * 6),
           (1050, [float("inf")] * 6)]
    table = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("id", F.lit(0))
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0, leaves=8, share=8.0).collect():  # every leaf is opened
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    expected = brute_neighbours(rows, 10)
    assert set(got) == set(expected)
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11)) and [v for _, _, v in own] == [v for _, v in expected[q]]
        assert [s for _, s, _ in own] == pytest.approx([s for s, _ in expected[q]])


def test_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = 9
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 300 >= 0.9


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 10 == 0).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0])], schema), F.col("vec_id") % 10 == 0).count() == 0
    rows = neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [4.0, 6.0])], schema), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.rank, r.score) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 1, 0.0), (2, 2, 5.0)]
