"""HTML extraction on small sites of planted templates."""

import random

import pytest

from quantfold.llm import html

rnd = random.Random(5)
VOCAB = [f"word{i}" for i in range(400)]


def sentence(n=12):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


NOTICES = [sentence() for _ in range(4)]


def page(host, k, box="box"):
    paras = [sentence() for _ in range(rnd.randint(1, 6))]
    body = "".join(f"<p>{p}</p>" for p in paras)
    markup = (f"<html><head><title>t</title><script>var a='</p><article>x</article>';</script></head><body><div class=top><ul><li><a href=/>Home</a><li>About us</ul></div>"
              f"<div class='{box}'>{NOTICES[k % 4]}</div><div class=story id=s{k}><h2>Head&nbsp;{k} &amp; more</h2>{body}</div>"
              f"<section class=comments><p>{sentence()}</p></section><form><input><p>Your name</p></form></body></html>")
    return f"http://{host}/{k}", markup, " ".join([f"Head {k} & more", *paras])


@pytest.fixture
def sites(spark):
    def make(rows):
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make


@pytest.mark.parametrize("broadcast_rows", [10**6, -1])
def test_repeated_branches_go(sites, broadcast_rows):
    pages = [page("big.example.com", k) for k in range(60)] + [page(f"h{k}.example.org", k) for k in range(5)]
    rows = [(i, u, m) for i, (u, m, _) in enumerate(pages)]
    got = {r["page_id"]: r for r in html.extract(sites(rows), broadcast_rows=broadcast_rows).collect()}
    for i, (u, _, want) in enumerate(pages):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["url"] == u


def test_odd_pages(sites):
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    rows = [(1, "http://a/1", None), (2, "http://a/2", ""), (3, None, "<p>no url"), (4, "nonsense", "plain &lt;text&gt; only"), (5, "http://a/5", deep),
            (6, "http://b/1", "<article><p>one<br>two<p>thr<b>ee</b></article><!-- <p>gone</p> --><footer>foot</footer>"), (7, "http://c/", "<p a='unclosed><b>x</p>y <i"),
            (None, None, "<p>twice</p>"), (None, None, "<p>twice</p>"), (8, "http://d/", "<nav>only menu</nav>"), (9, "http://e/", "<table><tr><td>a<td>b<tr><td>c</table>")]
    got = {}
    for r in html.extract(sites(rows)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[1] == got[2] == got[8] == [""]
    assert got[3] == ["no url"] and got[4] == ["plain <text> only"] and got[5] == ["deep text"] and got[6] == ["one two three"]
    assert got[None] == ["twice", "twice"] and got[9] == ["a b c"]


def test_empty_table(sites):
    assert html.extract(sites([])).collect() == []


@pytest.mark.parametrize("wrapper", ["content has-sidebar", "no-sidebar", "post social", "search-result"])
def test_names_only_weigh(sites, wrapper):
    want = [" ".join(sentence(30) for _ in range(3)) for _ in range(40)]
    inner = "<article><p>{}</p></article>" if "has-" in wrapper else "<p>{}</p>"
    rows = [(i, f"http://w/{i}", f"<div class='{wrapper}'>{inner.format(t)}</div><div class=comments>{sentence(4)}</div><nav>home about</nav>") for i, t in enumerate(want)]
    rows.append((40, "http://alone/1", "<div class='post social widget'><p>alone</p></div>"))
    got = {r["page_id"]: r["text"] for r in html.extract(sites(rows)).collect()}
    assert [got[i] for i in range(40)] == want and got[40] == "alone"


def test_deep_articles(sites):
    """An article 15 elements deep beside a deep comment branch, below classes that hold a >."""
    want = [" ".join(sentence(30) for _ in range(3)) for _ in range(40)]
    down, up = "<div class='[&>p]:mt-2'><div>" * 7 + "<div>", "</div>" * 15
    rows = [(i, f"http://deep/{i}", f"{down}<div class=story><p>{t}</p></div><div class=comments><div><p>{sentence(4)}</p></div></div><div><p>Same words</p></div>{up}") for i, t in enumerate(want)]
    got = {r["page_id"]: r["text"] for r in html.extract(sites(rows)).collect()}
    assert [got[i] for i in range(40)] == want


def test_importance_is_that_of_the_recursion(spark):
    n = random.Random(9)
    rows = [(0, None, 0, 5, 2, 0.7, None)]
    for i in range(1, 60):
        parent = rows[n.randrange(max(0, i - 4), i)]
        rows.append((i, parent[0], parent[2] + 1, n.randint(1, 9), n.randint(1, 6), n.random(), n.choice([None, n.random()])))
    nodes = spark.createDataFrame([(*r, False, 0.0) for r in rows], "path long, parent long, depth int, n long, layouts long, layout double, content double, apart boolean, weight double")
    want, best = {}, {}
    for path, _, _, _, layouts, layout, content in reversed(rows):
        kids = [r for r in rows if r[1] == path]
        mean = sum(want[k[0]] * k[3] for k in kids) / sum(k[3] for k in kids) if kids else None
        share = 1 - html.GAMMA**layouts
        leaf = layout if content is None else content
        want[path] = leaf if mean is None else share * layout + (1 - share) * (mean if content is None else (mean + content) / 2)
        best[path] = max([want[path], *(best[k[0]] for k in kids)])
    got = {r["path"]: r for r in html.importance(nodes).collect()}
    assert len(got) == 60
    for path in want:
        assert abs(got[path]["importance"] - want[path]) < 1e-12 and abs(got[path]["branch"] - best[path]) < 1e-12


def test_copies_count_once(sites):
    want = [" ".join(sentence(30) for _ in range(3)) for _ in range(30)]
    rows = [(30 * k + i, f"http://copies/{i}?{k}", f"<ul><li>Home page</ul><div class=story><p>{t}</p></div>") for i, t in enumerate(want) for k in range(12)]
    rows += [(1000 + k, f"http://one/{k}", f"<div class=story><p>{want[0]}</p></div>") for k in range(40)]
    got = {r["page_id"]: r["text"] for r in html.extract(sites(rows)).collect()}
    assert len(got) == 400 and all(got[30 * k + i] == t for i, t in enumerate(want) for k in range(12)) and all(got[1000 + k] == want[0] for k in range(40))


def test_low_nodes_are_joined_to_the_pages_that_have_them(sites):
    """Comment ids with letters give each page paths of its own; a page's list holds only its own, the topmost."""
    want = [" ".join(sentence(30) for _ in range(3)) for _ in range(40)]
    page = "<div class=story><p>{}</p></div><div id=comment-{}><div><p>short {}</p></div></div>"
    letters = [chr(97 + i // 10) * 3 + chr(97 + i % 10) for i in range(40)]
    rows = [(i, f"http://hot/{i}", page.format(t, x, x)) for i, (t, x) in enumerate(zip(want, letters))] + [(40, "http://hot/40", page.format(want[0], letters[0], letters[0]))]
    pages = sites(rows).withColumn("host", html._host())
    low = html.low_nodes(html.style_tree(pages))
    assert low.count() == 40
    lists = html.low_of_pages(pages, low).collect()
    assert len(lists) == 40 and all(len(r["low"]) == 1 for r in lists)
    for limit in (10**6, -1):
        got = {r["page_id"]: r["text"] for r in html.extract(sites(rows), broadcast_rows=limit).collect()}
        assert [got[i] for i in range(41)] == [*want, want[0]]


@pytest.mark.parametrize("name", ["related-work", "post-reply-analysis", "search-method", "alert", "methods"])
def test_a_name_does_not_remove_a_varied_part_of_the_article(sites, name):
    want = [[" ".join(sentence(20) for _ in range(2)) for _ in range(3)] for _ in range(40)]
    rows = [(i, f"http://paper/{i}", f"<nav>home about</nav><article><p>{a}</p><p>{b}</p><section class='{name}'><p>{c}</p></section></article>"
             f"<div class='reader-comments'><p>{sentence(5)}</p></div><div class='ad-box'>buy {sentence(3)}</div>") for i, (a, b, c) in enumerate(want)]
    got = {r["page_id"]: r["text"] for r in html.extract(sites(rows)).collect()}
    assert [got[i] for i in range(40)] == [" ".join(w) for w in want]


def test_notices_and_comments_within_the_article_go(sites):
    want = [" ".join(sentence(30) for _ in range(3)) for _ in range(40)]
    rows = [(i, f"http://in/{i}", f"<article><p>{t}</p><div class='alert'>{sentence(2)}</div><div class='comments'><p>{sentence(12)}</p></div><div class='related-posts'>{sentence(3)}</div></article>") for i, t in enumerate(want)]
    got = {r["page_id"]: r["text"] for r in html.extract(sites(rows)).collect()}
    assert [got[i] for i in range(40)] == want
