"""Copies of pages, branches below articles, and the choice of a page's main text."""

from lakeweave.llm import site_style


def texts(spark, sources):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}


def test_copies_don_t_empty_the_pages_of_a_host(spark):
    for inner in ("<article><p>{}</p></article>", "<main><p>{}</p></main>", "<p>{}</p>"):
        page = f"<html><body><div class=a><div class=b>{inner}</div></div></body></html>"
        found = texts(spark, [page.format("The same story")] * 40 + [page.format(f"Another story {k}") for k in range(4)])
        assert [found[k] for k in (0, 39, 40, 43)] == ["The same story"] * 2 + ["Another story 0", "Another story 3"], inner


def test_articles_in_low_branches_stay():
    page = "<html><body><div class=a>Top <article><p>Story</p></article></div></body></html>"
    _, found = site_style.nodes(page)
    assert site_style.main_text(page, frozenset(found)) == "Story"


def test_branches_that_repeat_below_articles_go(spark):
    page = "<body><{0}><h1>Title {1}</h1><p>Story <b>of</b> {1}</p><div class=x7>Read more on our site</div></{0}></body>"
    for tag in ("article", "main"):
        found = texts(spark, [page.format(tag, k) for k in range(9)])
        assert found == {k: f"Title {k}\nStory of {k}" for k in range(9)}


def test_text_outside_a_teaser_stays():
    t = site_style.main_text
    assert t("<main><h1>Head</h1><p>Lead</p><article>teaser</article><p>Story</p></main>out") == "Head\nLead\nteaser\nStory"
    assert t("<div><p>A long story of a page</p></div><article>teaser</article>") == "A long story of a page\nteaser"
    assert t("<div>menu</div><article>A story in an article</article>") == "A story in an article"
