"""The style tree against a plain version, and pages that are long, deep or broken."""

import math
import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lakeweave.llm import site_style


def plain_low_nodes(pages, least_pages=site_style.LEAST_PAGES, low=site_style.LOW):
    """Of each host the nodes of low importance, from the definition: normalised entropies over its distinct pages."""
    seen = defaultdict(lambda: defaultdict(lambda: (Counter(), Counter())))
    for (host, _), source in {(h, site_style.nodes(s)[0]): s for h, s in pages}.items():
        for node, (shape, text) in site_style.nodes(source)[1].items():
            seen[host][node][0][shape] += 1
            seen[host][node][1][text] += 1

    def entropy(counts):
        n = sum(counts.values())
        return 1.0 if n == 1 else -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)

    out = {}
    for host, nodes in seen.items():
        w = site_style.PRESENTATION_WEIGHT
        found = {node for node, (shape, text) in nodes.items() if sum(shape.values()) >= least_pages and w * entropy(shape) + (1 - w) * entropy(text) < low}
        if found:
            out[host] = found
    return out


def test_low_nodes_are_those_of_the_definition(spark):
    rng, pages = random.Random(2), []
    for k in range(120):
        menu = "".join(f"<a>{rng.choice('abc')}</a>" for _ in range(rng.choice((3, 3, 4))))
        side = rng.choice(("<div class=s>Always</div>", "<div class=s>Always</div>", "<div class=s>Seldom <b>x</b></div>"))
        pages.append((f"h{k % 5}", f"<body><div class=m>{menu}</div>{side}<div class=t><p>Text {k}</p><p>and {rng.random()}</p></div><div class=e>All alike</div></body>"))
    df = spark.createDataFrame(pages, "host string, html string")
    found = {r["host"]: set(r["nodes"]) for r in site_style.low_nodes(df).collect()}
    assert found == plain_low_nodes(pages) and len(found) == 5


def test_the_tree_changes_pages_that_markup_alone_doesn_t(spark):
    body = "<html><body><div class=q1>Visit the shop</div><article><h1>Title {0}</h1><div class=q2>Read more on our site</div><p>Story {0}</p></article><div class=q3>Made by us</div></body></html>"
    df = spark.createDataFrame([(k, f"http://h.example/{k}", body.format(k)) for k in range(30)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in site_style.extract(df).collect()}
    assert found == {k: f"Title {k}\nStory {k}" for k in range(30)}
    assert all(site_style.main_text(body.format(k)) != found[k] for k in found)


def test_long_deep_and_broken_pages():
    n = 60_000
    began = time.monotonic()
    assert site_style.main_text("<article>" + "<p>word</p>" * n + "</article>").count("word") == n
    assert site_style.main_text("<p>" + "<span>" * n + "deep" + "</i>" * n) == "deep"
    assert site_style.main_text("<p><table><td>" + "<div>" * n + "cell") == "cell"
    assert site_style.main_text("<p>one" + "<b>" * 20 + "<div>two") == "one\ntwo"
    assert site_style.main_text("<" * n) == "<" * n and site_style.main_text("<a b='" * n) == ""
    assert len(site_style.nodes("<div>" * n + "x")[1]) > 0
    assert time.monotonic() - began < 60


def test_extra_columns_with_clashing_names_and_nulls(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>"), (None, None, None), (1, "u", "<p>a</p>")], "page_id long, url string, html string").withColumns({c: F.lit("z") for c in ("host", "nodes", "text", "n_chars")})
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in site_style.extract(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
