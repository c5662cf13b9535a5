"""The classifier, the language model, page extraction and the pipeline."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakeweave.llm import bpe, co_training, pseudo_likelihood, queries, site_style
from lakeweave.llm.text import WHITE, word_hashes


def quality_corpus(prose, n=600):
    rng, docs, labels = random.Random(6), [], []
    for k in range(n):
        text, good = prose(rng.randint(20, 120)), k % 3 != 0
        if not good:
            text = [text.upper().replace(" ", "!! "), text.replace(" ", "### "), " ".join(w for w in text.split()[:9] for _ in range(12)), text.replace(" ", " | ")][k % 4]
        docs.append((k, text, "blog" if good == (rng.random() < 0.8) else "spam", len(text)))
        if k % 2:
            labels.append((k, int(good)))
    return docs, labels


def test_quality_of_unlabelled_documents(spark, prose, odd_docs):
    docs, labels = quality_corpus(prose)
    d, y = spark.createDataFrame(docs, "doc_id long, text string, site string, n long"), spark.createDataFrame([*labels, (0, 1), (0, 0), (None, 1), (2, None)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in co_training.classify(d, y).collect()}
    held = [k for k in range(600) if k % 2 == 0]
    assert sum(found[k]["keep"] == (k % 3 != 0) for k in held) / len(held) > 0.97
    assert sum((found[k]["meta_prob"] >= 0.5) == (k % 3 != 0) for k in held) / len(held) > 0.7
    kept = co_training.keep_good(d, y)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in found.items() if r["keep"]} and kept.schema == d.schema
    model = co_training.train(d, y, ["site", "n"])
    assert len(model.rounds) == co_training.ROUNDS and model.rounds[0][0] > 0
    assert [tuple(r) for r in co_training.classify(d.repartition(3), y).orderBy("doc_id").collect()] == [tuple(found[k]) for k in sorted(found)]
    assert sum(model.rounds[0]) > 400  # of 2 x 600 pseudo-labels: no bound on the documents that give them
    dotted = d.withColumnRenamed("site", "a.site").withColumn("b c", F.lit(1))
    assert co_training.keep_good(dotted, y).columns == dotted.columns
    odd = co_training.classify(odd_docs, y).collect()
    assert len(odd) == 9 and all(0 <= r["score"] <= 1 for r in odd)
    none = co_training.classify(odd_docs, y.limit(0)).collect()
    assert len(none) == 9 and all(r["keep"] and r["score"] == 1 for r in none)
    assert co_training.classify(odd_docs.limit(0), y).count() == 0
    assert co_training.keep_good(odd_docs, y.limit(0)).count() == 9


def test_sums_of_pseudo_labels_are_those_of_the_loss():
    """Against the plain loss of the same documents: its slope and curvature by differences, and the numbers of labels."""
    rng, n, d, buckets = np.random.default_rng(5), 40, 3, 7
    dense, row, bucket = rng.normal(size=(n, d)), np.repeat(np.arange(n), 4), rng.integers(0, buckets, 4 * n)
    view = co_training.View(np.zeros(d), np.ones(d), rng.normal(size=d), rng.normal(size=buckets))
    y = rng.integers(-1, 2, n)
    found = co_training.slope_of(view, co_training.sums_of(view, dense, row, bucket, buckets, y))

    def loss(w):
        margin = co_training.View(np.zeros(d), np.ones(d), w[:d], w[d:]).margin(dense, row, bucket)
        each = np.log1p(np.exp(-np.where(y == 1, margin, -margin)))
        return co_training.PSEUDO / 2 * (each[y == 1].mean() + each[y == 0].mean())

    def slope(w):
        return np.array([(loss(w + e) - loss(w - e)) / 2e-5 for e in np.eye(d + buckets) * 1e-5])

    w = np.concatenate([view.dense, view.hashed])
    assert np.allclose(found.slope, slope(w), atol=1e-5) and np.allclose(found.gradient(w), found.slope)
    curve = np.array([(slope(w + e) - slope(w - e)) / 2e-3 for e in np.eye(d + buckets) * 1e-3])
    assert np.allclose(found.dense, curve[:d, :d], atol=1e-3)


def test_gradient_is_that_of_the_loss():
    shape, rng = pseudo_likelihood.Shape(4), np.random.default_rng(2)
    p = pseudo_likelihood.start(shape, np.arange(16), 3).astype(np.float64)
    context, target = rng.integers(0, 17, (7, 4)), rng.integers(0, 16, 7)
    order, back, d_out, d_bias, members = pseudo_likelihood.gradient(shape, p, context, target)
    want = np.zeros(shape.size)
    table, bias, out, out_bias, inner, inner_bias, *_ = shape.views(want)
    for k in range(4):
        np.add.at(table[k], context[order, k], back)
    bias[:], out[:], out_bias[:] = back.sum(axis=0), d_out, d_bias
    for c, w, x in members:
        inner[c], inner_bias[c] = w, x
    squares = sum(int(np.prod(s)) for s in shape.shapes()[6:])
    for i in rng.permutation(shape.size - squares)[:60].tolist():
        up, down = p.copy(), p.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (pseudo_likelihood.log_probs(shape, down, context, target) - pseudo_likelihood.log_probs(shape, up, context, target)).sum() / 2e-5
        assert abs(slope - want[i]) < 1e-4


def test_probabilities_of_all_tokens_sum_to_one():
    shape, rng = pseudo_likelihood.Shape(5), np.random.default_rng(4)
    p = pseudo_likelihood.start(shape, np.arange(25), 1)
    context = np.repeat(rng.integers(0, 26, (1, 4)), 25, axis=0)
    assert abs(np.exp(pseudo_likelihood.log_probs(shape, p, context, np.arange(25))).sum() - 1) < 1e-5


def test_pseudo_likelihood(spark, prose, odd_docs):
    rng = random.Random(8)
    pattern = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [" ".join(pattern[(s + k) % 8] for k in range(rng.randint(60, 300))) for s in (rng.randrange(8) for _ in range(200))]
    shuffled = " ".join(rng.sample(" ".join(texts[:2]).split(), 100))
    docs = spark.createDataFrame(list(enumerate([*texts, shuffled])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pseudo_likelihood.score(docs).collect()}
    assert all(found[k]["n_tokens"] == len(texts[k].split()) for k in range(200))
    assert found[0]["mean_log_prob"] > -np.log(8) / 2 > found[200]["mean_log_prob"]
    model, passages = pseudo_likelihood.fit(docs)
    assert len(model.known) == 8 and model.losses[-1] < 0.7 * model.losses[0]
    assert passages.agg({"n": "sum"}).first()[0] == sum(r["n_tokens"] for r in found.values())
    number = {w: int(np.flatnonzero(model.known == word_hashes(w, WHITE)[0])[0]) for w in pattern}
    t = [number[w] for w in texts[3].split()]
    context = np.array([[t[i + d] if 0 <= i + d < len(t) else model.shape.tokens for d in (-2, -1, 1, 2)] for i in range(len(t))])
    assert abs(pseudo_likelihood.log_probs(model.shape, model.params, context, np.array(t)).sum() - found[3]["log_prob"]) < 0.05
    odd = {r["doc_id"]: r for r in pseudo_likelihood.score(odd_docs).collect()}
    assert odd[1]["n_tokens"] == odd[3]["n_tokens"] == 0 and odd[1]["log_prob"] == 0 and odd[1]["mean_log_prob"] is None and odd[5]["n_tokens"] == 60_000
    assert pseudo_likelihood.score(odd_docs.limit(0)).count() == 0


def test_scores_do_not_depend_on_partitions_and_beat_the_shares_of_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["mean_log_prob"] for r in pseudo_likelihood.score(docs.repartition(k), epochs=2).collect()} for k in (1, 7))
    assert max(abs(one[k] - many[k]) for k in one if one[k] is not None) < 1e-4
    model, _ = pseudo_likelihood.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"), epochs=2)
    assert min(model.losses) < model.losses[0] - 0.2


def test_passages_hold_every_position_once(spark):
    long = " ".join(f"w{k % 50}" for k in range(2 * pseudo_likelihood.PASSAGE + 5))
    docs = spark.createDataFrame([(1, long), (2, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    _, passages = pseudo_likelihood.fit(docs, epochs=1)
    assert sorted((r["doc_id"] or 0, r["lead"], r["n"]) for r in passages.collect()) == [(0, 0, 0), (0, 0, 1), (1, 0, pseudo_likelihood.PASSAGE), (1, 2, 5), (1, 2, pseudo_likelihood.PASSAGE), (2, 0, 2)]


def test_page_text():
    t = site_style.main_text
    page = '<html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body><nav><a href="/">Menu</a></nav><div class="cookie-notice">We use</div><article><header><h1>Head &amp; more</h1></header><p>One <b>two</b>\n three<p>Four<br>five &lt;x&gt; &#233;&nbsp;z<ul><li>a<li>b</ul><aside>side</aside><form><input>go</form><div id="comments"><p>first!</p></div><table><tr><td>1<td>2</table></article><div class=ad>buy</div><footer>end</footer>'
    assert t(page) == "Head & more\nOne two three\nFour five <x> é z\na\nb\n1\n2"
    assert t(None) == t("") == t("<!-- x") == t("<script>never") == "" and t("a < b <i>c") == "a < b c" and t("<p>cut <b") == "cut"
    assert t("<main>in</main>out") == "in" and t("<div>x</div>y<div class='sidebar'>no</div>") == "x\ny" and t('<p title="a>b">q') == "q"


def test_style_trees_remove_what_a_host_repeats(spark):
    rows = [(k, f"http://h.example/{k}", f"<body><div class=top>Always the same</div><div class=text><p>Story number {k} of its own</p></div><div class=end>All alike</div></body>") for k in range(12)]
    rows += [(50, "http://few.example/1", "<body><div class=top>Always the same</div><p>x</p></body>"), (51, None, None), (52, "no url", ""), (50, "http://few.example/1", "<body><div class=top>Always the same</div><p>x</p></body>")]
    rows += [(60 + k, "http://copy.example/", "<article><h1>Same</h1><p>Copies stay whole</p></article>") for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS host", "'z' AS nodes")
    found = {r["page_id"]: r for r in site_style.extract(df).collect()}
    assert [found[k]["text"] for k in range(12)] == [f"Story number {k} of its own" for k in range(12)]
    assert found[50]["text"] == "Always the same\nx" and found[51]["text"] == found[52]["text"] == "" and found[52]["n_chars"] == 0
    assert found[61]["text"] == "Same\nCopies stay whole" and site_style.extract(df).count() == len(rows) and site_style.extract(df.limit(0)).count() == 0


def test_pipeline(spark, prose, tmp_path, monkeypatch):
    docs, labels = quality_corpus(prose, 240)
    docs = [(k, t, "en", s, n) for k, t, s, n in docs]
    texts = {k: t for k, t, *_ in docs}
    item = prose(30)
    docs += [(1000, texts[1], "en", "blog", 1), (1001, f"{prose(50)} {item} {prose(9)}", "en", "blog", 1), (1002, f"{prose(60)} token = abcdef0123456789abcdef {prose(9)}", "en", "blog", 1), (None, prose(40), "en", "blog", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = {r["doc_id"] for r in co_training.keep_good(d, spark.read.parquet(str(tmp_path / "labels.parquet")), ["lang", "source", "n_chars"]).collect()}
    assert set(found) == kept - {1000, 1001} and {1, 1002, None} <= set(found) and len([k for k in range(240) if k % 3 and k in found]) >= 150
    masked = re.sub("token = [0-9a-f]+", "[secret]", next(t for k, t, *_ in docs if k == 1002))
    assert found[1002]["decoded_sha256"] == hashlib.sha256(masked.encode()).hexdigest()
    codec = bpe.codec(bpe.default_vocabulary())
    assert found[1]["n_tokens"] == len(codec.encode(np.frombuffer(texts[1].encode(), np.uint8)))
    assert list(codec.encode(np.frombuffer(texts[1].encode(), np.uint8))) == found[1]["ids"]
    folder, made = str(tmp_path / "stages"), []
    first = corpus_pipeline.run(spark, str(tmp_path), folder)
    assert {r["doc_id"]: r["ids_sha256"] for r in first.collect()} == {k: r["ids_sha256"] for k, r in found.items()}
    (tmp_path / "stages/4-encoding/_SUCCESS").unlink()
    stages = [(n, lambda *a, n=n, f=f: made.append(n) or f(*a)) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, str(tmp_path), folder).count() == len(found) and made == ["encoding"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secret_scan", "encoding"]


def test_stages_on_odd_and_empty_documents(spark, odd_docs, tmp_path):
    spark.createDataFrame([(4, 1, None), (5, 0, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "ab ab ab"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, str(tmp_path))
        ids = sorted(str(r["doc_id"]) for r in out.collect())
        assert len(ids) == {"quality": len(ids), "decontamination": 8}.get(name, 9) and (out.columns == odd_docs.columns or name == "encoding"), name
        if name == "decontamination":
            assert "5" not in ids
        nothing = stage(spark, odd_docs.limit(0), str(tmp_path))
        assert nothing.count() == 0 and nothing.columns == out.columns


def test_registry():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11)) and set(queries.oracle_sql()) <= set(names)
