"""Licence scans with DataFrame functions only: sparse TF-IDF cosines to templates, then inheritance by path.

Compared are every line of a file, every paragraph of several lines, and the whole file if it has several paragraphs;
with them templates of single notices, of the paragraphs of standard headers and texts, and of these as a whole. Terms
are the words of the templates that aren't stop words. A unit's other words count in its length with the greatest weight
that the corpus gives, so a notice inside running prose is less alike than one on its own. By Cauchy's inequality the
squares of its numbers of known and other words bound a unit's cosine to any template; units that can't reach the least
cosine are compared with none, but their words count in the document frequencies, which are those of whole texts. A file whose name is that of a licence file, or most of whose
words stand in matching units, speaks for its directory; a file without a header takes the licence of the nearest
directory above it that has one.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm.common import written
from lakeweave.llm.license_texts import STOP_WORDS, TEXTS

LEAST_COSINE = 0.6
FILE_SHARE = 0.5
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][a-z0-9.-]+)?$"
PARAGRAPH = r"\n[^A-Za-z0-9\n]*\n"
LINE, BLOCK, WHOLE = 0, 1, 2


def paragraphs_of(text: str) -> list[str]:
    return [x for x in re.split(PARAGRAPH, text.strip()) if x.strip()]


def templates() -> list[tuple[str, str]]:
    """(licence, text) of every text, and of every paragraph that is in the texts of one licence only: what several share tells none."""
    shared = Counter(x for texts in TEXTS.values() for x in {p for t in texts for p in paragraphs_of(t)})
    out = [(name, x) for name, texts in sorted(TEXTS.items()) for t in texts for x in (*(p for p in paragraphs_of(t) if shared[p] == 1), t.strip())]
    return list(dict.fromkeys(out))


def template_terms() -> list[tuple[int, str, str, int]]:
    """(number, licence, term, occurrences) of the templates."""
    out = []
    for k, (name, text) in enumerate(templates()):
        counts = Counter(w for w in re.findall(r"[a-z0-9]+", text.lower()) if w not in STOP_WORDS)
        out += [(k, name, w, n) for w, n in sorted(counts.items())]
    return out


def values(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"({k}, '{a}', '{b}', {n})" for k, a, b, n in template_terms())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(template, license, term, tf)")


def directory(path):
    """The directory of a path; of one without a slash, the empty root."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def words_of(text):
    """A text's words without stop words; the dotted capital I, which the JVM alone lower-cases to two characters, is an i."""
    return F.filter(F.split(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i"))), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*sorted(STOP_WORDS)))


def squares(words):
    """The sum of the squares of the numbers of each word."""
    return F.aggregate(F.transform(F.array_distinct(words), lambda t: F.pow(F.size(F.filter(words, lambda w: w == t)), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)


def units(text):
    """A text's lines, paragraphs of several lines, and itself if it has several paragraphs."""
    paragraphs = F.split(text, PARAGRAPH)
    of = lambda kind, texts: F.transform(texts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    whole = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(of(LINE, F.split(text, "\n")), of(BLOCK, F.filter(paragraphs, lambda p: p.contains("\n"))), of(WHOLE, whole))


def scan(docs: DataFrame, path_col="path", id_col="doc_id", text_col="text", least: float = LEAST_COSINE) -> DataFrame:
    """One row per file: its licence, the best unit's cosine, and whence: header, file, inherited or none.

    Defined cases: a null or empty text has no header; a null path is the root's; of equal cosines the licence first
    in order wins; in a directory files of a licence file's name go first, then the best; the units of rows with the
    same id are compared apart, and each such row has the best header found under the id; a null id has no header but
    inherits, and isn't counted as a file of the corpus; no rows give none. Other columns are not read.
    """
    spark = docs.sparkSession
    files = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    terms = values(spark)
    vocabulary = sorted({t for _, _, t, _ in template_terms()})
    every = files.where("doc_id is not null and text is not null").select("doc_id", F.explode(units(F.col("text"))).alias("u")).select("doc_id", F.col("u.kind").alias("kind"), words_of(F.col("u.unit")).alias("words"))
    split = every.withColumn("known", F.filter("words", lambda w: w.isin(*vocabulary))).where(F.size("known") > 0)
    other = F.size("words") - F.size("known")
    bound = least * least / (1 - least * least) - 1e-4  # what squares of known words are to those of others at the least cosine
    hits = split.where(F.pow(F.size("known"), F.lit(2.0)) >= bound * other).where(squares(F.col("known")) >= bound * other)
    hits = written(hits.select("doc_id", F.monotonically_increasing_id().alias("unit"), "kind", "words", "known"), "units")
    total = F.lit(files.where("doc_id is not null").select("doc_id").distinct().count())
    occurrences = hits.select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count("*").alias("n"))
    held = F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(*vocabulary)))
    frequency = files.where("doc_id is not null").select("doc_id", F.explode(held).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log((total + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    idf = written(terms.select("term").distinct().join(frequency, "term", "left").select("term", weight.alias("idf")), "idf")
    weighted = terms.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("template_length"))
    weighed = occurrences.join(F.broadcast(idf), "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.log(total + 1) + 1))
    unit_lengths = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("unit_length"))
    dots = weighed.join(F.broadcast(weighted.select("term", "template", "license", "w")), "term").groupBy("unit", "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / (F.col("unit_length") * F.col("template_length")), 6)
    alike = dots.join(unit_lengths, "unit").join(F.broadcast(lengths), "template").select("unit", "license", cosine.alias("cosine")).where(F.col("cosine") >= least)
    best_unit = alike.groupBy("unit").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("best"))
    sized = best_unit.join(hits.select("unit", "doc_id", "kind", F.size("words").alias("n_words")), "unit")
    by_kind = sized.groupBy("doc_id", "kind").agg(F.min("best").alias("best"), F.sum("n_words").alias("n"))
    headers = written(by_kind.groupBy("doc_id").agg(F.min("best").alias("best"), F.max("n").alias("n_matched")).select("doc_id", F.col("best.license").alias("own"), (-F.col("best.c")).alias("score"), "n_matched"), "headers")

    named = F.col("path").rlike(FILE_NAME)
    speaking = files.join(headers, "doc_id").where(named | (F.col("n_matched") >= FILE_SHARE * F.size(words_of(F.col("text")))))
    speaking = written(speaking.select("doc_id", "path", "own", "score", (~named).alias("unnamed")).distinct(), "speaking")
    by_directory = speaking.groupBy(directory(F.col("path")).alias("above")).agg(F.min(F.struct("unnamed", (-F.col("score")).alias("c"), "own")).alias("best")).select("above", F.col("best.own").alias("given"))
    directories = files.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = directories.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts")).select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("above"))
    inherited = written(above.join(by_directory, "above").groupBy("dir").agg(F.max(F.struct("depth", "given", "above")).alias("near")).select("dir", "near.given", F.col("near.above").alias("from_dir")), "inherited")
    found = files.select("doc_id", "path", directory(F.col("path")).alias("dir")).join(headers, "doc_id", "left").join(inherited, "dir", "left").join(speaking.select("doc_id", "path", F.lit(True).alias("speaks")), ["doc_id", "path"], "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("speaks"), "file").otherwise("header")).when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return found.select("doc_id", "path", F.coalesce("own", "given").alias("license"), F.coalesce("score", F.lit(0.0)).alias("score"), origin.alias("origin"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))


def document_path():
    """The path that the registered query gives a document: three levels deep, with a licence file for every fortieth."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    name = F.when(F.col("doc_id") % 40 == 0, "LICENSE").otherwise(F.concat(part("doc_id"), F.lit(".txt")))
    return F.concat(part("source"), F.lit("/"), part("lang"), F.lit("/d"), F.coalesce((F.col("doc_id") % 7).cast("string"), F.lit("")), F.lit("/"), F.coalesce(name, F.lit(".txt")))


def oracle_sql() -> str:
    """DuckDB SQL of scan() over documents with document_path(); but its frequencies are those of the units within reach alone."""
    rows = ", ".join(f"({k}, '{a}', '{b}', {n})" for k, a, b, n in template_terms())
    stop = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
    split = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({stop}))"
    paragraphs = "string_split_regex(text, '\n[^A-Za-z0-9\n]*\n')"
    named = f"regexp_matches(path, '{FILE_NAME}')"
    return f"""
WITH terms(template, license, term, tf) AS (VALUES {rows}),
paths AS (
  SELECT doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/d' || coalesce((doc_id % 7)::varchar, '') || '/'
    || CASE WHEN doc_id % 40 = 0 THEN 'LICENSE' ELSE coalesce(doc_id::varchar, '') || '.txt' END AS path
  FROM documents),
files AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS dir FROM paths),
units AS (
  SELECT doc_id, 0 AS kind, unnest(string_split(text, chr(10))) AS unit FROM files WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT doc_id, 1, unnest(list_filter({paragraphs}, lambda p: contains(p, chr(10)))) FROM files WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT doc_id, 2, text FROM files WHERE doc_id IS NOT NULL AND len({paragraphs}) > 1),
split AS (SELECT doc_id, kind, row_number() OVER () AS unit_no, {split("unit")} AS words FROM units),
counted AS (SELECT doc_id, kind, unit_no, term, count(*) AS n, term IN (SELECT term FROM terms) AS known FROM (SELECT doc_id, kind, unit_no, unnest(words) AS term FROM split) GROUP BY ALL),
reach AS (
  SELECT unit_no, sum(n) AS n_words FROM counted GROUP BY unit_no
  HAVING sum(n * n) FILTER (WHERE known) >= {LEAST_COSINE**2 / (1 - LEAST_COSINE**2) - 1e-4} * coalesce(sum(n) FILTER (WHERE NOT known), 0)),
occurrences AS (SELECT c.*, r.n_words FROM counted c JOIN reach r USING (unit_no)),
total AS (SELECT count(DISTINCT doc_id) AS n FROM files),
frequency AS (SELECT term, count(DISTINCT doc_id) AS df FROM occurrences WHERE known GROUP BY term),
idf AS (SELECT t.term, ln((total.n + 1) / (coalesce(df, 0) + 1)) + 1 AS idf FROM (SELECT DISTINCT term FROM terms) t LEFT JOIN frequency USING (term), total),
templates AS (SELECT template, license, term, tf * idf AS w FROM terms JOIN idf USING (term)),
lengths AS (SELECT template, sqrt(sum(w * w)) AS template_length FROM templates GROUP BY template),
weighed AS (SELECT o.*, o.n * coalesce(idf, ln(total.n + 1) + 1) AS x FROM occurrences o LEFT JOIN idf USING (term), total),
unit_lengths AS (SELECT unit_no, sqrt(sum(x * x)) AS unit_length FROM weighed GROUP BY ALL),
alike AS (
  SELECT doc_id, kind, unit_no, n_words, license, round(dot / (unit_length * template_length), 6) AS cosine
  FROM (SELECT doc_id, kind, unit_no, n_words, template, license, sum(x * w) AS dot FROM weighed JOIN templates USING (term) GROUP BY ALL)
    JOIN unit_lengths USING (unit_no) JOIN lengths USING (template)
  WHERE round(dot / (unit_length * template_length), 6) >= {LEAST_COSINE}),
best_unit AS (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY unit_no ORDER BY cosine DESC, license) = 1),
matched AS (SELECT doc_id, max(n) AS n_matched FROM (SELECT doc_id, kind, sum(n_words) AS n FROM best_unit GROUP BY ALL) GROUP BY doc_id),
headers AS (
  SELECT doc_id, license AS own, cosine AS score, n_matched FROM best_unit JOIN matched USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
speaking AS (SELECT DISTINCT f.doc_id, path, dir, own, score, NOT {named} AS unnamed FROM files f JOIN headers USING (doc_id) WHERE {named} OR n_matched >= {FILE_SHARE} * len({split("text")})),
by_dir AS (SELECT dir AS above, own AS given FROM speaking QUALIFY row_number() OVER (PARTITION BY dir ORDER BY unnamed, score DESC, own) = 1),
near AS (
  SELECT d.dir, b.above, b.given FROM (SELECT DISTINCT dir FROM files) d JOIN by_dir b ON b.above = d.dir OR b.above = '' OR starts_with(d.dir, b.above || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(b.above) DESC) = 1)
SELECT f.doc_id, f.path, coalesce(h.own, given) AS license, coalesce(h.score, 0.0)::double AS score,
  CASE WHEN h.own IS NOT NULL THEN CASE WHEN s.doc_id IS NOT NULL THEN 'file' ELSE 'header' END WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN h.own IS NULL THEN n.above END AS from_dir
FROM files f LEFT JOIN headers h USING (doc_id) LEFT JOIN near n ON n.dir = f.dir LEFT JOIN speaking s ON s.doc_id = f.doc_id AND s.path = f.path
"""
