"""Licence scans: nothing of a corpus is left out."""

from lakeweave.llm import license_scan

SCHEMA = "doc_id long, path string, text string"
MIT, GPL, NC = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."


def filler(n=40):
    return [(1000 + k, f"fill/{k}.txt", f"plain words number {k} about the weather") for k in range(n)]


def test_units_of_repeated_ids_are_compared_apart(spark):
    """Put together, the first lines of the three texts would be like no template."""
    rows = [(1, "a/x", MIT), (1, "b/x", GPL), (1, "c/x", NC), (2, "d/x", "nothing here"), (2, "e/x", "one more\n" + GPL)]
    found = sorted((r["doc_id"], r["path"], r["license"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows + filler(), SCHEMA)).collect() if r["doc_id"] < 1000)
    assert [x[:3] for x in found] == [(1, "a/x", "cc-by-nc-4.0"), (1, "b/x", "cc-by-nc-4.0"), (1, "c/x", "cc-by-nc-4.0"), (2, "d/x", "gpl-3.0"), (2, "e/x", "gpl-3.0")]
    assert [x[3] for x in found[:3]] == [1.0] * 3


def test_dotted_capital_i_is_an_i(spark):
    rows = [(1, "a/x", "RELEASED UNDER THE MİT LİCENSE")]
    assert {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows + filler(), SCHEMA)).collect()}[1] == "mit"


def test_null_ids_are_no_files_of_the_corpus(spark):
    rows = [(1, "a/x", MIT[:-1] + " weather words")]
    score = lambda more: {r["doc_id"]: r["score"] for r in license_scan.scan(spark.createDataFrame(rows + filler() + more, SCHEMA)).collect()}[1]
    assert 0 < score([]) < 1 and score([]) == score([(None, "b/x", MIT)])


def test_frequencies_are_those_of_whole_texts(spark):
    """A word of running prose isn't rare because its units are too long to match."""
    prose = [(100 + k, f"p/{k}", " ".join(f"wort{j}" for j in range(9)) + f" mit leuten und dingen {k}") for k in range(80)]
    rows = [(1, "a/x", "Leute kommen an\nmit"), (2, "b/x", MIT)]
    found = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows + prose, SCHEMA)).collect()}
    assert (found[1], found[2]) == (None, "mit")


def test_scores_do_not_depend_on_the_least_cosine(spark):
    rows = [(1, "a/x", MIT[:-1] + " weather"), (2, "b/x", "permission notice software license " + " ".join(f"w{k}" for k in range(12)))]
    score = lambda least: {r["doc_id"]: r["score"] for r in license_scan.scan(spark.createDataFrame(rows + filler(), SCHEMA), least=least).collect()}[1]
    assert score(0.05) == score(0.6) > 0.6
