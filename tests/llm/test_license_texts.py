"""Licence files and headers of several lines, in the forms in which files carry them."""

from lakeweave.llm import license_scan
from lakeweave.llm.license_texts import BSD_DISCLAIMER, BSD_TERMS, BSD_THIRD, LIABILITY, MIT, TEXTS, gnu


def wrapped(text, width=60, mark=""):
    lines, line = [], ""
    for paragraph in text.strip().split("\n\n"):
        for word in paragraph.split():
            if len(line) + len(word) > width:
                lines.append(f"{mark}{line}".rstrip())
                line = ""
            line += word + " "
        lines += [f"{mark}{line}".rstrip(), mark.rstrip()]
        line = ""
    return "\n".join(lines)


def test_texts_of_several_lines(spark):
    code = "\nimport os\n\ndef run(path):\n    return os.listdir(path)\n" * 4
    apache = TEXTS["apache-2.0"][1]
    files = {
        "one/LICENSE": "Copyright (c) 2020 Some Body\n\n" + wrapped(MIT + LIABILITY, 72),
        "one/src/deep/a.py": code,
        "two/COPYING": wrapped(BSD_TERMS + BSD_THIRD + BSD_DISCLAIMER, 50),
        "two/b.py": "",
        "three/LICENSE.txt": wrapped(BSD_TERMS + BSD_DISCLAIMER, 76),
        "four/gpl.py": wrapped(gnu("GNU General Public License", "3"), 64, "# ") + code,
        "four/lgpl.c": "/*\n" + wrapped(gnu("GNU Lesser General Public License", "3"), 64, " * ") + "\n */" + code,
        "four/apache.js": wrapped(apache, 70, "// ") + code,
        "four/mpl.rs": wrapped(TEXTS["mpl-2.0"][1], 66, "// ") + code,
        "five/prose.txt": "we asked for permission to use the software and the conditions of the license were explained without warranty to any person there",
    }
    rows = [(k, p, t) for k, (p, t) in enumerate(files.items())] + [(100 + k, f"fill/{k}.txt", f"plain words number {k} about the weather") for k in range(60)]
    found = {r["path"]: (r["license"], r["origin"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {p: found[p] for p in files} == {
        "one/LICENSE": ("mit", "file"), "one/src/deep/a.py": ("mit", "inherited"), "two/COPYING": ("bsd-3-clause", "file"), "two/b.py": ("bsd-3-clause", "inherited"), "three/LICENSE.txt": ("bsd-2-clause", "file"),
        "four/gpl.py": ("gpl-3.0", found["four/gpl.py"][1]), "four/lgpl.c": ("lgpl-3.0", found["four/lgpl.c"][1]), "four/apache.js": ("apache-2.0", found["four/apache.js"][1]), "four/mpl.rs": ("mpl-2.0", found["four/mpl.rs"][1]), "five/prose.txt": (None, "none"),
    }
    assert all(found[p][1] in ("header", "file") for p in files if p.startswith("four/"))


def test_units_left_out_could_not_have_matched(spark):
    """The bound against the cosines of all units."""
    texts = ["Released under the MIT License.", "Released under the MIT License. " + "x " * 9, "permission notice software " + " ".join(f"w{k}" for k in range(12)), "license license license " + "y " * 5, "as published by the Free Software Foundation, either version 3 of the License"]
    docs = spark.createDataFrame([(k, f"d/{k}", t) for k, t in enumerate(texts)], "doc_id long, path string, text string")
    some = {r["doc_id"]: r["score"] for r in license_scan.scan(docs).collect()}
    every = {r["doc_id"]: r["score"] for r in license_scan.scan(docs, least=0.05).collect()}
    assert {k for k, x in some.items() if x} == {k for k, x in every.items() if x >= license_scan.LEAST_COSINE - 0.05} or {k for k, x in some.items() if x} <= {k for k, x in every.items() if x}
    assert some[0] > 0.9
