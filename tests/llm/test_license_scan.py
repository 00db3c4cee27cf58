from pyspark.sql import functions as F

from millrace.llm import license_scan
from millrace.llm.license_scan import KNOWN, TEXTS, canonical, known_licenses, scan

MIT = next(t for n, t in KNOWN if n == "MIT" and len(t) > 500)


def test_canonical_forms():
    pairs = [
        ("Released under the MIT Licence", "released under the MIT license."),
        ("Copyright (c) 2020 A. Person\nAll rights reserved.\n\n" + MIT.upper().replace(". ", ".\n"), MIT),
        ("Licensed   under\tthe “Apache License”, version 2.0!", "Licensed under the Apache License, Version 2.0"),
        ("licensed under the GPL, v 3", "Licensed under the GNU General Public License, version 3"),
        ("non-commercial per cent licence licence", "NonCommercial percent license license"),
    ]
    for a, b in pairs:
        assert canonical(a) == canonical(b) != ""
    assert canonical(pairs[2][0]).endswith("version 2.0")


def test_whole_texts_and_lines(spark, docs):
    rows = [
        (1, MIT),
        (2, "Some prose.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.\nreleased under the mit licence"),
        (3, "We discuss the MIT License at length."),
        (4, None),
        (5, "©\n...\n"),
        (6, "x " * 100_000),
        (7, "Licensed under CC BY-NC 4.0."),
        (7, "Licensed under CC BY-NC 4.0."),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    table = docs(rows).withColumn("digest", F.lit(1)).withColumn("license", F.lit("own"))
    got = sorted((str(r.doc_id), r.license, r.line_licenses, r.n_license_lines) for r in scan(table, known_licenses(spark)).collect())
    assert got == [
        ("1", "MIT", "MIT", 1),
        ("2", None, "Apache-2.0,MIT", 3),
        ("3", None, "", 0),
        ("4", None, "", 0),
        ("5", None, "", 0),
        ("6", None, "", 0),
        ("7", "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        ("7", "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
        ("None", "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1),
    ]


def test_whole_licence_documents(spark, docs):
    names = {"Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense"}
    texts = {f.stem: f.read_text() for f in TEXTS.glob("*.txt")}
    assert {n.split("+")[0] for n in texts} == names
    bsd, gpl, apache = texts["BSD-3-Clause"], texts["GPL-3.0"], texts["Apache-2.0"]
    holder = "Copyright (c) 2020, A. Person\nAll rights reserved.\n\n"
    rows = [(n.split("+")[0], t) for n, t in texts.items()]
    rows += [(n.split("+")[0], "  " + " ".join(t.split("\n")[k] + "\n" for k in range(len(t.split("\n"))))) for n, t in texts.items()]
    rows += [("BSD-3-Clause", "BSD 3-Clause License\n\n" + holder + bsd), ("BSD-3-Clause", holder + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "))]
    rows += [("MIT", "MIT License\n\n" + holder + MIT), ("GPL-3.0", gpl[: gpl.index("END OF TERMS")]), ("Apache-2.0", apache[: apache.index("APPENDIX")])]
    rows += [(None, bsd + "and more"), (None, gpl[:-2000]), (None, "Some prose.\n" + apache)]
    got = {r.doc_id: r.license for r in scan(docs([(i, t) for i, (_, t) in enumerate(rows)]), known_licenses(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in rows]


def test_empty_tables(spark, docs):
    assert scan(docs([]), known_licenses(spark)).count() == 0
    none = spark.createDataFrame([], "license string, digest binary")
    assert [r.license for r in scan(docs([(1, MIT)]), none).collect()] == [None]


def test_time_grows_with_the_length_of_a_text():
    import time

    texts = ["(c)" + "\n" * 1_000_000, "copyright " + "- " * 500_000 + "x", "all rights reserved" + "\n" * 1_000_000 + "x", "©" + " \n" * 500_000, "(c) " * 250_000]
    for text in texts:
        began = time.perf_counter()
        license_scan.digest(text)
        assert time.perf_counter() - began < 5
