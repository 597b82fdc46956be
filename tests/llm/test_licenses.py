from cohortline.llm import licenses

MIT = licenses.TEMPLATES[2][1]
APACHE = licenses.TEMPLATES[4][1]
CASES = [
    (None, []), ("", []), ("A license to nothing in particular is granted to Bob.", []),
    ("prose\nLicensed under the Apache License, Version 2.0.\nmore", ["Apache-2.0"]),
    ("x\nlicensed  under the apache license version 2.0\n", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", []),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]), ("Released under the MIT License.", ["MIT"]),
    ("Released under the MIT License.\n\nLicensed under CC BY-SA 4.0.", ["MIT", "CC-BY-SA-4.0"]),
    ("Header\n" + MIT.replace(" to ", "\nto ").replace("free of charge, ", ""), ["MIT"]),
    (APACHE.replace(". ", ".\n"), ["Apache-2.0"]),
    ("words of prose " * 20_000 + "\nLicensed under CC BY-ND 4.0.\n" + "and more " * 9000, ["CC-BY-ND-4.0"]),
    ("Licensed under the MIT License.\n" * 700, ["MIT"] * 700),
]


def test_cases(spark):
    rows = [(i if i % 4 else None, t, "x") for i, (t, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string").repartition(1)
    got = sorted((str(r.doc_id), [m.license for m in r.matches]) for r in licenses.licensed(docs).collect())
    assert got == sorted((str(k), want) for (k, _, _), (_, want) in zip(rows, CASES, strict=True))


def test_spans_and_differences():
    scanner = licenses.Scanner(licenses.TEMPLATES, 9, 0.4, 0.2)
    text = "aé\nLicensed under the nice Apache License, Version 2.0.\nb"
    (m,) = scanner.scan(text)
    assert text[m["start"]:m["stop"]] == "Licensed under the nice Apache License, Version 2.0" and m["added"] == ["nice"] and not m["missing"]
    assert m["with_template_bytes"] < m["alone_bytes"]


def test_every_template_wins_for_itself():
    scanner = licenses.Scanner(licenses.TEMPLATES, 9, 0.4, 0.2)
    for name, text in licenses.TEMPLATES:
        assert [m["license"] for m in scanner.scan(text)] == [name]


def test_given_lines(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: {m.license for m in r.matches} for r in licenses.licensed(docs).collect()}
    lines = {text: name for name, text in licenses.TEMPLATES}
    want = {r.doc_id: {lines[x] for x in r.text.split("\n") if x in lines} for r in docs.collect()}
    assert all(want[k] <= got[k] for k in want)


def test_notices_inside_longer_lines(spark):
    cases = [
        ("Photo essay by Anna Berg about harbour cranes and fishing boats in winter. Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Le texte de cette page est disponible gratuitement pour tous nos lecteurs. Licensed under the Apache License, Version 2.0. "
         "Merci de votre visite et à bientôt.", ["Apache-2.0"]),
        ("harbour cranes " * 300 + MIT + " fishing boats" * 300 + " Released under the MIT License. winter" * 3, ["MIT"] * 4),
        ("prose before " * 30 + " ".join(text for _, text in licenses.TEMPLATES[-4:]), [name for name, _ in licenses.TEMPLATES[-4:]])]
    docs = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "doc_id long, text string")
    got = {r.doc_id: [m.license for m in r.matches] for r in licenses.licensed(docs).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_templates_are_an_argument(spark):
    docs = spark.createDataFrame([(1, "Some words first. Licensed under the Harbour House License. And more.")], "doc_id long, text string")
    (row,) = licenses.licensed(docs, templates=[("house", "Licensed under the Harbour House License.")]).collect()
    assert [m.license for m in row.matches] == ["house"]


def test_words_of_the_opening_elsewhere():
    scanner = licenses.Scanner(licenses.TEMPLATES, 9, 0.4, 0.2)
    text = "The work is licensed under the terms of the license of the work.\nLicensed under the nice Apache License, Version 2.0."
    (m,) = scanner.scan(text)
    assert text[m["start"]:m["stop"]] == "Licensed under the nice Apache License, Version 2.0" and m["added"] == ["nice"]
    long = "Permission is granted to any person, subject to the license terms of the software and the work.\n" + MIT.replace("without restriction, ", "")
    (m,) = scanner.scan(long)
    assert m["license"] == "MIT" and m["missing"] == ["without", "restriction"] and not m["added"] and long[m["start"]:].startswith("Permission is hereby")
