from lexiloom.llm import licences


def test_variants_of_known_texts(spark):
    mit = licences.TEXTS["MIT"]
    variants = [
        mit,
        "Copyright (c) 2024 Some One\n\n" + mit.upper().replace("\n", "\n\n  "),
        "The words\n" + mit,
        "Released under the MIT Licence",
        "intro\nlicensed under CC-BY-NC 4.0!\nReleased under the MIT License.\nmore",
        None,
        "",
        "word " * 50_000,
    ]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(variants)] + [(4, variants[4], "q"), (None, mit, "q")], "doc_id long, text string, license string")
    out = {}
    for r in licences.scan(df, licences.known_licences(spark)).collect():
        out.setdefault(r.doc_id, []).append((r.license, r.n_notices, r.notices))
    assert out[0] == out[1] == out[None] == [("MIT", 0, "")] and out[2] == [(None, 0, "")]
    assert out[3] == [("MIT", 1, "MIT")] and out[4] == [(None, 2, "CC-BY-NC-4.0,MIT")] * 2
    assert out[5] == out[6] == out[7] == [(None, 0, "")]
    assert licences.scan(df.limit(0), licences.known_licences(spark)).isEmpty()


def test_every_notice_is_found(spark):
    rows = [(k, f"first\n  {n.upper()}\nlast") for k, names in licences.NOTICES.items() for n in names]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r.notices for r in licences.scan(df, licences.known_licences(spark)).collect()}
    assert out == {i: k for i, (k, _) in enumerate(rows)}


def test_whole_texts_and_lines_without_the_word_licence(spark):
    bsd = licences.TEXTS["BSD-3-Clause"]
    texts = [licences.TEXTS["Apache-2.0"], "Copyright (c) 2024 Some One\n\n" + bsd, licences.TEXTS["GPL-3.0"], "x\n" + licences.TEXTS["ISC"].replace("\n", " ") + "\ny", "a\nUse it as you like!\npublic domain: cc0"]
    known = licences.known_licences(spark, notices=licences.NOTICES | {"own": ["Use it as you like"], "CC0": ["Public domain, CC0"]})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: (r.license, r.n_notices, r.notices) for r in licences.scan(df, known).collect()}
    assert [out[i][0] for i in range(5)] == ["Apache-2.0", "BSD-3-Clause", "GPL-3.0", None, None]
    assert out[3][1:] == (1, "ISC") and out[4][1:] == (2, "CC0,own")


def test_files_as_people_ship_them(spark):
    mit, isc, bsd = (licences.TEXTS[k] for k in ("MIT", "ISC", "BSD-3-Clause"))
    holder = "Copyright (c) 2021, Some One <one@example.org>"
    files = [
        ("MIT", f"MIT License\n\n{holder}\n\n{mit}\n"),
        ("MIT", f"The MIT License (MIT)\r\n\r\n{holder}\r\n{mit}"),
        ("ISC", f"ISC License\n\n{holder}\n\n{isc}"),
        ("BSD-3-Clause", f"BSD 3-Clause License\n\n{holder}\n{bsd}"),
        ("BSD-3-Clause", f"{holder}\nAll rights reserved.\n\n{bsd}"),
        ("BSD-3-Clause", bsd.replace("\n1. ", "\n * ").replace("\n2. ", "\n * ").replace("\n3. ", "\n * ")),
        ("BSD-3-Clause", bsd.replace("\n1. ", "\n(1) ").replace("\n2. ", "\n2) ").replace("\n3. ", "\n- ")),
        ("Unlicense", licences.TEXTS["Unlicense"].replace("https", "http")),
        ("AGPL-3.0-or-later", "© 2020 Some One\n" + licences.TEXTS["AGPL-3.0-or-later"]),
        (None, f"MIT License\n{holder}\n{mit}\nNot for use on Sundays."),
        (None, "MIT License"),
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(files)], "doc_id long, text string")
    out = {r.doc_id: r.license for r in licences.scan(df, licences.known_licences(spark)).collect()}
    assert out == {i: k for i, (k, _) in enumerate(files)}


def test_files_equal_sql(spark, tmp_path):
    import duckdb

    from ..compare import same

    texts = [None, "", "MIT License\nCopyright 2020 x\r\nReleased under the MIT License.", "(c) 2020\n1. a\n22) b\n123. c\n* d\n-e\n(x) f", "All Rights Reserved\n\u2028© 2020 gone\nLicence & favour", *licences.TEXTS.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    same(licences.scan(df, licences.known_licences(spark)).toPandas(), con.sql(licences.oracle()).df())
