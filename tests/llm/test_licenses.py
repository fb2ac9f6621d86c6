import duckdb
import pytest

from folioweave.llm import licenses


def table():
    texts = ["Released under the MIT License.", "MIT-license mit  License, mit license", "cc by cc BY 4.0", "Licensed under CC BY-NC 4.0.", None, "", "...", "This work is licensed under the GNU General Public License, version 3.\nand more",
             "licensed under apache version 2 0 license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "x\ny", "MİT license", "é mit license", "gnu general public", "license mit", "word " * 30000 + "mit license", "Licensed under\nthe Apache License\nVersion 2.0", "\x00mit\x7flicense\x7f"]
    return [(i, t, "s", 0.5) for i, t in enumerate(texts)]


def test_equal_to_sql(spark):
    rows = table()
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    got = sorted(tuple(r) for r in licenses.license_scan(df).collect())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(licenses.oracle()).fetchall())
    assert got == want
    by = {r[0]: r for r in got}
    assert by[1][1:5] == (6, 3, 0, 4) and by[1][5] == "mit"
    assert by[2][2] == 2 and by[4][1:] == (0, 0, None, None, "", "", 0.0)
    assert "cc-by-nc-4.0" in by[3][6] and "gpl-3.0" in by[7][6] and by[8][5] == "" and by[8][6] == "apache-2.0"


NOTICES = {
    "Licensed under the Mozilla Public License, Version 2.0": "mpl-2.0",
    "licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "licensed under CC BY-NC-ND 4.0": "cc-by",
    "released under the license": "",
    "released under the BSD license": "bsd",
    "you may redistribute it under the GNU Lesser General Public License version 2": "",
    "This work is licensed under the GNU General Public License, version 2.": "gpl",
    "under the terms of the GNU Lesser General Public License": "lgpl",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
    "the license was released under the sea, and the version of the apache was 2": "",
}
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"


def test_near_misses_and_wrapped_notices(spark):
    texts = list(NOTICES) + [f"x{w * 40} " + BSD.replace(" ", "\n# ") + f" {w * 70}" for w in (" of", " word", "\n")] + ["\n".join(BSD.split()[:8])]
    wrapped = [" ".join(t for t in text.split()) for text in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES.values())
    assert [got[i] for i in range(len(NOTICES), len(texts))] == ["bsd", "bsd", "bsd", ""]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts + wrapped)))
    want = con.execute(licenses.oracle()).fetchall()
    both = spark.createDataFrame(list(enumerate(texts + wrapped)), "doc_id long, text string")
    assert sorted(map(tuple, licenses.license_scan(both).collect())) == sorted(want)


def test_rows_and_nothing(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "cc by"), (1, "other")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_base) for r in licenses.license_scan(df).collect())
    assert got == [("1", 0), ("1", 1), ("1", 1), ("None", 1)]
    assert licenses.license_scan(df.where("false")).count() == 0


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.sql("select id as doc_id, concat('mit license ', id) as text from range(9)")
    facts = licenses.scanned(docs, licenses.Notices())
    for df in (facts, licenses.matching_blocks(facts, licenses.Notices()), licenses.license_scan(docs)):
        df.explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("size,need", [(5, 4), (6, 5), (10, 8)])
def test_need(size, need):
    assert licenses._need(size, 0.8) == need
