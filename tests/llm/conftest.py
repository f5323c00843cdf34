import os

import pytest

FOLDER = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [
    None, "", " \t\n\r\x0b\x0c", "one", "One two three", "a b c a b c a b c a b c", "x\n\nx\nx \n y", "été ünïcode ß İstanbul K 漢字 😀 ok",
    " nbsp wide", "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "cc by nc cc by-nc CC, BY. NC",
    LONG, LONG + " tail", "same text here", "same  text\nhere", "sametexthere", "it's I'LL don't 1234567 12 34 --- !!!   end  ", "A" * 700 + " " + "=" * 500,
    "same text here", "\x01\x02 control \x00 zero", "### $$$ %% && <a|b>",
]


@pytest.fixture(scope="session")
def edge(spark):
    """Awkward rows: null ids, texts, languages and sources, repeated rows, and columns with the operators' own names."""
    rows = [(None if i == 4 else i % 19, t, [None, "en", "de", ""][i % 4], [None, "src0", "src0", "src9", "x"][i % 5], None, 1.5, "r", "k", 7)
            for i, t in enumerate(TEXTS)]
    rows += [rows[13]] * 3 + [(None, None, None, None, None, None, None, None, None)] * 2
    schema = ("doc_id long, text string, lang string, source string, n_chars long, text_sha256 double, `row` string, `a.b` string, maybe int")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def edge_rows(edge):
    return edge.collect()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
