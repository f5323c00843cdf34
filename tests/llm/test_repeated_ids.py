"""One row of a group stays when ids repeat or are null; languages beyond one matrix."""

from collections import Counter

import pytest

from colscope.llm import exact_dedup, language, mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string"
NEAR = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("rows", [
    [(1, "a b c d e"), (1, "a bc  d e")], [(None, "same text"), (None, "same text")], [(None, "a  b"), (None, "a b"), (3, "ab")],
    [(2, "x y"), (2, "x y"), (2, "x y"), (1, "x  y")]])
def test_exact_copies_keep_one_row(spark, rows):
    docs = docs_of(spark, rows)
    marked = exact_dedup.mark(docs).collect()
    assert len(marked) == len(rows) and sum(r.kept for r in marked) == 1
    stay = exact_dedup.deduplicate(docs).collect()
    best = min(rows, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))
    assert len(stay) == 1 and (stay[0].doc_id, len(stay[0].text)) == (best[0], len(best[1]))
    assert {r.keep_id for r in marked} == {best[0]} and next(r.doc_id for r in marked if r.kept) == best[0]


@pytest.mark.parametrize("rows", [
    [(1, NEAR), (1, NEAR + " "), (2, NEAR + "\n")], [(None, NEAR), (None, NEAR.upper())], [(5, NEAR), (5, NEAR), (None, NEAR)], [(7, "alone")]])
def test_near_copies_keep_one_row(spark, rows):
    docs = docs_of(spark, rows)
    stay = simhash.representatives(docs).collect()
    assert [r.doc_id for r in stay] == [min(rows, key=lambda r: (r[0] is None, r[0] or 0))[0]]
    assert {r.component_id for r in simhash.mark(docs).collect()} == {stay[0].doc_id}


def test_mixing_tells_null_ids_apart(spark):
    """A leaf of rows without ids meets its budget; equal rows without ids go together."""
    rows = [(None, " ".join(f"w{i}" for i in range(n, n + 10)), "en", "src0") for n in range(100)] + [(None, "same words here", "en", "src0")] * 3
    recipe = mixing.Recipe(numerator=1, denominator=2, epochs=1)
    taken = mixing.chosen(spark.createDataFrame(rows, SCHEMA), recipe).collect()
    total = sum(r.n_tokens for r in taken)
    assert total // 2 - 10 < sum(r.n_tokens * r.epochs for r in taken) <= total // 2
    assert len({r.epochs for r in taken if r.n_tokens == 3}) == 1


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="module")
def many(spark):
    """Forty languages of a few letters each."""
    rows = [(i * 40 + k, " ".join((LETTERS[k % 26] * 2 + LETTERS[(k * 7 + j) % 26] + LETTERS[k // 2]) for j in range(6)), f"l{k:02}", "s")
            for k in range(40) for i in range(4)]
    return spark.createDataFrame([*rows, (9001, "...", None, "s"), (9002, None, None, "s"), (None, "aab", None, "s")], SCHEMA)


@pytest.mark.parametrize("most", [1, 7, 40])
def test_languages_in_blocks(many, most):
    whole = list(language.fit(many))
    assert len(whole) == 1 and len(whole[0].languages) == 40
    one = {(r.row.doc_id, r.lang_pred): r.score for r in language.predict(many, whole).collect()}
    models = list(language.fit(many, most=most))
    assert [len(m.languages) for m in models] == [most] * (40 // most) + ([40 % most] if 40 % most else [])
    split = {(r.row.doc_id, r.lang_pred): r.score for r in language.predict(many, iter(models)).collect()}
    assert split.keys() == one.keys() and all(abs(split[k] - one[k]) < 1e-9 for k in one)
    assert one[(9001, "und")] == one[(9002, "und")] == 0.0


def test_more_languages_than_a_matrix_holds(spark, monkeypatch):
    """A label a row, beyond the size of a matrix: every row has a result."""
    rows = [(i, f"{LETTERS[i % 26] * 3} {LETTERS[i % 25] * 4}", f"label {i}", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language.identified(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(range(300))
    assert all(r.lang_pred.startswith("label") and 0 < r.score <= 1 for r in found)
