"""Personal data: base spans beside regular expressions of Python, added spans on sentences that the trees haven't seen."""

import hashlib
import math
import random
import re
from itertools import accumulate

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from colscope.llm import pii
from colscope.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
            "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def parsed(spans):
    return [(k, int(a), int(z)) for k, a, z in (s.split(":") for s in spans.split(",") if s)]


def check(row, text):
    base = base_spans(text)
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
    assert row.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
    spans = parsed(row.spans)
    assert set(base) <= set(spans) and len(spans) == len(base) + row.n_added
    assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), *s[1:]))
    added = sorted((a, z) for k, a, z in spans if (k, a, z) not in set(base))
    assert all(z <= a or b <= c for c, z in added for _, a, b in base)
    assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))


PIECES = ["a.b", "x@y.de", "@", ".", "..", "_d@e.f", "é@ü.fr", "1.2.3.4", "256.1.1.1", "007.1.2.3", ".5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "-", " ", "  ",
          "+1 (555) 555-0100", "+", "(", ")", "+49", "12", "0", "😀", "漢", "\n", "4012888888881881", "3782 822463 10005", "1990-1995", "00", "%", "bob at home dot org", "fe80::1:2:3",
          "12:30:45", "5555.5555.5555.4444", "(212) 555-0199", "=", "a" * 70]


def awkward():
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 12))) for _ in range(600)]


# Long texts, with the number of base spans of each kind: brute force would be quadratic on most.
LONG = [("a" * 200_000, [0, 0, 0, 0]), ("1" * 200_000, [0, 0, 0, 0]), ("1 " * 100_000, [0, 0, 0, 0]), ("+1" + "(" * 200_000, [0, 0, 0, 0]),
        ("a@b" + ".c" * 100_000, [1, 0, 0, 0]), (".1" * 4_000, [0, 1_000, 0, 0]), ("+1 - " * 50_000, [0, 0, 0, 0]), ("a@" * 50_000, [0, 0, 0, 0]),
        (" ".join(f"user{i}@example.org and 10.0.{i % 256}.7" for i in range(1_500)), [1_500, 1_500, 0, 0])]

ADDED = [("reach sue under ", "sue.miller [at] example [dot] org", " any day", "email"), ("my number, call ", "(646) 555-0147", " at night", "phone"),
         ("she paid by amex card ", "3714 496353 98431", " yesterday", "card"), ("the server at address ", "2001:db8:85a3:8d3:1319:8a2e:370:7348", " is mine", "ip"),
         ("schreib an ", "jürgen.groß@beispiel.de", " heute", "email"), ("telephone ", "0044 20 7946 0958", " please", "phone")]
CLEAN = ["The train left at 12:30:45 and came at 13:02:10.", "Order 4111-1111-1111-1112 was shipped.", "Version 300.1.2.3 and section 4.2.1 of the book.",
         "A total of 123.456.789 dollars for 100 200 300 units.", "In the years 1914 1939 1989 all of this changed.", "Look at the dot on the map. Then go on @ noon.",
         "isbn 978-3-1614-8410-0 in print", "1 + 2 = 3, +12 and 7.", "Plain words and nothing else, again and again, at home."]


@pytest.fixture(scope="module")
def model(documents):
    return pii.learned(documents)


@pytest.fixture(scope="module")
def results(spark, documents, model):
    texts = [None, "", *awkward(), *[t for t, _ in LONG], *[a + v + b for a, v, b, _ in ADDED], *CLEAN, *CLEAN]
    made = spark.createDataFrame([(-i, t, "x", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, spans string, `a.b` double")
    docs = made.unionByName(documents.withColumns({"spans": F.lit("y"), "a.b": F.lit(0.0)}).select("doc_id", "text", "spans", "`a.b`").filter("doc_id > 0"))
    rows = {r.doc_id: r for r in pii.digested(pii.found(docs, model=model)).collect()}
    return texts, rows


def test_base_spans(results, texts):
    made, rows = results
    assert len(rows) == len(made) + sum(i > 0 for i in texts)
    for i, text in enumerate(made):
        if len(text or "") < 5_000:
            check(rows[-i], text)
    for text, counts in LONG:
        row = rows[-made.index(text)]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
    for i, text in texts.items():
        if i > 0:
            check(rows[i], text)


def test_added_spans(results):
    made, rows = results
    for before, value, after, kind in ADDED:
        row = rows[-made.index(before + value + after)]
        assert (kind, len(before), len(before) + len(value)) in parsed(row.spans), (value, row.spans)
    for text in CLEAN:
        assert rows[-made.index(text)].spans == "", text


def test_clean_documents_are_left_alone(results, texts):
    """Documents without a digit, an @ or a bracket have nothing; the others little that isn't base."""
    _, rows = results
    plain = [i for i, t in texts.items() if i > 0 and not re.search(r"[0-9@]", t or "")]
    assert plain and all(rows[i].spans == "" for i in plain)
    assert sum(rows[i].n_added for i in texts if i > 0) <= len(texts) // 100


def test_query_and_edges(spark, edge, edge_rows, empty, folder, texts, model):
    rows = QUERIES["op11_pii"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert pii.digested(pii.found(empty)).collect() == []
    found = pii.digested(pii.found(edge, model=model)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in edge_rows)


def test_redacted(spark, model):
    rows = [(1, "mail a@b.de or 4111 1111 1111 1111, +1 (555) 555-0100.", "k"), (2, None, "k"), (3, "nothing here", None), (4, "é x@y.fr", ""),
            (5, "x 1.2.3.4 +4111 1111 1111 1111 y", "overlap")]
    docs = spark.createDataFrame(rows, "doc_id int, `the text` string, `row` string")
    out = {r.doc_id: r for r in pii.redacted(docs, "the text", model).collect()}
    assert [out[i]["the text"] for i in range(1, 6)] == ["mail [EMAIL] or [CARD], [PHONE].", None, "nothing here", "é [EMAIL]", "x [IP] +[CARD] y"]
    assert out[1].asDict().keys() == {"doc_id", "the text", "row"} and out[5]["row"] == "overlap"


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 1_500])
def test_running(spark, size):
    rng = random.Random(size)
    values = [rng.randint(0, 9) for _ in range(size)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums = pii.running(F.col("v"), lambda a, b: a + b, 0)
    row = df.select(sums.alias("sums"), pii.earlier(sums, 0).alias("before"), pii.running(F.col("v"), lambda a, b: F.greatest(a, b), 0).alias("most")).first()
    assert row.sums == list(accumulate(values)) and row.before == [0, *accumulate(values)][:size] and row.most == list(accumulate(values, max))


def test_luhn(spark):
    values = ["", "0", "4111111111111111", "4111111111111112", "378282246310005", "1" * 40]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(pii.luhn(F.col("v"))).collect()
    assert [r[0] for r in rows] == [bool(v) and len(v) <= 32 and luhn(v) for v in values]


def test_calibration():
    assert pii.rising([(0.0, 0, 10), (1.0, 5, 10), (2.0, 4, 10), (3.0, 10, 10)]) == [(0.0, 0.0), (1.0, 0.45), (3.0, 1.0)]
    assert pii.threshold([(0.0, 0, 10), (1.0, 5, 10), (3.0, 10, 10)]) == 3.0
    assert pii.threshold([(0.0, 1, 10)]) == math.inf and pii.threshold([]) == math.inf


def test_trees_as_columns(spark):
    """The column expression scores as the trained model does."""
    rows = spark.range(400).select(*[F.pmod(F.xxhash64("id", F.lit(n)), F.lit(7)).cast("double").alias(f"f{n}") for n in range(4)])
    rows = rows.withColumn("label", (F.col("f0") * F.col("f1") > F.col("f2") + 4).cast("double"))
    data = VectorAssembler(inputCols=[f"f{n}" for n in range(4)], outputCol="vector").transform(rows)
    fitted = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=4, maxDepth=3, seed=1).fit(data)
    model = pii.Model(tuple(pii._nodes(t._java_obj.rootNode()) for t in fitted.trees), tuple(fitted.treeWeights))
    both = fitted.transform(data).withColumn("own", model.margin(F.array(*[F.col(f"f{n}") for n in range(4)])))
    assert all(abs(r.rawPrediction[1] - r.own) < 1e-9 for r in both.select("rawPrediction", "own").collect())
