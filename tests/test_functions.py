import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kgspark import validate
from kgspark.functions import literals as L
from kgspark.functions import text as T


def one(spark, rows, *columns):
    names = [f"c{i}" for i in range(len(rows[0]))]
    return [tuple(r) for r in spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).select(*columns).collect()]


@pytest.fixture(scope="module", autouse=True)
def columns(spark):
    globals().update(A=F.col("c0"), B=F.col("c1"))


def test_similarities(spark):
    rows = [("red plate", "red plates"), ("red plate", "red plate"), ("ab cd", "ab ce"), ("plate red", "red plate"), ("", ""), ("été", "ete")]
    found = one(spark, rows, T.edit_similarity(A, B), T.overlap(T.token_set(A), T.token_set(B)), T.overlap(T.trigrams(A), T.trigrams(B)))
    expected = [(0.9, 0.5, 0.8), (1.0, 1.0, 1.0), (0.8, 0.5, 0.0), (1 - 8 / 9, 1.0, 1.0), (1.0, 0.0, 0.0), (1 / 3, 0.0, 0.0)]
    for f, e in zip(found, expected, strict=True):
        assert f == pytest.approx(e)


def test_clean_and_tokens(spark):
    assert one(spark, [("  A\t\n b  C ",)], T.clean(A)) == [("a b c",)]
    assert one(spark, [("a  b",)], F.size(T.tokens(A)), F.size(T.analysed(A))) == [(3, 2)]


def test_abbreviations(spark):
    assert one(spark, [("John Ronald Tolkien",), ("Cher",)], T.abbreviations(A)) == [(["John Ronald Tolkien", "J. Ronald Tolkien", "J. R. Tolkien"],), (["Cher"],)]


def test_knowledge_graph(spark):
    assert [r[0] for r in one(spark, [("Q42",), ("P31",), ("Q42x",), ("Berlin",)], T.knowledge_graph(A))] == ["wikidata", "wikidata", "dbpedia", "dbpedia"]


GOLDEN = {
    "FLOAT": ["2.8", "+1.5e-3", "12 km", "12 kmXYZ", "5 million", "26 may 1997", "26 march 1997"], "INTEGER": ["1997", "-3", "5 thousand", "5-million", "٣"], "URL": ["a@b.com", "google.com", "1997.august"], "EMAIL": ["a+b@c.org"],
    "DATE": ["2,797,800", "26 june 1997", "may 5 1997", "1997–2003", "1997-now", "1997-08-26", "26/08/97", "145 bc"], "DATETIME": ["1997-08-26T10:30"], "TIME": ["10:30", "24:00"],
    "STRING": ["http://x.example.com/a?b=1", "10-20 million", "26 december 1997", "1.5e3", "hello", ""],
}


def test_literal_classes(spark):
    rows = [(text, name) for name, texts in GOLDEN.items() for text in texts]
    assert [(r[1], r[0], r[1]) for r in rows] == one(spark, rows, B, A, L.literal_class(A))


def test_value_types(spark):
    rows = [("2020",), ("2020-01-02",), ("1.5",), ("nan",), ("1e3",), ("abc",), ("",), ("2020-01-02T03:04:05Z",)]
    assert [r[0] for r in one(spark, rows, L.value_type(A))] == ["DATETIME", "DATETIME", "NUMBER", "NUMBER", "NUMBER", "STRING", "STRING", "DATETIME"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab é", max_size=8), st.text("ab é", max_size=8)), min_size=1, max_size=10))
def test_similarities_lie_in_the_unit_interval(spark, pairs):
    for found in one(spark, pairs, T.edit_similarity(A, B), T.overlap(T.token_set(A), T.token_set(B)), T.overlap(T.trigrams(A), T.trigrams(B))):
        assert all(0 <= x <= 1 for x in found)


def test_requests():
    assert validate.boolean("TRUE") and not validate.boolean(None) and not validate.boolean("false")
    assert validate.limit(None) == 1000 and validate.limit("7") == 7 and validate.k(0) == 10 and validate.k(None) == 10
    assert validate.values(["b,a", "a c", None]) == ["a", "b", "c"] and validate.values("B,a", preserve_case=False) == ["a", "b"]
    assert validate.ner_types("LOC, ORG") == ["LOC", "ORG"] and validate.model_type("none") == "fast" and validate.graph(None, ["wikidata"]) == "wikidata"
    for wrong in (lambda: validate.boolean("yes"), lambda: validate.limit("x"), lambda: validate.ner_types("CITY"), lambda: validate.graph("other", ["wikidata"])):
        with pytest.raises(ValueError):
            wrong()
