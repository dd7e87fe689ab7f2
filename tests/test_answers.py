"""Answer metrics on values whose scores follow from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as X

ACCURACY = [
    (["x"], "not answerable", "not-answerable", 0), (["x"], "None", "not-answerable", 1), (["x"], None, "not-answerable", 1),
    (["none"], "none", "string", 0), (["3.7"], "3", "int", 0), (["3"], "3.7", "int", 0), (["+3"], "3.7", "int", 1), (["-3"], "-3.5", "int", 1), (["3", "x"], "3", "int", 1), (["+3", "x"], "3", "int", 0),
    (["3", "4"], "4", "int", 1), (["+3", "+4"], "4", "int", 1), (["+3", "+4"], "4.9", "int", 1), (["1_000"], "1e3", "int", 1), (["+5"], "nan", "int", 0), (["+5"], "5d", "int", 0),
    (["3.5"], "3.52", "float", 0), (["3.5"], "3.505%", "float", 1), (["3.5%", "x"], "3.5", "float", 0), (["3%5"], "35", "float", 0), (["nan"], "nan", "float", 0),
    (["[[b,a]]"], "a,b", "list", 1), (["a, b"], "b,a", "list", 0), (["Paris "], " paris", "string", 1), (["page 3"], "page 4", "string", 0), (["2020-01"], "2020-01", "float", 1),
    (["a"], "A", None, 1),
]

ANLS = [
    (["nine"], "none", "string", 0), (["nine"], "nina", "string", 0.75), (["ab"], "ac", "string", 0.5), (["abc"], "xyc", "string", 0), (["a"], "", "not-answerable", 0),
    (["a"], "none", "not-answerable", 1), (["", "a"], "a", "string", 0), (["", "a"], "none", "string", 1), (["page 3"], "page 4", "string", 0), (["+7"], "7.2", "int", 1),
]

SCORES = [
    ("-3", "-3.5", "Int", 1), ("3.5", "3", "Int", 0), ("$5", "5", "Int", 0), ("5", "five", "Int", 0), ("", "x", "Int", 1), ("5", "5.9", "Int", 1),
    ("12.5", "12.6", "Float", 1), ("12.5", "0.125", "Float", 1), ("12.5", "1250%", "Float", 1), ("12.5", "14", "Float", 0), ("0.3", "0", "Float", 1), ("0.3", "0.02", "Float", 0), ("x", "1", "Float", 0), ("$3", "3.0", "Float", 1),
    ("Paris (France)", "'paris'", "Str", 1), ("(a) 'b'", "b", "Str", 1), ("abcd", "abxd", "Str", 0.75), ("ab", "ac", "Str", 0), ("2020-01", "2020-02", "Str", 0), ("http://a.b", "http://a.c", "Str", 0.9), ("", "", "None", 1), ("notesipynb", "notesipynx", "Str", 0),
    ("['b, c', 'a']", "['a', \"b, c\"]", "List", 1), ("['a', 'b']", "['a']", "List", 0), ("[1, 2]", "[2, 1]", "List", 1), ("[1, 2]", "[2, 3]", "List", 0), ("['abcd', 'x']", "['abxd', 'x']", "List", 0.75), ("a, b", "b, a", "List", 0), ("['it\\'s']", "[\"it's\"]", "List", 1), ("[]", "[]", "List", 0),
]


@pytest.mark.parametrize(("rows", "score"), [(ACCURACY, X.accuracy), (ANLS, X.anls)])
def test_scores_of_right_answers(spark, rows, score):
    table = spark.createDataFrame([(i, *r[:-1], float(r[-1])) for i, r in enumerate(rows)], "i int, golds array<string>, pred string, kind string, want double")
    got = table.withColumn("got", score(F.col("golds"), F.col("pred"), F.col("kind"))).orderBy("i").collect()
    assert [(r["golds"], r["pred"], r["kind"], r["got"]) for r in got] == [(r["golds"], r["pred"], r["kind"], r["want"]) for r in got]


def test_scores_of_the_report(spark):
    table = spark.createDataFrame([(i, *r[:-1], float(r[-1])) for i, r in enumerate(SCORES)], "i int, gold string, pred string, kind string, want double")
    got = table.withColumn("got", F.round(X.eval_score(F.col("gold"), F.col("pred"), F.col("kind")), 6)).orderBy("i").collect()
    assert [(r["gold"], r["pred"], r["kind"], r["got"]) for r in got] == [(r["gold"], r["pred"], r["kind"], r["want"]) for r in got]


def test_decimals_as_python_writes_them(spark):
    values = [0.0, 1.0, 0.1, 12.345, 1e-4, 1.5e-4, 1e-5, 1.25e-7, 1e7, 1.2345678e7, 1e16, 1.5e16, 123456.789, 3e-12]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", X.decimals(F.col("x")).alias("n")).collect()
    assert [(r["x"], r["n"]) for r in got] == [(v, len(str(v).split(".")[-1]) if "." in str(v) else 3) for v in values]
