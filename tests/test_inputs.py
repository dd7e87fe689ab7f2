"""Configurations, files, plug-ins and the ways to choose evidence."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscan import config as C
from folioscan.operators import inputs as I
from folioscan.operators import models as M
from folioscan.plans import answering as Q
from folioscan.sources import records, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors can't import tests


def test_configuration():
    merged = C.merge({"a": 1, "page_retrieval": None}, {"a": None, "b": 2}, {"b": 3})
    assert merged == {"a": 1, "b": 3, "seed": 42, "page_retrieval": "concat"}
    assert C.check({"page_retrieval": "concat", "max_pages": 3}) == ["max_pages is ignored with concat retrieval"]
    assert len(C.check({"page_retrieval": "none"})) == 1 and C.check({"page_retrieval": "none", "single_page": True}) == [] == C.check({"page_retrieval": "custom", "hierarchical": True})
    for bad in ({"page_retrieval": "custom"}, {"page_retrieval": "concat", "hierarchical": True}, {"page_retrieval": "no"}):
        with pytest.raises(ValueError):
            C.check(bad)
    assert C.overridden({"a": 1}, ["a=2", "b=True", "c=x=y", "d"]) == {"a": 2, "b": True, "c": "x=y"}
    assert C.flatten({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"b": 1, "d": 2, "e": 3}
    assert [(r["k"], r["size"]) for r in C.runs({"run": {"k": [1, 2], "size": [60, 80], "visible_devices": [0, 1], "x": 5}})] == [(1, 60), (2, 80)]
    with pytest.raises(ValueError):
        C.runs({"a": [1, 2], "b": [1]})
    assert (C.numbers("[2-5]"), C.numbers("[1, 7]"), C.numbers("4"), C.numbers(None)) == ([2, 3, 4], [1, 7], [4], None)


def test_readable_json():
    value = {"n": 1, "rows": [{"a": [1, 2]}, {"text": "x" * 100}], "none": None, "empty": {}}
    for level in (0, 1, 2, 9):
        assert json.loads(C.readable(value, from_level=level)) == value
    assert C.readable({"a": [1, {"b": 2}]}) == '{"a": [1, {"b": 2}]}'
    assert C.readable({"a": [1, 2]}, from_level=1) == '{\n  "a": [1, 2]\n}'
    assert C.readable([1, [2]], from_level=9) == "[\n  1,\n  [\n    2\n  ]\n]"
    assert C.simple([1, "a", {"b": None}]) and not C.simple({1: 2}) and not C.simple(object())


def test_files(spark, tmp_path):
    made = []
    path = str(tmp_path / "once")
    for _ in range(2):
        assert records.once(spark, path, lambda: made.append(1) or spark.range(3)).count() == 3
    assert made == [1]
    (tmp_path / "img").mkdir()
    (tmp_path / "ocr").mkdir()
    for name in ("d_2", "d_10", "e_1"):
        (tmp_path / "img" / f"{name}.png").write_bytes(name.encode())
    for name, text in (("d_2", "two"), ("d_10", "ten")):
        (tmp_path / "ocr" / f"{name}.json").write_text(json.dumps({"LINE": [{"Text": text}], "WORD": [{"Text": text, "Geometry": {"Polygon": [{"X": k, "Y": k} for k in (0.1, 0.2, 0.3, 0.4)]}}]}))
    both = {r["name"]: r for r in records.images_with_ocr(spark, str(tmp_path / "img"), str(tmp_path / "ocr")).collect()}
    assert both["d_2"]["words"] == ["two"] and both["d_2"]["boxes"][0]["x0"] == 0.1 and both["d_2"]["boxes"][0]["x1"] == 0.3 and both["e_1"]["words"] is None and both["d_10"]["length"] == 4
    assert [(r["document"], r["lines"]) for r in records.ocr_documents(spark, str(tmp_path / "ocr")).collect()] == [("d", ["two", "ten"])]
    asked = spark.createDataFrame([("q", ["d_10", "gone"])], "question_id string, image_name array<string>")
    held = records.pages_with_images(asked, records.images(spark, str(tmp_path / "img"))).orderBy("page_idx").collect()
    assert [(r["page_idx"], r["image_name"], r["content"] and bytes(r["content"])) for r in held] == [(0, "d_10", b"d_10"), (1, "gone", None)]
    boxes = spark.createDataFrame([("a", 1, (0.0, 0.1, 0.2, 0.3), 2, None), ("a", 0, (0.0, 0.0, 1.0, 1.0), 1, 3)], "image_name string, box_id long, box struct<x0:double,y0:double,x1:double,y1:double>, label int, cluster int")
    sinks.write_layouts(boxes, str(tmp_path / "layouts"))
    assert sorted(map(tuple, records.read_layouts(spark, str(tmp_path / "layouts")).select("box_id", "label", "cluster").collect())) == [(0, 1, 3), (1, 2, None)]
    (tmp_path / "prompt.txt").write_text("\n  ask this \n")
    assert records.prompt(spark, str(tmp_path / "prompt.txt")) == "ask this"


def characters():
    """A parser of files that hold lines of text: characters are 10 wide and 20 high on a page of 100 by 200."""

    def read(content):
        for line, text in enumerate(content.decode().split("\n")):
            for i, c in enumerate(text):
                yield 0, line, i, c, 10.0 * i, 180.0 - 20 * line, 10.0 * (i + 1), 200.0 - 20 * line, 100.0, 200.0

    return read


def test_document_words(spark, tmp_path):
    (tmp_path / "a.doc").write_text("to be or\nnot so wide a line")
    got = records.document_words(spark, str(tmp_path), characters).orderBy("line", "first").collect()
    assert [(r["document"], r["page"], r["line"], r["word"]) for r in got] == [("a", 0, 0, w) for w in ("to", "be", "or")] + [("a", 0, 1, w) for w in ("not", "so", "wide", "a", "line")]
    side = lambda r: tuple(round(v, 6) for v in r["box"])
    assert side(got[1]) == (0.3, 0.0, 0.5, 0.1) and side(got[3]) == (0.0, 0.1, 0.3, 0.2) and side(got[7]) == (1.0, 0.1, 1.0, 0.2)


def test_summary(spark):
    scores = spark.createDataFrame([(1.0,), (None,), (0.5,), (None,)], "anls double")
    row = sinks.run_summary(scores, ["anls"], {"load": 1.0, "answer": 3.0}, model="m").first()
    assert (row["model"], row["n"], row["anls"], row["failure_rate"], row["answer_time"]["share"], row["load_time"]["mean"]) == ("m", 4, 0.375, 0.5, 0.75, 0.25)


def test_image_plug_ins(spark):
    rows = spark.createDataFrame([(b"\x00\xff" * 50,), (None,)], "image binary")
    got = rows.select(M.image_vectors(F.col("image")).alias("v"), M.layout(F.col("image")).alias("l"), M.seen_answer(F.lit("the cat"), F.lit("A dog. The cat sat."), F.array("image")).alias("a")).collect()
    assert [len(r["v"]) for r in got] == [4, 0] and got[0]["v"][0] == [0.52, 0, 0, 0, 0, 0, 0, 0.48] and got[0]["l"]["labels"] == [1] and got[1]["l"]["boxes"] == []
    assert got[0]["a"]["answer"] == "The cat sat."
    mask = np.zeros((8, 8), bool)
    mask[1:3, 1:4] = mask[5:8, 6] = mask[4, 5] = mask[0, 7] = True
    assert M.mask_boxes(mask) == [(1, 1, 4, 3), (5, 4, 7, 8)]

    def short():
        def find(question, output):
            return {"long": "s"}[output]

        return find

    out = spark.createDataFrame([("long",), ("other",)], "o string")
    assert [r[0] for r in out.select(M.extracted(F.lit("q"), F.col("o"), short)).collect()] == ["s", "other"]
    assert [r[0] for r in out.select(M.extracted(F.lit("q"), F.col("o"))).collect()] == ["long", "other"]


def test_unanswerable(spark):
    rows = [([float(i % 2), 0.0], [0.0, float(i % 2)], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "question_vector array<double>, context_vector array<double>, label double")
    assert all((r["chance"] > 0.5) == (r["label"] == 1) for r in M.fit_unanswerable(df)(df).collect())


PAGES = [(1, 0, "the red cat sat on the mat today"), (1, 1, "a blue dog ran in the park"), (1, 2, "green birds sing"), (2, 0, "only one page here about fish")]


@pytest.fixture(scope="module")
def asked(spark):
    pages = spark.createDataFrame([(d, p, t.split()) for d, p, t in PAGES], "doc_id long, page_idx long, words array<string>")
    questions = spark.createDataFrame([("a", 1, "blue dog", 1), ("b", 2, "fish page", 0)], "question_id string, doc_id long, question string, gold_page long")
    return questions, pages


class Echo:
    """The context itself is the answer."""

    def answer(self, questions, contexts):
        return [(c, 1.0) for c in contexts]


def contexts(rows):
    return {r["question_id"]: ([a["answer"] for a in r["answers"]], r["pages"]) for r in rows.collect()}


def test_modes_without_retrieval(asked):
    questions, pages = asked
    text = {(d, p): t for d, p, t in PAGES}
    got = contexts(Q.answer_questions(questions, pages, "whole", answerer=Echo))
    assert got == {"a": ([" ".join(text[1, p] for p in range(3))], [0, 1, 2]), "b": ([text[2, 0]], [0])}
    assert contexts(Q.answer_questions(questions, pages, "none", answerer=Echo))["b"] == ([text[2, 0]], [0])
    for most in (1, 2, 3):
        answers, listed = contexts(Q.answer_questions(questions, pages, "custom", answerer=Echo, max_pages=most))["a"]
        assert len(listed) == most and 1 in listed and listed == list(range(listed[0], listed[0] + most))
        assert answers == [" ".join(text[1, p] for p in listed)]


def test_rerank_and_surroundings(asked):
    questions, pages = asked
    rule = Q.C.ChunkRule(3, 0.0, 0)
    plain = Q.retrieve(questions, pages, 10, rule, M.HashedTerms).filter("question_id = 'a'").collect()
    assert len(plain) == 7
    kept = Q.reranked(Q.retrieve(questions, pages, 10, rule, M.HashedTerms), Q.Rerank(threshold=0.5, most=1)).filter("question_id = 'a'").collect()
    assert [(r["rank"], r["words"]) for r in kept] == [(1, ["a", "blue", "dog"])]
    one = Q.answer_questions(questions, pages, "concat", k=1, rule=rule, answerer=Echo, rerank=Q.Rerank(), around=2)
    assert contexts(one)["a"] == (["a blue dog ran in"], [1])
    two = Q.with_surroundings(Q.retrieve(questions, pages, 10, rule, M.HashedTerms), pages, rule, 100).filter("question_id = 'a'").collect()
    taken = [w for r in sorted(two, key=lambda r: r["rank"]) for w in r["words"]]
    assert sorted(taken) == sorted(" ".join(t for d, _, t in PAGES if d == 1).split())  # every word of a page is taken once


def test_pasted_and_patches(spark):
    sizes = spark.createDataFrame([([],), ([(10, 5), (8, 9), (4, 2)],)], "p array<struct<width:int,height:int>>")
    got = [sizes.select(I.pasted(F.col("p"), m).alias("v")).collect() for m in ("horizontal", "vertical", "grid")]
    assert [(r[1]["v"]["width"], r[1]["v"]["height"], [tuple(a) for a in r[1]["v"]["at"]]) for r in got] == [(22, 9, [(0, 0), (10, 0), (18, 0)]), (10, 16, [(0, 0), (0, 5), (0, 14)]), (10, 13, [(0, 0), (0, 5), (0, 14)])]
    assert all((r[0]["v"]["width"], r[0]["v"]["height"], r[0]["v"]["at"]) == (5, 5, []) for r in got)
    with pytest.raises(ValueError):
        I.pasted(F.col("p"), "heap")
