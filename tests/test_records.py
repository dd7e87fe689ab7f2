"""Readers of record files on small files made here."""

import json
import sqlite3

import numpy as np
import pytest

from folioscan.sources import records as R


def test_paged_questions(spark, tmp_path):
    many = {"question_id": 7, "question": "Q?", "answers": ["A", "a", "B"], "answer_page_idx": 1, "image_id": "d", "image_name": ["p0", "p1"], "ocr_tokens": [["x", "y"], []], "ocr_normalized_boxes": [np.array([[0, 0, 0.5, 1], [0.5, 0, 1, 1]]), np.zeros((0, 4))]}
    one = {"question_id": "8", "question": "R?", "image_name": "p", "ocr_tokens": ["z"], "ocr_normalized_boxes": [[0, 0, 1, 1]]}
    np.save(tmp_path / "q.npy", np.array([{"header": 1}, many, one], dtype=object), allow_pickle=True)
    got = {r.question_id: r for r in R.paged_questions(spark, str(tmp_path / "q.npy"), trusted=True).collect()}
    assert got["7"].answers == ["a", "b"] and got["7"].ocr_tokens == [["x", "y"], []] and got["7"].ocr_normalized_boxes[0][1] == [0.5, 0.0, 1.0, 1.0]
    assert got["8"].answers == [""] and got["8"].image_name == ["p"] and got["8"].ocr_tokens == [["z"]] and got["8"].answer_page_idx is None
    with pytest.raises(ValueError):
        R.paged_questions(spark, str(tmp_path / "q.npy"))


def test_page_layouts(spark, tmp_path):
    np.savez_compressed(tmp_path / "l.npz", a={"boxes": np.array([[0, 0, 1, 1], [0, 0, 0.5, 1]]), "labels": [2, 3], "clusters": [-1, 4]}, b={"boxes": np.zeros((0, 4)), "labels": []}, c={"boxes": [[0, 0, 1, 1]], "labels": [1]})
    got = sorted((r.image_name, r.box_id, r.box.x1, r.label, r.cluster) for r in R.page_layouts(spark, str(tmp_path / "l.npz"), trusted=True).collect())
    assert got == [("a", 0, 1.0, 2, -1), ("a", 1, 0.5, 3, 4), ("c", 0, 1.0, 1, None)]


def test_sqlite_pairs(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "t.db")
    db.execute("CREATE TABLE trainset (id INTEGER PRIMARY KEY, anchor TEXT, positive TEXT)")
    db.executemany("INSERT INTO trainset (anchor, positive) VALUES (?, ?)", [("a", "b"), ("c", None)])
    db.commit()
    db.close()
    assert sorted(map(tuple, R.sqlite_pairs(spark, str(tmp_path / "t.db")).collect())) == [("a", "b"), ("c", None)]


def test_json_records(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"data": [{"questionId": 1, "question": "Q", "answers": ["x"], "ocr_output_file": "o.json", "image_local_name": "i.png"}]}, indent=1))
    (tmp_path / "o.json").write_text(json.dumps({"LINE": [{"Text": "a b"}], "WORD": [{"Text": "a", "Geometry": {"Polygon": [{"X": 0, "Y": 0}, {"X": 1, "Y": 0}, {"X": 1, "Y": 0.5}, {"X": 0, "Y": 0.5}]}}]}))
    (tmp_path / "e.json").write_text("{}")
    (tmp_path / "s.json").write_text(json.dumps([{"question": "Q", "answer": "A", "doc_id": "d", "evidence_pages": "[1, 2]", "evidence_sources": "['Chart', 'Table']"}]))
    assert [(r.questionId, r.answers) for r in R.infographic_questions(spark, str(tmp_path / "q.json")).collect()] == [("1", ["x"])]
    got = {r.file: r for r in R.ocr_pages(spark, str(tmp_path / "[oe].json")).collect()}
    assert got["o.json"].words == ["a"] and tuple(got["o.json"].boxes[0]) == (0.0, 0.0, 1.0, 0.5)
    assert got["e.json"].lines == [] and got["e.json"].boxes == []
    row = R.long_questions(spark, str(tmp_path / "s.json")).first()
    assert row.evidence_pages == [1, 2] and row.evidence_sources == ["Chart", "Table"]


def test_text_files(spark, tmp_path):
    for name in ("doc_p10.txt", "doc_2.txt", "other.txt"):
        (tmp_path / name).write_text(name)
    got = {(r.document, r.page, r.text) for r in R.text_files(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {("doc", 10, "doc_p10.txt"), ("doc", 2, "doc_2.txt"), ("other", None, "other.txt")}
