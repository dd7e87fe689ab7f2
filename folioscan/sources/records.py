"""Readers of question and page records from files, each with a fixed schema. Files are read by Spark, so any store will do."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.operators.assembly import words_of_chars
from folioscan.sources import pdf

BOXES = "array<array<array<double>>>"
PAGED = f"question_id string, question string, answers array<string>, answer_page_idx int, image_id string, image_name array<string>, ocr_tokens array<array<string>>, ocr_normalized_boxes {BOXES}"
INFOGRAPHIC = "data array<struct<questionId:string, question:string, answers:array<string>, ocr_output_file:string, image_local_name:string>>"
OCR = "LINE array<struct<Text:string>>, WORD array<struct<Text:string, Geometry:struct<Polygon:array<struct<X:double,Y:double>>, BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>"
#: Words that travel to the JVM together.
WORDS = 20_000
LONG = "id string, question string, answer string, doc_id string, doc_type string, evidence_pages string, evidence_sources string, answer_format string"


def _files(spark: SparkSession, path: str, read: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that `read` makes of each file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = list(read(bytes(content)))
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _plain(value):
    """Lists and Python numbers instead of arrays and numpy numbers."""
    if isinstance(value, np.ndarray | list | tuple):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def paged_questions(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """Question records of .npy files whose first entry is a header; single-page records become one page.

    Such files hold pickled objects, which can run code when read, so the caller must say that they are trusted.
    """
    if not trusted:
        raise ValueError("object arrays can run code when read; pass trusted=True for files of your own")

    def read(content: bytes) -> Iterator[dict]:
        for r in np.load(io.BytesIO(content), allow_pickle=True)[1:]:
            tokens, boxes, names = (_plain(r.get(k, [])) for k in ("ocr_tokens", "ocr_normalized_boxes", "image_name"))
            if isinstance(names, str):
                names, tokens, boxes = [names], [tokens], [boxes]
            page = r.get("answer_page_idx")
            yield {"question_id": str(r["question_id"]), "question": r["question"], "answers": list(dict.fromkeys(a.lower() for a in r.get("answers", [""]))), "answer_page_idx": None if page is None else int(page), "image_id": str(r.get("image_id", "")), "image_name": names, "ocr_tokens": tokens, "ocr_normalized_boxes": boxes}

    return _files(spark, path, read, PAGED)


def page_layouts(spark: SparkSession, path: str, trusted: bool = False) -> DataFrame:
    """image_name, box_id, box, label, cluster of .npz files with a pickled mapping for each image; cluster is null if there is none."""
    if not trusted:
        raise ValueError("object arrays can run code when read; pass trusted=True for files of your own")

    def read(content: bytes) -> Iterator[dict]:
        with np.load(io.BytesIO(content), allow_pickle=True) as file:
            for name in file.files:
                page = file[name].item()
                groups = page.get("clusters")
                for i, (box, label) in enumerate(zip(page["boxes"], page["labels"], strict=True)):
                    yield {"image_name": name, "box_id": i, "box": dict(zip(("x0", "y0", "x1", "y1"), (float(x) for x in box), strict=True)), "label": int(label), "cluster": None if groups is None else int(groups[i])}

    return _files(spark, path, read, "image_name string, box_id long, box struct<x0:double,y0:double,x1:double,y1:double>, label int, cluster int")


def sqlite_pairs(spark: SparkSession, path: str, name: str = "trainset") -> DataFrame:
    """anchor, positive of the named table of SQLite files."""

    def read(content: bytes) -> Iterator[dict]:
        db = sqlite3.connect(":memory:")
        db.deserialize(content)
        quoted = name.replace('"', '""')
        for anchor, positive in db.execute(f'SELECT anchor, positive FROM "{quoted}"'):
            yield {"anchor": anchor, "positive": positive}
        db.close()

    return _files(spark, path, read, "anchor string, positive string")


def infographic_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row for each question of JSON files with a `data` list."""
    rows = spark.read.schema(INFOGRAPHIC).json(path, multiLine=True)
    return rows.select(F.explode("data").alias("q")).select("q.*")


def ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """file, lines, words, boxes of OCR JSON files; a missing key gives empty lists. A box spans a polygon's first and third point."""
    rows = spark.read.schema(OCR).json(path, multiLine=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "LINE", "WORD")
    none = F.array()
    point = lambda w, i, a: F.try_element_at(w["Geometry"]["Polygon"], F.lit(i))[a]
    boxes = F.transform("WORD", lambda w: F.struct(point(w, 1, "X").alias("x0"), point(w, 1, "Y").alias("y0"), point(w, 3, "X").alias("x1"), point(w, 3, "Y").alias("y1")))
    return rows.select(
        "file",
        F.coalesce(F.transform("LINE", lambda x: x["Text"]), none.cast("array<string>")).alias("lines"),
        F.coalesce(F.transform("WORD", lambda x: x["Text"]), none.cast("array<string>")).alias("words"),
        F.coalesce(boxes, none.cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")).alias("boxes"),
    )


def long_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions on long documents; evidence lists are parsed from their text, never evaluated."""
    rows = spark.read.schema(LONG).json(path, multiLine=True)
    return rows.withColumn("evidence_pages", F.from_json("evidence_pages", "array<int>")).withColumn("evidence_sources", F.from_json(F.translate("evidence_sources", "'", '"'), "array<string>"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """document, page, text of files named <document>_<page>.txt (page is null without a number), ordered by nothing."""
    rows = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    page = F.try_to_number(F.nullif(F.regexp_extract("file", r"_p?(\d+)\.[^.]*$", 1), F.lit("")), F.lit("999999999"))
    return rows.select(F.regexp_replace("file", r"(_p?\d+)?\.[^.]*$", "").alias("document"), page.cast("int").alias("page"), F.col("value").alias("text"))


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written first if it isn't there whole yet."""
    file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """name (without its ending), file, length, content of image files; the content is read only where it is used."""
    rows = spark.read.format("binaryFile").load(path)
    file = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("name"), file.alias("file"), "length", "content")


def pages_with_images(questions: DataFrame, pictures: DataFrame) -> DataFrame:
    """The columns of questions and page_idx, image_name, content of each of its image_name (an array); a missing image is an error of the data and leaves null."""
    rows = questions.select("*", F.posexplode("image_name").alias("page_idx", "_name")).drop("image_name").withColumnRenamed("_name", "image_name")
    return rows.join(pictures.select(F.col("name").alias("image_name"), "content"), "image_name", "left")


def images_with_ocr(spark: SparkSession, images_path: str, ocr_path: str) -> DataFrame:
    """name, length, lines, words, boxes of image files and the OCR files of the same name; an image without one has nulls."""
    ocr = ocr_pages(spark, ocr_path).withColumn("name", F.regexp_replace("file", r"\.[^.]*$", "")).drop("file")
    return images(spark, images_path).select("name", "length").join(ocr, "name", "left")


def ocr_documents(spark: SparkSession, path: str) -> DataFrame:
    """document, lines of OCR files named <document>_<page>.json or <document>_p<page>.json: the pages' lines in the order of their numbers."""
    rows = ocr_pages(spark, path).select(F.regexp_replace("file", r"(_p?\d+)?\.[^.]*$", "").alias("document"), F.coalesce(F.nullif(F.regexp_extract("file", r"_p?(\d+)\.[^.]*$", 1), F.lit("")).cast("long"), F.lit(0)).alias("page"), "lines")
    return rows.groupBy("document").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "lines"))), lambda p: p["lines"])).alias("lines"))


Parser = Callable[[], Callable[[bytes], Iterator[tuple[int, int, int, str, float, float, float, float, float, float]]]]


def document_words(spark: SparkSession, path: str, parser: Parser, errors: bool = False) -> DataFrame:
    """document, page, line, first, word, box of each file: words of the characters that a parser finds.

    parser makes, in each task, a function from a file's bytes to (page, line, place, character, left, bottom, right, top, page's
    width, page's height), with the origin at the lower left, as page description formats have it. Words end at blanks; boxes are
    shares of the page with the origin at the upper left, cut off at its edges. A document is parsed once, whatever asks for it.
    If parser has a function `words` (as `pdf.parser` has), which gives the number and the words of each page of a file, words are
    made in the task that reads the file; characters of other parsers may come in any order, are rows and meet by page and line.
    With `errors`, a file that can't be parsed to its end gives what was found and a row with a message in `error`; without, it
    ends the job.
    """
    return words_of_files(spark.read.format("binaryFile").load(path).select("path", "content"), parser, errors)


def pdf_words(spark: SparkSession, path: str) -> DataFrame:
    """document, page, line, first, word, box, error of PDF files; a broken file has a row with an error."""
    return document_words(spark, path, pdf.parser, errors=True)


def _whole_words(files: DataFrame, words: Callable[[bytes], Iterator[tuple[int, tuple[list, ...]]]], errors: bool) -> DataFrame:
    """`words_of_files` for a parser that gives words itself. files: document, content."""
    kinds = {"document": "string", "page": "int", "line": "int", "first": "int", "word": "string", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "error": "string"}
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}

    def told(held: list[list]) -> Iterator[pa.RecordBatch]:
        batch = pa.record_batch([pa.array(x, types[k]) for x, k in zip(held, kinds.values(), strict=True)], list(kinds))
        return (batch.slice(at, WORDS) for at in range(0, batch.num_rows, WORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in kinds]
        for document, content in ((d.as_py(), c.as_py()) for b in batches for d, c in zip(b.column("document"), b.column("content"), strict=True)):
            found = words(content)
            while True:
                page = error = None
                try:
                    page = next(found, None)
                except Exception as e:  # whatever a file holds, the others are read
                    if not errors:
                        raise
                    error = f"{type(e).__name__}: {e}"
                if page is None and error is None:
                    break
                number, columns = page or (None, [[None]] * 7)
                n = len(columns[0])
                for x, own in zip(held, ([document] * n, [number] * n, *columns, [error] * n), strict=True):
                    x += own
                if len(held[0]) >= WORDS:
                    yield from told(held)
                    held = [[] for _ in kinds]
                if error:
                    break
        yield from told(held)

    rows = files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in kinds.items()))
    box = F.when(F.col("x0").isNotNull(), G.clip(G.box(*map(F.col, ("x0", "y0", "x1", "y1")))))
    return rows.select("document", "page", "line", "first", "word", box.alias("box"), *(["error"] if errors else []))


def words_of_files(files: DataFrame, parser: Parser, errors: bool = False) -> DataFrame:
    """The same of the rows of files (path, content)."""
    document = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("document")
    if words := getattr(parser, "words", None):
        return _whole_words(files.select(document, "content"), words, errors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read, names = parser(), ["path", "page", "line", "pos", "char", "l", "b", "r", "t", "w", "h"]
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                found, error = read(bytes(content)), None
                while True:
                    rows = []
                    try:
                        rows += ((path_, *c) for c in islice(found, 50_000))
                    except Exception as e:  # whatever a file holds, the others are read
                        if not errors:
                            raise
                        error = f"{type(e).__name__}: {e}"
                    if rows:
                        yield pd.DataFrame(rows, columns=names).assign(error=None)
                    if len(rows) < 50_000 or error:
                        break
                if error:
                    yield pd.DataFrame([(path_, *[None] * 10, error)], columns=[*names, "error"])

    schema = "path string, page int, line int, pos int, char string, l double, b double, r double, t double, w double, h double, error string"
    chars = files.select("path", "content").mapInPandas(run, schema)
    box = G.clip(G.box(F.col("l") / F.col("w"), 1 - F.col("t") / F.col("h"), F.col("r") / F.col("w"), 1 - F.col("b") / F.col("h")))
    if not errors:
        placed = chars.select(F.struct(document, "page").alias("page"), "line", "pos", "char", box.alias("box"))
        return words_of_chars(placed).select("page.document", "page.page", "line", "first", "word", "box")
    # An error travels as a character of its own line, so a file is parsed once.
    sign = F.when(F.col("error").isNotNull(), "!").otherwise(F.col("char"))
    placed = chars.select(F.struct(document, "page", "error").alias("page"), "line", "pos", sign.alias("char"), box.alias("box"))
    found = words_of_chars(placed)
    failed = F.col("page.error").isNotNull()
    return found.select("page.document", "page.page", "line", "first", F.when(~failed, F.col("word")).alias("word"), F.when(~failed, F.col("box")).alias("box"), "page.error")


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """image_name, box_id, box, label, cluster as `sinks.write_layouts` wrote them."""
    return spark.read.parquet(path)


def prompt(spark: SparkSession, path: str) -> str:
    """A small text file, without the white space around it."""
    return spark.read.text(path, wholetext=True).first()[0].strip()
