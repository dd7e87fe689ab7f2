"""Model inputs, results and held-out samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.functions import vectors as V
from folioscan.functions.text import bind
from folioscan.operators import assembly as A
from folioscan.operators import chunking as C
from folioscan.operators import layout as L
from folioscan.operators import sampling as S
from folioscan.plans import answering as Q
from folioscan.plans import experiment as E
from folioscan.plans import mining as N
from folioscan.plans.retrieval_queries import SQL_BOXES, SQL_CONF, _boxes, _confidences
from folioscan.plans.text_queries import SQL_WORDS
from folioscan.sources.tables import pages, table

W = SQL_WORDS.format("text")


def padded_pages(spark, sf) -> DataFrame:
    padded = A.pad_pages(pages(spark, sf), 6)
    return padded.select("doc_id", "page_idx", F.size("words").cast("long").alias("n_words"))


def labelled_words(spark, sf) -> DataFrame:
    words = A.label_prefix(F.col("words"), F.when(F.col("role") != "system", F.col("role")))
    return pages(spark, sf).select("doc_id", "page_idx", F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, " ").cast("binary")).alias("words_md5"))


def compact_chunks(spark, sf) -> DataFrame:
    """Text and box of the chunks of every turn; its words stand on a grid of ten a line."""

    def grid(ws, lines):
        return F.transform(ws, lambda w, i: F.struct(w.alias("word"), G.box(i % 10 / 10, F.floor(i / 10) / lines, (i % 10 + 1) / 10, (F.floor(i / 10) + 1) / lines).alias("box")))

    # The number of lines is bound, or it would be found, from the whole text, for every word anew.
    words = bind(F.col("words"), lambda ws: bind(F.ceil(F.size(ws) / 10), lambda lines: grid(ws, lines)))
    chunks = C.chunks(pages(spark, sf).select("doc_id", "page_idx", words.alias("words")))
    found = chunks.select("doc_id", "page_idx", "start", A.compact(F.col("words.word"), F.col("words.box")).alias("c"))
    sides = (F.round(F.col(f"c.box.{n}"), 6).alias(n) for n in ("x0", "y0", "x1", "y1"))
    return found.select("doc_id", "page_idx", F.col("start").cast("long").alias("start"), F.md5(F.col("c.text").cast("binary")).alias("text_md5"), *sides)


def aligned_spans(spark, sf) -> DataFrame:
    """The fifth to tenth characters of a turn, with spans that are right, one place off or two."""
    rows = table(spark, sf, "conversations").withColumn("answer", F.substring("text", 5, 6))
    rows = rows.withColumn("a", 4 + F.when(F.col("turn") % 4 == 1, 1).when(F.col("turn") % 4 == 3, 2).otherwise(0)).withColumn("b", 10 - (F.col("turn") % 4 == 2).cast("int"))
    span = A.align_span(F.col("text"), F.col("answer"), F.col("a"), F.col("b"))
    return rows.select("conv_id", "turn", span.alias("s")).select("conv_id", "turn", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"))


def _images(spark, sf) -> DataFrame:
    """Sizes of images from part keys, and a label of three."""
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(key.alias("image"), (key * 37 % 1900 + 10).cast("int").alias("width"), (key * 53 % 1300 + 10).cast("int").alias("height"), (F.col("p_size") % 3).cast("int").alias("label"))


def resized_images(spark, sf) -> DataFrame:
    sized = _images(spark, sf).select("image", A.fit_within(F.col("width"), F.col("height")).alias("s"))
    return sized.select("image", F.col("s.width").cast("long").alias("width"), F.col("s.height").cast("long").alias("height"))


def divided_regions(spark, sf) -> DataFrame:
    cut = A.divide_regions(_images(spark, sf), 512)
    return cut.select("image", *(F.col(c).cast("long").alias(c) for c in ("label", "row", "col", "x0", "y0", "x1", "y1")))


def patch_surroundings(spark, sf) -> DataFrame:
    """Two centres in the patch grid of every image, grown by five steps."""
    key = F.col("p_partkey")
    rows = table(spark, sf, "part").select(key.alias("grid"), (F.col("p_size") % 7 + 1).cast("int").alias("rows"), (key % 9 + 1).cast("int").alias("cols"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    centres = rows.select("grid", "rows", "cols", ((F.col("grid") + 3 * F.col("k")) % F.col("rows")).cast("int").alias("row"), ((F.col("grid") * 5 + F.col("k")) % F.col("cols")).cast("int").alias("col"))
    return A.surroundings(centres, 5).select("grid", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def page_grid(spark, sf) -> DataFrame:
    rows = A.page_boxes(table(spark, sf, "pages").select("page_id"), 14, 1000.0)
    return rows.select("page_id", F.col("place").cast("long").alias("place"), *(F.round(F.col(f"box.{n}"), 6).alias(n) for n in ("x0", "y0", "x1", "y1")))


def char_words(spark, sf) -> DataFrame:
    """Words of the characters of every turn; a character is a hundredth wide."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("line"), F.posexplode(F.split(F.regexp_replace("text", "[\\t\\n\\r]", " "), "")).alias("pos", "char"))
    rows = rows.withColumn("box", G.box(F.col("pos") / 100, F.lit(0), (F.col("pos") + 1) / 100, F.lit(1)))
    found = A.words_of_chars(rows.filter("char <> ''"))
    return found.select("page", "line", F.col("first").cast("long").alias("first"), "word", F.round("box.x0", 6).alias("x0"), F.round("box.x1", 6).alias("x1"))


def filtered_boxes(spark, sf) -> DataFrame:
    return L.filter_boxes(_boxes(spark, sf)).select("page", "box_id")


def example_ids(spark, sf) -> DataFrame:
    found = A.examples(table(spark, sf, "documents"), ["source", "lang"], "doc_id", 5)
    return found.select("source", "lang", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def extractive_confidences(spark, sf) -> DataFrame:
    """The halves of a vector are the scores of an answer's starts and ends."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(V.extractive_confidence(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)), 8).alias("conf"))


def overridden_answers(spark, sf) -> DataFrame:
    answer, conf = A.drop_unanswerable(F.col("answer"), F.col("conf"), (F.col("page_idx") * 31 + F.col("doc_id")) % 100 / 100)
    return _confidences(spark, sf).select("doc_id", "page_idx", answer.alias("answer"), F.round(conf, 6).alias("conf"))


def result_rows(spark, sf) -> DataFrame:
    """A result for each conversation: its last turn's role as the answer, its user turns as the pages."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("answer"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))).alias("pages"))
    return A.results(turns.withColumnRenamed("conv_id", "question_id"))


def clock_times(spark, sf) -> DataFrame:
    """Values as seconds, written as times of day and read back."""
    rows = table(spark, sf, "events").select("event_id", A.clock(F.abs("value") * 100).alias("time"))
    return rows.withColumn("seconds", A.seconds(F.concat("time", F.lit(" (1.5%)"))))


def noise_pool(spark, sf) -> DataFrame:
    """Forty documents that aren't conversations' numbers, in a fixed order."""
    seeds = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"))
    return S.held_out(table(spark, sf, "documents").select("doc_id", "source"), seeds, "doc_id", [F.col("doc_id") * 7919 % 10007, F.col("doc_id")], 40)


def answered_questions(spark, sf) -> DataFrame:
    """Each user turn as a question on its conversation, answered from the page of the largest summed similarity."""
    rows = pages(spark, sf)
    asked = rows.filter("role = 'user'").select(F.concat_ws(":", "doc_id", "page_idx").alias("question_id"), "doc_id", F.array_join("words", " ").alias("question"))
    found = Q.answer_questions(asked, rows.select("doc_id", "page_idx", "words"), "weightmajorpage")
    first = F.try_element_at("answers", F.lit(1))
    return found.select("question_id", first["answer"].alias("answer"), F.round(first["confidence"], 6).alias("confidence"), F.try_element_at("pages", F.lit(1)).alias("page"))


def _asked(rows: DataFrame) -> DataFrame:
    """Each user turn as a question on its conversation, its first sentence the answer."""
    said = F.array_join("words", " ")
    first = F.split(said, r"(?<=[.!?])\s")[0]
    return rows.filter("role = 'user'").select(F.concat_ws(":", "doc_id", "page_idx").alias("question_id"), "doc_id", said.alias("question"), F.col("page_idx").alias("gold_page"), F.array(first).alias("golds"))


def noise_experiment(spark, sf) -> DataFrame:
    """Questions on conversations with 0, 2 and 8 pages of others, two times."""
    rows = pages(spark, sf)
    found = E.by_pages(E.noise_experiment(_asked(rows), rows.select("doc_id", "page_idx", "words"), (0, 2, 8), 2, mode="maxconf", k=5))
    return found.select(F.col("level").cast("long").alias("level"), "n_pages", "samples", *(F.round(c, 6).alias(c) for c in found.columns[3:]))


def mined_pairs(spark, sf) -> DataFrame:
    """The chunks of its conversation from which a question is answered right."""
    rows = pages(spark, sf)
    found = N.mined_pairs(_asked(rows), rows.select("doc_id", "page_idx", "words"))
    return found.select("question_id", "page_idx", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5(F.col("positive").cast("binary")).alias("positive_md5"), F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (padded_pages, labelled_words, compact_chunks, aligned_spans, resized_images, divided_regions, patch_surroundings, page_grid, char_words, filtered_boxes, example_ids, extractive_confidences, overridden_answers, result_rows, clock_times, noise_pool, answered_questions, noise_experiment, mined_pairs)}

_SIZES = "i AS (SELECT p_partkey AS image, p_partkey * 37 % 1900 + 10 AS w, p_partkey * 53 % 1300 + 10 AS h, p_size % 3 AS label FROM part)"
_CONF_HALF = "1 / list_sum(list_transform({0}, lambda x: exp(x::DOUBLE - list_max({0})::DOUBLE)))"

SQL = {
    "padded_pages": f"SELECT conv_id AS doc_id, turn AS page_idx, len({W}) AS n_words FROM conversations UNION ALL SELECT d, last + unnest(range(1, 7 - n)), 1 FROM (SELECT conv_id AS d, max(turn) AS last, count(*) AS n FROM conversations GROUP BY 1) WHERE n < 6",
    "labelled_words": f"WITH w AS (SELECT conv_id AS doc_id, turn AS page_idx, CASE role WHEN 'system' THEN {W} ELSE list_concat([role || ': '], {W}) END AS ws FROM conversations) SELECT doc_id, page_idx, len(ws) AS n, md5(array_to_string(ws, ' ')) AS words_md5 FROM w",
    "compact_chunks": f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page_idx, {W} AS ws, len({W}) AS n FROM conversations), s AS (SELECT *, unnest(range(0, n, 50)) AS start FROM p),
 c AS (SELECT *, CASE WHEN n - (start + 50) <= 22 THEN n ELSE start + 60 END AS stop FROM s WHERE start = 0 OR n - start > 22), k AS (SELECT *, unnest(range(start, least(stop, n))) AS pos FROM c)
 SELECT doc_id, page_idx, start, md5(array_to_string(any_value(ws[start + 1 : stop]), ' ')) AS text_md5, round(min((pos % 10) / 10), 6) AS x0, round(min((pos // 10) / ceil(n / 10)), 6) AS y0, round(max((pos % 10 + 1) / 10), 6) AS x1, round(max((pos // 10 + 1) / ceil(n / 10)), 6) AS y1 FROM k GROUP BY doc_id, page_idx, start""",
    "aligned_spans": """WITH r AS (SELECT conv_id, turn, text, substr(text, 5, 6) AS answer, 4 + CASE turn % 4 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS a, CASE turn % 4 WHEN 2 THEN 9 ELSE 10 END AS b FROM conversations),
 t AS (SELECT *, CASE WHEN substr(text, a + 1, b - a) = answer THEN 1 WHEN substr(text, a, b - a + 1) = answer THEN 2 WHEN substr(text, a + 1, b - a + 1) = answer THEN 3 END AS how FROM r)
 SELECT conv_id, turn, CASE how WHEN 2 THEN a - 1 WHEN 1 THEN a WHEN 3 THEN a END AS span_start, CASE how WHEN 3 THEN b + 1 WHEN 1 THEN b WHEN 2 THEN b END AS span_end FROM t""",
    "resized_images": f"""WITH {_SIZES} SELECT image, (CASE WHEN w < 28 OR h < 28 THEN greatest(w, 28) WHEN w <= 512 AND h <= 512 THEN w WHEN w / h > 1 THEN 512 ELSE trunc(512 * (w / h)) END)::BIGINT AS width,
 (CASE WHEN w < 28 OR h < 28 THEN greatest(h, 28) WHEN w <= 512 AND h <= 512 THEN h WHEN w / h > 1 THEN trunc(512 / (w / h)) ELSE 512 END)::BIGINT AS height FROM i""",
    "divided_regions": f"""WITH {_SIZES}, g AS (SELECT *, CASE WHEN label <> 1 OR w <= 512 THEN 1 ELSE ceil((w - 512) / 256)::BIGINT + 1 END AS nc, CASE WHEN label <> 1 OR h <= 512 THEN 1 ELSE ceil((h - 512) / 256)::BIGINT + 1 END AS nr FROM i),
 r AS (SELECT *, unnest(range(0, nr)) AS row FROM g), c AS (SELECT *, unnest(range(0, nc)) AS col FROM r),
 x AS (SELECT *, greatest(0, least(col * 256, w - 512)) AS x0, greatest(0, least(row * 256, h - 512)) AS y0 FROM c)
 SELECT image, label::BIGINT AS label, row, col, CASE WHEN label = 1 THEN x0 ELSE 0 END AS x0, CASE WHEN label = 1 THEN y0 ELSE 0 END AS y0, CASE WHEN label = 1 THEN least(x0 + 512, w) ELSE w END AS x1, CASE WHEN label = 1 THEN least(y0 + 512, h) ELSE h END AS y1 FROM x""",
    "patch_surroundings": """WITH p AS (SELECT p_partkey AS grid, p_size % 7 + 1 AS rows, p_partkey % 9 + 1 AS cols, unnest([0, 1]) AS k FROM part), c AS (SELECT *, (grid + 3 * k) % rows AS r, (grid * 5 + k) % cols AS c FROM p),
 o AS (SELECT dr, dc FROM (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) WHERE abs(dr) <= 1 OR abs(dc) <= 1)
 SELECT DISTINCT grid, (r + dr)::BIGINT AS row, (c + dc)::BIGINT AS col FROM c, o WHERE r + dr BETWEEN 0 AND rows - 1 AND c + dc BETWEEN 0 AND cols - 1""",
    "page_grid": "SELECT page_id, 0 AS place, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 1000.0::DOUBLE AS x1, 1000.0::DOUBLE AS y1 FROM pages UNION ALL SELECT page_id, 1 + y * 14 + x, round(x * 1000.0::DOUBLE / 14, 6), round(y * 1000.0::DOUBLE / 14, 6), round((x + 1) * 1000.0::DOUBLE / 14, 6), round((y + 1) * 1000.0::DOUBLE / 14, 6) FROM pages, (SELECT unnest(range(0, 14)) AS x), (SELECT unnest(range(0, 14)) AS y)",
    "char_words": """WITH c AS (SELECT conv_id AS page, turn AS line, text, unnest(range(0, length(text))) AS pos FROM conversations), k AS (SELECT page, line, pos, substr(text, pos + 1, 1) AS ch FROM c),
 b AS (SELECT *, ch IN (' ', chr(9), chr(10), chr(13)) AS blank FROM k), r AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY page, line ORDER BY pos) AS run FROM b)
 SELECT page, line, min(pos) AS first, string_agg(ch, '' ORDER BY pos) AS word, round(min(pos / 100), 6) AS x0, round(max((pos + 1) / 100), 6) AS x1 FROM r WHERE NOT blank GROUP BY page, line, run""",
    "filtered_boxes": SQL_BOXES + " SELECT page, box_id FROM a WHERE w >= 0.02 AND NOT EXISTS (SELECT 1 FROM p WHERE p.page = a.page AND p.i = a.box_id AND wi < wj AND CASE WHEN ai <= 0 THEN 0 ELSE inter / ai END >= 0.6)",
    "example_ids": "SELECT source, lang, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS examples FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY source, lang",
    "extractive_confidences": f"SELECT vec_id, round({_CONF_HALF.format('embedding[1:32]')} * ({_CONF_HALF.format('embedding[33:64]')}), 8) AS conf FROM embeddings",
    "overridden_answers": SQL_CONF + " SELECT doc_id, page_idx, CASE WHEN (page_idx * 31 + doc_id) % 100 > 50 THEN '' ELSE answer END AS answer, CASE WHEN (page_idx * 31 + doc_id) % 100 > 50 THEN 0 ELSE round(conf, 6)::DOUBLE END AS conf FROM c",
    "result_rows": """SELECT conv_id AS "questionId", arg_max(role, turn) AS answer, coalesce(min(turn) FILTER (role = 'user'), 0) AS answer_page FROM conversations GROUP BY conv_id""",
    "clock_times": "WITH s AS (SELECT event_id, trunc(abs(value) * 100)::BIGINT AS seconds FROM events) SELECT event_id, printf('%02d:%02d:%02d', seconds // 3600, seconds % 3600 // 60, seconds % 60) AS time, seconds FROM s",
    "noise_pool": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations) ORDER BY doc_id * 7919 % 10007, doc_id LIMIT 40",
}
