"""Queries on pages, answers and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import chunking as C
from folioscan.operators import matching as M
from folioscan.operators import ranking as R
from folioscan.operators import sampling as S
from folioscan.sources.tables import pages, table, words

#: The words of a text in SQL, and a text with other than ASCII characters replaced (edit distances differ in their units).
SQL_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\n\\r]+'), lambda w: w <> '')"
W = SQL_WORDS.format("text")


def _ascii(c) -> F.Column:
    return F.regexp_replace(c, "[^\\x00-\\x7F]", "?")


def page_context(spark, sf) -> DataFrame:
    return pages(spark, sf).select("doc_id", "page_idx", F.array_join(F.transform("words", F.lower), " ").alias("context"))


def normal_answers(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return rows.select("conv_id", F.array_join(F.array_sort(X.normal_answers(F.transform("r", F.upper))), ",").alias("answers"))


def answer_span(spark, sf) -> DataFrame:
    """Where each document holds a whole item of benchmark for the first time; item -1 and (0, 0) for documents that hold none.

    Of several items the one that stands first in the text counts, then the one of least number.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = M.one_span(docs, M.first_spans(docs, table(spark, sf, "benchmark")))
    return found.select("doc_id", "item_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


def answer_choice(spark, sf) -> DataFrame:
    """The same with a drawn one of a document's items, and how many it holds: as golds of a question, of which one is trained on."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    spans = M.first_spans(docs, table(spark, sf, "benchmark"))
    found = M.one_span(docs, spans, "(doc_id * 7 + 3) % n")
    n = spans.groupBy("doc_id").agg(F.count("*").alias("n_items"))
    return found.join(n, "doc_id", "left").select("doc_id", "item_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def _gold(rows: DataFrame) -> DataFrame:
    """The gold page of each document: its last user turn."""
    return rows.filter(F.col("role") == "user").groupBy("doc_id").agg(F.max("page_idx").alias("gold"))


def oracle_page(spark, sf) -> DataFrame:
    rows = pages(spark, sf)
    hit = rows.join(_gold(rows), "doc_id").filter(F.col("page_idx") == F.col("gold"))
    return hit.select("doc_id", "page_idx", F.size("words").cast("long").alias("n_words"))


def size_subset(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source")
    first = S.group_rank(rows, ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    sizes = rows.groupBy("source").agg(F.floor(F.count("*") * 0.3).alias("n"))
    return first.join(sizes, "source").filter("rank <= n").select("doc_id", "source", F.col("rank").cast("long").alias("rank"))


def page_window(spark, sf) -> DataFrame:
    most = 3
    rows = pages(spark, sf)
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page_idx")).alias("all")).join(_gold(rows), "doc_id")
    low, high = F.greatest(F.lit(0), F.col("gold") - most + 1), F.least(F.col("gold"), F.greatest(F.lit(0), F.col("n") - most))
    first = low + (F.col("doc_id") * 7 + 3) % (high - low + 1)
    window = F.slice("all", first.cast("int") + 1, F.lit(most))
    padded = F.concat(window, F.array_repeat(F.lit(-1).cast("long"), most - F.size(window)))
    return docs.withColumn("first", first).select("doc_id", F.col("gold").alias("gold_page"), (F.col("gold") - F.col("first")).alias("gold_in_window"), F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("window"))


def doc_words(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", words(F.col("text")).alias("words"))


def chunk_words(spark, sf) -> DataFrame:
    return C.chunks(doc_words(spark, sf)).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), F.md5(F.array_join("words", " ").cast("binary")).alias("text_md5"))


SQL_CHUNKS = f"""
WITH w AS (SELECT doc_id, {W} AS ws FROM documents), n AS (SELECT *, len(ws) AS n FROM w),
s AS (SELECT doc_id, ws, n, unnest(range(0, n, 50)) AS s FROM n),
c AS (SELECT doc_id, ws, n, s AS start, CASE WHEN n - (s + 50) <= 22 THEN n ELSE s + 60 END AS stop FROM s WHERE s = 0 OR n - s > 22),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_id, start, stop, ws[start + 1 : stop] AS words FROM c)"""


def chunk_histogram(spark, sf) -> DataFrame:
    sizes = C.chunks(doc_words(spark, sf)).select(F.size("words").cast("long").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def histogram_summary(spark, sf) -> DataFrame:
    sizes = C.chunks(doc_words(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("k"), F.sum(F.size("words")).alias("n"))
    return sizes.agg(F.count("*").alias("docs"), F.round(F.avg("k"), 6).alias("mean_chunks"), F.round(F.stddev_pop("k"), 6).alias("std_chunks"), F.min("k").alias("least"), F.max("k").alias("most"), F.sum("n").alias("words"))


def histogram_extremes(spark, sf) -> DataFrame:
    """The five most and least common sizes, the five smallest and largest, and the five nearest to the mean."""
    hist = chunk_histogram(spark, sf)
    mean = hist.agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    hist = hist.join(F.broadcast(mean), how="cross")  # one row
    orders = {"most_common": [F.desc("n"), "size"], "least_common": ["n", "size"], "smallest": ["size"], "largest": [F.desc("size")], "nearest_mean": [F.round(F.abs(F.col("size") - F.col("mean")), 6), "size"]}
    parts = [hist.orderBy(*o).limit(5).select(F.lit(k).alias("kind"), "size", "n") for k, o in orders.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def concat_context(spark, sf) -> DataFrame:
    rows = C.chunks(doc_words(spark, sf)).withColumnRenamed("chunk_id", "rank")
    context = C.concat_evidence(rows, ["doc_id"], "rank", "[SEP]")
    return context.select("doc_id", F.length("context").cast("long").alias("n_chars"), F.md5(F.col("context").cast("binary")).alias("context_md5"))


def token_budget(spark, sf) -> DataFrame:
    rows = C.chunks(doc_words(spark, sf)).withColumn("tokens", F.size("words").cast("long"))
    return C.within_budget(rows, ["doc_id"], "chunk_id", "tokens", 200).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "used")


def surrounding_words(spark, sf) -> DataFrame:
    """The three longest chunks of each document with 15 places on either side; places count overlap words twice.

    Chunks are known by their ranges alone, and a place by the arrays of the three, so no word and no place becomes a row.
    """
    sizes = doc_words(spark, sf).select("doc_id", F.posexplode_outer(C.chunk_ranges(F.size("words"))).alias("chunk_id", "r")).filter(F.col("chunk_id").isNotNull())
    rows = sizes.select("doc_id", "chunk_id", (F.col("r.end") - F.col("r.start")).alias("n"))
    doc = Window.partitionBy("doc_id")
    placed = rows.withColumns({"last": F.sum("n").over(doc.orderBy("chunk_id")) - 1, "n_places": F.sum("n").over(doc)}).withColumn("first", F.col("last") - F.col("n") + 1)
    best = R.top_k(placed, ["doc_id"], "n", ["chunk_id"], 3)
    held = best.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "first", "last", "n_places"))).alias("k"))
    grown = held.withColumn("places", F.transform("k", lambda c: F.sequence(F.greatest(F.lit(0), c["first"] - 15), F.least(c["n_places"] - 1, c["last"] + 15))))
    own = F.transform("places", lambda p, i: F.array_except(p, F.flatten(F.slice("places", 1, i))))  # a better chunk's places stay its own
    out = grown.select("doc_id", F.posexplode(own).alias("at", "p")).filter(F.size("p") > 0)
    return out.select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), F.array_min("p").alias("first"), F.array_max("p").alias("last"), F.size("p").cast("long").alias("n"))


def _answers(spark, sf) -> DataFrame:
    """Gold and predicted answers of every type, made from events: right, near, wrong and unreadable ones."""
    e = table(spark, sf, "events")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("string", "int", "float", "list", "not-answerable"))), (F.col("event_id") % 5 + 1).cast("int"))
    cents = F.floor(F.col("value") * 100).cast("long")
    number = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    listed = F.concat(F.lit("['"), "event_type", F.lit("', 'b, c']"))
    gold = F.when(kind == "int", F.concat(F.lit("-"), F.col("user_id").cast("string"))).when(kind == "float", number).when(kind == "list", listed).otherwise(F.col("event_type"))
    off = F.floor(F.col("event_id") / 5) % 8
    pred = F.when(off == 0, gold).when(off == 1, F.concat(F.lit(" "), F.upper(gold))).when(off == 2, F.substring(gold, 1, 4)).when(off == 3, "none").when(off == 4, F.concat(gold, F.lit("%")))
    pred = pred.when(off == 5, F.concat(gold, F.lit(".7"))).when(off == 6, F.concat(F.lit('["b, c", "'), "event_type", F.lit('"]'))).otherwise("")
    return e.select("event_id", kind.alias("kind"), gold.alias("gold"), pred.alias("pred"))


#: Written from the metrics' rules, step by step: what reads as a number, which answers must match exactly, which score by distance.
SQL_ANSWERS = r"""
WITH e AS (SELECT *, event_id % 5 AS t, (event_id // 5) % 8 AS off, CAST(floor(value * 100) AS BIGINT) AS cents FROM events),
k AS (SELECT *, ['string','int','float','list','not-answerable'][t + 1] AS kind, (cents // 100)::VARCHAR || '.' || lpad((cents % 100)::VARCHAR, 2, '0') AS number FROM e),
g AS (SELECT *, CASE kind WHEN 'int' THEN '-' || user_id::VARCHAR WHEN 'float' THEN number WHEN 'list' THEN '[' || chr(39) || event_type || chr(39) || ', ' || chr(39) || 'b, c' || chr(39) || ']' ELSE event_type END AS gold FROM k),
a AS (SELECT event_id, kind, event_type, gold, CASE off WHEN 0 THEN gold WHEN 1 THEN ' ' || upper(gold) WHEN 2 THEN substr(gold, 1, 4) WHEN 3 THEN 'none' WHEN 4 THEN gold || '%' WHEN 5 THEN gold || '.7' WHEN 6 THEN '["b, c", "' || event_type || '"]' ELSE '' END AS pred, off FROM g),
p AS (SELECT *, trim(lower(gold)) AS g1, trim(lower(pred)) AS p1 FROM a),
s AS (SELECT *, contains(g1, 'https://') OR contains(g1, 'http://') OR suffix(g1, '.py') OR suffix(g1, '.ipynb') OR starts_with(g1, 'page') OR contains(g1, 'a.m.') OR contains(g1, 'p.m.')
  OR regexp_full_match(g1, '\d+(-\d+|\s\d+)?|\d{4}[-\s]\d{2}([-\s]\d{2})?|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') AS special,
 1 - levenshtein(g1, p1)::DOUBLE / greatest(len(g1), len(p1), 1) AS sim,
 CASE WHEN regexp_full_match(g1, '[+-]?\d+') THEN g1::BIGINT END AS g_int, trunc(try_cast(p1 AS DOUBLE)) AS p_int,
 try_cast(rtrim(g1, '%') AS DOUBLE) AS g_float, try_cast(rtrim(p1, '%') AS DOUBLE) AS p_float,
 list_sort(string_split(trim(g1, '[]'), ',')) AS g_list, list_sort(string_split(trim(p1, '[]'), ',')) AS p_list FROM p),
acc AS (SELECT *, CASE WHEN kind = 'not-answerable' THEN p1 = '' OR p1 = 'none' WHEN p1 = 'none' THEN false WHEN special THEN g1 = p1
 WHEN kind = 'int' THEN coalesce(g_int = p_int, false) WHEN kind = 'float' THEN coalesce(abs(p_float - g_float) < 0.01, false) WHEN kind = 'list' THEN g_list = p_list ELSE g1 = p1 END AS ok FROM s)"""


def typed_accuracy(spark, sf) -> DataFrame:
    a = _answers(spark, sf)
    return a.select("event_id", "kind", X.accuracy(F.array("gold"), F.col("pred"), F.col("kind")).alias("accuracy"))


def typed_anls(spark, sf) -> DataFrame:
    a = _answers(spark, sf)
    return a.select("event_id", "kind", F.round(X.anls(F.array("gold"), F.col("pred"), F.col("kind")), 6).alias("anls"))


def any_of_anls(spark, sf) -> DataFrame:
    """The best score of a turn over all assistant turns of its conversation: whole texts, each turn a prediction."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lower(_ascii(F.array_join(words(F.col("text")), " "))).alias("said"))
    both = rows.filter("role = 'user'").join(rows.filter("role = 'assistant'").select("conv_id", F.col("said").alias("gold")), "conv_id")
    return both.groupBy("conv_id", "turn").agg(F.round(F.max(X.anls_strict(F.col("gold"), F.col("said"))), 6).alias("anls"))


def report_score(spark, sf) -> DataFrame:
    """The report's score of answers of all its types."""
    kinds = F.create_map(*(F.lit(x) for kv in (("string", "Str"), ("int", "Int"), ("float", "Float"), ("list", "List"), ("not-answerable", "None")) for x in kv))
    a = _answers(spark, sf)
    return a.select("event_id", F.round(X.eval_score(F.col("gold"), F.col("pred"), F.try_element_at(kinds, F.col("kind"))), 6).alias("score"))


def _scored(spark, sf) -> DataFrame:
    """Report rows: quality is the score, toxic marks questions without an answer, and doc types and sources come along."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "source")
    pred = F.when(F.col("doc_id") % 7 == 0, "Not answerable").otherwise("text")
    return labels.join(docs, "doc_id").select("doc_id", "lang", "source", F.col("quality").cast("double").alias("score"), (F.col("toxic") == 1).alias("unanswerable"), pred.alias("pred"))


SQL_SCORED = "WITH r AS (SELECT l.doc_id, lang, source, quality::DOUBLE AS score, toxic = 1 AS unanswerable, CASE WHEN l.doc_id % 7 = 0 THEN 'Not answerable' ELSE 'text' END AS pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def accuracy_f1(spark, sf) -> DataFrame:
    hit = F.sum(F.when(~F.col("unanswerable"), F.col("score")).otherwise(0.0))
    rows = _scored(spark, sf).agg(F.avg("score").alias("accuracy"), hit.alias("hit"), F.count_if(~F.col("unanswerable")).alias("gold"), F.count_if(F.col("pred") != "Not answerable").alias("made"))
    r, p = F.try_divide(F.col("hit"), F.col("gold")), F.try_divide(F.col("hit"), F.col("made"))
    f1 = F.coalesce(F.try_divide(2 * r * p, r + p), F.lit(0.0))
    return rows.select(F.round("accuracy", 6).alias("accuracy"), F.round(r, 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(f1, 6).alias("f1"))


def report_by_type(spark, sf) -> DataFrame:
    return _scored(spark, sf).groupBy("lang").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def report_by_source(spark, sf) -> DataFrame:
    two = F.array("source", F.concat(F.lit("half"), (F.col("doc_id") % 2).cast("string")))
    return _scored(spark, sf).select("score", F.explode(two).alias("evidence")).groupBy("evidence").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))


def dataset_means(spark, sf) -> DataFrame:
    """Means whose denominator is all samples: a sample without a score counts as 0."""
    docs = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return docs.agg(F.count("*").alias("n"), F.round(F.avg(zero("quality")), 6).alias("accuracy"), F.round(F.avg(zero("toxic")), 6).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("n_failed"))


def label_means(spark, sf) -> DataFrame:
    """A mean for every label of a fixed domain; -1 for a label without rows."""
    domain = spark.createDataFrame([(x,) for x in ("de", "en", "es", "fr", "it")], "lang string")
    return F.broadcast(domain).join(_scored(spark, sf), "lang", "left").groupBy("lang").agg(F.round(F.coalesce(F.avg("score"), F.lit(-1.0)), 6).alias("mean"))


def timing_shares(spark, sf) -> DataFrame:
    """Total, mean and share of the time that each kind of step takes."""
    e = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return e.select("event_type", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), F.round(F.try_divide(F.col("total"), F.sum("total").over(Window.partitionBy())), 4).alias("share"))


def best_so_far(spark, sf) -> DataFrame:
    """Events that beat all earlier values of their user."""
    earlier = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").withColumn("best", F.max("value").over(earlier))
    return e.filter(F.col("best").isNull() | (F.col("value") > F.col("best"))).select("event_id", "user_id")


#: The least similarity of an anchor and its positive.
PAIR = 0.8


def contrastive_pairs(spark, sf) -> DataFrame:
    """Anchor and positive turns of one conversation whose whole texts score above PAIR by edit distance.

    Texts whose lengths differ by more than PAIR allows are never compared.
    """
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", _ascii(F.lower(F.array_join(words(F.col("text")), " "))).alias("said"))
    a, b = t.filter("role = 'user'").alias("a"), t.alias("b")
    one, two = F.length("a.said"), F.length("b.said")
    both = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") != F.col("b.turn")) & (F.least(one, two) > PAIR * F.greatest(one, two) - 1e-9))
    scored = both.select("a.conv_id", F.col("a.turn").alias("anchor"), F.col("b.turn").alias("positive"), X.anls_strict(F.col("a.said"), F.col("b.said"), PAIR).alias("s"))
    return scored.filter(F.col("s") > PAIR).select("conv_id", "anchor", "positive", F.round("s", 6).alias("score"))


QUERIES = {f.__name__: f for f in (page_context, normal_answers, answer_span, answer_choice, oracle_page, size_subset, page_window, chunk_words, chunk_histogram, histogram_summary, histogram_extremes, concat_context, token_budget, surrounding_words, typed_accuracy, typed_anls, any_of_anls, report_score, accuracy_f1, report_by_type, report_by_source, dataset_means, label_means, timing_shares, best_so_far, contrastive_pairs)}

SQL_GOLD = "g AS (SELECT conv_id, max(turn) AS gold FROM conversations WHERE role = 'user' GROUP BY conv_id)"

SQL = {
    "page_context": f"SELECT conv_id AS doc_id, turn AS page_idx, list_aggregate(list_transform({W}, lambda w: lower(w)), 'string_agg', ' ') AS context FROM conversations WHERE len({W}) > 0 UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE len({W}) = 0",
    "normal_answers": "SELECT conv_id, string_agg(r, ',' ORDER BY r) AS answers FROM (SELECT DISTINCT conv_id, lower(role) AS r FROM conversations) GROUP BY conv_id",
    "answer_span": "WITH m AS (SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS s, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, item_id) AS r FROM m) SELECT d.doc_id, coalesce(item_id, -1) AS item_id, coalesce(s, 0) AS span_start, coalesce(s + n, 0) AS span_end FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id AND r = 1",
    "answer_choice": "WITH m AS (SELECT doc_id, item_id, strpos(d.text, b.text) - 1 AS s, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS c FROM m) SELECT d.doc_id, coalesce(item_id, -1) AS item_id, coalesce(s, 0) AS span_start, coalesce(s + n, 0) AS span_end, coalesce(c, 0) AS n_items FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id AND r = (f.doc_id * 7 + 3) % c",
    "oracle_page": f"WITH {SQL_GOLD} SELECT c.conv_id AS doc_id, turn AS page_idx, len({W}) AS n_words FROM conversations c JOIN g ON c.conv_id = g.conv_id WHERE turn = gold",
    "size_subset": "SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE rank <= floor(c * 0.3)",
    "page_window": f"""WITH {SQL_GOLD}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id),
 b AS (SELECT n.conv_id, n, gold, greatest(0, gold - 2) AS lo, least(gold, greatest(0, n - 3)) AS hi FROM n JOIN g ON n.conv_id = g.conv_id),
 f AS (SELECT *, lo + (conv_id * 7 + 3) % (hi - lo + 1) AS first FROM b)
 SELECT conv_id AS doc_id, gold AS gold_page, gold - first AS gold_in_window, concat_ws(',', first, CASE WHEN first + 1 < n THEN first + 1 ELSE -1 END, CASE WHEN first + 2 < n THEN first + 2 ELSE -1 END) AS window FROM f""",
    "chunk_words": SQL_CHUNKS + " SELECT doc_id, chunk_id, start, stop, md5(array_to_string(words, ' ')) AS text_md5 FROM chunks",
    "chunk_histogram": SQL_CHUNKS + " SELECT stop - start AS size, count(*) AS n FROM chunks GROUP BY 1",
    "histogram_summary": SQL_CHUNKS + ", d AS (SELECT doc_id, count(*) AS k, sum(stop - start)::BIGINT AS n FROM chunks GROUP BY doc_id) SELECT count(*) AS docs, round(avg(k), 6) AS mean_chunks, round(stddev_pop(k), 6) AS std_chunks, min(k) AS least, max(k) AS most, sum(n)::BIGINT AS words FROM d",
    "histogram_extremes": SQL_CHUNKS + """, h AS (SELECT stop - start AS size, count(*) AS n FROM chunks GROUP BY 1), m AS (SELECT sum(size * n) / sum(n) AS mean FROM h)
 SELECT * FROM (SELECT 'most_common' AS kind, size, n FROM h ORDER BY n DESC, size LIMIT 5) UNION ALL SELECT * FROM (SELECT 'least_common', size, n FROM h ORDER BY n, size LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'smallest', size, n FROM h ORDER BY size LIMIT 5) UNION ALL SELECT * FROM (SELECT 'largest', size, n FROM h ORDER BY size DESC LIMIT 5)
 UNION ALL SELECT * FROM (SELECT 'nearest_mean', size, n FROM h, m ORDER BY round(abs(size - mean), 6), size LIMIT 5)""",
    "concat_context": SQL_CHUNKS + ", c2 AS (SELECT doc_id, string_agg(array_to_string(words, ' '), ' [SEP] ' ORDER BY chunk_id) AS c FROM chunks GROUP BY doc_id) SELECT doc_id, length(c) AS n_chars, md5(c) AS context_md5 FROM c2",
    "token_budget": SQL_CHUNKS + " SELECT * FROM (SELECT doc_id, chunk_id, sum(stop - start) OVER (PARTITION BY doc_id ORDER BY chunk_id)::BIGINT AS used FROM chunks) WHERE used <= 200",
    "surrounding_words": SQL_CHUNKS + """, p AS (SELECT doc_id, chunk_id, stop - start AS n, (sum(stop - start) OVER (PARTITION BY doc_id ORDER BY chunk_id))::BIGINT - 1 AS l FROM chunks),
 t AS (SELECT doc_id, sum(n)::BIGINT AS places FROM p GROUP BY doc_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, chunk_id) AS rank FROM p),
 x AS (SELECT k.doc_id, rank, unnest(range(greatest(0, l - n + 1 - 15), least(places - 1, l + 15) + 1)) AS pos FROM k JOIN t ON k.doc_id = t.doc_id WHERE rank <= 3),
 b AS (SELECT doc_id, pos, min(rank) AS rank FROM x GROUP BY 1, 2) SELECT doc_id, rank, min(pos) AS first, max(pos) AS last, count(*) AS n FROM b GROUP BY 1, 2""",
    "typed_accuracy": SQL_ANSWERS + " SELECT event_id, kind, ok::INT::DOUBLE AS accuracy FROM acc",
    "typed_anls": SQL_ANSWERS + " SELECT event_id, kind, round(CASE WHEN p1 = '' THEN 0.0 WHEN kind = 'not-answerable' OR g1 = '' THEN (p1 = 'none')::INT WHEN p1 = 'none' THEN 0.0 WHEN special THEN (g1 = p1)::INT WHEN kind IN ('int', 'float', 'list') THEN ok::INT WHEN sim >= 0.5 THEN sim ELSE 0.0 END, 6)::DOUBLE AS anls FROM acc",
    "any_of_anls": f"""WITH f AS (SELECT conv_id, turn, role, lower(regexp_replace(array_to_string({W}, ' '), '[^\\x00-\\x7F]', '?', 'g')) AS x FROM conversations),
 s AS (SELECT u.conv_id, u.turn, 1 - levenshtein(u.x, a.x)::DOUBLE / greatest(len(u.x), len(a.x), 1) AS s FROM f u JOIN f a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant')
 SELECT conv_id, turn, round(max(CASE WHEN s > 0.5 THEN s ELSE 0.0 END), 6)::DOUBLE AS anls FROM s GROUP BY 1, 2""",
    "report_score": SQL_ANSWERS + r""", c AS (SELECT *, rtrim(trim(g1, chr(39) || '"'), '%') AS gc, rtrim(trim(p1, chr(39) || '"'), '%') AS pc,
  CASE WHEN starts_with(gold, '[') THEN list_sort([event_type, 'b, c']) ELSE [g1] END AS gl,
  CASE WHEN kind = 'list' AND off = 0 OR off = 6 THEN list_sort([event_type, 'b, c']) ELSE [p1] END AS pl FROM s),
 n AS (SELECT *, try_cast(gc AS DOUBLE) AS gn, try_cast(pc AS DOUBLE) AS pn FROM c),
 r AS (SELECT *, [[gn / 100, pn], [gn, pn], [gn * 100, pn]] AS pairs FROM n),
 d AS (SELECT *, list_bool_or(list_transform(pairs, lambda q: abs(q[1] - q[2]) <= 0.01 * greatest(abs(q[1]), abs(q[2]))
   OR round(q[1], greatest(2, least(len(split_part(q[1]::VARCHAR, '.', 2)), len(split_part(q[2]::VARCHAR, '.', 2))))::INT) = round(q[2], greatest(2, least(len(split_part(q[1]::VARCHAR, '.', 2)), len(split_part(q[2]::VARCHAR, '.', 2))))::INT))) AS near FROM r),
 f AS (SELECT *, contains(gc, 'https://') OR suffix(gc, '.py') OR suffix(gc, 'ipynb') OR starts_with(gc, 'page') OR contains(gc, 'a.m.') OR contains(gc, 'p.m.') OR regexp_full_match(gc, '\d+(-\d+|\s\d+)?|\d{4}[-\s]\d{2}([-\s]\d{2})?|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}') AS exact,
  1 - levenshtein(gc, pc)::DOUBLE / greatest(len(gc), len(pc), 1) AS near_text FROM d)
 SELECT event_id, round(CASE kind WHEN 'int' THEN CASE WHEN g_int IS NOT NULL AND p_int IS NOT NULL THEN (g_int = p_int)::INT ELSE (gold = '')::INT END WHEN 'float' THEN coalesce(near, false)::INT
 WHEN 'list' THEN (gl = pl)::INT ELSE CASE WHEN exact THEN (gc = pc)::INT WHEN near_text > 0.5 THEN near_text ELSE 0 END END, 6)::DOUBLE AS score FROM f""",
    "accuracy_f1": SQL_SCORED + ", t AS (SELECT avg(score) AS a, sum(CASE WHEN NOT unanswerable THEN score ELSE 0 END) AS hit, count(*) FILTER (NOT unanswerable) AS gold, count(*) FILTER (pred <> 'Not answerable') AS made FROM r) SELECT round(a, 6) AS accuracy, round(hit / gold, 6) AS recall, round(hit / made, 6) AS precision, round(coalesce(2 * (hit / gold) * (hit / made) / nullif(hit / gold + hit / made, 0), 0), 6) AS f1 FROM t",
    "report_by_type": SQL_SCORED + " SELECT lang, round(avg(score), 6) AS mean, count(*) AS n FROM r GROUP BY lang",
    "report_by_source": SQL_SCORED + " SELECT evidence, round(avg(score), 6) AS mean, count(*) AS n FROM (SELECT score, unnest([source, 'half' || (doc_id % 2)]) AS evidence FROM r) GROUP BY evidence",
    "dataset_means": "SELECT count(*) AS n, round(avg(coalesce(quality, 0)), 6) AS accuracy, round(avg(coalesce(toxic, 0)), 6) AS toxic, count(*) FILTER (quality IS NULL) AS n_failed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "label_means": SQL_SCORED + " SELECT x.lang, round(coalesce(avg(score), -1), 6) AS mean FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'it']) AS lang) x LEFT JOIN r ON r.lang = x.lang GROUP BY x.lang",
    "timing_shares": "SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(sum(value) / sum(sum(value)) OVER (), 4) AS share FROM events GROUP BY event_type",
    "best_so_far": "SELECT event_id, user_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best",
    "contrastive_pairs": f"""WITH f AS (SELECT conv_id, turn, role, regexp_replace(lower(array_to_string({W}, ' ')), '[^\\x00-\\x7F]', '?', 'g') AS x FROM conversations),
 s AS (SELECT a.conv_id, a.turn AS anchor, b.turn AS positive, 1 - levenshtein(a.x, b.x)::DOUBLE / greatest(len(a.x), len(b.x), 1) AS s FROM f a JOIN f b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.role = 'user')
 SELECT conv_id, anchor, positive, round(s, 6)::DOUBLE AS score FROM s WHERE s > 0.8""",
}
