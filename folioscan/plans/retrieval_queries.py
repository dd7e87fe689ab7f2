"""Retrieval, choice of answers, layout, sampling and noise, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import geometry as G
from folioscan.functions import vectors as V
from folioscan.functions.similarity import best_window_score, chunk_score
from folioscan.operators import chunking as C
from folioscan.operators import clustering as K
from folioscan.operators import histograms as H
from folioscan.operators import layout as L
from folioscan.operators import ranking as R
from folioscan.operators import sampling as S
from folioscan.operators import search as N
from folioscan.plans.text_queries import SQL_WORDS, doc_words
from folioscan.sources.tables import pages, table

W = SQL_WORDS.format("text")


def _term(word) -> F.Column:
    """The slot of a word in a hashed term vector of 64."""
    return (F.conv(F.substring(F.md5(F.lower(word).cast("binary")), 1, 2), 16, 10).cast("int") % 64).alias("term")


def _vectors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse hashed term frequencies: keys, term, f, and the vector's norm."""
    counts = rows.select(*keys, F.explode("words").alias("w")).groupBy(*keys, _term(F.col("w"))).agg(F.count("*").alias("f"))
    return counts.withColumn("norm", F.sqrt(F.sum(F.col("f") * F.col("f")).over(Window.partitionBy(*keys)).cast("double")))


def retrieve_pages(spark, sf) -> DataFrame:
    """Flagship: pages of a conversation are cut in chunks, and the chunks ranked for each user turn.

    A chunk's similarity is the cosine of hashed term vectors (a lexical stand-in for an embedder); question and chunks
    meet within their document alone. Returns the three best chunks of each question and whether they are of its page.
    """
    rows = pages(spark, sf)
    chunks = C.chunks(rows.select("doc_id", "page_idx", "words")).select("doc_id", "page_idx", "chunk_id", "words")
    questions = rows.filter("role = 'user'").select("doc_id", F.col("page_idx").alias("gold"), "words")
    c, q = _vectors(chunks, ["doc_id", "page_idx", "chunk_id"]).alias("c"), _vectors(questions, ["doc_id", "gold"]).alias("q")
    both = q.join(c, (F.col("q.doc_id") == F.col("c.doc_id")) & (F.col("q.term") == F.col("c.term")))
    dots = both.groupBy("q.doc_id", "q.gold", "c.page_idx", "c.chunk_id").agg((F.sum(F.col("q.f") * F.col("c.f")) / (F.first("q.norm") * F.first("c.norm") + 1e-8)).alias("s"))
    best = R.top_k(dots, ["doc_id", "gold"], "s", ["page_idx", "chunk_id"], 3)
    return best.select("doc_id", "gold", F.col("rank").cast("long").alias("rank"), "page_idx", F.col("chunk_id").cast("long").alias("chunk_id"), F.round("s", 6).alias("sim"), (F.col("page_idx") == F.col("gold")).alias("hit"))


def _nearest(spark, sf, k: int) -> DataFrame:
    """Queries (every hundredth vector) against all others: the k most similar of each."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return N.nearest(e.filter("id % 100 = 0"), e, k)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_SQL_SIM = f"{_DOT.format(a='q.embedding', b='d.embedding')} / (q.norm * d.norm + 1e-8)"
_SQL_NORMS = f"nv AS (SELECT *, sqrt({_DOT.format(a='embedding', b='embedding')}) AS norm FROM embeddings)"
SQL_SIM = f"""WITH {_SQL_NORMS}, sims AS (SELECT q.vec_id AS question, d.vec_id AS chunk, round({_SQL_SIM}, 9) AS sim FROM nv q JOIN nv d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY sim DESC, chunk) AS rank FROM sims) WHERE rank <= {{k}})"""


def cosine_topk(spark, sf) -> DataFrame:
    return _nearest(spark, sf, 10).select("question", F.col("rank").cast("long").alias("rank"), "chunk", F.round("sim", 6).alias("sim"))


def rerank_filter(spark, sf) -> DataFrame:
    scored = _nearest(spark, sf, 20).withColumn("score", F.col("sim") + F.col("chunk") % 7 * 0.01)
    kept = R.rerank(scored, ["question"], "score", ["chunk"], 0.2, 5, 1)
    return kept.select("question", "chunk", F.round("score", 6).alias("score"), F.col("new_rank").cast("long").alias("new_rank"))


def _confidences(spark, sf) -> DataFrame:
    """An answer for each page of every conversation, its whole text, with a made-up confidence."""
    rows = pages(spark, sf).filter(F.size("words") > 0)
    conf = ((F.col("doc_id") * 13 + F.col("page_idx") * 29) % 100 / 100.0).alias("conf")
    return rows.select("doc_id", "page_idx", F.lower(F.array_join("words", " ")).alias("answer"), conf)


SQL_CONF = f"WITH c AS (SELECT conv_id AS doc_id, turn AS page_idx, lower(array_to_string({W}, ' ')) AS answer, (conv_id * 13 + turn * 29) % 100 / 100.0 AS conf FROM conversations WHERE len({W}) > 0)"


def max_confidence(spark, sf) -> DataFrame:
    return R.best(_confidences(spark, sf), ["doc_id"], "conf", ["page_idx"]).select("doc_id", "page_idx", "answer", F.round("conf", 6).alias("conf"))


def majority_page(spark, sf) -> DataFrame:
    """The page that most of a question's 50 best chunks are of."""
    rows = _nearest(spark, sf, 50).filter("sim > 0.05").withColumn("page", F.col("chunk") % 5)
    return R.page_vote(rows, ["question"], "page", F.lit(1)).select("question", "page", F.col("votes").cast("long").alias("votes"))


def weighted_page(spark, sf) -> DataFrame:
    rows = _nearest(spark, sf, 50).filter("sim > 0").withColumn("page", F.col("chunk") % 5)
    return R.page_vote(rows, ["question"], "page", F.col("sim")).select("question", "page", F.round("votes", 4).alias("votes"))


def reorder_chunks(spark, sf) -> DataFrame:
    """The best chunks of a question in reading order: page, then upper and left edge."""
    b = _boxes(spark, sf).select(F.col("box_id").alias("chunk"), "page", "box")
    best = _nearest(spark, sf, 5).join(b, "chunk")
    order = Window.partitionBy("question").orderBy("page", "box.y0", "box.x0", "chunk")
    return best.select("question", "chunk", F.row_number().over(order).cast("long").alias("place"))


def mean_pool(spark, sf) -> DataFrame:
    """The mean vector of each label over the vectors that its mask keeps; sums are partial before the exchange."""
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 3 != 0).alias("held"), F.posexplode("embedding").alias("dim", "x"))
    total = F.sum(F.when(F.col("held"), F.col("x").cast("double")).otherwise(0.0))
    means = e.groupBy("label", "dim").agg((total / F.greatest(F.count_if("held").cast("double"), F.lit(1e-9))).alias("value"))
    return means.select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


def late_interaction(spark, sf) -> DataFrame:
    """Questions against pages: the best patch of each token, summed. The vectors of a label that are divisible by 100 are a
    question's tokens; a label's others are a page's patches."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("part"), F.col("embedding").alias("vector"))
    tokens = e.filter("id % 100 = 0")
    best = N.best_of_parts(tokens.select("id", "vector"), e.filter("id % 100 <> 0"))
    of = tokens.select(F.col("id").alias("question"), F.col("part").alias("label"))
    return best.join(of, "question").groupBy("label", F.col("part").alias("page")).agg(F.round(F.sum("sim"), 5).alias("score"))


def _boxes(spark, sf) -> DataFrame:
    """Boxes on a grid of 200 from the first components of the vectors; a page has the vectors of a label and a remainder."""
    e = table(spark, sf, "embeddings")
    x = [F.floor((F.element_at("embedding", i + 1).cast("double") + 1) * 100) / 200 for i in range(4)]
    b = G.box(F.least(x[0], x[2]), F.least(x[1], x[3]), F.greatest(x[0], x[2]), F.greatest(x[1], x[3]))
    return e.select((F.col("label") * 10 + F.col("vec_id") % 10).cast("long").alias("page"), F.col("vec_id").alias("box_id"), b.alias("box"))


SQL_BOXES = """WITH f AS (SELECT (label * 10 + vec_id % 10)::BIGINT AS page, vec_id AS box_id, list_transform(embedding[1:4], lambda x: floor((x::DOUBLE + 1) * 100) / 200) AS x FROM embeddings),
b AS (SELECT page, box_id, least(x[1], x[3]) AS x0, least(x[2], x[4]) AS y0, greatest(x[1], x[3]) AS x1, greatest(x[2], x[4]) AS y1 FROM f),
a AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, CASE WHEN y1 = y0 THEN 0 ELSE (x1 - x0) * (y1 - y0) * ((x1 - x0) / (y1 - y0)) END AS w FROM b),
p AS (SELECT l.page, l.box_id AS i, r.box_id AS j, l.w AS wi, r.w AS wj, l.area AS ai, r.area AS aj,
 greatest(0, least(l.x1, r.x1) - greatest(l.x0, r.x0)) * greatest(0, least(l.y1, r.y1) - greatest(l.y0, r.y0)) AS inter,
 l.x0 < r.x1 AND r.x0 < l.x1 AND l.y0 < r.y1 AND r.y0 < l.y1 AS touch FROM a l JOIN a r ON l.page = r.page AND l.box_id <> r.box_id)"""


def box_pairs(spark, sf) -> DataFrame:
    """IoU, containment and spatial weight of the pairs of boxes of a page that overlap."""
    b = _boxes(spark, sf)
    x, y = b.alias("x"), b.alias("y")
    both = x.join(y, (F.col("x.page") == F.col("y.page")) & (F.col("x.box_id") < F.col("y.box_id")) & G.overlaps(F.col("x.box"), F.col("y.box")))
    one, two = F.col("x.box"), F.col("y.box")
    return both.select("x.page", F.col("x.box_id").alias("a"), F.col("y.box_id").alias("b"), F.round(G.iou(one, two), 6).alias("iou"), F.round(G.containment(one, two), 6).alias("inside"))


def absorbed_boxes(spark, sf) -> DataFrame:
    return L.absorbed(_boxes(spark, sf)).select("page", "box_id")


def suppressed_boxes(spark, sf) -> DataFrame:
    return L.suppress(_boxes(spark, sf), 0.3)


def box_components(spark, sf) -> DataFrame:
    return L.components(_boxes(spark, sf))


def merged_boxes(spark, sf) -> DataFrame:
    return L.merged(_boxes(spark, sf))


def box_clusters(spark, sf) -> DataFrame:
    return K.clusters(_boxes(spark, sf))


def cluster_crops(spark, sf) -> DataFrame:
    """Crops of boxes whose cluster is a remainder of their id (-1 for some) and whose label is another."""
    b = _boxes(spark, sf).withColumn("cluster", F.col("box_id") % 4 - 1).withColumn("label", (F.col("box_id") % 3).cast("int"))
    return K.crop_boxes(b).select("page", F.col("crop").cast("long").alias("crop"), F.col("label").cast("long").alias("label"), "x0", "y0", "x1", "y1")


def cluster_parts(spark, sf) -> DataFrame:
    """Pages of each conversation split where their words would exceed 120."""
    rows = pages(spark, sf).select("doc_id", "page_idx", F.size("words").alias("n"))
    return K.split_by_budget(rows, ["doc_id"], "page_idx", "n", 120).select("doc_id", "page_idx", F.col("part").cast("long").alias("part"))


def merged_words(spark, sf) -> DataFrame:
    """Turns as boxes; a conversation's turns of one role are a cluster, and system turns stand alone."""
    rows = pages(spark, sf)
    group = F.when(F.col("role") == "system", -1).when(F.col("role") == "user", 0).otherwise(1)
    units = rows.select(F.col("doc_id").alias("page"), F.col("page_idx").alias("box_id"), F.col("page_idx").alias("place"), F.col("role").alias("label"), group.alias("cluster"), "words")
    merged = K.merge_words(units)
    return merged.select("page", "place", "label", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ").cast("binary")).alias("words_md5"))


def chunk_scores(spark, sf) -> DataFrame:
    """How well the pages of a conversation's other roles hold each user turn, which is the answer that is looked for."""
    rows = pages(spark, sf).select("doc_id", "page_idx", "role", F.array_join("words", " ").alias("text"))
    asked = rows.filter("role = 'user'").select("doc_id", F.col("page_idx").alias("turn"), F.col("text").alias("part"))
    # A turn meets some pages at a time, so that what one page has needn't be looked for below that in the next.
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx"))
    held = rows.filter("role <> 'user'").select("doc_id", "text", F.floor((nth - 1) / 16).alias("some"))
    held = held.groupBy("doc_id", "some").agg(F.collect_list("text").alias("chunks"))
    # Comparing takes long for its few bytes, so it is dealt out by number, a long conversation's too.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    scored = asked.join(held, "doc_id").repartition(tasks).withColumn("s", best_window_score(F.col("chunks"), F.col("part")))
    return scored.groupBy("doc_id", "turn").agg(F.round(chunk_score(F.max("s")), 6).alias("chunk_score"))


def patch_grid(spark, sf) -> DataFrame:
    sizes = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), (F.col("p_size") * 20 + 100).cast("int").alias("width"), (F.col("p_partkey") % 700 + 60).cast("int").alias("height"))
    return C.patches(sizes, 256).select("image", *(F.col(c).cast("long").alias(c) for c in ("row", "col", "x0", "y0", "x1", "y1")))


def stratified(spark, sf) -> DataFrame:
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_pages"))
    return S.stratified(sizes, "n_pages", 30, [F.col("conv_id") * 7919 % 1009, F.col("conv_id")])


def balanced(spark, sf) -> DataFrame:
    """All rows of the rare class, and as many of the other, by a fixed order."""
    rows = table(spark, sf, "labels").select("doc_id", "toxic")
    n = rows.filter("toxic = 1").agg(F.count("*").alias("n"))
    key = F.col("doc_id") * 7919 % 10007
    ranked = S.group_rank(rows.filter("toxic = 0"), ["toxic"], key, ["doc_id"])
    few = ranked.join(F.broadcast(n), F.col("rank") <= F.col("n")).select("doc_id", "toxic")
    return rows.filter("toxic = 1").unionByName(few)


def noise_pages(spark, sf) -> DataFrame:
    """Two pages of other conversations, drawn from all of them, are mixed into every conversation, and its pages numbered anew."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_idx"))
    sizes = rows.groupBy("doc_id").agg(F.count("*").alias("n_pages")).withColumn("all", F.lit(0))
    docs = S.group_rank(sizes, ["all"], F.floor(F.col("doc_id") / 4096), ["doc_id"]).select("doc_id", "n_pages", (F.col("rank") - 1).alias("at"))
    noise = S.noise_draws(docs, sizes.count(), 2).join(docs.select("doc_id", F.col("n_pages").alias("n")), "doc_id")
    place = (F.col("doc_id") * 3 + F.col("k")) % (F.col("n") + 1)
    return S.mix_pages(rows, noise, place).select("doc_id", F.col("page_idx").cast("long").alias("page_idx"), "old_page", "was_noise")


def noise_bins(spark, sf) -> DataFrame:
    """Means by page count of each sample's mean and deviation over repetitions, at several noise levels; empty bins are 0.

    The bins go from 1 to the most pages of a conversation, and to 10 at least.
    """
    sizes = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(level, rep) for level in (0, 3, 20, 100) for rep in (0, 1, 2)], "level long, rep long")
    runs = sizes.crossJoin(F.broadcast(grid)).withColumn("score", (F.col("conv_id") * 17 + F.col("level") * 5 + F.col("rep") * 31) % 101 / 100.0)
    each = runs.groupBy("level", "conv_id", "n").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    most = sizes.agg(F.greatest(F.max("n"), F.lit(10).cast("long")).alias("most"))
    bins = most.select(F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("n")).crossJoin(F.broadcast(grid.select("level").distinct()))
    found = each.groupBy("level", "n").agg(F.avg("m").alias("m"), F.avg("s").alias("s"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    return bins.join(found, ["level", "n"], "left").select("level", "n", zero("m").alias("mean"), zero("s").alias("std"))


def layout_histograms(spark, sf) -> DataFrame:
    """Widths and heights of boxes in twentieths of a page, their labels, and boxes per page."""
    box = F.col("box")
    sizes = {"width": F.floor((box["x1"] - box["x0"]) * 20), "height": F.floor((box["y1"] - box["y0"]) * 20), "label": F.col("box_id") % 3}
    return H.histograms(_boxes(spark, sf), sizes, {"boxes_per_page": F.col("page")})


def chunk_counts(spark, sf) -> DataFrame:
    """Sizes of the chunks of all pages, chunks per page and per document."""
    found = C.chunks(pages(spark, sf).select("doc_id", "page_idx", "words"))
    return H.histograms(found, {"size": F.size("words")}, {"chunks_per_page": F.struct("doc_id", "page_idx"), "chunks_per_document": F.col("doc_id")})


QUERIES = {f.__name__: f for f in (retrieve_pages, cosine_topk, rerank_filter, max_confidence, majority_page, weighted_page, reorder_chunks, mean_pool, late_interaction, box_pairs, absorbed_boxes, suppressed_boxes, box_components, merged_boxes, box_clusters, cluster_crops, cluster_parts, merged_words, chunk_scores, patch_grid, stratified, balanced, noise_pages, noise_bins, layout_histograms, chunk_counts)}

_VOTE = "v AS (SELECT question, chunk % 5 AS page, {sum} AS votes FROM s WHERE sim > {least} GROUP BY 1, 2) SELECT question, page, {votes} AS votes FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(votes, 6) DESC, page) AS r FROM v) WHERE r = 1"
_COMPONENTS = SQL_BOXES.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT DISTINCT page, i, j FROM p WHERE touch), r AS (SELECT page, box_id, box_id AS x FROM b UNION SELECT r.page, r.box_id, e.j FROM r JOIN e ON r.page = e.page AND r.x = e.i), k AS (SELECT page, box_id, min(x) AS component FROM r GROUP BY 1, 2)"

SQL = {
    "retrieve_pages": f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page_idx, role, {W} AS ws FROM conversations), n AS (SELECT *, len(ws) AS n FROM p),
 s AS (SELECT doc_id, page_idx, ws, n, unnest(range(0, n, 50)) AS s FROM n),
 c AS (SELECT doc_id, page_idx, s AS start, ws[s + 1 : CASE WHEN n - (s + 50) <= 22 THEN n ELSE s + 60 END] AS ws FROM s WHERE s = 0 OR n - s > 22),
 ch AS (SELECT doc_id, page_idx, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY start) - 1 AS chunk_id, ws FROM c),
 cw AS (SELECT doc_id, page_idx, chunk_id, unnest(ws) AS w FROM ch), qw AS (SELECT doc_id, page_idx AS gold, unnest(ws) AS w FROM p WHERE role = 'user'),
 ct AS (SELECT doc_id, page_idx, chunk_id, ('0x' || substr(md5(lower(w)), 1, 2))::INT % 64 AS t, count(*) AS f FROM cw GROUP BY ALL),
 qt AS (SELECT doc_id, gold, ('0x' || substr(md5(lower(w)), 1, 2))::INT % 64 AS t, count(*) AS f FROM qw GROUP BY ALL),
 cn AS (SELECT *, sqrt((sum(f * f) OVER (PARTITION BY doc_id, page_idx, chunk_id))::DOUBLE) AS norm FROM ct), qn AS (SELECT *, sqrt((sum(f * f) OVER (PARTITION BY doc_id, gold))::DOUBLE) AS norm FROM qt),
 d AS (SELECT q.doc_id, q.gold, c.page_idx, c.chunk_id, sum(q.f * c.f)::DOUBLE / (any_value(q.norm) * any_value(c.norm) + 1e-8) AS s FROM qn q JOIN cn c ON q.doc_id = c.doc_id AND q.t = c.t GROUP BY ALL)
 SELECT doc_id, gold, rank, page_idx, chunk_id, round(s, 6) AS sim, page_idx = gold AS hit FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gold ORDER BY s DESC, page_idx, chunk_id) AS rank FROM d) WHERE rank <= 3""",
    "cosine_topk": SQL_SIM.format(k=10) + " SELECT question, rank, chunk, round(sim, 6) AS sim FROM s",
    "rerank_filter": SQL_SIM.format(k=20) + """, t AS (SELECT *, sim + chunk % 7 * 0.01::DOUBLE AS score FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, chunk) AS new_rank, count(*) FILTER (score >= 0.2) OVER (PARTITION BY question) AS n_pass FROM t)
 SELECT question, chunk, round(score, 6) AS score, new_rank FROM r WHERE (n_pass >= 1 AND score >= 0.2 AND new_rank <= 5) OR (n_pass < 1 AND new_rank <= 1)""",
    "layout_histograms": SQL_BOXES + """, k AS (SELECT unnest([{'kind': 'width', 'value': floor((x1 - x0) * 20)}, {'kind': 'height', 'value': floor((y1 - y0) * 20)}, {'kind': 'label', 'value': (box_id % 3)::DOUBLE}], recursive := true) FROM b),
 u AS (SELECT count(*)::DOUBLE AS value FROM b GROUP BY page) SELECT kind, value, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT 'boxes_per_page', value, count(*) FROM u GROUP BY 2""",
    "chunk_counts": f"""WITH p AS (SELECT conv_id AS d, turn AS p, len({W}) AS n FROM conversations), s AS (SELECT d, p, n, unnest(range(0, n, 50)) AS s FROM p),
 c AS (SELECT d, p, CASE WHEN n - (s + 50) <= 22 THEN n ELSE s + 60 END - s AS size FROM s WHERE s = 0 OR n - s > 22)
 SELECT 'size' AS kind, size::DOUBLE AS value, count(*) AS n FROM c GROUP BY 2 UNION ALL SELECT 'chunks_per_page', k, count(*) FROM (SELECT count(*)::DOUBLE AS k FROM c GROUP BY d, p) GROUP BY 2
 UNION ALL SELECT 'chunks_per_document', k, count(*) FROM (SELECT count(*)::DOUBLE AS k FROM c GROUP BY d) GROUP BY 2""",
    "max_confidence": SQL_CONF + " SELECT doc_id, page_idx, answer, round(conf, 6)::DOUBLE AS conf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY conf DESC, page_idx) AS r FROM c) WHERE r = 1",
    "majority_page": SQL_SIM.format(k=50) + ", " + _VOTE.format(sum="count(*)", least="0.05", votes="votes"),
    "weighted_page": SQL_SIM.format(k=50) + ", " + _VOTE.format(sum="sum(sim)", least="0", votes="round(votes, 4)"),
    "reorder_chunks": SQL_SIM.format(k=5).replace("WITH nv", SQL_BOXES + ", nv") + " SELECT question, chunk, row_number() OVER (PARTITION BY question ORDER BY page, y0, x0, chunk) AS place FROM s JOIN b ON chunk = box_id",
    "mean_pool": "WITH v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) SELECT label, dim, round(sum(CASE WHEN vec_id % 3 = 0 THEN 0 ELSE x END) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1e-9), 6) AS value FROM v GROUP BY label, dim",
    "late_interaction": f"WITH {_SQL_NORMS}, s AS (SELECT q.label::BIGINT AS label, d.label::BIGINT AS page, q.vec_id, max(round({_SQL_SIM}, 9)) AS m FROM nv q JOIN nv d ON q.vec_id % 100 = 0 AND d.vec_id % 100 <> 0 GROUP BY 1, 2, 3) SELECT label, page, round(sum(m), 5) AS score FROM s GROUP BY 1, 2",
    "box_pairs": SQL_BOXES + " SELECT page, i AS a, j AS b, round(inter / (ai + aj - inter + 1e-8), 6) AS iou, round(CASE WHEN ai <= 0 THEN 0 ELSE inter / ai END, 6) AS inside FROM p WHERE touch AND i < j",
    "absorbed_boxes": SQL_BOXES + " SELECT DISTINCT page, i AS box_id FROM p WHERE wi < wj AND CASE WHEN ai <= 0 THEN 0 ELSE inter / ai END >= 0.6",
    "box_components": _COMPONENTS + " SELECT page, box_id, component FROM k",
    "merged_boxes": _COMPONENTS + " SELECT k.page, component, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM k JOIN b ON k.page = b.page AND k.box_id = b.box_id GROUP BY 1, 2",
    "cluster_crops": SQL_BOXES + """, f2 AS (SELECT *, box_id % 4 = 0 AS lone, CASE WHEN box_id % 4 = 0 THEN box_id ELSE box_id % 4 - 1 END AS id, (box_id % 3)::BIGINT AS label FROM b),
 l AS (SELECT page, lone, id, label, round(sum((x1 - x0) * (y1 - y0)), 9) AS area, min(box_id) AS seen FROM f2 GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY page, lone, id ORDER BY area DESC, seen) AS r FROM l),
 u AS (SELECT page, lone, id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM f2 GROUP BY ALL)
 SELECT u.page, row_number() OVER (PARTITION BY u.page ORDER BY u.lone DESC, u.id) - 1 AS crop, label, x0, y0, x1, y1 FROM u JOIN t ON u.page = t.page AND u.lone = t.lone AND u.id = t.id AND r = 1""",
    "merged_words": f"""WITH c AS (SELECT conv_id AS page, turn, role, {W} AS ws, CASE role WHEN 'system' THEN 'box' || turn ELSE CASE role WHEN 'user' THEN 'user' ELSE 'other' END END AS unit FROM conversations),
 l AS (SELECT page, unit, role, count(*) AS n, min(turn) AS seen FROM c GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY page, unit ORDER BY n DESC, seen) AS r FROM l),
 u AS (SELECT page, unit, min(turn) AS place, flatten(list(ws ORDER BY turn)) AS ws FROM c GROUP BY ALL)
 SELECT u.page, place, role AS label, len(ws) AS n, md5(array_to_string(ws, ' ')) AS words_md5 FROM u JOIN m ON u.page = m.page AND u.unit = m.unit AND r = 1""",
    "cluster_parts": f"""WITH RECURSIVE c AS (SELECT conv_id AS doc_id, turn AS page_idx, len({W}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
 f AS (SELECT doc_id, page_idx, r, 0::BIGINT AS part, n AS used FROM c WHERE r = 1
 UNION ALL SELECT c.doc_id, c.page_idx, c.r, CASE WHEN f.used > 0 AND f.used + c.n > 120 THEN f.part + 1 ELSE f.part END, CASE WHEN f.used > 0 AND f.used + c.n > 120 THEN c.n ELSE f.used + c.n END FROM f JOIN c ON c.doc_id = f.doc_id AND c.r = f.r + 1)
 SELECT doc_id, page_idx, part FROM f""",
    "patch_grid": """WITH i AS (SELECT p_partkey AS image, p_size * 20 + 100 AS w, p_partkey % 700 + 60 AS h FROM part),
 g AS (SELECT *, CASE WHEN w <= 256 THEN 1 ELSE ceil((w - 256) / 128)::BIGINT + 1 END AS nc, CASE WHEN h <= 256 THEN 1 ELSE ceil((h - 256) / 128)::BIGINT + 1 END AS nr FROM i),
 r AS (SELECT *, unnest(range(0, nr)) AS row FROM g), c AS (SELECT *, unnest(range(0, nc)) AS col FROM r),
 x AS (SELECT image, w, h, row, col, greatest(0, least(col * 128, w - 256)) AS x0, greatest(0, least(row * 128, h - 256)) AS y0 FROM c)
 SELECT image, row, col, x0::BIGINT AS x0, y0::BIGINT AS y0, least(x0 + 256, w)::BIGINT AS x1, least(y0 + 256, h)::BIGINT AS y1 FROM x""",
    "stratified": """WITH z AS (SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id), k AS (SELECT n_pages, row_number() OVER (ORDER BY n_pages) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT n_pages FROM z)),
 u AS (SELECT z.*, row_number() OVER (PARTITION BY z.n_pages ORDER BY conv_id * 7919 % 1009, conv_id) AS u, 30 // k + CASE WHEN i < 30 % k THEN 1 ELSE 0 END AS share FROM z JOIN k ON z.n_pages = k.n_pages)
 SELECT conv_id, n_pages FROM (SELECT *, row_number() OVER (ORDER BY greatest(0, u - share), n_pages, u) AS r FROM u) WHERE r <= 30""",
    "suppressed_boxes": SQL_BOXES.replace("WITH", "WITH RECURSIVE", 1) + """, z AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY area DESC, box_id) AS r FROM a),
 folded AS (SELECT page, r, [box_id] AS kept FROM z WHERE r = 1 UNION ALL SELECT f.page, z.r, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.page = z.page AND p.i = z.box_id AND list_contains(f.kept, p.j) AND inter / (ai + aj - inter + 1e-8) > 0.3) THEN f.kept ELSE list_append(f.kept, z.box_id) END FROM folded f JOIN z ON z.page = f.page AND z.r = f.r + 1)
 SELECT page, unnest(kept) AS box_id FROM (SELECT page, arg_max(kept, r) AS kept FROM folded GROUP BY page)""",
    "balanced": "WITH n AS (SELECT count(*) AS n FROM labels WHERE toxic = 1) SELECT doc_id, toxic FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id * 7919 % 10007, doc_id) AS r FROM labels WHERE toxic = 0), n WHERE r <= n",
    "noise_pages": """WITH z AS (SELECT conv_id AS d, count(*) AS n FROM conversations GROUP BY 1), i AS (SELECT d, n, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS c FROM z),
 s AS (SELECT list_filter(range(1, 200), lambda x: gcd(x, m) = 1)[1:16] AS s FROM (SELECT count(*) - 1 AS m FROM z)),
 r AS (SELECT d, n, i, k, (i + 1 + (i * 31 + k * s[i % len(s) + 1]) % (c - 1)) % c AS o FROM i, s, (SELECT unnest([0, 1]) AS k) WHERE c > 1),
 u AS (SELECT conv_id AS d, turn AS place, 1 AS own, 0 AS k, turn AS old FROM conversations UNION ALL SELECT r.d, (r.d * 3 + k) % (r.n + 1), 0, k, (r.i * 5 + o * 3 + k * 7) % i.n FROM r JOIN i ON i.i = r.o)
 SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY place, own, k, old) - 1 AS page_idx, old AS old_page, own = 0 AS was_noise FROM u""",
    "noise_bins": """WITH z AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1), r AS (SELECT conv_id, n, level, rep, (conv_id * 17 + level * 5 + rep * 31) % 101 / 100.0 AS s FROM z, (SELECT unnest([0, 3, 20, 100])::BIGINT AS level), (SELECT unnest([0, 1, 2]) AS rep)),
 e AS (SELECT level, conv_id, n, avg(s) AS m, stddev_pop(s) AS sd FROM r GROUP BY 1, 2, 3), f AS (SELECT level, n, avg(m) AS m, avg(sd) AS sd FROM e GROUP BY 1, 2)
 SELECT b.level, b.n, round(coalesce(m, 0), 6)::DOUBLE AS mean, round(coalesce(sd, 0), 6)::DOUBLE AS std FROM (SELECT * FROM (SELECT unnest([0, 3, 20, 100])::BIGINT AS level), (SELECT unnest(range(1, (SELECT greatest(max(n), 10) + 1 FROM z))) AS n)) b LEFT JOIN f ON f.level = b.level AND f.n = b.n""",
}
