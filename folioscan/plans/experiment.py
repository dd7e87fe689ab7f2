"""How answers suffer from noise: documents with pages of others among their own, at several levels and repetitions, in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import text as X
from folioscan.operators import chunking as C
from folioscan.operators import models as M
from folioscan.operators import sampling as S
from folioscan.plans.answering import answer_questions

#: Questions of a document that a task holds together, about; similarities, and pairs to be answered, that it holds at a time.
ASKED, CELLS, PAIRS = 512, 1_000_000, 2_000
#: No page has this number.
NONE = -(1 << 62)


def _documents(pages: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, n_pages, at (numbered from 0) of the documents, and how many they are."""
    sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages")).withColumn("all", F.lit(0))
    docs = S.group_rank(sizes, ["all"], F.floor(F.col("doc_id") / 4096), ["doc_id"]).select("doc_id", "n_pages", (F.col("rank") - 1).alias("at"))
    return docs, sizes.count()


def _drawn(docs: DataFrame, n_docs: int, level: int, seed: int) -> DataFrame:
    """doc_id, place, k, other, nth: `level` pages of others for each document, and before which page they come. The draws of a
    lower level are the first of a higher one's; nth is a page's number among its document's pages, from 0."""
    drawn = S.noise_draws(docs, n_docs, level, seed).join(docs.select("doc_id", "at", "n_pages"), "doc_id")
    place = F.pmod(F.col("at") * 3 + F.col("k") * 5 + seed, F.col("n_pages") + 1)
    return drawn.select("doc_id", place.alias("place"), "k", "other", F.col("page_idx").alias("nth"))


def _numbered(pages: DataFrame) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_idx")) - 1
    return pages.select("doc_id", "page_idx", "words").withColumn("nth", nth.cast("long"))


def noisy_pages(pages: DataFrame, levels: tuple[int, ...], repetitions: int, seed: int = 42) -> DataFrame:
    """level, rep, doc_id, page_idx, words, old_page: every document once for each level and repetition, with `level` pages of
    other documents at places of their own among its pages; old_page is null for these.

    pages: doc_id (a whole number), page_idx, words.
    """
    runs = [(level, rep) for level in levels for rep in range(repetitions)]
    docs, n_docs = _documents(pages)
    told = lambda level, rep: F.struct(F.lit(level).cast("int").alias("level"), F.lit(rep).cast("int").alias("rep"))
    own = pages.select(F.explode(F.array(*(told(*r) for r in runs))).alias("run"), "doc_id", F.col("page_idx").alias("place"), F.lit(1).alias("own"), F.lit(0).cast("long").alias("k"), "words", F.col("page_idx").alias("old_page"))
    noise = [_drawn(docs, n_docs, level, seed + rep).select(told(level, rep).alias("run"), "*") for level, rep in runs if level]
    if noise:
        numbered = _numbered(pages).select(F.col("doc_id").alias("other"), "nth", "words")
        drawn = reduce(DataFrame.unionByName, noise).join(numbered, ["other", "nth"])
        own = own.unionByName(drawn.select("run", "doc_id", "place", F.lit(0).alias("own"), "k", "words"), allowMissingColumns=True)
    order = Window.partitionBy("run", "doc_id").orderBy("place", "own", "k")
    return own.select("run.level", "run.rep", "doc_id", (F.row_number().over(order) - 1).cast("long").alias("page_idx"), "words", "old_page")


class _Held:
    """Some questions of a document, and the best chunks of each so far in every run, while the document's pages pass by in order."""

    def __init__(self, runs: list[tuple[int, int]], k: int):
        self.runs, self.k, self.n_pages, self.asked, self.vectors, self.gold = runs, k, 0, [], [], None
        self.sims = self.refs = None
        self.texts, self.places = [], np.zeros(0, np.int64)  # of the chunks that refs tell

    def ask(self, rows: pa.Table, vectors: np.ndarray) -> None:
        self.asked.append(rows)
        self.vectors.append(vectors)

    def close(self) -> None:
        """All questions are here."""
        if self.gold is not None:
            return
        self.asked, self.vectors = pa.concat_tables(self.asked), np.concatenate(self.vectors)
        self.norms, self.gold = np.sqrt((self.vectors**2).sum(1))[:, None], _numbers(self.asked["page_idx"], NONE)
        self.known = np.zeros(len(self.gold), bool)
        self.sims = [np.zeros((len(self.gold), 0)) for _ in self.runs]
        self.refs = [np.zeros((len(self.gold), 0), np.int64) for _ in self.runs]

    def meet(self, rows: pa.Table, vectors: np.ndarray, texts: list[str]) -> None:
        """Pages of the document and of others pass by, in the order that they have in every run, so of equal chunks earlier ones stay."""
        self.close()
        own, rep, drawn, chunk = (_numbers(rows[c], -1) for c in ("own", "rep", "k", "chunk_id"))
        page = np.where(own == 1, _numbers(rows["page_idx"], NONE), NONE)
        begins = (own == 1) & (chunk < 1)  # pages without words are pages, too
        self.n_pages += int(begins.sum())
        self.known |= np.isin(self.gold, page[page != NONE])
        held = np.flatnonzero(chunk >= 0)
        step = max(1, CELLS // len(self.gold))
        for at in range(0, len(held), step):
            part = held[at : at + step]
            v, base = vectors[part], len(self.texts)
            self.texts += [texts[i] for i in part]
            self.places = np.append(self.places, page[part])
            near = self.vectors @ v.T / (self.norms * np.sqrt((v**2).sum(1)) + 1e-8)
            for r, (level, n) in enumerate(self.runs):
                mine = np.flatnonzero((own[part] == 1) | ((rep[part] == n) & (drawn[part] < level)))
                sims = np.concatenate([self.sims[r], near[:, mine]], 1)
                refs = np.concatenate([self.refs[r], np.broadcast_to(mine + base, (len(near), len(mine)))], 1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, : self.k]
                self.sims[r], self.refs[r] = np.take_along_axis(sims, best, 1), np.take_along_axis(refs, best, 1)
            used = np.unique(np.concatenate([x.ravel() for x in self.refs]))
            self.texts, self.places = [self.texts[i] for i in used], self.places[used]
            self.refs = [np.searchsorted(used, x) for x in self.refs]

    def pairs(self) -> tuple[list[int], list[int]]:
        """Question and chunk of each pair that is among the best in any run."""
        every = np.concatenate(self.refs, 1)
        every = np.unique(np.arange(len(every))[:, None] * max(1, len(self.texts)) + every) if every.size else np.zeros(0, np.int64)
        q, c = np.divmod(every, max(1, len(self.texts)))
        return q[self.known[q]].tolist(), c[self.known[q]].tolist()


def _numbers(column: pa.ChunkedArray, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy()


def _answered(runs: list[tuple[int, int]], k: int, surest: bool, embedder: Callable[[], M.Embedder], answerer: Callable[[], M.Answerer]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each question and run, with the answer of the best chunk, or of the surest of the k best; a question's document
    comes after its questions. A chunk that several runs have in common is answered from once."""

    def told(groups: list[_Held], answers: M.Answerer) -> pa.RecordBatch:
        pairs = [g.pairs() for g in groups]
        asked = [text or "" for g, (q, _) in zip(groups, pairs, strict=True) for text in g.asked["text"].take(pa.array(q, pa.int64())).to_pylist()]
        given = iter(answers.answer(asked, [g.texts[c] for g, (_, cs) in zip(groups, pairs, strict=True) for c in cs]) if asked else [])
        out = []
        for g, (qs, cs) in zip(groups, pairs, strict=True):
            found = {(q, c): next(given) for q, c in zip(qs, cs, strict=True)}
            which, preds, sizes = np.flatnonzero(g.known), [], []
            for i, (level, rep) in enumerate(runs):
                for q, refs in zip(which.tolist(), g.refs[i][which].tolist(), strict=True):
                    best = max((found[q, c] for c in refs), key=lambda a: a[1], default=("", 0.0)) if surest else found[q, refs[0]] if refs else ("", 0.0)
                    preds.append(best[0])
                sizes += [(level, rep)] * len(which)
            hits = np.concatenate([(g.places[x[which]] == g.gold[which, None]).any(1) for x in g.refs])
            rows = g.asked.select(["question_id", "golds"]).take(pa.array(np.tile(which, len(runs))))
            more = {"level": pa.array([x[0] for x in sizes], pa.int32()), "rep": pa.array([x[1] for x in sizes], pa.int32()), "n_pages": pa.array(np.full(len(preds), g.n_pages)), "pred": pa.array(preds, pa.string()), "hit": pa.array(hits)}
            out.append(pa.table({"question_id": rows["question_id"], "golds": rows["golds"], **more}))
        return pa.concat_tables(out).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embeds, answers, group, held, done, n = embedder(), answerer(), None, None, [], 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = np.stack([_numbers(rows[c], NONE) for c in ("doc_id", "part", "kind")])
            texts = batch.column("text").fill_null("").to_pylist()
            vectors = np.asarray(embeds.embed(texts), float)
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(0)) + 1).tolist(), len(texts)]
            for s, e in pairwise(cuts):
                if e > s and (of := tuple(keys[:2, s])) != group:
                    if held and len(held.asked):
                        held.close()
                        done, n = [*done, held], n + len(runs) * k * len(held.gold)
                    if n >= PAIRS:
                        yield from told(done, answers).to_batches()
                        done, n = [], 0
                    group, held = of, _Held(runs, k)
                if e > s and keys[2, s] == 0:
                    held.ask(rows.slice(s, e - s), vectors[s:e])
                elif e > s and len(held.asked):
                    held.meet(rows.slice(s, e - s), vectors[s:e], texts[s:e])
        if held and len(held.asked):
            held.close()
            done.append(held)
        if done:
            yield from told(done, answers).to_batches()

    return run


def _in_runs(questions: DataFrame, pages: DataFrame, levels: tuple[int, ...], repetitions: int, seed: int, surest: bool, k: int, rule: C.ChunkRule, embedder: Callable[[], M.Embedder], answerer: Callable[[], M.Answerer]) -> DataFrame:
    """level, rep, question_id, golds, n_pages, pred, hit (whether the gold page is among the evidence) by retrieved chunks.

    What a document's runs have in common is read, sent and answered from once: its own pages, and the noise pages of a lower level,
    which are the first of a higher one's. A task holds some questions of a document, and the pages pass by as texts of chunks.
    """
    runs = [(level, rep) for level in levels for rep in range(repetitions)]
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    asking = questions.groupBy("doc_id").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    cut = _numbered(pages).select("doc_id", "page_idx", "nth", "words", F.posexplode_outer(C.chunk_ranges(F.size("words"), rule)).alias("chunk_id", "r"))
    text = F.array_join(F.slice("words", F.col("r.start") + 1, F.col("r.end") - F.col("r.start")), " ")
    cut = cut.select("doc_id", "page_idx", "nth", F.col("chunk_id").cast("long").alias("chunk_id"), text.alias("text"))
    at = ["place", "own", "k", "rep", "nth", "chunk_id"]
    asked = questions.join(asking, "doc_id").select("doc_id", F.pmod(F.xxhash64("question_id"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "question_id", "golds", F.col("gold_page").alias("page_idx"), F.col("question").alias("text"), *(none(c, "long") for c in at))
    page = lambda rows, own: rows.join(asking, "doc_id").select("doc_id", parts, F.lit(1).alias("kind"), none("question_id", questions.schema["question_id"].dataType), none("golds", questions.schema["golds"].dataType), "page_idx", "text", F.col("place").cast("long").alias("place"), F.lit(own).cast("long").alias("own"), F.col("k").cast("long").alias("k"), F.col("rep").cast("long").alias("rep"), "nth", "chunk_id")
    rows = asked.unionByName(page(cut.select("*", F.col("page_idx").alias("place"), F.lit(0).alias("k"), F.lit(-1).alias("rep")), 1))
    if (most := max(levels, default=0)) > 0 and repetitions:
        docs, n_docs = _documents(pages)
        drawn = reduce(DataFrame.unionByName, (_drawn(docs, n_docs, most, seed + rep).withColumn("rep", F.lit(rep)) for rep in range(repetitions)))
        drawn = drawn.join(asking.select("doc_id"), "doc_id", "left_semi").join(cut.withColumnRenamed("doc_id", "other"), ["other", "nth"])
        rows = rows.unionByName(page(drawn, 0))
    tasks = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * pages.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, "doc_id", "part").sortWithinPartitions("doc_id", "part", "kind", *at)
    kinds = {f.name: f.dataType for f in questions.schema}
    out = T.StructType([T.StructField("question_id", kinds["question_id"]), T.StructField("golds", kinds["golds"]), T.StructField("level", T.IntegerType()), T.StructField("rep", T.IntegerType()), T.StructField("n_pages", T.LongType()), T.StructField("pred", T.StringType()), T.StructField("hit", T.BooleanType())])
    return rows.mapInArrow(_answered(runs, k, surest, embedder, answerer), out)


def noise_experiment(questions: DataFrame, pages: DataFrame, levels: tuple[int, ...] = (0, 3, 20, 100), repetitions: int = 3, seed: int = 42, **answering) -> DataFrame:
    """level, rep, question_id, n_pages (the document's own), anls, accuracy, precision of every question in every run.

    questions: question_id, doc_id, question, gold_page, golds (an array of right answers); pages: doc_id, page_idx, words.
    All runs are one job, and `answering` goes to answer_questions. In the modes maxconf and anyconf, unless chunks are reranked or
    grown, the runs share their work; in the others a run's documents and questions have the run in their keys.
    The score is that of the best gold, without regard to letter case; precision is whether the gold page is among the evidence.
    """
    mode, how = answering.get("mode", "concat"), {"k": 10, "rule": C.ChunkRule(), "embedder": M.HashedTerms, "answerer": M.BestSentence} | answering
    golds = F.transform("golds", F.lower)
    anls = F.coalesce(F.array_max(F.transform(golds, lambda g: X.anls_strict(g, F.col("pred")))), F.lit(0.0))
    if mode in ("maxconf", "anyconf") and not answering.get("rerank") and not answering.get("around"):
        found = _in_runs(questions, pages, levels, repetitions, seed, mode == "maxconf", how["k"], how["rule"], how["embedder"], how["answerer"])
        rows = found.withColumns({"pred": F.lower("pred"), "precision": F.col("hit").cast("double")})
    else:
        mixed = noisy_pages(pages, levels, repetitions, seed)
        key = lambda c: F.struct("level", "rep", F.col(c).alias("id")).alias(c)
        moved = mixed.filter("old_page IS NOT NULL").select("level", "rep", "doc_id", F.col("old_page").alias("gold_page"), F.col("page_idx").alias("new_page"))
        asked = questions.join(moved, ["doc_id", "gold_page"])
        sizes = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
        given = answer_questions(asked.select(key("question_id"), key("doc_id"), "question", F.col("new_page").alias("gold_page")), mixed.select(key("doc_id"), "page_idx", "words"), **answering)
        rows = given.select("question_id.level", "question_id.rep", F.col("question_id.id").alias("question_id"), F.lower(F.coalesce(F.try_element_at("answers", F.lit(1))["answer"], F.lit(""))).alias("pred"), "pages")
        rows = rows.join(asked.select("level", "rep", "question_id", "doc_id", "new_page", "golds"), ["level", "rep", "question_id"]).join(sizes, "doc_id")
        rows = rows.withColumn("precision", F.array_contains("pages", F.col("new_page")).cast("double"))
    return rows.select("level", "rep", "question_id", "n_pages", anls.alias("anls"), F.array_contains(golds, F.col("pred")).cast("double").alias("accuracy"), "precision")


def by_pages(scores: DataFrame) -> DataFrame:
    """level, n_pages, samples, and for each measure the mean over samples of their means and deviations over repetitions."""
    names = ("anls", "accuracy", "precision")
    each = scores.groupBy("level", "question_id", "n_pages").agg(*(f(n).alias(f"{n}{end}") for n in names for f, end in ((F.avg, ""), (F.stddev_pop, "_std"))))
    return each.groupBy("level", "n_pages").agg(F.count("*").alias("samples"), *(F.avg(f"{n}{end}").alias(f"{n}{end}") for n in names for end in ("", "_std")))
