"""Metadata, keyword and vector retrieval, and their fusion.

Query sets are small tables joined with everything; the corpus is read once for all queries. Nearest neighbours are found by blocks:
a block of query vectors of bounded size goes to every partition, which keeps its own best k, and only these meet in a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut, prepare_workers, stored, worker

WORD = r"[\p{L}\p{N}]+"
#: Query vectors that go to a partition at once.
QUERY_BLOCK = 4096


def words(text: Column, most: int = 40) -> Column:
    """Lower-case words of letters and digits of at most so many characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), 0), lambda w: F.length(w) <= most)


def metadata_scores(docs: DataFrame, identity: str, fields: dict[str, float], questions: list[str]) -> DataFrame:
    """query_id, identity, score of every row and question with a score above zero; the rows are read once for all questions.

    Per field its weight times the share of the question's words that it has, and its weight again if it holds the whole question.
    """
    known = docs.select(identity, *[F.lower(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    known = known.select("*", *[words(F.col(f), 1 << 20).alias(f"__{f}") for f in fields])
    asked = F.array(*[F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(q.lower()).alias("q"), words(F.lit(q)).alias("w")) for i, q in enumerate(questions)])
    each = known.withColumn("x", F.explode(asked))
    part = [f"{w}D * size(array_intersect(x.w, `__{f}`)) / greatest(size(x.w), 1) + CASE WHEN contains(`{f}`, x.q) THEN {w}D ELSE 0D END" for f, w in fields.items()]
    return each.select("x.query_id", identity, F.expr(f"round({' + '.join(part)}, 6)").alias("score")).where("score > 0")


def bm25(docs: DataFrame, identity: str, text: str, queries: DataFrame, k1: float = 1.2, b: float = 0.75, keep: Column | None = None) -> DataFrame:
    """query_id, identity, score of every document with a word of the query (queries: query_id, query); one row per document.

    Only postings of query words are made, before anything is grouped; counts and lengths are those of the whole corpus, whatever keep, a
    filter, leaves: it changes which documents come out and not their scores.
    """
    return bm25_fields(docs, identity, {text: 1.0}, queries, k1, b, keep, once=True)


def bm25_fields(docs: DataFrame, identity: str, fields: dict[str, float], queries: DataFrame, k1: float = 1.2, b: float = 0.75, keep: Column | None = None, once: bool = False) -> DataFrame:
    """query_id, identity, score: BM25 of every field with its boost, the best field per word of the query, summed over its words.

    Counts and lengths are those of each field over the whole corpus, exact copies of a row once; a word that the query repeats counts as often,
    or once. keep: a filter over docs that changes no score. Each text is read once and moves nowhere: what is shuffled of it is its length and
    those of its words that some query asks for. The words asked for come to the driver; their number is that of the questions' words.
    """
    times = F.max(F.lit(1)) if once else F.count(F.lit(1))
    asked = cut(queries.select("query_id", F.explode(words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(times.alias("times")))
    terms = [r.term for r in asked.select("term").distinct().collect()]
    kept = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(True)
    cut_up = docs.select(identity, kept.alias("__kept"), F.xxhash64(*fields).alias("__text"), *[words(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    narrow = cut(cut_up.select(identity, "__kept", "__text", *[F.struct(F.size(f).alias("length"), F.filter(f, lambda w: w.isin(terms)).alias("w")).alias(f) for f in fields]).distinct())
    stats = narrow.agg(F.count(F.lit(1)).alias("docs"), *[F.avg(F.col(f)["length"]).alias(f) for f in fields]).collect()[0]
    each = narrow.select(identity, "__kept", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("boost"), F.lit(float(stats[f] or 1)).alias("mean"), F.col(f)["length"].alias("length"), F.col(f)["w"].alias("w")) for f, w in fields.items()])).alias("x"))
    p = each.select(identity, "__kept", "x.*").select(identity, "__kept", "field", "boost", "mean", "length", F.explode("w").alias("term"))
    p = p.groupBy("term", "field", identity).agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"), F.max("boost").alias("boost"), F.max("mean").alias("mean"), F.max("__kept").alias("__kept"))
    df = p.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))  # a row per word asked for and field
    idf = F.log(1 + (stats["docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("boost") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    best = p.where("__kept").join(F.broadcast(df), ["term", "field"]).groupBy("term", identity).agg(F.max(weight).alias("weight"))
    return best.join(F.broadcast(asked), "term").groupBy("query_id", identity).agg(F.sum(F.col("weight") * F.col("times")).alias("score"))


def top_k(scored: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows per group by order, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn_batches(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, vector: the k nearest of each query within the partition."""
    best_d = np.full((len(ids), 0), np.inf)
    best_i = np.zeros((len(ids), 0), dtype=np.int64)
    for b in batches:
        for at in range(0, len(b), 2048):
            part = b.iloc[at : at + 2048]
            x = np.vstack(part["vector"].to_numpy()).astype(np.float64)
            norm = np.linalg.norm(x, axis=1)
            ok = norm > 0
            x, own = x[ok] / norm[ok, None], part["id"].to_numpy(dtype=np.int64)[ok]
            d = np.concatenate([best_d, 1 - matrix @ x.T], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    if best_d.shape[1]:
        yield pd.DataFrame({"query_id": np.repeat(ids, best_d.shape[1]), "id": best_i.ravel(), "distance": best_d.ravel()})


def _query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of queries (id, vector) in blocks of at most QUERY_BLOCK, in the order of ids; vectors without a direction are left out."""
    known, after = queries.where(F.col("vector").isNotNull()).select("id", "vector").orderBy("id"), None
    while block := (known if after is None else known.where(F.col("id") > after)).limit(QUERY_BLOCK).collect():
        m = np.array([r.vector for r in block], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)
        ok = norm > 0
        if ok.any():
            yield np.array([r.id for r in block], dtype=np.int64)[ok], m[ok] / norm[ok, None]
        after = block[-1].id
        if len(block) < QUERY_BLOCK:
            return


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance, rank of the k nearest of each query by cosine distance, ties by id (corpus and queries: id, vector).

    Queries are taken in blocks of QUERY_BLOCK; each goes to all partitions of the corpus as one matrix of bounded size, and its result is
    stored before the next one is taken, so plan and driver hold one block at a time.
    """
    prepare_workers(corpus.sparkSession)
    found, rows = None, corpus.select("id", "vector").where(F.col("vector").isNotNull())
    for ids, m in _query_blocks(queries):
        part = top_k(rows.mapInPandas(worker(__name__, "knn_batches", ids, m, k), "query_id long, id long, distance double"), ["query_id"], [F.col("distance"), F.col("id")], k)
        if found is not None or len(ids) >= QUERY_BLOCK:
            part = stored(part)
        found = part if found is None else found.unionByName(part)
    return corpus.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int") if found is None else found


def fuse(signals: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """query_id, id, score, signals: reciprocal-rank fusion of signals (query_id, id, signal, rank)."""
    w = F.coalesce(*[F.when(F.col("signal") == s, F.lit(float(x))) for s, x in (weights or {}).items()], F.lit(1.0))
    return signals.groupBy("query_id", "id").agg(F.sum(w / (k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals"))


def unit(vector: Column) -> Column:
    """The vector over its length, in double; null where it is empty, not finite or zero."""
    x = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.when((F.size(x) > 0) & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.transform(x, lambda v: v / norm))


def dot(a: Column, b: Column) -> Column:
    """The inner product of two double vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def feature_hash(docs: DataFrame, identity: str, text: str, dimensions: int) -> DataFrame:
    """identity, bucket, value: signed counts of words hashed into dimensions buckets, over the vector's length."""
    t = docs.select(identity, F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("w")).withColumn("h", F.sha2("w", 256))
    bucket = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(dimensions))
    sign = F.when(F.conv(F.substring("h", 9, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    v = t.groupBy(identity, bucket.alias("bucket")).agg(F.sum(sign).alias("n")).where("n <> 0")
    norm = v.groupBy(identity).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return v.join(norm, identity).select(identity, "bucket", (F.col("n") / F.col("norm")).alias("value"))


_TOKEN = re.compile(r"\w+")


@lru_cache(maxsize=1 << 17)
def _placed(feature: str) -> tuple[int, float]:
    digest = hashlib.sha256(feature.encode("utf-8", "surrogatepass")).digest()
    return int.from_bytes(digest[:8], "big"), 1.0 if digest[8] & 1 else -1.0


def feature_vector(text: str | None, dimensions: int) -> np.ndarray:
    """The unit vector of the signed counts of tokens, token pairs and a bias; tokens of composed, case-folded text, of any length."""
    tokens = _TOKEN.findall(unicodedata.normalize("NFC", text or "").casefold())
    out = np.zeros(dimensions)
    for feature in ("__bias__", *tokens, *(f"{a}\x1f{b}" for a, b in zip(tokens, tokens[1:]))):
        number, sign = _placed(feature)
        out[number % dimensions] += sign
    norm = np.sqrt((out * out).sum())
    if norm == 0:  # all features cancel
        out[0] = norm = 1.0
    return out / norm


def feature_vector_batches(batches: Iterator[pd.DataFrame], dimensions: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, text."""
    for b in batches:
        yield pd.DataFrame({"id": b["id"], "vector": [feature_vector(t, dimensions) for t in b["text"]]})


def feature_vectors(docs: DataFrame, dimensions: int) -> DataFrame:
    """id, vector of every row of docs (id string, text); no text is as an empty one."""
    prepare_workers(docs.sparkSession)
    return docs.select("id", "text").mapInPandas(worker(__name__, "feature_vector_batches", dimensions), "id string, vector array<double>")


def feature_similarity_batches(batches: Iterator[pd.DataFrame], questions: list[str], dimensions: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, text: the similarity of every text to every question."""
    q = np.array([feature_vector(t, dimensions) for t in questions])
    for b in batches:
        x = np.array([feature_vector(t, dimensions) for t in b["text"]]).reshape(-1, dimensions)
        yield pd.DataFrame({"query_id": np.tile(np.arange(len(q)), len(b)), "id": np.repeat(b["id"].to_numpy(), len(q)), "score": (x @ q.T).round(9).ravel()})


def feature_similarity(docs: DataFrame, questions: list[str], dimensions: int) -> DataFrame:
    """query_id, id, score of every row of docs (id string, text) and question by the feature vectors' cosine."""
    prepare_workers(docs.sparkSession)
    return docs.select("id", "text").mapInPandas(worker(__name__, "feature_similarity_batches", questions, dimensions), "query_id long, id string, score double")


def nearest_centre_batches(batches: Iterator[pd.DataFrame], centres: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, vector: the nearest centres of each vector as cell, and the unit vector with them."""
    for b in batches:
        x = np.vstack(b["vector"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, centres.shape[1]))
        norm = np.linalg.norm(x, axis=1)
        x, own = x[norm > 0] / norm[norm > 0, None], b["id"].to_numpy()[norm > 0]
        cells = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
        yield pd.DataFrame({"id": np.repeat(own, cells.shape[1]), "cell": cells.ravel(), "u": list(np.repeat(x, cells.shape[1], axis=0))})


def fit_cells(corpus: DataFrame, cells: int, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Centres of an inverted-file index, by spherical k-means over a sample of at most sample vectors (those of least hash)."""
    rows = corpus.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()
    x = np.array([r.vector for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    c = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        for k in range(len(c)):
            if (near == k).any():
                m = x[near == k].sum(axis=0)
                c[k] = m / max(np.linalg.norm(m), 1e-30)
    return c


def cell_knn(corpus: DataFrame, queries: DataFrame, k: int, centres: np.ndarray, probes: int, part_rows: int = 50_000) -> DataFrame:
    """Approximate neighbours: every vector lies in the cell of its nearest centre; a query looks into its nearest probes cells.

    A cell with many vectors is spread over parts of about part_rows; its queries, the fewer, are repeated for each.
    """
    prepare_workers(corpus.sparkSession)

    def placed(df: DataFrame, n: int) -> DataFrame:
        return df.where(F.col("vector").isNotNull()).select("id", "vector").mapInPandas(worker(__name__, "nearest_centre_batches", centres, n), "id long, cell long, u array<double>")

    c = stored(placed(corpus, 1).select("cell", "id", F.col("u").alias("cu")))
    parts = F.broadcast(c.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_rows)).alias("parts")))  # a row per centre
    q = placed(queries, probes).join(parts, "cell").select("cell", F.col("id").alias("query_id"), F.col("u").alias("qu"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    near = c.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).join(q, ["cell", "part"]).select("query_id", "id", (1 - dot(F.col("cu"), F.col("qu"))).alias("distance"))
    return top_k(near, ["query_id"], [F.col("distance"), F.col("id")], k)


def sketches(vectors: np.ndarray, bits: int) -> np.ndarray:
    """The signs of vectors on so many random directions, the same in every run, packed into 64-bit numbers."""
    directions = np.random.default_rng(bits).normal(size=(vectors.shape[1], bits))
    return np.packbits(vectors @ directions > 0, axis=1).view(np.int64)


def sketch_batches(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, vector: the sketch of each vector that has a direction."""
    for b in batches:
        x = np.vstack(b["vector"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, 1))
        ok = np.linalg.norm(x, axis=1) > 0
        yield pd.DataFrame({"id": b["id"].to_numpy()[ok], "sketch": list(sketches(x[ok], bits))})


def sketch_index(corpus: DataFrame, bits: int = 512) -> DataFrame:
    """id, sketch of every vector of corpus (id, vector): an index that is fitted on nothing and is an eighth of the vectors' size or less."""
    prepare_workers(corpus.sparkSession)
    return stored(corpus.where(F.col("vector").isNotNull()).select("id", "vector").mapInPandas(worker(__name__, "sketch_batches", bits), "id long, sketch array<long>"))


def near_sketch_batches(batches: Iterator[pd.DataFrame], ids: np.ndarray, wanted: np.ndarray, candidates: int) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, sketch: within the partition the candidates of each query with the fewest different signs, ties by id."""
    best_d, best_i = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0), dtype=np.int64)
    for b in batches:
        for at in range(0, len(b), 1024):
            part = b.iloc[at : at + 1024]
            x, own = np.vstack(part["sketch"].to_numpy()), part["id"].to_numpy(dtype=np.int64)
            d = np.concatenate([best_d, np.bitwise_count((wanted[:, None, :] ^ x[None, :, :]).view(np.uint64)).sum(axis=2, dtype=np.int64)], axis=1)
            i = np.concatenate([best_i, np.broadcast_to(own, (len(ids), len(own)))], axis=1)
            order = np.lexsort((i, d), axis=1)[:, :candidates]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
    if best_d.shape[1]:
        yield pd.DataFrame({"query_id": np.repeat(ids, best_d.shape[1]), "id": best_i.ravel(), "signs": best_d.ravel()})


def sketch_knn(corpus: DataFrame, queries: DataFrame, k: int, index: DataFrame | None = None, bits: int = 512, candidates: int = 200) -> DataFrame:
    """query_id, id, distance, rank: approximate neighbours. The candidates with the fewest different signs are found over the index of all
    rows, and their vectors, joined by id, are compared exactly. Queries go to the partitions in blocks of QUERY_BLOCK."""
    index = sketch_index(corpus, bits) if index is None else index
    found = None
    for ids, m in _query_blocks(queries):
        part = index.mapInPandas(worker(__name__, "near_sketch_batches", ids, sketches(m, bits), candidates), "query_id long, id long, signs long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return corpus.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
    few = top_k(found, ["query_id"], [F.col("signs"), F.col("id")], candidates, "place").select("query_id", "id")
    near = few.join(corpus.select("id", unit(F.col("vector")).alias("cu")), "id").join(queries.select(F.col("id").alias("query_id"), unit(F.col("vector")).alias("qu")), "query_id")
    return top_k(near.select("query_id", "id", (1 - dot(F.col("cu"), F.col("qu"))).alias("distance")), ["query_id"], [F.col("distance"), F.col("id")], k)


def best_per_group_batches(batches: Iterator[pd.DataFrame], ids: np.ndarray, matrix: np.ndarray) -> Iterator[pd.DataFrame]:
    """For mapInPandas over id, group, vector: the best similarity of each query in each group within the partition."""
    best: dict[int, np.ndarray] = {}
    for b in batches:
        for g, part in b.groupby("group"):
            x = np.vstack(part["vector"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
            top = (matrix @ x.T).max(axis=1)
            best[g] = np.maximum(best[g], top) if g in best else top
    for g, top in best.items():
        yield pd.DataFrame({"query_id": ids, "group": g, "similarity": top})


def best_per_group(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, group, similarity: the best cosine similarity per group of corpus (id, group, vector), queries in bounded blocks."""
    prepare_workers(corpus.sparkSession)
    rows, found = corpus.select("id", "group", "vector").where(F.col("vector").isNotNull() & F.col("group").isNotNull()), None
    for ids, m in _query_blocks(queries):
        part = rows.mapInPandas(worker(__name__, "best_per_group_batches", ids, m), "query_id long, group int, similarity double").groupBy("query_id", "group").agg(F.max("similarity").alias("similarity"))
        if found is not None or len(ids) >= QUERY_BLOCK:
            part = stored(part)
        found = part if found is None else found.unionByName(part)
    return corpus.sparkSession.createDataFrame([], "query_id long, group int, similarity double") if found is None else found


def extractive_answer(ranked: DataFrame, text: str, passages: int = 2, most: int = 4000) -> DataFrame:
    """query_id, answer, cited of ranked (query_id, id, rank, text): the first distinct passages that fit, joined in order of rank."""
    first = ranked.where(F.col(text).isNotNull()).groupBy("query_id", text).agg(F.min(F.struct("rank", "id")).alias("x")).select("query_id", F.col("x.rank").alias("rank"), F.col("x.id").alias("id"), F.col(text).alias("text"))
    w = Window.partitionBy("query_id").orderBy("rank")  # ranked has the top k of each query
    kept = first.withColumn("place", F.row_number().over(w)).withColumn("length", F.sum(F.length("text")).over(w)).where((F.col("place") <= passages) & (F.col("length") <= most))
    a = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("a"))
    return a.select("query_id", F.array_join(F.transform("a", lambda x: x["text"]), "\n\n").alias("answer"), F.array_join(F.transform("a", lambda x: x["id"]), ",").alias("cited"))
