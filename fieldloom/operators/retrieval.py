"""Retrieval: token-overlap and vector top-k, hashed embeddings, form identification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .work import computed

TOP = 5
#: Rows of a block of queries and of a block of vectors, as they meet in one task.
QUERY_BLOCK = 1024
#: Queries of a block whose distances stand in a task at once.
QUERY_SLICE = 64
VECTOR_BLOCK = 16384
#: Tokens of all queries that may be sent to the tasks, about 100 MB there.
SENT_TOKENS = 2_000_000
#: Postings, and pairs of documents and queries, that a task holds at once.
CELLS = 1_000_000
#: Share of a query's tokens, the rarest, by which joins begin.
RARE = 0.3
#: Forms of a block: one block is sent to the tasks, of more each document meets every one.
FORMS_BLOCK = 2_000


class _Kept:
    """The k best documents of each query among those a task has met; ties by smaller id."""

    def __init__(self, k: int, most: int):
        self.k, self.most, self.held, self.rows = k, most, [], 0

    def add(self, doc: pa.Array, query: np.ndarray, n: np.ndarray, n_doc: np.ndarray, score: np.ndarray) -> None:
        self.held.append((doc, query, n, n_doc, score))
        self.rows += len(query)
        if self.rows > self.most:
            self.reduce()

    def reduce(self) -> None:
        if len(self.held) == 0:
            return
        doc = pa.concat_arrays([x[0] for x in self.held])
        query, n, n_doc, score = (np.concatenate([x[i] for x in self.held]) for i in range(1, 5))
        place = np.empty(len(doc), np.int64)
        place[pc.sort_indices(doc).to_numpy()] = np.arange(len(doc))
        order = np.lexsort((place, -score, query))
        q = query[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        keep = order[(np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))) < self.k]
        self.held = [(doc.take(pa.array(keep)), query[keep], n[keep], n_doc[keep], score[keep])]
        self.rows = len(keep)


def _slices(postings: np.ndarray, n_queries: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about ``CELLS`` postings and pairs with queries; a document of more is a range of its own."""
    through = np.concatenate([[0], np.cumsum(postings)])
    at = 0
    while at < len(postings):
        to = max(at + 1, min(int(np.searchsorted(through, through[at] + CELLS, "right")) - 1, at + CELLS // max(n_queries, 1)))
        yield at, to
        at = to


def _overlaps(sent, k: int, names: list[str]):
    """For rows (doc, tokens): each query's k best documents of those a task reads, by one pass over the postings of the documents' tokens."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, first, posts, sizes = sent.value
        tokens = pa.array(tokens, pa.string())
        kept = _Kept(k, max(4 * k * len(sizes), CELLS))
        for batch in batches:
            lists = batch.column(1)
            at = pc.index_in(lists.flatten(), value_set=tokens)
            held = at.is_valid().to_numpy(zero_copy_only=False)
            token = at.fill_null(0).to_numpy()[held]
            n_doc = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), n_doc)[held]
            count = (first[1:] - first[:-1])[token]
            bound = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            through = np.concatenate([[0], np.cumsum(count)])
            for a, b in _slices(np.diff(through[bound]), len(sizes)):
                i, j = bound[a], bound[b]
                own, n_own = token[i:j], count[i:j]
                query = posts[np.repeat(first[own] - (through[i:j] - through[i]), n_own) + np.arange(int(n_own.sum()))]
                shared = np.bincount(np.repeat(owner[i:j] - a, n_own) * len(sizes) + query, minlength=1)
                pairs = np.flatnonzero(shared)
                row, query, n = pairs // len(sizes) + a, pairs % len(sizes), shared[pairs]
                kept.add(batch.column(0).take(pa.array(row)), query, n, n_doc[row].astype(np.int64), np.floor(n / (sizes[query] + n_doc[row] - n) * 1e6 + 0.5))
        kept.reduce()
        for doc, query, n, n_doc, _ in kept.held:
            yield pa.RecordBatch.from_arrays([doc, pa.array(query), pa.array(n), pa.array(n_doc)], names=names)

    return overlaps


def rare_first(sets: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``sets`` (keys, tokens) with its tokens in order of how many sets of ``other`` (keys, tokens) hold them, the rarest first; ties by the token."""
    often = other.select(*keys, F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("often"))
    names = [c for c in sets.columns if c != "tokens"]
    numbered = sets.withColumn("_set", F.monotonically_increasing_id())
    each = numbered.select("_set", *keys, F.explode("tokens").alias("token")).join(often, [*keys, "token"], "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))), lambda x: x["token"])
    return numbered.select("_set", *names).join(each.groupBy("_set").agg(ordered.alias("tokens")), "_set").drop("_set")


def _pairs(left: DataFrame, right: DataFrame, keys: list[str], take: Column) -> DataFrame:
    """Pairs (query, doc, n, nq, nd) of sets that share one of the ``take`` first tokens of the query's; n is the whole overlap. ``right``: doc, tokens, with keys."""
    asked = left.withColumn("nq", F.size("tokens")).select(*keys, "query", "nq", F.explode(F.slice("tokens", F.lit(1), take)).alias("token"))
    posts = right.select(*keys, "doc", F.explode("tokens").alias("token"))
    met = asked.join(posts, [*keys, "token"]).select("query", "doc", "nq").distinct()
    whole = met.join(right.select("doc", F.col("tokens").alias("_u")), "doc").join(left.select("query", F.col("tokens").alias("_t")), "query")
    return whole.select("query", "doc", "nq", F.size("_u").alias("nd"), F.size(F.array_intersect("_t", "_u")).alias("n"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    scored = pairs.select("query", "doc", F.round(F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)


def _joined_topk(q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """The top k by joins: first on each query's rarest tokens; then, for queries to which that can't be all, on as many as their k-th score asks for.

    A document without any of a query's p first tokens overlaps it in nq - p at most, so its score is (nq - p) / nq at most: once that is less than
    the k-th score found, no document is missing. Tokens that most documents hold are last, and few queries get to them.
    """
    left = computed(rare_first(q.where(F.size("tokens") > 0), d, []))
    first = F.greatest(F.lit(1), F.ceil(F.size("tokens") * RARE)).cast("int")
    found = computed(_best(_pairs(left, d, [], first), k))
    last = left.join(found.groupBy("query").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least")), "query", "left")
    need = F.least(F.floor(F.size("tokens") * (1 - F.coalesce("least", F.lit(0.0)) + 2e-6)) + 1, F.size("tokens")).cast("int")
    rest = computed(last.withColumn("need", need).where(F.col("need") > first))
    again = _best(_pairs(rest, d, [], F.col("need")), k)
    return found.join(rest.select("query"), "query", "left_anti").unionByName(again)


def lexical_topk(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text: str = "text", k: int = TOP, most_tokens: int = SENT_TOKENS) -> DataFrame:
    """query, doc, score, rank: the k documents with the greatest Jaccard similarity of token sets, ties by smaller id. Ids are taken to be unique.

    Queries with up to ``most_tokens`` tokens together are sent to the tasks, which keep their k best before anything moves; beyond that, documents
    meet queries by joins on their rare tokens.
    """
    q = queries.select(F.col(query_id).alias("query"), F.array_distinct(tokens(F.col(text))).alias("tokens"))
    d = docs.select(F.col(doc_id).alias("doc"), F.array_distinct(tokens(F.col(text))).alias("tokens"))
    if _n_tokens(q) > most_tokens:
        return _joined_topk(q, d.where(F.size("tokens") > 0), k)
    return _best(_sent_pairs(q, d, k), k)


def _n_tokens(q: DataFrame) -> int:
    return q.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]


def _sent_pairs(q: DataFrame, d: DataFrame, k: int) -> DataFrame:
    """Pairs (the columns of ``q`` but its tokens, doc, n, nq, nd) with each query's k best documents of each task, by queries (tokens) sent to the tasks that read documents (doc, tokens)."""
    rows = q.where(F.size("tokens") > 0).toArrow()
    lists = rows.column("tokens").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    words = pc.dictionary_encode(lists.values)
    order = np.argsort(words.indices.to_numpy(), kind="stable")
    first = np.searchsorted(words.indices.to_numpy()[order], np.arange(len(words.dictionary) + 1))
    posts = np.repeat(np.arange(len(sizes)), sizes)[order]
    sent = d.sparkSession.sparkContext.broadcast((words.dictionary.to_pylist(), first, posts, sizes))
    names = d.sparkSession.createDataFrame(rows.drop_columns("tokens").append_column("number", pa.array(np.arange(len(sizes)))).append_column("nq", pa.array(sizes.astype(np.int64))))
    found = d.mapInArrow(_overlaps(sent, k, ["doc", "number", "n", "nd"]), f"doc {d.schema['doc'].dataType.simpleString()}, number long, n long, nd long")
    return found.join(F.broadcast(names), "number").drop("number")


def _sent_retrieved(q: DataFrame, c: DataFrame, floor: Column, k: int) -> DataFrame:
    """:func:`retrieved` by one pass over the chunks. Tokens bear their language, or language and form: each query asks for both, a chunk answers to both."""
    bear = lambda *of: F.transform("tokens", lambda t: F.concat(*of, t))
    both = lambda form: F.array(F.struct(F.lit(False).alias("own"), bear(F.lit("l"), "language", F.lit("\0")).alias("tokens")), F.struct(F.lit(True).alias("own"), bear(F.lit("f"), "language", F.lit("\0"), form, F.lit("\0")).alias("tokens")))
    asked = q.select("query", "form", F.explode(both(F.col("form"))).alias("x")).select("query", "form", "x.own", "x.tokens").where("tokens[0] IS NOT NULL")
    said = c.select("doc", F.explode(both(F.col("form_id"))).alias("x")).select("doc", F.when(F.get("x.tokens", F.lit(0)).isNotNull(), F.col("x.tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"))
    scored = _sent_pairs(asked, said, k).withColumn("score", F.round(F.col("n") / (F.col("nq") + F.col("nd") - F.col("n")), 6))
    ranked = computed(scored.withColumn("rank", F.row_number().over(Window.partitionBy("query", "own").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k))
    # a form has a hit if any of its chunks shares a token with the query
    hit = ranked.where("own").select("query").distinct()
    found = ranked.where("own").unionByName(ranked.where("NOT own").join(hit, "query", "left_anti"))
    return found.where(F.col("score") >= floor).select("query", F.col("doc").alias("chunk"), "score", "rank", (F.col("form").isNotNull() & ~F.col("own")).alias("widened"))


def retrieved(queries: DataFrame, chunks: DataFrame, least: float = 0.35, least_unknown: float = 0.62, k: int = TOP, most_tokens: int = SENT_TOKENS) -> DataFrame:
    """query, chunk, score, rank, widened: the k best chunks of the query's language and form; a form without any hit is asked again in its language alone (widened).

    ``queries``: query, text, language, form_id (null: unknown form). ``chunks``: chunk, text, language, form_id. Only scores of ``least``, for unknown
    forms ``least_unknown``, count. Sets of n tokens whose similarity is s share one of the n - s n + 1 rarest of either, so
    queries meet chunks on language and those tokens alone; whether a form has any hit is asked of its tokens, once each. Ids are taken to be unique.
    Queries with up to ``most_tokens`` tokens together are sent to the tasks instead, where chunks are read once.
    """
    floor = F.when(F.col("form").isNull(), float(max(least, least_unknown))).otherwise(float(least))
    q = queries.select("query", "language", F.col("form_id").alias("form"), F.array_distinct(tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
    c = chunks.select(F.col("chunk").alias("doc"), "language", "form_id", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    if 2 * _n_tokens(q) <= most_tokens:
        return _sent_retrieved(q, c, floor, k)
    c = computed(c.where(F.size("tokens") > 0))
    spoken = c.select("language", F.col("form_id").alias("form"), F.explode("tokens").alias("token")).distinct()
    hit = q.where("form IS NOT NULL").select("query", "language", "form", F.explode("tokens").alias("token")).join(spoken, ["language", "form", "token"], "left_semi").select("query").distinct()
    ranked = rare_first(q, c, ["language"]).join(hit.withColumn("hit", F.lit(True)), "query", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rare = lambda s: (F.size("tokens") - F.ceil(F.size("tokens") * (s - 1e-6)) + 1).cast("int")
    left = ranked.withColumn("floor", floor)
    prefix = rare_first(c, c, ["language"])
    asked = left.select("language", "query", F.explode(F.slice("tokens", F.lit(1), rare(F.col("floor")))).alias("token"))
    # chunks take the prefix of the lower floor
    posts = prefix.select("language", "doc", F.explode(F.slice("tokens", F.lit(1), rare(F.lit(float(min(least, least_unknown)))))).alias("token"))
    met = asked.join(posts, ["language", "token"]).select("query", "doc").distinct()
    whole = met.join(left.select("query", "form", "hit", "floor", F.col("tokens").alias("t")), "query").join(c.select("doc", "form_id", F.col("tokens").alias("u")), "doc")
    scored = whole.withColumn("n", F.size(F.array_intersect("t", "u"))).withColumn("score", F.round(F.col("n") / (F.size("t") + F.size("u") - F.col("n")), 6))
    own = F.coalesce(F.col("form") == F.col("form_id"), F.lit(False))
    good = scored.where((F.col("score") >= F.col("floor")) & (F.col("form").isNull() | own | ~F.col("hit")))
    found = good.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= k)
    return found.select("query", F.col("doc").alias("chunk"), "score", "rank", (F.col("form").isNotNull() & ~F.col("hit")).alias("widened"))


def hash_embedding(df: DataFrame, key: str, text: str, width: int = 256) -> DataFrame:
    """key, bucket, weight: signed counts of hashed words, of length one; words are cut at white space."""
    words = df.select(key, F.explode(F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")).alias("word"))
    digest = F.sha2("word", 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    # the first four bytes, little-endian, modulo 256 are the first byte
    signed = words.select(key, F.pmod(byte(0), F.lit(width)).alias("bucket"), F.when(byte(4) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = signed.groupBy(key, "bucket").agg(F.sum("s").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return sums.select(key, "bucket", F.round(F.col("w") / norm, 6).alias("weight"))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _nearest(k: int):
    def nearest(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = {"query": [], "vector": [], "distance": []}
        if queries.num_rows and vectors.num_rows:
            q, v = _matrix(queries.column("v")), _matrix(vectors.column("v"))
            names, asked = vectors.column("id").to_numpy(), queries.column("id").to_numpy()
            # candidates by one product, their distances anew from the differences
            length = (v**2).sum(1)
            scale = 1e-5 + 1e-9 * (np.abs(q).max() ** 2 + np.abs(v).max() ** 2) * q.shape[1]
            for i in range(len(q)):
                if i % QUERY_SLICE == 0:
                    about = q[i : i + QUERY_SLICE] @ (-2 * v.T)
                    about += length
                    about += (q[i : i + QUERY_SLICE] ** 2).sum(1)[:, None]
                row = about[i % QUERY_SLICE]
                near = np.flatnonzero(row <= np.partition(row, min(k, v.shape[0]) - 1)[min(k, v.shape[0]) - 1] + scale)
                distance = ((v[near] - q[i]) ** 2).sum(1).round(6)
                best = np.lexsort((names[near], distance))[:k]
                out["query"].append(np.full(len(best), asked[i]))
                out["vector"].append(names[near][best])
                out["distance"].append(distance[best])
        joined = lambda c, t: pa.array(np.concatenate(out[c]) if out[c] else np.zeros(0), t)
        return pa.table({"query": joined("query", pa.int64()), "vector": joined("vector", pa.int64()), "distance": joined("distance", pa.float64())})

    return nearest


def vector_topk(queries: DataFrame, vectors: DataFrame, id_col: str, vector_col: str, k: int = TOP) -> DataFrame:
    """query, vector, distance (squared Euclidean), score = max(0, 1 - distance), rank.

    Both sides are dealt to blocks; each pair of blocks is one task's product, and the k best of all blocks are merged.
    """
    sides = [t.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL") for t in (queries, vectors)]
    nq, nv = (max(1, -(-t.count() // size)) for t, size in zip(sides, (QUERY_BLOCK, VECTOR_BLOCK), strict=True))
    q = sides[0].select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nv - 1).cast("long"))).alias("vb"))
    v = sides[1].select("id", "v", F.pmod(F.xxhash64("id"), F.lit(nv)).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    near = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(_nearest(k), "query long, vector long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "vector")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query", "vector", "distance", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("score"), "rank")


def _form_scores(low: Column, known: Column, category: Column, forms: Column) -> Column:
    """Scores of the forms of one array for a document whose text and labels are in lower case."""

    def score(f: Column) -> Column:
        terms = F.size(F.filter(f["terms"], low.contains))
        hits = F.size(F.filter(known, lambda x: F.exists(f["aliases"], lambda a: x.contains(a) | a.contains(x))))
        share = lambda n, of: n / F.greatest(F.size(of), F.lit(1))
        return F.round(F.least(F.lit(1.0), 0.55 * share(terms, f["terms"]) + 0.4 * share(hits, f["aliases"]) + F.when(f["category"] == category, 0.12).otherwise(0.0)), 3)

    return F.transform(forms, lambda f: F.struct(score(f).alias("score"), (-f["ord"]).alias("first"), f["form_id"].alias("form_id")))


def form_scores(docs: DataFrame, forms: DataFrame, text: Column, labels: Column, category: Column) -> DataFrame:
    """``docs`` with scores: score, first (less for later forms) and form_id of every form. ``forms``: ord, form_id, category, terms, aliases.

    The forms are a table of arrays of ``FORMS_BLOCK`` at most. One such row is sent to the tasks and each document looks through it; of
    more, each document meets every block, and its scores are put together again by a number that it gets before.
    """
    lower = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    one = F.struct("ord", "form_id", "category", lower(F.col("terms")).alias("terms"), lower(F.col("aliases")).alias("aliases"))
    blocks = max(1, -(-forms.count() // FORMS_BLOCK))
    packed = forms.select(F.pmod(F.xxhash64("ord", "form_id"), F.lit(blocks)).alias("_block"), one.alias("f")).groupBy("_block").agg(F.array_sort(F.collect_list("f")).alias("_forms"))
    none = F.coalesce("_forms", F.array().cast(packed.schema["_forms"].dataType))
    # the text is lowered once, not for each term: it is bound by the outer function
    scores = lambda found: found.withColumn("scores", F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), F.transform(labels, F.lower).alias("known"))), lambda d: _form_scores(d["low"], d["known"], category, none)), F.lit(0))).drop("_forms", "_block")
    if blocks == 1:
        return scores(docs.withColumn("_block", F.lit(0).cast("long")).join(F.broadcast(packed), "_block", "left"))
    rows = computed(docs.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(packed, "_block")
    every = scores(each).groupBy("_row").agg(F.flatten(F.collect_list("scores")).alias("scores"))
    return rows.join(every, "_row", "left").drop("_row")


def match_form(docs: DataFrame, forms: DataFrame, text: Column, labels: Column, category: Column, least: float = 0.42) -> DataFrame:
    """``docs`` with form_id (null below ``least``) and form_score; of equal scores the first form."""
    best = F.array_max("scores")
    return form_scores(docs, forms, text, labels, category).withColumn("form_score", best["score"]).withColumn("form_id", F.when(F.col("form_score") >= least, best["form_id"])).drop("scores")
