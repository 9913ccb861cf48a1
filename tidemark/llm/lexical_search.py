"""Ranked lexical search: for every term a tree of maxima over document ranges, searched best first by branch and bound.

``build`` cuts the rows into ranges of up to ``LEAVES * LEAF`` documents (a block) and writes, for each block and term, the
documents that hold the term and how often. ``search`` turns the postings of the queries' terms into impacts, the part of
a document's score that does not depend on the query, whose maxima make the tree: documents, leaves of 16, nodes of
8 leaves, blocks, regions of 16 blocks. The sum over a query's terms of weight times maximum bounds every score below a
node. Regions are opened in waves, those of the highest bounds first; each wave opens the blocks of its regions that can
still hold one of the best ``k``, a block descends its own tree with a heap, and the best ``k`` found so far raise the
limit that the next wave has to reach. Nodes whose bound equals the limit are opened too, since an equal score with a
smaller id comes first, so the result is exact.

No task holds more than one block's postings of the asked terms with up to ``TOGETHER`` queries; candidates are limited
to ``k`` for each query and task before they move. Weights and impacts are 64-bit integers.

Defined cases: a null text counts as empty and has no terms; documents without terms count for nothing and are never
found; repeated rows are found once each; a null id sorts first; queries with null or empty texts have no rows; query rows
of one id and text count as one, of one id and several texts each have their own ranks; other columns are dropped; an
empty table of either kind gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bytetext as bt
from tidemark.llm.shared import written

LEAF = 16
NODE = 8  # leaves of a node
LEAVES = 64  # leaves of a block
REGION = 16  # blocks of a region
BLOCK_BYTES = 4_000_000
TOGETHER = 2_000  # queries that meet a block's postings in one task
WAVE = 64  # how many times as many regions a wave opens as the last one
#: Terms are the longest runs of these characters, of which only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(text: str):
    """The distinct terms of a text column, in the JVM: for queries, which are short."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_distinct(F.regexp_extract_all(F.translate(text, capitals, capitals.lower()), F.lit(TERM), F.lit(0)))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _postings(batches):
    """For each block a row of its ids and lengths (term null), and a row for each of its terms; documents are numbered by id."""
    part, n_blocks = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for first, end, data, offsets in bt.slices(texts, BLOCK_BYTES):
            for low in range(first, end, LEAF * LEAVES):
                high = min(end, low + LEAF * LEAVES)
                own = offsets[low - first : high - first + 1]
                yield _block(ids.slice(low, high - low), bt.lower(data[own[0] : own[-1]]), own - own[0], (part << 32) | n_blocks)
                n_blocks += 1


def _block(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, block: int) -> pa.RecordBatch:
    by_id = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
    number = np.empty(len(ids), np.int64)
    number[by_id] = np.arange(len(ids))
    starts, ends, rows = bt.word_spans(data, offsets, _BETWEEN)
    lengths = np.bincount(number[rows], minlength=len(ids))
    _, where, term = np.unique(bt.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    pair, tf = np.unique(term * (LEAF * LEAVES) + number[rows], return_counts=True)
    docs, bounds = pair % (LEAF * LEAVES), np.searchsorted(pair, np.arange(len(where) + 1) * (LEAF * LEAVES))
    n = len(where) + 1
    whole = np.array([0, *bounds[1:], bounds[-1]])  # the last row, of the ids, has no documents of a term
    columns = {
        "region": pa.array(np.full(n, (block >> 32 << 32) | ((block & 0xFFFFFFFF) // REGION))),
        "block": pa.array(np.full(n, block)),
        "term": pa.concat_arrays([_cut(data, starts[where], ends[where]), pa.nulls(1, pa.string())]),
        "docs": _lists(docs, whole), "tf": _lists(tf, whole),
        "n": _lists(np.concatenate([lengths[docs], lengths]), np.array([*whole[:-1], whole[-1] + len(ids)])),
        "ids": pa.ListArray.from_arrays(pa.array(np.array([0] * n + [len(ids)]), pa.int32()), ids.take(pa.array(by_id))),
    }
    return pa.RecordBatch.from_pydict(columns)


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The index, a written table: (region, block, term, docs, tf, n, ids); a block's row without a term has all its ids."""
    kind = dict(docs.dtypes)[doc_id]
    schema = f"region long, block long, term string, docs array<int>, tf array<int>, n array<int>, ids array<{kind}>"
    return written(docs.select(F.col(doc_id), F.col(text)).mapInArrow(_postings, schema), "postings")


def _impacts(n_docs: int, n_terms: int):
    """(region, block, term, docs, impacts, top) of postings."""

    def run(batches):
        for batch in batches:
            tf, n = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("tf", "n"))
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))
            bounds = np.append(0, np.cumsum(pc.list_value_length(batch.column("tf")).to_numpy()))
            top = np.maximum.reduceat(impact, bounds[:-1]) if len(batch) else impact
            impacts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(impact))
            columns = [batch.column(c) for c in ("region", "block", "term", "docs")]
            yield pa.RecordBatch.from_arrays([*columns, impacts, pa.array(top)], ["region", "block", "term", "docs", "impacts", "top"])

    return run


class Block:
    """The trees of a block: impacts of its documents by leaf, and their maxima by term over leaves and nodes."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.term = {t: i for i, t in enumerate(table.column("term").to_pylist())}
        size = pc.list_value_length(table.column("docs")).to_numpy()
        docs = pc.list_flatten(table.column("docs")).to_numpy().astype(np.int64)
        impact = pc.list_flatten(table.column("impacts")).to_numpy()
        term = np.repeat(np.arange(len(size)), size)
        key = term * LEAVES + docs // LEAF
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.leaves = np.zeros((len(size), LEAVES), np.int64)
        self.leaves.reshape(-1)[key[new]] = np.maximum.reduceat(impact, new)
        self.nodes = self.leaves.reshape(len(size), LEAVES // NODE, NODE).max(2)
        by_leaf = np.argsort(docs // LEAF, kind="stable")
        self.docs, self.of, self.impact = docs[by_leaf], term[by_leaf], impact[by_leaf]
        self.starts = np.searchsorted(self.docs // LEAF, np.arange(LEAVES + 1))

    def best(self, terms: list[str], weights: list[int], limit: int, k: int) -> list[tuple[int, int]]:
        """(score, document) of the best ``k`` that reach ``limit``, equal scores by smaller document."""
        held = [(self.term[t], w) for t, w in zip(terms, weights, strict=True) if t in self.term]
        if not held:
            return []
        own, weight = (np.array(x) for x in zip(*held, strict=True))
        of_term = np.zeros(len(self.term), np.int64)
        of_term[own] = weight
        leaves = self.leaves[own]
        found: list[tuple[int, int]] = []
        open_ = [(-b, 0, i) for i, b in enumerate((weight @ self.nodes[own]).tolist()) if b >= limit]
        heapq.heapify(open_)
        while open_ and -open_[0][0] >= limit:
            _, is_leaf, i = heapq.heappop(open_)
            if not is_leaf:
                for j, b in enumerate((weight @ leaves[:, i * NODE : (i + 1) * NODE]).tolist()):
                    if b >= limit:
                        heapq.heappush(open_, (-b, 1, i * NODE + j))
                continue
            here = slice(self.starts[i], self.starts[i + 1])
            scores = np.zeros(LEAF, np.int64)
            np.add.at(scores, self.docs[here] - i * LEAF, of_term[self.of[here]] * self.impact[here])
            for j in np.flatnonzero(scores >= limit).tolist():
                entry = (int(scores[j]), -(i * LEAF + j))
                if len(found) < k:
                    heapq.heappush(found, entry)
                else:
                    heapq.heappushpop(found, entry)
            if len(found) == k:
                limit = max(limit, found[0][0])
        return [(s, -d) for s, d in found]


def _descend(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            block = Block(left)
            for q, limit, terms, weights in zip(*(right.column(c).to_pylist() for c in ("q", "limit", "terms", "weights")), strict=True):
                out += [(q, d, s) for s, d in block.best(terms, weights, limit, k)]
        number = left.column("block")[0].as_py() if len(left) else 0
        return pa.table({
            "q": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([number] * len(out), pa.int64()),
            "doc": pa.array([x[1] for x in out], pa.int32()), "score": pa.array([x[2] for x in out], pa.int64()),
        })

    return run


def search(index: DataFrame, queries: DataFrame, k: int = 50, text: str = "text", query_id: str = "item_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each query."""
    kind = dict(index.dtypes)["ids"].removeprefix("array<").removesuffix(">")
    asked = queries.select(F.col(query_id).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    asked = written(asked.select(F.monotonically_increasing_id().alias("q"), "item", terms_of("text").alias("terms")), "queries")
    terms = written(asked.select(F.explode("terms").alias("term")).distinct(), "terms")
    ids = index.where("term IS NULL")
    sums = ids.agg(F.sum(F.expr("size(filter(n, x -> x > 0))")), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()
    n_docs, n_terms = (int(x or 0) for x in sums)
    postings = index.where("term IS NOT NULL").join(terms, "term").select("region", "block", "term", "docs", "tf", "n")
    trees = written(postings.mapInArrow(_impacts(n_docs, max(1, n_terms)), "region long, block long, term string, docs array<int>, impacts array<long>, top long"), "trees")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.sum(F.size("docs")) + 1))).alias("w")
    weights = trees.groupBy("term").agg(weight).where("w > 0")
    weighted = written(asked.select("q", F.explode("terms").alias("term")).join(weights, "term"), "weights")
    packed = F.collect_list(F.struct("term", "w"))
    whole = written(weighted.groupBy("q").agg(packed.alias("p")).select("q", F.col("p.term").alias("terms"), F.col("p.w").alias("weights")), "queries")
    parts = -(-whole.count() // TOGETHER) or 1
    dealt = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")

    bound = F.sum(F.col("w") * F.col("top")).alias("bound")
    regions = trees.groupBy("region", "term").agg(F.max("top").alias("top"))
    place = F.rank().over(Window.partitionBy("q").orderBy(F.col("bound").desc()))
    frontier = written(weighted.join(regions, "term").groupBy("q", "region").agg(bound).where("bound > 0").withColumn("place", place), "regions")
    most = frontier.agg(F.max("place")).first()[0] or 0
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    best, reach = None, 0
    while reach < most:
        last, reach = reach, max(1, reach * WAVE)
        opened = frontier.where((F.col("place") > last) & (F.col("place") <= reach))
        if best is None:
            opened = opened.withColumn("limit", F.lit(1).cast("long"))
        else:
            so_far = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(1).alias("limit"))
            opened = opened.join(so_far, "q", "left").withColumn("limit", F.coalesce("limit", F.lit(1).cast("long"))).where("bound >= limit")
        tops = trees.select("region", "block", "term", "top")
        blocks = opened.select("q", "region", "limit").join(weighted, "q").join(tops, ["region", "term"]).groupBy("q", "limit", "block").agg(bound)
        work = written(blocks.where("bound >= limit").select("q", "block", "limit"), "work")
        opened_blocks = trees.join(work.select("block").distinct(), "block", "left_semi").select("block", "term", "docs", "impacts")
        left = opened_blocks.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(parts)])))
        right = work.join(whole, "q").withColumn("part", dealt)
        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_descend(k), "q long, block long, doc int, score long")
        found = found.join(ids.select("block", "ids"), "block").select("q", F.expr("ids[doc]").alias("doc_id"), "score")
        found = found if best is None else found.unionByName(best.select("q", "doc_id", "score"))
        best = written(found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k), "best")
    if best is None:
        best = index.sparkSession.createDataFrame([], f"q long, doc_id {kind}, score long, rank int")
    return best.join(asked.select("q", F.col("item").alias(query_id)), "q").select(query_id, "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(build(docs), items)


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
items AS (
    SELECT DISTINCT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
    FROM benchmark),
tf AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM items) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
scored AS (
    SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
    FROM items JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, text, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
WHERE rank <= 50
"""

QUERIES = {"op11_lexical_search": op11_lexical_search}
ORACLES = {"op11_lexical_search": SQL}
