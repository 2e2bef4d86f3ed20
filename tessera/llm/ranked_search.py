"""Ranked lexical search: an inverted index in shards of documents, searched by WAND.

The index is a table in the shared folder. Each task makes shards of the documents that it reads, bounded by their terms, each with
the postings of all its terms (documents by ascending id). What ranking needs of the whole corpus, its size and the documents that
hold a term, is a sum over that table.

A shard is searched for one item after the other. Each of an item's terms has in the shard a maximum impact, the most it adds
to any score. Documents come in ascending order; pivots are those whose terms' maximum impacts add up to more than the
threshold, the least score of the full heap. All others are skipped without a score. A term whose maximum, with those of all
lesser terms, stays within the threshold makes no pivot, so that its postings are only looked up. Pivots are chosen for a run of documents at
once, in arrays, and the heap and its threshold are renewed behind each run. The heaps of all shards are merged in two steps.

Items are taken in blocks of bounded size, so that neither driver nor task holds a table of queries that grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.tokens import array_parts

TOP = 50
#: Terms, and documents, of one shard at most; a longer document is a shard of its own.
SHARD_TERMS, SHARD_DOCS = 2_000_000, 16_384
#: Bytes of items that are searched for in one go.
BLOCK_BYTES = 4_000_000
#: Documents of a shard's first run; each further run has twice as many.
FIRST_RUN = 256
#: Heaps that are merged side by side before the last step.
MERGERS = 32
INDEX = "shard string, term binary, df int, at array<int>, tf array<int>, ids array<long>"
_KINDS = pa.schema([("shard", pa.string()), ("term", pa.binary()), ("df", pa.int32()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
#: A-Z to a-z; every other ASCII character that is no digit and no letter to a blank. Bytes above are parts of letters.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _shard(name: str, ids: list[int | None], terms: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: one for its documents (their ids, and lengths as tf), one for each term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
    known: dict[bytes, int] = {}
    number = known.setdefault
    flat = np.fromiter((number(t, len(known)) for i in order for t in terms[i]), np.int64)
    sizes = np.array([len(terms[i]) for i in order], np.int64)
    keys, tf = np.unique(flat * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, at = keys // len(ids), (keys % len(ids)).astype(np.int32)
    ends = np.searchsorted(term, np.arange(len(known) + 1)).astype(np.int32)
    n = len(known)
    listed = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(list(known), pa.binary()), pa.array(np.diff(ends)), listed(at), listed(tf), pa.nulls(n, pa.list_(pa.int64()))], schema=_KINDS)
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int32())), pa.array([[ids[i] for i in order]], pa.list_(pa.int64()))], schema=_KINDS)


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of docs (doc_id, text): for each shard a row of its documents (term null, ids, tf their numbers of terms) and one for
    each term (df, at: places among the ids, tf). Every row of docs is in it, those without a term too."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids: list[int | None] = []
        terms: list[list[bytes]] = []
        made = held = 0
        # A word is kept once for all documents of a shard.
        one: dict[bytes, bytes] = {}
        for batch in batches:
            for start, texts in array_parts(batch.column(1)):
                for i, text in enumerate(texts.to_pylist()):
                    ids.append(batch.column(0)[start + i].as_py())
                    terms.append([one.setdefault(t, t) for t in terms_of(text)])
                    held += len(terms[-1])
                    if held >= shard_terms or len(ids) >= shard_docs:
                        yield from _shard(f"{TaskContext.get().partitionId()}-{made}", ids, terms)
                        ids, terms, one, held, made = [], [], {}, 0, made + 1
        if ids:
            yield from _shard(f"{TaskContext.get().partitionId()}-{made}", ids, terms)

    return materialise(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(index, INDEX), "index", compression="zstd")


def wand(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, top: int = TOP, first_run: int = FIRST_RUN) -> tuple[np.ndarray, np.ndarray, int]:
    """The `top` best documents and their scores, best first (equal scores by place), and how many were scored.

    lists: for each term of the item the documents that hold it, ascending, and its impact on each."""
    bounds = [int(impacts.max()) for _, impacts in lists]
    order = sorted(range(len(lists)), key=bounds.__getitem__)
    lists, bounds = [lists[i] for i in order], [bounds[i] for i in order]
    upto = np.cumsum(bounds)
    best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    threshold = scored = begin = 0
    run = first_run
    while begin < documents:
        end = min(begin + run, documents)
        # Terms before `essential` cannot lift a document above the threshold, all of them together.
        essential = int(np.searchsorted(upto, threshold, side="right"))
        if essential == len(lists):
            break
        bound = np.zeros(end - begin, np.int64)
        parts = []
        for at, _ in lists:
            low, high = np.searchsorted(at, (begin, end))
            parts.append((low, high))
        for k in range(len(lists) - 1, -1, -1):
            low, high = parts[k]
            here = lists[k][0][low:high] - begin
            if k < essential:
                here = here[bound[here] > 0]
            bound[here] += bounds[k]
        pivots = np.flatnonzero(bound > threshold)
        if len(pivots):
            score = np.zeros(len(pivots), np.int64)
            for (at, impacts), (low, high) in zip(lists, parts):
                if low < high:
                    place = np.minimum(np.searchsorted(at[low:high], pivots + begin), high - low - 1) + low
                    score += np.where(at[place] == pivots + begin, impacts[place], 0)
            scored += len(pivots)
            best, scores = np.concatenate([best, pivots + begin]), np.concatenate([scores, score])
            heap = np.lexsort((best, -scores))[:top]
            heap = heap[scores[heap] > 0]
            best, scores = best[heap], scores[heap]
            if len(best) == top:
                threshold = int(scores[-1])
        begin, run = end, 2 * run
    return best, scores, scored


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(index: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `top` documents of highest score above 0, all if they are fewer.

    items: item_id and text. Equal scores go by ascending doc_id, a null one last; documents that repeat a doc_id have a rank
    each. Rows of items that repeat an item_id are one item with the terms of all of them, a null item_id is one too. Items without
    terms, or with terms that no document has, have no rows."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    found = [_search_block(index, _terms_by_item(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)), top) for b in range(blocks)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    best = lambda *key: F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    some = rows.withColumn("merger", F.pmod(F.xxhash64("doc_id"), F.lit(MERGERS))).withColumn("rank", best("item_id", "merger")).where(F.col("rank") <= top)
    return some.withColumn("rank", best("item_id")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _terms_by_item(items: DataFrame) -> dict[int | None, set[bytes]]:
    out: dict[int | None, set[bytes]] = {}
    for r in items.toLocalIterator():
        out.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
    return out


def _search_block(index: DataFrame, items: dict[int | None, set[bytes]], top: int) -> DataFrame:
    """item_id, doc_id, score: the merged rows of the heaps of all shards."""
    spark = index.sparkSession
    found = "item_id long, doc_id long, score long"
    vocabulary = spark.createDataFrame([(t,) for t in sorted(set().union(*items.values()))], "term binary")
    asked = index.where("term is not null").join(vocabulary, "term", "left_semi")
    holding = {bytes(r["term"]): r["df"] for r in asked.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    of_docs = index.where("term is null")
    sizes = of_docs.select(F.size(F.filter("tf", lambda n: n > 0)).alias("n"), F.aggregate("tf", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"))
    documents, length = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    if not holding:
        return spark.createDataFrame([], found)
    weights = {t: weight(documents, n) for t, n in holding.items()}
    wanted = spark.sparkContext.broadcast([(i, [t for t in terms if weights.get(t)]) for i, terms in items.items()])

    def ranked(key: tuple, shard: pa.Table) -> pa.Table:
        rows = shard["term"].to_pylist()
        own = rows.index(None)
        ids = shard["ids"][own].values
        n = shard["tf"][own].values.to_numpy(zero_copy_only=False).astype(np.int64)
        m = 20 * (50 + (50 * n * documents) // length)
        lists = {}
        for k, term in enumerate(rows):
            if w := term is not None and weights[term]:
                at, tf = (shard[c][k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
                lists[term] = at, w * ((1_000_000_000 * tf) // (1000 * tf + m[at]))
        out: list[tuple] = []
        for item, terms in wanted.value:
            if of := [lists[t] for t in terms if t in lists]:
                best, scores, _ = wand(of, len(n), top)
                out.append((np.full(len(best), -1 if item is None else item, np.int64), pa.array(np.full(len(best), item is None)), ids.take(pa.array(best)), scores))
        if not out:
            return pa.table({"item_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        item, none = np.concatenate([x[0] for x in out]), np.concatenate([x[1].to_numpy(zero_copy_only=False) for x in out])
        return pa.table({"item_id": pa.array(item, mask=none), "doc_id": pa.chunked_array([x[2] for x in out]), "score": pa.array(np.concatenate([x[3] for x in out]))})

    shards = asked.select("shard", "term", "at", "tf", "ids").unionByName(of_docs.select("shard", "term", "at", "tf", "ids"))
    return materialise(shards.groupBy("shard").applyInArrow(ranked, found), "heaps")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The documents of docs (doc_id, text) that rank highest for each of items (item_id, text); see `search`.

    Terms are runs of ASCII digits, ASCII letters in lower case and all characters beyond ASCII. A null text has no terms. Very long
    texts are indexed whole. Other columns are ignored. An empty table on either side gives an empty result."""
    return search(build_index(docs), items, top)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n_row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), p AS (
  SELECT n_row, doc_id, n, term, count(*) AS tf FROM (SELECT n_row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term
), i AS (
  SELECT n_row, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact FROM p JOIN w ON w.term = p.term, s
), r AS (
  SELECT item_id, n_row, doc_id, sum(impact)::BIGINT AS score FROM i JOIN q ON q.term = i.term GROUP BY ALL
), k AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
