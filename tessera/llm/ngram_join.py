"""Similarity join on word n-grams, exact, with set-relation skipping.

Documents of one set are one class. A class's prefix, its rarest shingles, must share one with that
of any similar class; shingles are ordered by a count sketch of all documents, whose size follows their number. Index lists, one
for each prefix shingle, are used twice:

1. Each class in a list is compared with the list's pivot, the one that shares most of its prefix with others, and in a long list with a few further ones, if their sizes and
   places in the list (which bound the overlap) allow a link.
   Lists that stay mixed have further pivots, a few rounds long.
2. The pivot's answers give those of the sets that are highly similar to it. For components, what is linked with a pivot is in
   its component and needs no search of its own: only the classes, pivots aside, that are not in the component
   which most of a list is in are compared with the others of other components. For all links, two sets
   whose distances to the pivot add up to no more than a link allows are linked without being compared. Lists
   are cut into blocks by size. A set's place in a list bounds its overlap through that list and with it the sizes it reaches: blocks
   that do not reach each other never meet. Pairs whose distances to the pivot, known from step 1, differ by more than a link allows
   (the distance is a metric) are left out.

Pairs whose parity maps, small bit sets, differ in more bits than a link allows are left out. Other comparisons count the common shingles of two whole texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, numbered
from tessera.llm.components import components, joined
from tessera.llm.tokens import array_parts, in_parts

WORDS = 4
PERCENT = 85
#: Buckets of the count sketch, as a power of two: 16 for each document between these bounds. A worker
#: counts in four bytes for each, and has a byte for each from then on.
LEAST_BUCKETS = 22
MOST_BUCKETS = 26
SLICES = 64
#: Lists of more than so many rows have further pivots, so many of them: what one pivot leaves open another one mostly links.
MORE_ROWS, MORE = 16, 4
#: Rounds of further pivots at most (one that finds no link is the last), and how many open comparisons for each row of a list need no further one.
ROUNDS, OPEN_SHARE = 3, 2
#: Rows of an index list that are joined by one task; longer lists are dealt out in parts.
LONG = 1000
#: Sizes of one block differ by this factor at most.
BLOCK_RATIO = 1.05
#: Bits of a set's parity map at most; fewer for sets of fewer shingles.
MAP_BITS = 8192
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; of all words in one if they are fewer."""

    def __init__(self, words: int = WORDS, remembered: int = 100_000):
        self.words, self.remembered, self.known = words, remembered, {}

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of_bytes((text or "").encode())

    def of_bytes(self, text: bytes) -> np.ndarray:
        import xxhash

        words = text.translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.unique(_rolled(np.array([known[w] for w in words], np.uint64), min(self.words, len(words))))

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of all texts: their hashes in a row, and where each text's begin (with the end of the last one)."""
        import xxhash

        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        coded = split.flatten().dictionary_encode()
        each = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        of = np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each))[coded.indices.to_numpy()]
        offsets = split.offsets.to_numpy().astype(np.int64)
        begin = offsets - offsets[0]
        if b"" in each:  # beside white space at the ends of a text
            word = coded.indices.to_numpy() != each.index(b"")
            begin, of = np.concatenate([[0], np.cumsum(word)])[begin], of[word]
        size = np.diff(begin)
        count = np.where(size, np.maximum(size - self.words + 1, 1), 0)
        upto = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(upto[-1], np.uint64)
        if len(of) >= self.words:
            # Those that begin in a text of enough words and end within it.
            whole = np.repeat(size >= self.words, count)
            at = np.arange(upto[-1]) + np.repeat(begin[:-1] - upto[:-1], count)
            out[whole] = _rolled(of, self.words)[at[whole]]
        for i in np.flatnonzero((size > 0) & (size < self.words)).tolist():
            out[upto[i]] = _rolled(of[begin[i] : begin[i + 1]], int(size[i]))[0]
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            out[a:b].sort()
        first = np.ones(len(out), bool)
        first[1:] = out[1:] != out[:-1]
        first[upto[:-1][count > 0]] = True
        return out[first], np.concatenate([[0], np.cumsum(first)])[upto]


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out *= _A
            out += words[i : len(words) - n + 1 + i]
        out ^= out >> np.uint64(31)
        out *= _B
        out ^= out >> np.uint64(29)
    return out


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def _parity_map(h: np.ndarray) -> np.ndarray:
    """One bit for each bucket of hashes, whether it holds an odd number: two maps differ in no more
    bits than the sets differ in shingles. Folding a map in halves gives that of half the size."""
    over = 1 << max(0, len(h) - 1).bit_length()
    bits = min(MAP_BITS, max(64, min(over, 128), over // 2))
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_be_near(x: Column, y: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether parity maps x and y, of sets of sizes n and m, allow a link."""
    fold = lambda a, size: F.when(F.size(a) > size, F.zip_with(F.slice(a, F.lit(1), size), F.slice(a, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(a)
    size = F.least(F.size(x), F.size(y))
    differ = F.aggregate(F.zip_with(fold(x, size), fold(y, size), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def shingle_levels(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How common the shingles of a hash bucket are: the binary logarithm of the bucket's count, the same for all
    up to the mean. Tasks count all texts and send their counts in slices; the sums' logarithms, one byte for
    each bucket, are all that the driver sees."""
    buckets = 1 << min(MOST_BUCKETS, max(LEAST_BUCKETS, math.ceil(math.log2(16 * docs.count() + 1))))
    wide = buckets // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), np.zeros(buckets, np.uint32)
        for batch in batches:
            for _, texts in array_parts(batch.column(0)):
                np.add.at(counts, _bucket(shingler.of_texts(texts)[0], buckets), np.uint32(1))
        if counts.any():
            cut = [zlib.compress(counts[i * wide : (i + 1) * wide].tobytes(), 1) for i in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary())], names=["slice", "counts"])

    def add(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(wide, np.uint64)
        for part in rows:
            for c in part["counts"]:
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        level = np.log2(np.maximum(total, np.uint64(1))).astype(np.uint8)
        yield pd.DataFrame({"slice": [key[0]], "shingles": [int(total.sum())], "levels": [level.tobytes()]})

    sums = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, shingles long, levels binary")
    levels, shingles = np.zeros(buckets, np.uint8), 0
    for r in sums.toLocalIterator():
        levels[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["levels"], np.uint8)
        shingles += r["shingles"]
    return np.maximum(levels, np.uint8(math.log2(max(1.0, shingles / buckets))))


def _lists(values: list[np.ndarray]) -> pa.Array:
    begin = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *values]), pa.int64()))


def shingle_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, levels: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if it is empty) and, with levels, prefix (the
    hashes one of which any linked set has in its own prefix, in the common order) and parity."""
    held = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["doc_id", "n_shingles", "digest"] + ["prefix", "parity"] * (levels is not None)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, levels = Shingler(words), held.value
        for batch in batches:
            for start, texts in array_parts(batch.column(1)):
                hashes, begin = shingler.of_texts(texts)
                n, each = np.diff(begin), [hashes[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                columns = [batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in each], pa.binary())]
                if levels is not None:
                    level, first = levels[_bucket(hashes, len(levels))], np.where(n, n - (percent * n + 99) // 100 + 1, 0)
                    # Hashes are sorted, and stay so within a level.
                    prefixes = [h[np.argsort(level[a : a + len(h)], kind="stable")[:k]].view(np.int64) for h, a, k in zip(each, begin.tolist(), first.tolist())]
                    columns += [_lists(prefixes), _lists([_parity_map(h) for h in each])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_shingles long, digest binary" + (", prefix array<long>, parity array<long>" if levels is not None else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sets, schema)


def _may_link(n: Column, place: Column, m: Column, there: Column, percent: int) -> Column:
    """Sizes n and m, with the shared shingle at these places (from 0) of the common order: the overlap is at
    most what follows in the shorter rest."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * F.least(n - place, m - there) >= percent * (n + m))


def _block(size: Column) -> Column:
    return F.floor(F.log(size) / math.log(BLOCK_RATIO)).cast("int")


def _reached(n: Column, place: Column, percent: int) -> Column:
    """The blocks of sizes that a set of size n may link with through a shingle at this place: the overlap is at most n - place."""
    low = F.ceil(percent * n / 100)
    high = F.least(F.floor(100 * n / percent), F.floor((100 + percent) * (n - place) / percent) - n)
    return F.when(low <= high, F.sequence(_block(low), _block(high))).otherwise(F.array().cast("array<int>"))


def _packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, packed for the documents of ids: compressed before they are dealt out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start, texts in in_parts(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([c.compress((t or "").encode()) for t in texts], pa.binary())], names=["id", "packed"])

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "id long, packed binary")
    # Rows that repeat a doc_id with other texts: the class was named after one of them, which its digest tells.
    return packed.join(ids, "id", "left_semi")


def _compared(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (a, b) with common, n, m: the overlap and sizes of their sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shingler, d = Shingler(words), zstandard.ZstdDecompressor()
        last, of_last = None, None
        for batch in batches:
            common, n, m = [], [], []
            for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if b != last:
                    last, of_last = b, shingler.of_bytes(d.decompress(y))
                h = shingler.of_bytes(d.decompress(x))
                common.append(len(np.intersect1d(h, of_last, assume_unique=True)))
                n.append(len(h))
                m.append(len(of_last))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in (common, n, m)]], names=["a", "b", "common", "n", "m"])

    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long, common long, n long, m long")


def _parts(long: int) -> Column:
    """The numbers of the parts of a list (by its `rows`)."""
    return F.sequence(F.lit(0), F.ceil(F.col("rows") / long).cast("int") - 1)


def _part(key: str, long: int) -> Column:
    return F.pmod(F.xxhash64(key), F.ceil(F.col("rows") / long)).cast("int")


def _mixed(named: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with their component and the one that most of the list is in."""
    of = named.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = of.groupBy("token", "component").agg(F.count("*").alias("rows"))
    most = shares.groupBy("token").agg(F.count("*").alias("of"), F.max(F.struct("rows", "component"))["component"].alias("most"))
    return of.join(most.where("of > 1").select("token", "most"), "token")


def _linked(docs: DataFrame, sets: DataFrame, words: int, percent: int, every: bool = False, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Links between classes that connect what all links between them would connect: id, component of what the pivots link, and a, b, the links
    behind them. With every: all links, in two tables (a, b).

    docs: doc_id and text, one row for each id that sets (doc_id, n_shingles, prefix, parity) names; sets has one row
    for each class. Lists of more than `long` rows are joined in parts, the pivot, or the rows that are still open, with each."""
    sets = materialise(sets, "classes")
    maps = sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "parity")
    listed = sets.select("doc_id", "n_shingles", F.posexplode("prefix").alias("place", "token"))
    rows = listed.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    shared = materialise(listed.join(rows, "token").select("token", F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "place", "rows"), "lists", compression="zstd")
    # How much of a set's prefix other sets have too: a text that others were made from has the most, as changes are shingles of their own.
    share = shared.groupBy("id", "n").agg((F.count("*") / (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)).alias("share")).select("id", "share")
    best = lambda among=None: F.max_by("id", F.when(F.lit(True) if among is None else among, F.struct("share", -F.col("id"))))
    heads = shared.join(share, "id").groupBy("token").agg(best().alias("pivot"), F.array_compact(F.array(*[best(F.pmod(F.xxhash64("id"), F.lit(MORE)) == k) for k in range(MORE)])).alias("more"))
    pivot = (F.col("id") == F.col("pivot")) | ((F.col("rows") > MORE_ROWS) & F.array_contains("more", F.col("id")))
    listed = materialise(shared.join(heads, "token").select("token", "id", "n", "place", "pivot", "rows", pivot.alias("is_pivot")), "lists", compression="zstd")

    # Step 1: each with its lists' pivots.
    pivots = listed.where("is_pivot").select("token", F.col("id").alias("with"), F.col("n").alias("m"), F.col("place").alias("there"), F.explode(_parts(long)).alias("part"))
    first = listed.withColumn("part", _part("id", long)).join(pivots, ["token", "part"]).where((F.col("id") != F.col("with")) & (_may_link(F.col("n"), F.col("place"), F.col("m"), F.col("there"), percent)))
    first = first.select(F.greatest("id", "with").alias("a"), F.least("id", "with").alias("b")).distinct()
    first = first.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").where(_may_be_near(F.col("x"), F.col("y"), F.col("n"), F.col("m"), percent))
    first = materialise(first.select("a", "b"), "pairs")
    ids = first.select(F.col("a").alias("id")).union(first.select("b")).distinct()
    texts = materialise(_packed_texts(docs, ids), "texts")
    seen = materialise(_compared(first, texts, words), "compared")
    linked = (100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("m"))
    found = seen.where(linked).select("a", "b")

    # Further rounds for components: each list that is still mixed has a next pivot. A round compares each row of such lists once.
    used = listed.where("is_pivot").select("token", "id")
    labels = None if every else components(found)
    for _ in range(0 if every else ROUNDS):
        mixed = _mixed(listed.where("rows > 2"), labels)
        weight = mixed.agg(F.coalesce(F.sum((F.col("component") != F.col("most")).cast("long") * F.col("rows")), F.lit(0)), F.count("*")).first()
        if weight[0] <= OPEN_SHARE * weight[1]:
            break
        order = F.struct("share", -F.col("id"))
        chosen = mixed.join(used, ["token", "id"], "left_anti").join(share, "id").groupBy("token").agg(F.max_by(F.struct("id", "n", "place", "component"), order).alias("p"), F.max("rows").alias("rows"))
        chosen = materialise(chosen.select("token", F.col("p.id").alias("with"), F.col("p.n").alias("m"), F.col("p.place").alias("there"), F.col("p.component").alias("its"), "rows"), "next-pivots")
        used = used.unionByName(chosen.select("token", F.col("with").alias("id")))
        parts = mixed.withColumn("part", _part("id", long)).join(chosen.withColumn("part", F.explode(_parts(long))).drop("rows"), ["token", "part"])
        again = parts.where((F.col("component") != F.col("its")) & _may_link(F.col("n"), F.col("place"), F.col("m"), F.col("there"), percent)).select(F.greatest("id", "with").alias("a"), F.least("id", "with").alias("b")).distinct()
        again = again.join(first, ["a", "b"], "left_anti")
        again = again.join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").where(_may_be_near(F.col("x"), F.col("y"), F.col("n"), F.col("m"), percent))
        again = materialise(again.select("a", "b"), "pairs")
        first = first.unionByName(again)
        new_ids = again.select(F.col("a").alias("id")).union(again.select("b")).distinct().join(ids, "id", "left_anti")
        if not new_ids.isEmpty():
            new_ids = materialise(new_ids, "ids")
            texts, ids = texts.union(materialise(_packed_texts(docs, new_ids), "texts")), ids.union(new_ids)
        more = materialise(_compared(again, texts, words).where(linked).select("a", "b"), "compared")
        if more.isEmpty():
            break
        labels = joined(labels, more)

    # Step 2: what is left open. A pair's first common shingle heads a list that step 1 used if one
    # of the two is its pivot; so pivots, and lists of two, have no more to give.
    distance = seen.select(F.col("a").alias("id"), F.col("b").alias("pivot"), (1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("far"))
    named = listed.where("id <> pivot and rows > 2").drop("is_pivot")
    if every:
        named = named.withColumn("component", F.col("id")).withColumn("most", F.lit(None).cast("long"))
    else:
        named = _mixed(named, labels)
    named = materialise(named.join(distance, ["id", "pivot"], "left"), "open-lists", compression="zstd")
    of = named.withColumn("part", _part("id", long))
    # Where a set's shingle stands says how large a partner of this list may be: each side names its own block of sizes and those it reaches,
    # and only blocks that reach each other meet. Sets whose places rule each other out are skipped as blocks.
    own, reached = _block(F.col("n")), F.explode(_reached(F.col("n"), F.col("place"), percent))
    left = of.where("most is null or component <> most").withColumn("part", F.explode(_parts(long))).select("token", "part", F.col("id").alias("a"), F.col("n").alias("an"), F.col("place").alias("ap"), F.col("component").alias("ac"), F.col("far").alias("af"), own.alias("k"), reached.alias("l"))
    right = of.select("token", "part", F.col("id").alias("b"), "n", "place", "component", "far", own.alias("l"), reached.alias("k"))
    apart = 1 - percent / 100
    near = F.coalesce(F.abs(F.col("af") - F.col("far")) <= apart + 1e-9, F.lit(True))
    sure = F.coalesce(F.col("af") + F.col("far") <= apart - 1e-9, F.lit(False))
    open_ = left.join(right, ["token", "part", "k", "l"]).where((F.col("ac") != F.col("component")) & near & _may_link(F.col("an"), F.col("ap"), F.col("n"), F.col("place"), percent))
    second = open_.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.max(sure).alias("sure"))
    second = materialise(second.join(first, ["a", "b"], "left_anti"), "pairs")
    sure = second.where("sure").select("a", "b")
    second = second.where("not sure").join(maps.toDF("a", "n", "x"), "a").join(maps.toDF("b", "m", "y"), "b").where(_may_be_near(F.col("x"), F.col("y"), F.col("n"), F.col("m"), percent))
    second = materialise(second.select("a", "b"), "pairs")
    more_ids = second.select(F.col("a").alias("id")).union(second.select("b")).distinct()
    # Whose place in a list ruled out its pivot has no text yet.
    missing = more_ids.join(ids, "id", "left_anti")
    if not missing.isEmpty():
        texts = texts.union(materialise(_packed_texts(docs, missing), "texts"))
    return found if every else labels, sure.union(_compared(second, texts, words).where(linked).select("a", "b"))


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id (the smallest), n_shingles, digest, prefix, parity: a row for each set that one of rows (shingle_sets) with an id has."""
    of = rows.where("digest is not null and doc_id is not null")
    return of.groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("doc_id"), F.any_value("prefix").alias("prefix"), F.any_value("parity").alias("parity"))


def all_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Every link between classes (a, b; a above b), and the members of each class (class_id, doc_id, n_shingles). A class
    is the rows of one set and has its smallest doc_id; sets that are empty or have no id are in none.

    A group of n similar sets has up to n squared links; similar_groups finds the groups without them."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(shingle_sets(docs, words, percent, shingle_levels(docs, words)), "sets")
    classes = materialise(_classes(rows), "classes")
    first, second = _linked(docs, classes.select("doc_id", "n_shingles", "prefix", "parity"), words, percent, every=True, long=long)
    found = first.union(second)
    members = rows.where("doc_id is not null").join(classes.select("n_shingles", "digest", F.col("doc_id").alias("class_id")), ["n_shingles", "digest"]).select("class_id", "doc_id", "n_shingles")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), members


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    docs: doc_id and text; other columns are ignored. A null text and one without words have the empty
    set and are linked with nothing. Rows that repeat have equal sets and are linked. A null
    doc_id takes the component of its set, null if no other row has it. Ids that stand for
    several texts link what those texts link. Very long texts are shingled whole. An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(shingle_sets(docs, words, percent, shingle_levels(docs, words)), "sets")
    labels, more = _linked(docs, _classes(rows).select("doc_id", "n_shingles", "prefix", "parity"), words, percent, long=long)
    found = joined(labels, more)
    named = rows.where("digest is not null").groupBy("n_shingles", "digest").agg(F.min("doc_id").alias("id"))
    named = named.join(found, "id", "left").select("n_shingles", "digest", F.coalesce("component", "id").alias("component_id"))
    return rows.join(named, ["n_shingles", "digest"], "left").select("doc_id", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each group of rows of docs that hang together one: that with the smallest doc_id, a null one last. Rows
    without words are alone."""
    rows, n = numbered(docs)
    group = similar_groups(rows.select(F.col(n).alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias(n), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", n)
    kept = rows.select("doc_id", n).join(group, n).groupBy("component_id").agg(F.min_by(n, order).alias(n)).select(n)
    return rows.join(kept, n, "left_semi").drop(n)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), both_ AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT w.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = w.doc_id
"""
