"""Removal of long repeated passages by a logarithmic family of suffix arrays.

Every byte that a string of `length` bytes covers goes if that string starts anywhere else too.

A suffix array holds suffixes of a batch of documents in the order of their bytes, as far as the first SEED
ones tell them apart. It is sparse: of each string of `length` bytes it has the
suffix at the string's anchor, the place whose SEED bytes have the least hash, first one first.
Equal strings have equal anchors, so that two strings are equal only if their anchors'
suffixes meet, as neighbours in one array or in the merge of two. Documents come in batches. A new batch gets its own
array, a level of the family, in sorted files; it is merge-scanned against itself and all levels before it, and seeds that
occur twice are hits. Levels of equal size are merged into one that is sorted as a whole when the next batch comes, so that
there are as many as the logarithm of the batches. A seed's suffixes may stand in many files: a scan counts seeds within
each file first and shuffles and merges the counts.

Anchors of hits are compared with their surroundings, all strings that have them as anchor.
Equal surroundings are known by their 64-bit hash, within their seed. Those that differ are compared string by
string, by 64-bit hashes too, within their seed; seeds with very many different surroundings are compared by a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialise, shared_dir
from tessera.llm.tokens import array_parts

LENGTH = 200
SEED = 32
#: With four batches the first two levels are merged once.
BATCHES = 4
#: Bytes that are searched for anchors at once: some ten arrays of eight times as many.
PART = 1_000_000
#: Seeds with more different surroundings than that are not compared in one task.
MANY = 5000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BYTES = np.random.default_rng(5).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 31) - 1)
SUFFIXES = "seed binary, context long, doc_id long, place int, before int, after int"


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_A), n, 1 << 64))


def substring_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the `length` bytes from each place on (in wrapping integers), by doubling."""
    h, n, out, have = _BYTES[data], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if length & n:
                out, have = (h, n) if out is None else (h[: len(h) - have] * _power(have) + out[n:] if len(h) - have <= len(out) - n else h[: len(out) - n] * _power(have) + out[n:], have + n)
            if 2 * n > length:
                break
            h = h[:-n] * _power(n) + h[n:]
            n *= 2
        out = out[: len(data) - length + 1]
        out = out ^ (out >> np.uint64(32))
        out = out * _B
        return out ^ (out >> np.uint64(29))


def anchors(texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, seed) for each anchor: the strings that start from first to last
    have their anchor at place; all relative to the text. Seeds are rows of bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return none, none, none, none, np.zeros((0, seed), np.uint8)
    h = substring_hashes(data, seed)
    wide = length - seed + 1
    keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(keys) // wide) * wide, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, wide)
    n = len(data) - length + 1
    del h, keys
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(down[:n], up[wide - 1 : wide - 1 + n]) & _PLACE).astype(np.int64)
    del up, down, blocks, padded
    text = np.repeat(np.arange(len(texts)), sizes)[:n]
    starts = np.arange(n)
    valid = np.flatnonzero(starts + length <= ends[text])
    at, text, starts = at[valid], text[valid], starts[valid]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[new[1:], len(at)] - 1
    base = (ends - sizes)[text[new]]
    return text[new], at[new] - base, starts[new] - base, starts[last] - base, data[at[new][:, None] + np.arange(seed)]


def _context_hash(text: bytes, place: int, first: int, last: int, length: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text[first : last + length], place - first)


def suffixes(docs: DataFrame, length: int = LENGTH, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """seed, context, doc_id, place, before, after: the anchors of each document; `before` and `after` the
    distances to the first and last string that has it. carry: an int column of docs that goes along."""
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    names = ["seed", "context", "doc_id", "place", "before", "after"] + ([carry] if carry else [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in array_parts(batch.column(1), PART):
                raw = [(t or "").encode() for t in texts.to_pylist()]
                text, place, first, last, seeds = anchors(raw, length, seed)
                context = [_context_hash(raw[t], p, a, b, length) for t, p, a, b in zip(text.tolist(), place.tolist(), first.tolist(), last.tolist())]
                ends = pa.py_buffer(np.arange(0, seed * len(text) + 1, seed, dtype=np.int32))
                of = pa.array(start + text)
                columns = [pa.Array.from_buffers(pa.binary(), len(text), [None, ends, pa.py_buffer(seeds.tobytes())]), np.array(context, np.uint64).view(np.int64), batch.column(0).take(of), place.astype(np.int32), (place - first).astype(np.int32), (last - place).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns + [batch.column(i).take(of) for i in range(2, batch.num_columns)], kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", *([F.col(carry).cast("int")] if carry else [])).mapInArrow(scan, SUFFIXES + (f", {carry} int" if carry else ""))


class SuffixFamily:
    """Suffix arrays of sizes that grow geometrically, in batches, as tables in the shared folder."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, seed: int = SEED):
        self.spark, self.length, self.seed = spark, length, seed
        self.levels: list[tuple[int, str]] = []  # (batches in it, path)
        self.hits: list[DataFrame] = []
        self.merges = 0

    def _new_path(self) -> str:
        return f"{shared_dir(self.spark)}/suffixes-{uuid.uuid4().hex}"

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema(SUFFIXES).parquet(path)

    def add(self, docs: DataFrame) -> None:
        """Sorts a batch's suffixes and takes them in."""
        path = self._new_path()
        suffixes(docs, self.length, self.seed).sortWithinPartitions("seed").write.parquet(path)
        self._take_in(path)

    def add_batches(self, docs: DataFrame, batches: int) -> None:
        """Deals docs out into batches, sorts the suffixes of all of them in one pass and takes in one batch after the other."""
        path = self._new_path()
        of = suffixes(docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), self.length, self.seed, carry="batch")
        of.sortWithinPartitions("batch", "seed").write.partitionBy("batch").parquet(path)
        there = {r["batch"] for r in self.spark.read.schema(SUFFIXES + ", batch int").parquet(path).select("batch").distinct().collect()}
        for b in sorted(there):
            self._take_in(f"{path}/batch={b}")

    def _take_in(self, path: str) -> None:
        """Merges levels of equal size, scans the new one against itself and every level, and notes the hits."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            # In ranges of seed and document, so that a seed that many documents have is in many ranges.
            both = self._level(a).unionByName(self._level(b)).repartitionByRange("seed", "doc_id", "place").sortWithinPartitions("seed", "doc_id", "place")
            both.write.parquet(merged := self._new_path())
            self.levels.append((n + m, merged))
            self.merges += 1
            for old in (a, b):
                delete(self.spark, old)
        new = self._level(path).groupBy("seed").agg(F.count("*").alias("n"))
        hits = new.where("n > 1").select("seed")
        for _, level in self.levels:
            hits = hits.unionByName(new.select("seed").join(self._level(level).select("seed").distinct().hint("merge"), "seed", "left_semi"))
        self.hits.append(materialise(hits, "hits"))
        self.levels.append((1, path))

    def found(self) -> DataFrame:
        """fp (a hash of the seed), context, doc_id, place, before, after: the suffixes of all levels whose seeds were hit."""
        empty = self.spark.createDataFrame([], "seed binary")
        hits = materialise(reduce(DataFrame.unionByName, self.hits, empty).distinct(), "hits")
        of = reduce(DataFrame.unionByName, [self._level(level).join(hits, "seed", "left_semi") for _, level in self.levels], self.spark.createDataFrame([], SUFFIXES))
        return of.select(F.xxhash64("seed").alias("fp"), *of.columns[1:])

    def drop(self) -> None:
        for _, path in self.levels:
            delete(self.spark, path)


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, packed, key (of the text), n_bytes: texts compressed before they are dealt out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for start, texts in array_parts(batch.column(1), PART):
                raw = [(t or "").encode() for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array([c.compress(x) for x in raw], pa.binary()), pa.array(np.array([xxhash.xxh3_64_intdigest(x) for x in raw], np.uint64).view(np.int64))], names=["doc_id", "packed", "key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "doc_id long, packed binary, key long")


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (fp, context, n, many, doc_id, place, before, after) with their bytes, cut from the texts. Texts of
    another row with that doc_id are known by the context's hash."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "context", "n", "many", "place", "before", "after")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: list[tuple] = []
            for packed, wants in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = d.decompress(packed)
                for w in wants:
                    first, last = w["place"] - w["before"], w["place"] + w["after"]
                    if last + length <= len(text) and np.uint64(_context_hash(text, w["place"], first, last, length)).astype(np.int64) == w["context"]:
                        rows.append((w["fp"], w["context"], w["n"], w["many"], w["before"], text[first : last + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))], names=["fp", "context", "n", "many", "before", "bytes"])

    joined = _packed(docs).join(by_doc, "doc_id").select("packed", "wanted")
    return joined.mapInArrow(cut, "fp long, context long, n long, many boolean, before int, bytes binary")


def _strings(raw: list[bytes], before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance to the anchor, hash) of each string of the surroundings."""
    sizes = np.array([len(x) for x in raw])
    counts = sizes - length + 1
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(raw)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = substring_hashes(np.frombuffer(b"".join(raw), np.uint8), length)
    return row, within - before[row], h[begin[row] + within]


def _shared_strings(around: DataFrame, length: int) -> DataFrame:
    """fp, context, from, to: runs of strings, by their distance to the anchor, that other surroundings of
    the seed have too."""
    schema = "fp long, context long, from int, to int"
    names = ["fp", "context", "from", "to"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def runs(rows: pa.Table) -> pa.RecordBatch:
            fp, context = rows["fp"].to_numpy(), rows["context"].to_numpy()
            row, off, h = _strings(rows["bytes"].to_pylist(), rows["before"].to_numpy(), length)
            with np.errstate(over="ignore"):
                mixed = h + fp.view(np.uint64)[row] * _B + off.astype(np.uint64) * _A
            order = np.argsort(mixed, kind="stable")
            same = mixed[order][1:] == mixed[order][:-1]
            twice = np.zeros(len(mixed), bool)
            twice[order] = np.r_[same, False] | np.r_[False, same]
            twice &= (rows["n"].to_numpy() == 1)[row]
            at = np.flatnonzero(twice)
            new = np.r_[True, (row[at][1:] != row[at][:-1]) | (off[at][1:] != off[at][:-1] + 1)] if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(at)] - 1 if len(at) else first
            return pa.RecordBatch.from_arrays([pa.array(fp[row[at[first]]]), pa.array(context[row[at[first]]]), pa.array(off[at[first]], pa.int32()), pa.array(off[at[last]], pa.int32())], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last seed may go on in the next batch.
            fp = batch.column(0).to_numpy()
            cut = int(np.searchsorted(fp, fp[-1]))
            if cut or (held and held[0].column(0)[0].as_py() != fp[0]):
                held.append(batch.slice(0, cut))
                yield runs(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield runs(pa.Table.from_batches(held))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, off, h = _strings(batch.column(4).to_pylist(), batch.column(3).to_numpy(), length)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), batch.column(2).take(pa.array(row)), pa.array(off, pa.int32()), pa.array(h.view(np.int64))], names=["fp", "context", "n", "off", "h"])

    few = around.where("not many").repartition("fp").sortWithinPartitions("fp").select("fp", "context", "n", "before", "bytes").mapInArrow(compare, schema)
    each = around.where("many").select("fp", "context", "n", "before", "bytes").mapInArrow(strings, "fp long, context long, n long, off int, h long")
    twice = each.groupBy("fp", "off", "h").count().where("count > 1").drop("count")
    many = each.where("n = 1").join(twice, ["fp", "off", "h"], "left_semi").select("fp", "context", F.col("off").alias("from"), F.col("off").alias("to"))
    return few.unionByName(many)


def _removed(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes), kept (what remains): a row for each row of docs."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        d = zstandard.ZstdDecompressor()
        for batch in batches:
            columns: list[list] = [[], [], []]
            for packed, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text, spans = d.decompress(packed), []
                for r in sorted((r["from"], r["to"]) for r in ranges or []):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                columns[0].append(len(text))
                columns[1].append([{"from": a, "to": b} for a, b in spans])
                columns[2].append(b"".join([*kept, text[at:]]))
            types = (pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", "n_bytes", "spans", "kept"])

    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    both = _packed(docs).join(by_doc, "doc_id", "left").select("doc_id", "packed", "ranges")
    return both.mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<from:int,to:int>>, kept binary")


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, batches: int = BATCHES, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs of bytes, end exclusive), kept (the bytes that remain): a
    row for each row of docs (doc_id, text); other columns are ignored. A null text is empty. An empty table gives an empty
    result. Very long texts are searched whole, one at a time.

    Rows that repeat are documents of their own, so that all that is long in them goes. Ids that are null or
    stand for different texts are numbered anew first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = rows.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if not named.isEmpty():
        rows = materialise(rows.select(F.monotonically_increasing_id().alias("_id"), "doc_id", "text"), "rows")
        out = without_repeats(rows.select(F.col("_id").alias("doc_id"), "text"), length, seed, batches, many).withColumnRenamed("doc_id", "_id")
        return out.join(rows.select("_id", "doc_id"), "_id").select("doc_id", "n_bytes", "spans", "kept")

    family = SuffixFamily(rows.sparkSession, length, seed)
    family.add_batches(rows, batches)
    found = materialise(family.found(), "found")
    family.drop()
    whole = found.groupBy("fp", "context").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "place", "before", "after")])
    whole = materialise(whole, "contexts")
    several = whole.groupBy("fp").agg(F.count("*").alias("contexts")).where("contexts > 1")
    wanted = whole.join(several, "fp").withColumn("many", F.col("contexts") > many).drop("contexts")
    around = materialise(_surroundings(rows, wanted, length), "surroundings", compression="zstd")
    shared = materialise(_shared_strings(around, length), "shared")

    all_of = found.join(whole.where("n > 1").select("fp", "context"), ["fp", "context"]).select("doc_id", (F.col("place") - F.col("before")).alias("from"), (F.col("place") + F.col("after") + length).alias("to"))
    parts = shared.join(whole.where("n = 1").select("fp", "context", "doc_id", "place"), ["fp", "context"]).select("doc_id", (F.col("place") + F.col("from")).alias("from"), (F.col("place") + F.col("to") + length).alias("to"))
    return _removed(rows, all_of.unionByName(parts))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = without_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hex digits. Each byte is taken out of a run of 1,000, so that no long text is cut once for each byte.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), runs AS (
  SELECT doc_id, k, substring(h, 2000 * k + 1, 2398) AS part, length(h) // 2 AS n_bytes FROM (SELECT doc_id, h, unnest(range(length(h) // 2000 + 1)) AS k FROM d)
), places AS (
  SELECT doc_id, n_bytes, 1000 * k + i AS place, substring(part, 2 * i + 1, 2) AS byte, CASE WHEN 1000 * k + i + 200 <= n_bytes THEN hash(substring(part, 2 * i + 1, 400)) END AS h
  FROM (SELECT *, unnest(range(1000)) AS i FROM runs) WHERE 1000 * k + i < n_bytes
), twice AS (
  SELECT h FROM places WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT p.doc_id, place, byte, coalesce(place - max(CASE WHEN t.h IS NOT NULL THEN place END) OVER (PARTITION BY p.doc_id ORDER BY place) < 200, false) AS gone
  FROM places p LEFT JOIN twice t ON t.h = p.h
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY place), false) AS begins FROM covered
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(byte, '' ORDER BY place) FILTER (NOT gone), '') AS rest FROM edges GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
