"""Incremental, reversible removal of lines that many documents have.

Exact reference counts, the number of documents that hold a line's key, are tables in the shared folder: inserting documents adds
a table of what they add to the counts, deleting them adds one of negative numbers, and tables are added up into one from time to time. Backed
by the counts, cuckoo filters in shards hold the keys that reached the limit: a key goes in when its count reaches
the limit and out when it falls below, so that inserting documents and deleting them again leaves everything as it was.

Documents are filtered where they lie. A line whose key is not in the filters stays, without being looked up: only keys that
the filters report move, once for each task, to be confirmed by the counts. The few that are reported wrongly are spared.

The filters go to every task while all of them together stay within a bound. Beyond it they stay where they are: the lines' keys are
dealt out to the shards in parts of bounded size, and each shard's filter is read just before its lines.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, materialise, numbered, written
from tessera.llm.tokens import array_parts

#: A line's key goes when so many documents hold it.
LEAST = 10
#: Keys of one shard at most, on average: about two megabytes of fingerprints.
SHARD_KEYS = 1 << 18
#: Bytes of filters that every task may hold.
FILTER_BYTES = 64_000_000
#: Lines that are looked up in one part of a shard where the filters are not sent out.
PART_LINES = 4_000_000
#: Tables of counts that are added up into one when another comes.
TABLES = 8
FINGERPRINT_BITS = 32
SLOTS, KICKS = 4, 500
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLANKS = b" \t\n\x0b\x0c\r"
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "hi long, lo long, n long"
FILTERS = "shard int, buckets int, slots binary"


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line, by 16 bytes of its BLAKE2b digest; nothing for a line without one."""
    from hashlib import blake2b

    stripped = [k.strip(_BLANKS) for k in text.translate(_LOWER).split(b"\n")]
    return [blake2b(k, digest_size=16).digest() if k else b"" for k in stripped]


def _numbers(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    """Fingerprints of 128-bit keys in buckets of four, each in one of two buckets of which either follows from the other and the
    fingerprint. Keys must be distinct; what is deleted must have been inserted."""

    def __init__(self, buckets: int, slots: bytes | None = None, bits: int = FINGERPRINT_BITS):
        self.bits, self.mask = bits, np.uint64(buckets - 1)
        self.slots = np.zeros((buckets, SLOTS), np.uint32) if slots is None else np.frombuffer(slots, np.uint32).reshape(buckets, SLOTS).copy()
        self.turn = 0

    @staticmethod
    def buckets_for(keys: int) -> int:
        """A power of two that keys fill to four fifths at most."""
        return 1 << max(0, math.ceil(math.log2(max(1, keys) / (0.8 * SLOTS))))

    def _fingerprints(self, lo: np.ndarray) -> np.ndarray:
        return np.maximum(lo & np.uint64((1 << self.bits) - 1), np.uint64(1))

    def _other(self, bucket: np.ndarray, fingerprint: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket ^ (((fingerprint * _MIX) >> np.uint64(32)) & self.mask)

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        f, first = self._fingerprints(lo), hi & self.mask
        second = self._other(first, f)
        return ((self.slots[first] == f[:, None]) | (self.slots[second] == f[:, None])).any(axis=1)

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> bool:
        """Whether there was room for all; if not, the filter must be made anew."""
        f, first = self._fingerprints(lo), hi & self.mask
        for x, a, b in zip(f.tolist(), first.tolist(), self._other(first, f).tolist()):
            if not self._put(x, a, b):
                return False
        return True

    def _put(self, fingerprint: int, first: int, second: int) -> bool:
        for bucket in (first, second):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = fingerprint
                return True
        bucket = second
        for _ in range(KICKS):
            self.turn = (self.turn + 1) % SLOTS
            out = int(self.slots[bucket, self.turn])
            self.slots[bucket, self.turn] = fingerprint
            fingerprint, bucket = out, int(self._other(np.uint64(bucket), np.uint64(out)))
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = fingerprint
                return True
        return False

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        f, first = self._fingerprints(lo), hi & self.mask
        for x, a, b in zip(f.tolist(), first.tolist(), self._other(first, f).tolist()):
            bucket = a if (self.slots[a] == x).any() else b
            self.slots[bucket, np.flatnonzero(self.slots[bucket] == x)[0]] = 0


def _shard_of(hi: np.ndarray, bits: int) -> np.ndarray:
    return (hi >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(hi), np.int32)


def _reported(held: dict[int, CuckooFilter], bits: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    if not bits:
        return held[0].contains(hi, lo) if held else np.zeros(len(hi), bool)
    out, shards = np.zeros(len(hi), bool), _shard_of(hi, bits)
    for s in np.unique(shards):
        if s in held:
            here = np.flatnonzero(shards == s)
            out[here] = held[s].contains(hi[here], lo[here])
    return out


class LineIndex:
    """Counts and filters of the documents inserted so far. A document is a row; rows that repeat are documents of their own."""

    def __init__(self, spark: SparkSession, least: int = LEAST, fingerprint_bits: int = FINGERPRINT_BITS, shard_keys: int = SHARD_KEYS, filter_bytes: int = FILTER_BYTES, part_lines: int = PART_LINES):
        self.spark, self.least, self.fingerprint_bits, self.shard_keys, self.filter_bytes, self.part_lines = spark, least, fingerprint_bits, shard_keys, filter_bytes, part_lines
        self.tables: list[str] = []
        self.filters: str | None = None
        self.bits = 0  # shards, as a power of two
        self.frequent = 0

    # Counts

    def counts(self) -> DataFrame:
        """hi, lo, n: how many documents hold each key."""
        tables = [self.spark.read.schema(COUNTS).parquet(t) for t in self.tables]
        if len(tables) == 1:
            return tables[0]
        every = reduce(DataFrame.unionByName, tables, self.spark.createDataFrame([], COUNTS))
        return every.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where("n <> 0")

    def insert(self, docs: DataFrame) -> None:
        """Takes in the rows of docs (text)."""
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes out the rows of docs, given as they were inserted. ValueError, and no change, if a line would be held by less than no
        document."""
        self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> None:
        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts: Counter[bytes] = Counter()
                for _, texts in array_parts(batch.column(0)):
                    for text in texts.cast(pa.binary()).to_pylist():
                        counts.update({*line_keys(text or b"")})
                counts.pop(b"", None)
                if counts:
                    hi, lo = _numbers(list(counts))
                    yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(list(counts.values()), pa.int64())], names=["hi", "lo", "n"])

        added = docs.select("text").mapInArrow(held, COUNTS).groupBy("hi", "lo").agg((F.sum("n") * sign).alias("n"))
        table, path = written(added, "line-counts", "zstd")
        if self.tables:
            table = table.join(self.counts().withColumnRenamed("n", "before"), ["hi", "lo"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
        else:
            table = table.withColumn("before", F.lit(0).cast("long"))
        table = table.withColumn("after", F.col("before") + F.col("n"))
        if sign < 0 and not table.where("after < 0").isEmpty():
            delete(self.spark, path)
            raise ValueError("documents are deleted that were not inserted")
        crossed, crossings = written(table.where(F.expr(f"(before >= {self.least}) <> (after >= {self.least})")).select("hi", "lo", (F.col("after") >= self.least).alias("comes")), "crossings")
        self.tables.append(path)
        if len(self.tables) > TABLES:
            _, merged = written(self.counts(), "line-counts", "zstd")
            for old in self.tables:
                delete(self.spark, old)
            self.tables = [merged]
        self._refilter(crossed)
        delete(self.spark, crossings)

    # Filters

    def _shard(self) -> Column:
        return F.shiftrightunsigned("hi", 64 - self.bits).cast("int") if self.bits else F.lit(0)

    def _frequent_keys(self) -> DataFrame:
        return self.counts().where(F.col("n") >= self.least).select("hi", "lo")

    def _refilter(self, crossed: DataFrame) -> None:
        """Takes keys that reached the limit into the filters, and those that fell below out."""
        came, went = crossed.agg(F.count_if("comes"), F.count_if(~F.col("comes"))).first()
        if not came + went:
            return
        self.frequent += came - went
        bits, limit = self.fingerprint_bits, self.shard_keys
        if self.filters is None or self.frequent > limit << self.bits:
            self.bits = max(0, math.ceil(math.log2(max(1, self.frequent) / limit)))
            self._store(self._built(self._frequent_keys().withColumn("shard", self._shard())))
            return

        def update(key: tuple, old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if keys.empty:
                return old
            of = CuckooFilter(int(old["buckets"][0]), old["slots"][0], bits) if len(old) else CuckooFilter(CuckooFilter.buckets_for(len(keys)), None, bits)
            hi, lo, comes = keys["hi"].to_numpy().view(np.uint64), keys["lo"].to_numpy().view(np.uint64), keys["comes"].to_numpy()
            of.delete(hi[~comes], lo[~comes])
            room = of.insert(hi[comes], lo[comes])
            return pd.DataFrame({"shard": [key[0]], "buckets": [len(of.slots)], "slots": [of.slots.tobytes() if room else None]})

        old = self._stored()
        now, path = written(old.groupBy("shard").cogroup(crossed.withColumn("shard", self._shard()).groupBy("shard")).applyInPandas(update, FILTERS), "line-filters")
        full = now.where("slots is null").select("shard")
        if not full.isEmpty():
            # Their keys are all in the counts.
            again = self._built(self._frequent_keys().withColumn("shard", self._shard()).join(full, "shard", "left_semi"))
            self._store(now.where("slots is not null").unionByName(again))
            delete(self.spark, path)
        else:
            self._keep(path)

    def _built(self, keys: DataFrame) -> DataFrame:
        bits = self.fingerprint_bits

        def build(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            hi, lo = keys["hi"].to_numpy().view(np.uint64), keys["lo"].to_numpy().view(np.uint64)
            buckets = CuckooFilter.buckets_for(len(keys))
            while not (of := CuckooFilter(buckets, None, bits)).insert(hi, lo):
                buckets *= 2
            return pd.DataFrame({"shard": [key[0]], "buckets": [buckets], "slots": [of.slots.tobytes()]})

        return keys.groupBy("shard").applyInPandas(build, FILTERS)

    def _store(self, filters: DataFrame) -> None:
        self._keep(written(filters, "line-filters")[1])

    def _keep(self, path: str) -> None:
        if self.filters:
            delete(self.spark, self.filters)
        self.filters = path

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(FILTERS).parquet(self.filters) if self.filters else self.spark.createDataFrame([], FILTERS)

    # Documents

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept: a row for each row of docs (doc_id, text), inserted or not, without the lines
        whose keys reached the limit. A null text is one empty line; lines of white space have no key and stay. Very long texts are
        filtered whole. Other columns are ignored. An empty table gives an empty result."""
        rows, n = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        small = (self._stored().agg(F.coalesce(F.sum(F.octet_length("slots")), F.lit(0))).first()[0]) <= self.filter_bytes
        if small:
            sent = {r["shard"]: (r["buckets"], bytes(r["slots"])) for r in self._stored().toLocalIterator()}
            held = self.spark.sparkContext.broadcast((self.bits, self.fingerprint_bits, sent))
            wrong = self._wrong(_reported_keys(rows, held))
            listed = None if wrong.isEmpty() else _reported_lines(rows, n, held).join(wrong, ["hi", "lo"], "left_semi")
        else:
            held = None
            hits = materialise(self._looked_up(rows, n), "reported-lines")
            wrong = self._wrong(hits)
            listed = hits if wrong.isEmpty() else hits.join(wrong, ["hi", "lo"], "left_anti")
        if listed is None:
            rows = rows.withColumn("lines", F.lit(None).cast("array<int>"))
        else:
            rows = rows.join(listed.groupBy(n).agg(F.collect_list("line").alias("lines")), n, "left")
        return _without(rows, held)

    def _wrong(self, keys: DataFrame) -> DataFrame:
        """Those of the reported keys that are not frequent."""
        return materialise(keys.select("hi", "lo").distinct().join(self._frequent_keys(), ["hi", "lo"], "left_anti"), "wrong-keys")

    def _looked_up(self, rows: DataFrame, n: str) -> DataFrame:
        """n, line, hi, lo of lines that the filters report, where these are not sent out: a shard's lines come in parts, its filter in front of each."""
        bits, wide = self.fingerprint_bits, 1 << self.bits
        lines = materialise(_reported_lines(rows, n, None), "line-keys", compression="zstd")
        parts = max(1, math.ceil(lines.count() / wide / self.part_lines))
        lines = lines.withColumn("shard", self._shard()).withColumn("part", F.pmod(F.xxhash64(n), F.lit(parts)).cast("int"))
        filters = self._stored().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        both = filters.withColumns({n: F.lit(None).cast("long"), "line": F.lit(None).cast("int"), "hi": F.lit(None).cast("long"), "lo": F.lit(None).cast("long")})
        both = both.unionByName(lines.withColumns({"buckets": F.lit(None).cast("int"), "slots": F.lit(None).cast("binary")}))
        both = both.repartition(max(1, wide * parts), "shard", "part").sortWithinPartitions("shard", "part", F.col("buckets").isNull())

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                place = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist()))
                begins = [i for i in range(len(place)) if i == 0 or place[i] != place[i - 1]]
                for i, end in zip(begins, [*begins[1:], len(place)]):
                    if place[i] != at:
                        at, held = place[i], None
                    if batch.column("buckets")[i].is_valid:
                        held = CuckooFilter(batch.column("buckets")[i].as_py(), batch.column("slots")[i].as_py(), bits)
                        i += 1
                    here = batch.slice(i, end - i).select([n, "line", "hi", "lo"])
                    if held and here.num_rows:
                        hi, lo = (here.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
                        yield here.filter(pa.array(held.contains(hi, lo)))

        return both.mapInArrow(test, f"{n} long, line int, hi long, lo long")

    def drop(self) -> None:
        """Deletes the tables of the index."""
        for path in [*self.tables, *([self.filters] if self.filters else [])]:
            delete(self.spark, path)
        self.tables, self.filters, self.bits, self.frequent = [], None, 0, 0


def _filters(held) -> tuple[dict[int, CuckooFilter], int]:
    bits, fingerprint_bits, sent = held.value
    return {s: CuckooFilter(b, slots, fingerprint_bits) for s, (b, slots) in sent.items()}, bits


def _reported_keys(rows: DataFrame, held) -> DataFrame:
    """hi, lo: the keys of lines that the filters report, each once for a batch."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, bits = _filters(held)
        for batch in batches:
            keys: set[bytes] = set()
            for _, texts in array_parts(batch.column(0)):
                for text in texts.cast(pa.binary()).to_pylist():
                    keys.update(line_keys(text or b""))
            keys.discard(b"")
            hi, lo = _numbers(sorted(keys))
            at = _reported(filters, bits, hi, lo)
            yield pa.RecordBatch.from_arrays([pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64))], names=["hi", "lo"])

    return rows.select("text").mapInArrow(test, "hi long, lo long")


def _reported_lines(rows: DataFrame, n: str, held) -> DataFrame:
    """n, line, hi, lo: the lines, from 0, that have a key and that the filters report; all that have one without filters."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, bits = _filters(held) if held else (None, 0)
        for batch in batches:
            for start, texts in array_parts(batch.column(1)):
                of, line, keys = [], [], []
                for i, text in enumerate(texts.cast(pa.binary()).to_pylist()):
                    for k, key in enumerate(line_keys(text or b"")):
                        if key:
                            of.append(start + i)
                            line.append(k)
                            keys.append(key)
                hi, lo = _numbers(keys)
                at = np.flatnonzero(_reported(filters, bits, hi, lo)) if held else np.arange(len(keys))
                taken = batch.column(0).take(pa.array(np.array(of, np.int64)[at]))
                yield pa.RecordBatch.from_arrays([taken, pa.array(np.array(line, np.int32)[at]), pa.array(hi[at].view(np.int64)), pa.array(lo[at].view(np.int64))], names=[n, "line", "hi", "lo"])

    return rows.select(n, "text").mapInArrow(test, f"{n} long, line int, hi long, lo long")


def _without(rows: DataFrame, held) -> DataFrame:
    """rows (doc_id, text, lines) without the lines that the filters report and that are not in `lines`; without filters, without `lines`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, bits = _filters(held) if held else (None, 0)
        for batch in batches:
            for start, texts in array_parts(batch.column(1)):
                raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
                listed = batch.column(2).slice(start, len(texts)).to_pylist()
                if filters is not None:
                    keys = [line_keys(t) for t in raw]
                    hi, lo = _numbers([k or bytes(16) for of in keys for k in of])
                    seen = iter(_reported(filters, bits, hi, lo).tolist())
                    goes = [[next(seen) and k != b"" and not (spared and i in spared) for i, k in enumerate(of)] for of, spared in zip(keys, map(set, (x or () for x in listed)))]
                else:
                    goes = [[i in gone for i in range(t.count(b"\n") + 1)] for t, gone in zip(raw, map(set, (x or () for x in listed)))]
                kept = [b"\n".join(x for x, g in zip(t.split(b"\n"), of) if not g) if any(of) else t for t, of in zip(raw, goes)]
                columns = [batch.column(0).slice(start, len(texts)), pa.array([len(of) for of in goes], pa.int64()), pa.array([sum(of) for of in goes], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.select("doc_id", "text", "lines").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: all rows of docs inserted into a new index and filtered by it."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs)
    out = index.deduplicated(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
    index.drop()
    return out


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS n_row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT n_row, i, lines[i] AS line, regexp_replace(translate(lines[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
  FROM (SELECT n_row, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)
), f AS (
  SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT n_row) >= 10
), k AS (
  SELECT n_row, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS kept FROM l LEFT JOIN f ON f.key = l.key GROUP BY n_row
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN k ON k.n_row = d.n_row
"""
