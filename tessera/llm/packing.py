"""Best-fit packing by linear grouping.

Documents become token pieces of at most `most` tokens. How many pieces have each length is all
that the plan needs, at most `most` numbers, whatever the input. Large lengths, in order, are cut
into groups of equal cardinality and rounded up to the largest of their group. How often each
configuration of these few sizes is used is optimised by column generation: the linear program over all
configurations, each new one found by dynamic programming on the prices of the sizes. Whole
uses are kept, the actual lengths take the places of their group, and what is left over goes with the small
lengths, longest first, where it fits best. This is done for several numbers of groups, none among
them (best fit alone), and the plan with the fewest sequences holds.

The plan says for each length which sequence and place its first, second, ... piece gets, in runs.
Pieces are ranked within their length, in two steps so that no length is sorted by one task,
and look their run up.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import materialise
from tessera.llm.tokens import array_parts, ended, word_encoder

MOST = 4096
END = 1
#: Numbers of groups that are tried; 0 groups is best fit for all lengths.
GROUPS = (192, 96, 32, 0)
#: Lengths up to 1/SMALL of a sequence are small.
SMALL = 4
#: Pieces of one length that are ranked by one sort.
RANKED_AT_ONCE = 20_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def token_pieces(docs: DataFrame, vocabulary: str, most: int = MOST, end: int = END, special_as_text: bool = False, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, with_ids, ids (little-endian unsigned 32-bit): each document's ids
    and the end id, cut every `most` tokens. docs: doc_id and text; other columns are ignored.

    A null text is empty and gives the end id alone. Rows that repeat are each cut. Very long texts are encoded
    whole and leave a task in runs of pieces. An empty table gives an empty result. special_as_text: see tokens.WordEncoder."""
    names = PIECES.names if with_ids else PIECES.names[:-1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary, special_as_text)
        for batch in batches:
            for at, texts in array_parts(batch.column(1)):
                ids, begin = ended(*encoder.encode(texts), end, np.uint32)
                size = np.diff(begin)
                pieces = -(-size // most)
                row = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(most, size[row] - piece * most)
                raw, first = memoryview(ids.astype("<u4").tobytes()), 4 * (begin[row] + piece * most)
                crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(first.tolist(), (4 * length).tolist())]
                for k in range(0, len(row), 4096):
                    cut = slice(k, k + 4096)
                    columns = [batch.column(0).take(pa.array(at + row[cut])), *[pa.array(x, t) for x, t in zip((piece[cut], piece[cut] * most, length[cut], crc[cut]), PIECES.types[1:5])]]
                    if with_ids:
                        columns.append(pa.array([raw[a : a + n] for a, n in zip(first[cut].tolist(), (4 * length[cut]).tolist())], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def _dearest(sizes: np.ndarray, prices: np.ndarray, most: int, items: int) -> tuple[float, Counter]:
    """The configuration of at most `items` sizes of the highest total price, and that price."""
    value, choice = np.zeros(most + 1), []
    for _ in range(items):
        with_one = np.full((len(sizes), most + 1), -1.0)
        for g, (size, price) in enumerate(zip(sizes, prices)):
            with_one[g, size:] = value[: most + 1 - size] + price
        best = with_one.argmax(axis=0)
        gain = with_one[best, np.arange(most + 1)]
        choice.append(np.where(gain > value, best, -1))
        value = np.maximum(value, gain)
    at, used = most, Counter()
    for step in reversed(choice):
        if step[at] >= 0:
            used[int(step[at])] += 1
            at -= sizes[step[at]]
    return float(value[most]), used


def configurations(sizes: list[int], counts: list[int], most: int, items: int, rounds: int = 2000) -> list[tuple[int, Counter]]:
    """(times, configuration by position in sizes): whole uses, no size more often than its count. The linear program
    min sum(x), A x = counts over all configurations of at most `items` sizes, by column generation from
    those of one size each; its solution rounded down."""
    size, want = np.array(sizes), np.array(counts, float)
    used = [Counter({g: min(items, most // s)}) for g, s in enumerate(sizes)]
    basis = np.diag([float(c[g]) for g, c in enumerate(used)])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, new = _dearest(size, inverse.sum(axis=0), most, items)
        if value <= 1 + 1e-9:
            break
        column = np.zeros(len(sizes))
        for g, k in new.items():
            column[g] = k
        x, step = np.maximum(inverse @ want, 0), inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out], used[out] = column, new
    left, made = list(counts), []
    for x, c in sorted(zip(np.linalg.inv(basis) @ want, used), key=lambda p: -p[0]):
        times = max(0, min(int(x + 1e-6), *[left[g] // k for g, k in c.items()]))
        if times:
            made.append((times, c))
            for g, k in c.items():
                left[g] -= k * times
    return made


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first n of runs of [length, count], taken out."""
    out = []
    while n:
        t = min(n, runs[0][1])
        out.append((runs[0][0], t))
        runs[0][1] -= t
        n -= t
        if not runs[0][1]:
            runs.pop(0)
    return out


def plan(counts: dict[int, int], most: int = MOST, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> list[tuple[int, Counter]]:
    """(n, lengths): n sequences that hold these lengths each, the fewest of what the numbers of groups give.
    counts: how many pieces have a length."""
    return min((_planned(counts, most, n, small) for n in groups), key=lambda p: sum(n for n, _ in p))


def _planned(counts: dict[int, int], most: int, groups: int, small: int) -> list[tuple[int, Counter]]:
    out = [(counts[most], Counter({most: 1}))] if counts.get(most) else []
    left = Counter({size: n for size, n in counts.items() if size < most})
    large = sorted(((size, n) for size, n in left.items() if size > most // small), reverse=True) if groups else []
    if large:
        if len(large) <= groups:
            grouped = [[list(x)] for x in large]
        else:
            each, runs, grouped = -(-sum(n for _, n in large) // groups), [list(x) for x in large], []
            while runs:
                grouped.append([list(x) for x in _take(runs, min(each, sum(n for _, n in runs)))])
        for times, used in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], most, small - 1):
            columns = [_take(grouped[g], times) for g, k in used.items() for _ in range(k)]
            # The lengths that stand in one sequence change where those of any column change.
            ends = sorted({e for c in columns for e in _ends(c)})
            for begin, end in zip([0, *ends], ends):
                out.append((end - begin, Counter(_at(c, begin) for c in columns)))
        for n, lengths in out:
            for x, k in lengths.items():
                left[x] -= n * k

    by_room: dict[int, list[tuple[int, Counter]]] = {}
    for n, lengths in out:
        by_room.setdefault(most - sum(x * k for x, k in lengths.items()), []).append((n, lengths))
    rooms = sorted(by_room)
    for size in sorted((s for s, n in left.items() if n > 0), reverse=True):
        n = left[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            room = rooms[at] if at < len(rooms) else most
            fits = room // size
            if at < len(rooms):
                have, lengths = by_room[room].pop()
            else:
                have, lengths = -(-n // fits), Counter()
            # Best fit stays in a sequence that it has begun: as many as fit in each, and the rest in one.
            full, rest = (have, 0) if have * fits <= n else divmod(n, fits)
            n -= full * fits + rest
            for times, k in ((full, fits), (1 if rest else 0, rest), (have - full - (1 if rest else 0), 0)):
                if times:
                    left_room = room - k * size
                    if left_room not in by_room:
                        by_room[left_room] = []
                    if left_room not in rooms:
                        bisect.insort(rooms, left_room)
                    by_room[left_room].append((times, lengths + Counter({size: k})))
            if room in by_room and not by_room[room]:
                del by_room[room]
                rooms.remove(room)
    return [x for room in sorted(by_room) for x in by_room[room]]


def _ends(column: list[tuple[int, int]]) -> list[int]:
    out, at = [], 0
    for _, n in column:
        at += n
        out.append(at)
    return out


def _at(column: list[tuple[int, int]], k: int) -> int:
    for length, n in column:
        if k < n:
            return length
        k -= n
    raise IndexError(k)


def places(planned: list[tuple[int, Counter]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, times, sequence, offset): the pieces of that length ranked from `from`
    to before `to` stand `times` in each of the sequences from `sequence` on, from `offset` on."""
    out, ranked, sequence = [], Counter(), 0
    for n, lengths in planned:
        offset = 0
        for length, k in sorted(lengths.items(), reverse=True):
            out.append((length, ranked[length], ranked[length] + n * k, k, sequence, offset))
            ranked[length] += n * k
            offset += length * k
        sequence += n
    return out


def pack(pieces: DataFrame, most: int = MOST, groups: tuple[int, ...] = GROUPS, small: int = SMALL) -> DataFrame:
    """pieces (doc_id, piece, length and any other columns) with sequence_id and offset, which replace columns of these
    names.

    Each piece is in one sequence; sequences hold at most `most` tokens, without gaps from 0.
    Rows that repeat are each packed. An empty table gives an empty result. A length above `most`
    or below 1 is an error. The table of places has a few rows for each length, so that it is
    bounded by `most` and may be broadcast."""
    spark, pieces = pieces.sparkSession, materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 1 <= x <= most for x in counts):
        raise ValueError(f"lengths must be between 1 and {most}")
    rows = places(plan(counts, most, groups, small))
    where = spark.createDataFrame(rows, "_size long, _from long, _to long, _times long, _sequence long, _offset long")

    # Rows that doc_id and piece do not tell apart are told by all they hold, so that a task that is run again ranks them alike.
    parts = -(-max(counts.values(), default=1) // RANKED_AT_ONCE)
    of = pieces.select(F.struct("*").alias("_row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).alias("_part"), F.struct("doc_id", "piece", F.xxhash64(*pieces.columns)).alias("_order"))
    base = of.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    base = base.withColumn("_base", F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    of = of.withColumn("_nth", F.row_number().over(W.partitionBy("length", "_part").orderBy("_order"))).join(base, ["length", "_part"])
    of = of.withColumn("_rank", F.col("_base") + F.col("_nth") - 1)
    of = of.join(F.broadcast(where), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    at = F.col("_rank") - F.col("_from")
    sequence, offset = F.col("_sequence") + F.floor(at / F.col("_times")), F.col("_offset") + F.pmod(at, F.col("_times")) * F.col("length")
    return of.select(*[f"_row.{c}" for c in pieces.columns if c not in ("sequence_id", "offset")], sequence.alias("sequence_id"), offset.alias("offset"))
