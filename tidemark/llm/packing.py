"""Best-fit packing of token sequences, after Martello-Toth dominance reduction.

Packing needs only how many pieces have each length, and lengths are at most the capacity. So the
plan is made on the driver from a histogram of at most ``capacity`` counts, whatever the number of
documents, and says for each length which ranks of its pieces go to which sequences. Pieces are
then ranked within their length in parallel and each finds its place in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.token_ids import WORDS_KEPT, default_path, encoder, spans_of
from tidemark.llm.workspace import Workspace, files_for, short_batches, slices

CAPACITY = 1024
END_ID = 2


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns that pack ``counts[length]`` pieces: ([(length, how many), ...], times used).

    First the reduction: for a piece j, a set {j, ...} is fixed for good if it dominates every other
    set that j can be in, which holds if

    - nothing fits beside j: {j};
    - one piece k fills the rest exactly: {j, k};
    - k is the largest that fits beside j and no two pieces fit there together: {j, k};
    - two pieces can, but not three, and no two together exceed k: {j, k}.

    Every length is tried, from the largest down; fixing a set repeats while its pieces last, and
    passes are repeated until one fixes nothing. The remainder is packed by best fit in decreasing
    order. Both handle all equal pieces at once.
    """
    left = {n: c for n, c in counts.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"piece lengths must lie in 1..{capacity}")
    return _reduced(left, capacity) + _best_fit(left, capacity)


def _reduced(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """The sets that dominance fixes; their pieces are taken out of ``left``."""
    lengths = sorted(left)
    made: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(n: int, c: int) -> None:
        left[n] -= c
        if not left[n]:
            del left[n]
            lengths.pop(bisect_left(lengths, n))

    before = -1
    while before != len(made):
        before = len(made)
        for j in lengths[::-1]:
            while j in left and (k := _dominating(j, left, lengths, capacity)) is not None:
                if k == 0:
                    times = left[j]
                    made.append((((j, 1),), times))
                elif k == j:
                    times = left[j] // 2
                    made.append((((j, 2),), times))
                    take(j, times)
                else:
                    # while it is repeated only counts of j and k change, so the same set stays dominating
                    times = min(left[j], left[k])
                    made.append((((j, 1), (k, 1)), times))
                    take(k, times)
                take(j, times)
    return made


def _dominating(j: int, left: dict[int, int], lengths: list[int], capacity: int) -> int | None:
    """k if {j, k} dominates, 0 if {j} does, None if no set found does."""
    room = capacity - j
    if left[j] > 1:
        others = lengths
    else:
        at = bisect_left(lengths, j)
        others = lengths[:at] + lengths[at + 1 :]
    if not others or others[0] > room:
        return 0
    k = others[bisect_right(others, room) - 1]
    if k == room:
        return k
    low = others[0]
    after = left[low] - (low == j)
    second = low if after > 1 else (others[1] if len(others) > 1 else capacity + 1)
    if low + second > room:
        return k
    third = low if after > 2 else second if second != low and left[second] - (second == j) > 1 else (others[2] if len(others) > 2 else capacity + 1)
    if after == 2 and second == low:
        third = others[1] if len(others) > 1 else capacity + 1
    if low + second + third > room and _best_pair(others, left, j, room) <= k:
        return k
    return None


def _best_pair(others: list[int], left: dict[int, int], j: int, room: int) -> int:
    """The largest sum up to ``room`` of two pieces beside j."""
    best, a, b = 0, 0, len(others) - 1
    while a <= b:
        total = others[a] + others[b]
        if total > room or (a == b and left[others[a]] - (others[a] == j) < 2):
            b -= 1
        else:
            best = max(best, total)
            a += 1
    return best


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit in decreasing order over groups of like-filled sequences."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(room: int, pattern: tuple, times: int) -> None:
        if not room:
            done.append((pattern, times))
            return
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((pattern, times))

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = min(capacity // n, count)
                times = count // each
                put(capacity - each * n, ((n, each),), times)
                count -= each * times
                continue
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // n, count)  # best fit keeps filling the sequence it chose
            used = min(times, count // each)
            put(room - each * n, (*pattern, (n, each)), used)
            if used < times:
                put(room, pattern, times - used)
            count -= each * used
    return done + [g for gs in groups.values() for g in gs]


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, words_kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of ids of 32 bits), part and nth and, if asked for,
    ids (little-endian, 16 bits each if the vocabulary fits, else 32). ``part`` is the task that cut the piece, ``nth`` how many of its length it had
    cut before; both are settled once the pieces are written as a table.

    Each document is its ids and ``end_id``; a longer one than ``capacity`` is cut into pieces of
    that length, of which the first takes what is over. A null text is empty: one piece of length
    1. Repeated rows are separate documents, null doc_ids are kept, other columns are ignored.
    """
    path = tokenizer_path or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, met = encoder(path, words_kept), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([end_id], enc.width).tobytes()
        for batch in slices(batches):
            every, doc_ids = [t or "" for t in batch.column(1).to_pylist()], batch.column(0).to_pylist()
            for span in spans_of(every):
                rows: list[tuple] = []
                for doc_id, x in zip(doc_ids[span], enc.encode(every[span])):
                    ids = np.frombuffer(x + end, enc.width)
                    first = len(ids) % capacity or capacity
                    at = 0
                    for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        cut_ids = ids[at:stop]
                        rows.append((doc_id, piece, at, stop - at, zlib.crc32(cut_ids.astype("<u4").tobytes()), part, met[stop - at], cut_ids.tobytes()))
                        met[stop - at] += 1
                        at = stop
                columns = list(zip(*rows))[: 8 if with_ids else 7]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"][: len(columns)])

    short_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def place(ws: Workspace, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (what ``pieces`` makes, as a written table) with sequence_id and offset in place of
    part and nth.

    A piece's rank within its length is its ``nth`` and the pieces of that length in earlier parts,
    so that no length, however frequent, has to meet in one task.
    """
    counts = ws.stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    table = _slots(plan(histogram, capacity))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = locate(table, length.to_numpy(), rank.to_numpy())
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    kept = [c for c in cut.columns if c not in ("part", "nth")]
    ranked = cut.join(bases.hint("merge"), ["part", "length"]).select(*kept, seat("length", F.col("nth") + F.col("base")).alias("seat"))
    return ranked.select(*kept, "seat.sequence_id", "seat.offset").coalesce(files_for(cut))


def _slots(patterns) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted by length and first rank."""
    rows, sequence, used = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for n, each in pattern:
            rows.append((n, used.get(n, 0), times, sequence, offset))
            used[n] = used.get(n, 0) + each * times
            offset += n * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def locate(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sequence_id and offset of pieces by length and rank within the length."""
    sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    for n in np.unique(length):
        mine = np.flatnonzero(length == n)
        rows = table[np.searchsorted(table[:, 0], n) : np.searchsorted(table[:, 0], n, side="right")]
        row = rows[np.searchsorted(rows[:, 1], rank[mine], side="right") - 1]
        over = rank[mine] - row[:, 1]
        sequence[mine] = row[:, 3] + over % row[:, 2]
        offset[mine] = row[:, 4] + over // row[:, 2] * n
    return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True, words_kept: int = WORDS_KEPT) -> DataFrame:
    """Pieces of ``docs`` with their places in as few sequences as found; see ``pieces``. A worker
    remembers the ids of ``words_kept`` words, which changes its memory and time only."""
    ws = Workspace(docs.sparkSession, "pack")
    cut = ws.stage(pieces(docs, tokenizer_path, capacity, end_id, with_ids, words_kept), "pieces")
    return place(ws, cut, capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_ids=False)
