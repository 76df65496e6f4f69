"""Best-fit packing of token sequences with certified bounds.

Documents are encoded once and cut into pieces of at most ``capacity`` tokens. Full pieces are sequences of
their own. The rest is dealt to partitions of bounded size, and each packs its pieces best-fit decreasing.
Dual feasible functions bound the bins that a partition needs from below: a partition that reaches its bound
is done. From the others, full bins stay and the documents of bins with room are exchanged: they are dealt
anew, into fewer partitions, and packed again, until bounds are reached or an exchange saves nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdantflow.llm.shared import slices, written
from verdantflow.llm.tokens import encoder

GROUP = 20_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", sequence_id long, offset long, kept boolean, bins long, bound long, seat int"


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; ``count[s]`` items have size ``s``.

    The best of the volume bound, the two-parameter bound over all thresholds (large items stand alone,
    medium ones fill what is left), and rounding functions u_k for k up to 40; all are dual feasible.
    """
    size = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(count), np.cumsum(count * size)
    best = -(-int(volume[-1]) // capacity)
    half = capacity // 2
    t = np.arange(1, half + 1)
    alone = number[-1] - number[capacity - t]  # larger than capacity - t
    large, large_volume = number[capacity - t] - number[half], volume[capacity - t] - volume[half]
    small_volume = volume[half] - volume[t - 1]
    more = -(-np.maximum(0, small_volume - (capacity * large - large_volume)) // capacity)
    best = max(best, int((alone + large + more).max(initial=0)))
    for k in range(1, 41):
        # in units of 1 / (k (k + 1) capacity), so that all is exact in integers
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * scaled, scaled // capacity * capacity * (k + 1))
        unit = k * (k + 1) * capacity
        best = max(best, -(-int((count * value).sum()) // unit))
    return best


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the room left in each bin; the fullest bin that fits takes an item."""
    bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    room: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a bin with room r is open
    for i in np.argsort(-length, kind="stable").tolist():
        size = int(length[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask ^= 1 << left
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[i], offset[i] = b, capacity - left
        left -= size
        room[b] = left
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins, offset, room


def _pieces(batches, tokenizer: str, kind: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(tokenizer, kind)
    last = end.to_bytes(4, "little")
    for batch in slices(batches, "text", 1 << 20, hold=True):
        rows = []
        ids, at = encode.ids(batch.column("text"))
        data = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
        for doc, begin, stop in zip(batch.column("id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            n = stop - begin + 1
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                crc = zlib.crc32(data[4 * (begin + a) : 4 * min(begin + b, stop)])
                rows.append((doc, k, a, b - a, zlib.crc32(last, crc) if b == n else crc))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def _pack(batches, capacity: int, turn: int, alone: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seat; each seat is packed on its own and holds about GROUP pieces."""

    def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        length, seat = table.column("length").to_numpy(), table.column("seat")[0].as_py()
        bins, offset, room = best_fit_decreasing(length, capacity)
        bound = lower_bound(np.bincount(length, minlength=capacity + 1), capacity)
        room = np.array(room)
        if len(room) > bound or len(room) > -(-int(length.sum()) // capacity) and not alone:
            kept = room[bins] == 0
        else:
            kept = (bins != room.argmax()) | alone
        own = (turn << 56) + (seat << 24)
        more = [pa.array(own + bins), pa.array(offset), pa.array(kept), pa.array(np.full(len(length), len(room))), pa.array(np.full(len(length), bound))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "kept", "bins", "bound", "seat"]
        yield from pa.Table.from_arrays([*(table.column(c) for c in names[:5]), *more, table.column("seat")], names=names).to_batches()

    seat, rows = None, []
    for batch in batches:
        seats = batch.column("seat").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(seats)) + 1).tolist(), len(seats)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if rows and seats[a] != seat:
                yield from out(rows)
                rows = []
            seat = seats[a]
            rows.append(batch.slice(a, b - a))
    if rows:
        yield from out(rows)


def best_fit_packing(docs: DataFrame, tokenizer: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, group: int = GROUP, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``. Only a document longer than ``capacity`` is cut: its first piece
    takes the remainder, all others are full. Null and empty texts are one piece of one token. Repeated rows
    are packed as often as they occur; a null id stays null. Ties in length keep the order of the rows.
    ``kind`` names the pieces at which the tokenizer's pre-tokenizer cuts (see ``tokens``).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(rows.mapInArrow(lambda b: _pieces(b, tokenizer, kind, end_id, capacity), _PIECE), "pieces")
    # the table is written, so these numbers are the same in every attempt
    numbered = pieces.withColumn("number", F.monotonically_increasing_id())
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    done = numbered.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("number"), "offset": F.lit(0).cast("long")}).select(columns)
    left = numbered.filter(F.col("length") < capacity)
    count, best, fewest = left.count(), None, None
    for turn in range(1, rounds + 1):
        if not count:
            break
        seats = -(-count // group)
        dealt = left.withColumn("seat", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(seats)).cast("int")).drop("number")
        dealt = dealt.repartition("seat").sortWithinPartitions("seat", "doc_id", "piece", "ids_crc32", "length")
        packed = written(dealt.mapInArrow(lambda b, turn=turn, alone=seats == 1: _pack(b, capacity, turn, alone), _PACKED), "packed")
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if best is not None and bins >= fewest:  # nothing saved: what these documents had stands
            if seats == 1:
                break
            continue
        done = done.unionByName(packed.filter("kept").select(columns))
        best = packed.filter("not kept")
        count, fewest = best.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        left = best.select(*_names(_PIECE)).withColumn("number", F.monotonically_increasing_id())
    return done if best is None else done.unionByName(best.select(columns))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]
