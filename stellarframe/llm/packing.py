"""Best-fit packing by minimum bin slack.

Pieces of one length are alike, so bins are planned on the histogram of lengths, which has no more entries than a bin
has tokens, however large the corpus. A bin takes the longest piece left and the fullest combination beside it, found
by subset-sum dynamic programming on bit sets. A combination is used as often as its lengths last: while they do, it
stays the fullest. Then each piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

END = b"\0\0\0\0"
#: Rows of one length that are ranked in one hash bucket.
BUCKET_ROWS = 500


def cut(length: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: whole if it fits, else full pieces after a first that may be shorter."""
    first = length % room or min(length, room)
    return [(0, first), *((s, room) for s in range(first, length, room))]


def _pieces(path: str, room: int, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for b in common.slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            ids = b.column(0).to_pylist()
            for i, t in zip(ids, b.column(1).to_pylist(), strict=True):
                raw = encode(t or "") + END
                for k, (start, n) in enumerate(cut(len(raw) // 4, room)):
                    for col, x in zip(rows, (i, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])), strict=True):
                        col.append(x)
            kinds = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [id_name, "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The fullest combination of at most room among lengths, each used at most counts[length] times, as {length: uses}.

    Bit s of a set is on if some combination has length s. Longer lengths come first, and the search ends at a full bin.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, k = min(counts[n], room // n), 1
        while left:
            take = min(k, left)
            more = (reach | reach << (n * take)) & mask
            if more != reach:
                steps.append((n, take, reach))
                reach = more
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + take
            at -= n * take
    return used


def plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: pieces in each}) in turn, until every piece of the histogram {length: pieces} is placed."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = fullest(rest, room - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        out.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return out


def _places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first bin, pieces in each bin, offset of the first), in order of rank."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    first = 0
    for times, used in bins:
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.setdefault(n, []).append((rank.get(n, 0), first, k, offset))
            rank[n] = rank.get(n, 0) + times * k
            offset += n * k
        first += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(zero_copy_only=False), b.column("_rank_in_length").to_numpy(zero_copy_only=False)
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                rows, at = places[int(n)], np.flatnonzero(length == n)
                r = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - r[:, 0]
                bins[at], offset[at] = r[:, 1] + k // r[:, 2], r[:, 3] + k % r[:, 2] * n
            keep = b.drop_columns(["_rank_in_length"]) if hasattr(b, "drop_columns") else pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(bins), pa.array(offset)], [*keep.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", room: int = 2048, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each document.

    A document is the ids of its whole text (null: empty) and then id 0, so every document has at least one piece. Only
    documents of over room tokens are cut: into pieces of room tokens, of which the first may be shorter. sequence_id
    and offset say where the piece lies; a sequence has no gaps from 0 on. Repeated rows and null ids are packed like any
    other, extra columns are ignored, an empty table gives no rows. Only the histogram of lengths (at most room entries)
    comes to the driver.
    """
    common.arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    cut_up = common.materialise(docs.select(id_col, text_col).mapInArrow(_pieces(tokens.vocabulary_path(vocabulary), room, id_col), schema), "pieces")
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(plan(histogram, room))
    buckets = F.get(F.array(*(F.lit(1 + histogram.get(n, 0) // BUCKET_ROWS) for n in range(room + 1))), F.col("length").cast("int"))
    order = [id_col, "piece", "ids_crc32"]
    ranks = common.ranked(cut_up, "length", F.struct(*order), order, "_rank_in_length", buckets)
    ranks = ranks.select(id_col, "piece", "start", "length", "ids_crc32", "_rank_in_length")
    return ranks.mapInArrow(_place(places), f"{schema}, sequence_id long, offset long")
