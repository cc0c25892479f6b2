"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is mapped to the bit counts of its segments. The Manhattan distance of two such vectors is at
most the Hamming distance of the fingerprints, so a grid join within that distance loses no pair; the pairs found are
then verified exactly. Members of a crowded cell go on to a grid of twice as many segments, at last of one bit each, where a
cell can't hold more than a fingerprint and its 64 neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
BITS = 64
SEGMENTS = 16
#: Cells are one step wide, which meets this distance and no other.
MAX_BITS = 2
#: Members of a cell that are compared with each other; those of larger cells are spread over a finer grid. At least 65.
CROWD = 512


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of text: A-Z lower-cased, words split at ASCII white space, XXH64 with seed 42.

    A bit is 1 if set in over half of the shingles' hashes, repeats included. Fewer words than a shingle: the whole
    sequence is the one shingle. No words or null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp long): the fingerprint's 64 bits as a signed long. One row for each input row; texts are read whole."""
    common.arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            fps = [signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def popcounts(fps: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Bit counts of the segments of uint64 fingerprints, (n, segments)."""
    width = BITS // segments
    shifts = np.arange(segments, dtype=np.uint64) * np.uint64(width)
    return np.bitwise_count((fps[:, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.int64)


def _cells(segments: int):
    """The cells in which fingerprints meet: the own vector and those one step away.

    Vectors within Manhattan distance 2 always share such a cell: equal ones their own, those at distance 1 the own
    cell of either, those at distance 2 a cell one step from both.
    """
    width = BITS // segments
    weights = [pow(6364136223846793005, i + 1, 1 << 64) for i in range(segments)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights, dtype=np.uint64)
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            counts = popcounts(fps, segments)
            own = (counts.astype(np.uint64) * w).sum(axis=1, dtype=np.uint64)
            up, down = own[:, None] + w, own[:, None] - w
            keys = np.concatenate([own[:, None], up, down], axis=1)
            fits = np.concatenate([np.ones((len(fps), 1), bool), counts < width, counts > 0], axis=1)
            step = np.broadcast_to(np.arange(2 * segments + 1, dtype=np.int16), keys.shape)
            fp = np.broadcast_to(fps[:, None], keys.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[fits].view(np.int64)), pa.array(fp[fits].view(np.int64)), pa.array(step[fits])], ["cell", "fp", "step"]
            )

    return run


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that it reaches by the links u, v."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def _verify(crowd: int):
    """The links within each cell, as one from each member to the smallest of its class; a cell of over crowd members only
    names them. Rows come ordered by cell."""

    def links(fps: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.triu_indices(len(fps), 1)
        # both one step away by the same step: equal vectors, which meet in their own cell as well
        near = ((step[i] != step[j]) | (step[i] == 0)) & (np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS)
        root = _roots(len(fps), i[near], j[near])
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return fps[linked], fps[root[linked]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(a: list, b: list, crowded: list) -> pa.RecordBatch:
            u = np.concatenate([*a, *crowded, np.zeros(0, np.uint64)])
            v = np.concatenate([*b, *crowded, np.zeros(0, np.uint64)])
            n = sum(map(len, a))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), pa.array(np.arange(len(u)) >= n)], ["u", "v", "crowded"])

        cell, held, steps = None, np.zeros(0, np.uint64), np.zeros(0, np.int16)
        over = False
        for b in batches:
            cells = b.column(0).to_numpy(zero_copy_only=False)
            fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            step = b.column(2).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(np.diff(cells)) + 1
            a, z, crowded = [], [], []
            for s, e in zip(np.r_[0, at], np.r_[at, len(cells)], strict=True):
                if cells[s] != cell:
                    if len(held) > 1 and not over:
                        x, y = links(held, steps)
                        a.append(x)
                        z.append(y)
                    cell, held, steps, over = cells[s], fps[s:e], step[s:e], False
                else:
                    held, steps = np.r_[held, fps[s:e]], np.r_[steps, step[s:e]]
                if over or len(held) > crowd:
                    crowded.append(held)
                    held, steps, over = held[:0], steps[:0], True
            yield pack(a, z, crowded)
        if len(held) > 1 and not over:
            x, y = links(held, steps)
            yield pack([x], [y], [])

    return run


def fingerprint_links(distinct: DataFrame, segments: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp) that keep all components at no more than MAX_BITS differing bits.

    Both ends of a link share a cell. If the cell is crowded, both go to the grid of twice as many segments, where they
    share a cell again. Segments of one bit are the last: their cells hold 65 fingerprints at most.
    """
    if crowd <= BITS:
        raise ValueError("crowd must exceed the number of bits")
    n = max(common.shuffle_partitions(distinct.sparkSession), 1)
    now, out = distinct.select("fp"), None
    while True:
        cells = now.mapInArrow(_cells(segments), "cell long, fp long, step short")
        found = common.materialise(cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_verify(crowd), "u long, v long, crowded boolean"), "cells")
        links = found.where("not crowded").select("u", "v")
        out = links if out is None else out.unionByName(links)
        crowded = found.where("crowded")
        if segments == BITS or crowded.isEmpty():
            return out.distinct()
        now, segments = crowded.select(F.col("u").alias("fp")).distinct(), segments * 2


def gathered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(fp long, ids array): the ids of each fingerprint, gathered in each batch of rows: copies meet as few rows later on."""
    common.arrow_rows(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps = np.array([signed(fingerprint(t.as_py(), shingle)) for t in b.column(1)], np.int64)
                order = np.argsort(fps, kind="stable")
                first = np.flatnonzero(np.diff(fps[order], prepend=fps[order[0]] - 1))
                ids = pa.ListArray.from_arrays(pa.array([*first.tolist(), len(fps)], pa.int32()), b.column(0).take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([pa.array(fps[order][first]), ids], ["fp", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"fp long, ids array<{kind}>")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id): the class of near copies of each document.

    fingerprint is 16 hex digits; component_id is the smallest id reachable by links of at most two differing
    bits. Documents with one fingerprint are linked, so they are first gathered, by batch and then by a partial aggregate, and
    only distinct fingerprints are compared: copies, however many, cost one row. Null or empty text: fingerprint 0, linked
    like any other. Null ids are kept, with the component of the others of their fingerprint. Repeated rows are kept.
    Other columns of docs are ignored. Empty input gives no rows.
    """
    fps = common.materialise(gathered(docs, id_col, text_col, shingle), "fingerprints")
    reps = _classes(fps).select("fp", F.col("least").alias("component_id"))
    return fps.join(reps, "fp").select(F.explode("ids").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(fps: DataFrame) -> DataFrame:
    """(fp, component, least): for each distinct fingerprint its class, named by a fingerprint, and the smallest id in it."""
    heads = fps.groupBy("fp").agg(F.min(F.array_min("ids")).alias("head"))
    comps = common.connected_components(fingerprint_links(heads))
    # the smallest id of a component, over the fingerprints it holds
    named = heads.join(comps, heads["fp"] == comps["id"]).select("fp", "component", "head")
    least = named.groupBy("component").agg(F.min("head").alias("least"))
    linked = common.salted(named, least, "component", "fp").select("fp", "component", "least")
    return heads.join(linked, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("least", "head").alias("least"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id; a null id stays only if all are null.

    Where ids are null or repeated, of the rows that share the id the one with the smallest fingerprint stays, then the one with
    the smallest hash of its columns. Columns stay.
    """
    fps = common.materialise(gathered(docs, id_col, text_col), "fingerprints")
    classes = common.materialise(_classes(fps), "classes")
    ids = fps.select(F.explode("ids").alias("i"), "fp")
    plain = ids.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("i").isNull() | (F.col("n") > 1)).isEmpty()
    if plain:  # an id names one row
        gone = fps.join(classes, "fp").select(F.explode("ids").alias(id_col), "least").where(F.col(id_col) != F.col("least")).select(id_col)
        return docs.join(gone, id_col, "left_anti").select(docs.columns)
    fp, pick = common.fresh(docs, "_fp"), common.fresh(docs, "_pick")
    kind, at, names = docs.schema[id_col].dataType, docs.columns.index(text_col), [*docs.columns, fp]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([signed(fingerprint(t.as_py())) for t in b.column(at)], pa.int64())], names)

    wide = docs.mapInArrow(put, T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())]))
    told = ids.distinct().join(classes, "fp").select("i", "fp", "component", "least")
    stays = told.where(F.col("i").eqNullSafe(F.col("least"))).groupBy("component").agg(F.min("fp").alias("fp"), F.min("i").cast(kind).alias("i"))
    both = wide.join(stays.select(F.col("i"), F.col("fp").alias("f")), F.col(fp).eqNullSafe(F.col("f")) & wide[id_col].eqNullSafe(F.col("i")), "left_semi")
    hashed = F.xxhash64(*(F.to_json(c) if "map" in t or t == "variant" else F.col(c) for c, t in docs.dtypes))
    one = both.groupBy(id_col, fp).agg(F.min_by(F.struct(*docs.columns), hashed).alias(pick))
    return one.select(*(F.col(f"{pick}.`{c}`").alias(c) for c in docs.columns))
