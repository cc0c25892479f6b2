"""Near-duplicate embeddings by cross-polytope hashing.

A vector is turned by fast Hadamard rotations with random signs; its hash is the nearest of the 2d points +-e_i. Some
hashes side by side are the bucket of a table. A vector lies in its own bucket and, by multiprobe, in the next nearest
ones. Vectors that share a bucket are compared exactly, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash tables, hashes side by side in each, and further buckets probed in each, at least; see plan().
TABLES, HASHES, PROBES = 5, 2, 2
#: Vectors in an average bucket beyond which a label's tables get a hash more.
FULL = 64
SEED = 17
#: Bytes of the vectors of a bucket that are compared in one go; larger buckets are split into blocks, and all pairs of blocks
#: compared.
BLOCK_BYTES = 4 << 20


def plan(hashes: int) -> tuple[int, int]:
    """(tables, probes) for so many hashes side by side: each hash more is less often shared, more tables make up for it."""
    return TABLES + 3 * (hashes - HASHES), PROBES + 2 * (hashes - HASHES)


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and the fast Hadamard transform; x is (n, d) with d a power of two."""
    for s in signs:
        x = x * s
        n, d = x.shape
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
            h *= 2
        x = x / math.sqrt(d)
    return x


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets (n, tables, 1 + probes) of unit vectors: the own one first, then the next likely ones.

    Probes change one hash to its second best point; the changes that cost least come first, and those of two hashes
    at once after them. Only element-wise arithmetic decides, so a vector's buckets don't depend on its batch.
    """
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    x = np.zeros((n, size))
    x[:, :d] = unit
    out = np.empty((n, tables, 1 + probes), np.int64)
    rng = np.random.default_rng(seed)
    for t in range(tables):
        best, second, cost = [], [], []
        for _ in range(hashes):
            y = rotate(x, rng.choice([-1.0, 1.0], (3, size)))
            a = np.abs(y)
            i = a.argmax(axis=1)
            rows = np.arange(n)
            top = a[rows, i]
            a[rows, i] = -1
            j = a.argmax(axis=1)
            best.append(2 * i + (y[rows, i] < 0))
            second.append(2 * j + (y[rows, j] < 0))
            cost.append(top - a[rows, j])
        choice = np.array(list(np.ndindex(*[2] * hashes)))[1:]  # which hashes take their second best
        price = choice @ np.array(cost) + 1e-3 * choice.sum(axis=1)[:, None]
        order = np.argsort(price, axis=0, kind="stable")[:probes].T
        pick = np.concatenate([np.zeros((n, 1, hashes), np.int64), choice[order]], axis=1)
        code = np.zeros((n, 1 + len(order[0]) if n else 1 + min(probes, len(choice))), np.int64)
        for k in range(hashes):
            code = code * (2 * size) + np.where(pick[:, :, k] == 1, second[k][:, None], best[k][:, None])
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, :1]  # fewer probes than asked for: the own bucket once more
    return out


def _hash(tables: int, hashes: int, probes: int):
    """Vectors with their distinct buckets: table + tables * code, by table, the own one of a table first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                vecs = part.column("vec")
                x = np.asarray(vecs.flatten()).reshape(len(vecs), -1).astype(np.float64)
                code = buckets(x / np.sqrt((x * x).sum(axis=1))[:, None], tables, hashes, probes) * tables + np.arange(tables)[None, :, None]
                codes = pa.FixedSizeListArray.from_arrays(pa.array(code.ravel()), code[0].size).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, codes], [*part.schema.names, "codes"])

    return run


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of codes (m, tables, 1 + probes) the first bucket in which they meet: by table, then by number; -1 if none."""
    far = np.iinfo(np.int64).max
    out = np.full(len(a), -1, np.int64)
    for t in reversed(range(a.shape[1])):
        least = np.full(len(a), far)
        for k in range(a.shape[2]):
            least = np.minimum(least, np.where((b[:, t] == a[:, t, k : k + 1]).any(axis=1), a[:, t, k], far))
        out = np.where(least < far, least, out)
    return out


#: Groups up to this size are compared together, at one distance in their order after the other.
SMALL = 48


def _compare(tables: int, threshold: float, most: int | None):
    """Links within each bucket, or each pair of blocks: for each vector the weight it is linked to, and a link to its class.

    Rows come ordered by label, bucket, i, j and id, a group's rows together. A pair counts in the first bucket that its
    vectors share and nowhere else, so counts add up. Of the links, those are returned that keep the group's components:
    one for each vector. Groups of over `most` rows are passed over: they come again in blocks.
    """
    keys = ["label", "bucket", "i", "j"]

    def links(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_numpy() for c in ("bucket", "i", "j", "side", "id", "weight")}
        text = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        n = t.num_rows
        new = np.ones(n, bool)
        new[1:] = np.any([a[1:] != a[:-1] for a in (text, cols["bucket"], cols["i"], cols["j"])], axis=0)
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, n])
        group, ids, weight, bucket = np.cumsum(new) - 1, cols["id"], cols["weight"], cols["bucket"]
        x = np.asarray(t.column("vec").combine_chunks().flatten()).reshape(n, -1).astype(np.float64)
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
        code = np.asarray(t.column("codes").combine_chunks().flatten()).reshape(n, tables, -1)
        apart = cols["i"] != cols["j"]  # of two blocks only pairs across count
        count, label = np.zeros(n, np.int64), np.arange(n)

        def take(u: np.ndarray, v: np.ndarray) -> None:
            for e in range(0, len(u), 20_000):
                p, q = u[e : e + 20_000], v[e : e + 20_000]
                here = first_shared(code[p], code[q]) == bucket[p]
                p, q = p[here], q[here]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                while len(p):  # hook the larger root to the smaller until both ends agree
                    a, b = label[p], label[q]
                    differ = a != b
                    p, q, a, b = p[differ], q[differ], a[differ], b[differ]
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while (label != label[label]).any():
                        label[:] = label[label]

        few = min(SMALL, most or SMALL)
        small = (sizes <= few)[group]
        for d in range(1, min(few, int(sizes.max(initial=0)))):
            u = np.flatnonzero((group[:-d] == group[d:]) & small[:-d]) if d < n else np.zeros(0, np.int64)
            if not len(u):
                break
            u = u[~apart[u] | (cols["side"][u] != cols["side"][u + d])]
            u = u[np.einsum("ij,ij->i", x[u], x[u + d]) >= threshold]
            take(u, u + d)
        for s, size in zip(starts[sizes > few], sizes[sizes > few], strict=True):
            if most and size > most:
                continue
            rows = np.arange(s, s + size)
            left, right = (rows[cols["side"][rows] == cols[k][s]] for k in ("i", "j"))
            for e in range(0, len(left), 256):
                p, q = np.nonzero(x[left[e : e + 256]] @ x[right].T >= threshold)
                p, q = left[e : e + 256][p], right[q]
                if not apart[s]:
                    p, q = p[p < q], q[p < q]
                take(p, q)
        to = ids[label]
        keep = (count > 0) | (to != ids)
        return pa.table({"id": pa.array(ids[keep]), "links": pa.array(count[keep]), "to": pa.array(to[keep])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            last = [held.column(k)[-1] for k in keys]
            at = held.num_rows - 1
            columns = [held.column(k) for k in keys]
            while at > 0 and all(c[at - 1] == v for c, v in zip(columns, last, strict=True)):
                at -= 1
            if most and held.num_rows - at > 2 * most:
                held = pa.concat_tables([held.slice(0, at), held.slice(at, most + 1)])  # passed over: no more is needed of it
            if at:
                yield from links(held.slice(0, at).combine_chunks()).to_batches()
                held = held.slice(at)
        if held is not None and held.num_rows:
            yield from links(held.combine_chunks()).to_batches()

    return run


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, hashes: int | None = None, block: int | None = None) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors.

    Vectors of one non-null label are linked at a cosine of at least threshold, in double precision. n_links counts the
    other vectors linked directly, component_id is the smallest id reachable, kept says that it is the own one. Null or
    zero vectors, those with null or non-finite components and those without a label link with nothing. Equal vectors of a
    label are compared as one, and a bucket of any size is compared whole, in blocks: no cap drops a pair. The hashing may
    miss a pair near the threshold (recall is measured in the tests); no pair below it is linked. Vectors of different
    lengths don't link. A label's hashes grow with the logarithm of its vectors, so its buckets stay about the same size; hashes
    and block set them instead. A null id links like any other; component_id is null only where all of a class are. Repeated rows count as linked vectors of their own; other columns are ignored; an empty table
    gives no rows.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("string").alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & _usable("vec"), F.lit(False))
    valid = rows.where(usable).withColumn("label", F.concat_ws("/", F.size("vec").cast("string"), "label"))
    # a distinct vector of a label goes by a number, fixed where it is written: ids may repeat over vectors and labels
    heads = valid.groupBy("label", "vec").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("weight"))
    heads = common.materialise(heads.select("label", F.monotonically_increasing_id().alias("id"), "head", "weight", "vec"), "vectors")
    common.arrow_rows(vectors.sparkSession, 2000)
    per = heads.groupBy("label", F.size("vec").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    points = F.log(2 * F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2("size")), F.lit(1))))
    many = F.ceil(F.log(F.col("n") * (1 + PROBES) / FULL) / points).cast("int")
    per = per.withColumn("hashes", F.lit(hashes) if hashes else F.greatest(F.lit(HASHES), F.least(many, F.lit(8))))
    kinds = [tuple(r) for r in per.select("size", "hashes").distinct().collect()]
    out = None
    for size, k in sorted(kinds):  # vectors of one length and number of hashes at a time; there is one kind as a rule
        some = heads.where(F.size("vec") == size).drop("head")
        if sum(s == size for s, _ in kinds) > 1:
            some = some.join(per.where((F.col("size") == size) & (F.col("hashes") == k)).select("label"), "label", "left_semi").select(some.columns)
        found = _links(some, plan(k)[0], k, plan(k)[1], threshold, block or max(256, min(8192, BLOCK_BYTES // (8 * size))))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = common.materialise(out, "links")
    comps = common.connected_components(out.select(F.col("id").alias("u"), F.col("to").alias("v")))
    counts = out.groupBy("id").agg(F.sum("links").alias("links"))
    linked = heads.select("id", "head").join(comps, "id")
    linked = common.salted(linked, linked.groupBy("component").agg(F.min("head").alias("least")), "component", "id").select("id", "least")
    told = heads.join(counts, "id", "left").join(linked, "id", "left")
    told = told.select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "head").cast("long").alias("component_id"))
    keyed = rows.withColumn("_label", F.when(usable, F.concat_ws("/", F.size("vec").cast("string"), "label")))
    full = keyed.join(told, (keyed["_label"] == told["_label"]) & (keyed["vec"] == told["_vec"]), "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return full.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _usable(name: str):
    """All components are numbers, and their squares neither vanish nor overflow together."""
    norm = F.aggregate(name, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)
    return F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (norm > 0) & (norm < float("inf"))


def _links(heads: DataFrame, tables: int, hashes: int, probes: int, threshold: float, block: int) -> DataFrame:
    spark, n = heads.sparkSession, common.shuffle_partitions(heads.sparkSession)
    kind = heads.schema["vec"].dataType.simpleString()
    hashed = common.materialise(heads.mapInArrow(_hash(tables, hashes, probes), f"label string, id long, weight long, vec {kind}, codes array<long>"), "hashed")
    spread = hashed.withColumn("bucket", F.explode(F.array_distinct("codes")))
    columns, order = ["label", "bucket", "i", "j", "id", "weight", "side", "vec", "codes"], ["label", "bucket", "i", "j", "id"]
    one = spread.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}).select(columns)
    small = one.repartition(n, "label", "bucket").sortWithinPartitions(*order).mapInArrow(_compare(tables, threshold, block), "id long, links long, to long")
    # counts are partial aggregates, so a bucket of any size is a row per task
    hot = spread.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    hot = common.materialise(hot.select("label", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "hot")
    large = spread.join(hot, ["label", "bucket"]).withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each pair of blocks meets once: a row goes to the pairs of its own block, as the first or as the second of them
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).select(columns)
    large = large.repartition(n, "label", "bucket", "i", "j").sortWithinPartitions(*order).mapInArrow(_compare(tables, threshold, None), "id long, links long, to long")
    return small.unionByName(large)
