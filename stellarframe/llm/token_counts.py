"""Token counts by distinct pre-token.

Documents are gathered in blocks. A block turns its texts into per-document pre-token frequencies over its own sorted
list of pre-tokens. The lists of a hash bucket pass through one task one after the other; there each distinct pre-token is counted
once, whatever the number of blocks that hold it, and only the counts go back. A document's tokens are the sum of frequency times count: ids are
never laid out for a document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

#: Characters of text in a block: what a task holds as frequencies at once (a longer document is a block of its own).
BLOCK_CHARS = 8_000_000
#: Distinct pre-tokens of a bucket whose counts are held at once; where it has more, some are counted again.
WORDS = 2_000_000


def _pack(parts: list[bytes], level: int = 3) -> bytes:
    """Byte strings, compressed: lengths and contents."""
    head = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)) + 4 * (n + 1)
    starts = np.r_[4 * (n + 1), ends[:-1]]
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _planes(numbers: np.ndarray) -> bytes:
    """Small numbers below 2**32, compressed byte by byte place."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _bucket(pre: bytes, n: int) -> int:
    return xxhash.xxh64_intdigest(pre, 11) % n


_FREQ = "block long, bucket int, words binary, ids binary, n_bytes binary, sizes binary, at binary, freq binary"


def _frequencies(path: str, buckets: int, id_type: pa.DataType, room: int):
    """Rows of a block: for each bucket the sorted pre-tokens (words), and one with the documents' frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, n_block = tokens.PreTokens(path), TaskContext.get().partitionId(), 0
        ids: list = []
        n_bytes: list[int] = []
        sizes: list[int] = []
        at: list[np.ndarray] = []
        freq: list[np.ndarray] = []
        known: dict[str, int] = {}
        chars = 0

        def block() -> pa.RecordBatch:
            by: list[list[bytes]] = [[] for _ in range(buckets)]
            raw = [p.encode("utf-8", "surrogatepass") for p in known]
            home = np.fromiter((_bucket(p, buckets) for p in raw), np.int64, len(raw))
            for p, b in zip(raw, home.tolist(), strict=True):
                by[b].append(p)
            # local numbers in the order of bucket and pre-token, which the counts come back in
            order = sorted(range(len(raw)), key=lambda k: (home[k], raw[k]))
            number = np.empty(len(raw), np.uint32)
            number[np.array(order, dtype=np.int64)] = np.arange(len(raw), dtype=np.uint32)
            cat = lambda a: np.concatenate([*a, np.zeros(0, np.int64)])
            doc, local, often = np.repeat(np.arange(len(sizes)), sizes), number[cat(at)].astype(np.int64), cat(freq)
            by_doc = np.lexsort((local, doc))  # ascending within a document, so that only steps are stored
            steps = np.diff(local[by_doc], prepend=0)
            first = np.cumsum([0, *sizes[:-1]])[np.array(sizes) > 0]
            steps[first] = local[by_doc][first]
            full = [b for b in range(buckets) if by[b]]
            rows = len(full) + 1
            none = [None] * len(full)
            key = np.full(rows, part * 1_000_000 + n_block, np.int64)
            own = pa.RecordBatch.from_arrays([pa.array(ids, id_type)], ["id"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as w:
                w.write_batch(own)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(key),
                    pa.array([*full, -1], pa.int32()),
                    pa.array([*(_pack(sorted(by[b])) for b in full), None], pa.binary()),
                    pa.array([*none, sink.getvalue().to_pybytes()], pa.binary()),
                    pa.array([*none, np.array(n_bytes, "<i8").tobytes()], pa.binary()),
                    pa.array([*none, np.array(sizes, "<u4").tobytes()], pa.binary()),
                    pa.array([*none, _planes(steps)], pa.binary()),
                    pa.array([*none, _planes(often[by_doc])], pa.binary()),
                ],
                ["block", "bucket", "words", "ids", "n_bytes", "sizes", "at", "freq"],
            )

        for b in common.slices(batches):
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = t or ""
                found = Counter(split(text))
                ids.append(i)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                sizes.append(len(found))
                at.append(np.fromiter((known.setdefault(p, len(known)) for p in found), np.int64, len(found)))
                freq.append(np.fromiter(found.values(), np.int64, len(found)))
                chars += len(text) + 16
                if chars >= room:
                    yield block()
                    n_block += 1
                    chars = 0
                    for x in (ids, n_bytes, sizes, at, freq, known):
                        x.clear()
        if ids:
            yield block()

    return run


def _count_pieces(path: str):
    """Pieces of each distinct pre-token, to each block's list of them. Lists come ordered by bucket, one at a time; a
    bucket's pre-tokens keep their counts until the next bucket, so each is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, bucket, n = tokens.encoder(path).pieces, None, {}
        for b in common.slices(batches, 16):
            counts = []
            for at, words in zip(b.column("bucket").to_pylist(), b.column("words"), strict=True):
                if at != bucket:
                    bucket, n = at, {}
                ps = _unpack(words.as_py())
                for p in ps:
                    if p not in n:
                        n[p] = pieces(p.decode("utf-8", "surrogatepass"))
                counts.append(zlib.compress(np.fromiter((n[p] for p in ps), "<u4", len(ps)).tobytes(), 1))
                if len(n) > WORDS:
                    n.clear()
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(counts, pa.binary())], ["block", "bucket", "counts"])

    return run


def _sum(id_name: str, id_type: pa.DataType, limit: int):
    """Per document, the sum of frequency times count."""

    def run(block: pa.Table, counts: pa.Table) -> pa.Table:
        by = sorted(zip(counts.column("bucket").to_pylist(), counts.column("counts").to_pylist(), strict=True))
        pieces = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(zlib.decompress(c), "<u4") for _, c in by)]).astype(np.int64)
        out = []
        for row in block.to_pylist():
            ids = pa.ipc.open_stream(row["ids"]).read_all().column(0).combine_chunks()
            steps, freq = _numbers(row["at"]), _numbers(row["freq"])
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            ends = np.cumsum(sizes)
            # steps add up within a document: take off what the documents before it added up to
            run_up = np.r_[0, np.cumsum(steps)]
            at = run_up[1:] - np.repeat(run_up[np.r_[0, ends[:-1]].astype(np.int64)], sizes)
            total = np.r_[0, np.cumsum(pieces[at] * freq)]
            n = total[ends] - total[np.r_[0, ends[:-1]].astype(np.int64)]
            out.append(pa.table({id_name: ids, "n_bytes": pa.array(np.frombuffer(row["n_bytes"], "<i8")), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)}))
        schema = pa.schema([(id_name, id_type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = tokens.VOCABULARY, limit: int = 512, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row of docs: the tokens of its whole text.

    Equal to the library's encode without added special tokens; special strings inside a text are one token, as is the
    library's default. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids are kept, other columns
    ignored; an empty table gives no rows. A pre-token that very many documents hold is one entry of each block's list.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    common.arrow_rows(spark)
    path, buckets = tokens.vocabulary_path(vocabulary), common.shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)
    found = common.materialise(docs.select(id_col, text_col).mapInArrow(_frequencies(path, buckets, id_type, block_chars), _FREQ), "frequencies")
    lists = found.where("bucket >= 0").select("block", "bucket", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = lists.mapInArrow(_count_pieces(path), "block long, bucket int, counts binary")
    blocks = found.where("bucket < 0").drop("bucket", "words")
    schema = f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_sum(id_col, id_type, limit), schema)


def total(counts: DataFrame) -> DataFrame:
    """One row: documents, bytes and tokens of token_counts' result."""
    return counts.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
