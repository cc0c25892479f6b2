"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each shard draws a number for each key; the key goes to the shard with the best one. A new shard only competes for
keys, so the keys that move are those that it wins, about its share of the weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: 2**53: hashes are cut to 53 bits, which doubles hold exactly.
SPAN = 9007199254740992.0
#: Rows of a shard that are ranked in one hash bucket, about.
BUCKET_ROWS = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of key among shards 0 to len(weights)-1, each winning keys in proportion to its weight.

    Shard s draws u in (0, 1) from a hash of (key, s) and bids -ln(u)/weight; the lowest bid wins, ties go to the lowest
    shard. A shard of weight 0 gets nothing. A null key is a key of its own. Neither other shards nor other rows
    enter into a bid.
    """
    bids = []
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("weights must not be negative")
        if weight:
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(SPAN)
            bids.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("bid"), F.lit(shard).alias("shard")))
    if not bids:
        raise ValueError("at least one shard needs a weight")
    return F.least(*bids)["shard"] if len(bids) > 1 else bids[0]["shard"]


def shard_documents(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", new_weight: float | None = None) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for each row of docs.

    size is the text's UTF-8 bytes plus 8 (null text: 8) and text_crc32 its CRC-32 (null: that of the empty text, 0). law
    is "key": id_col and the shards decide alone, so rows with one id share a shard, null ids too. slot numbers a
    shard's rows from 0 without gaps; it is ranked in hash buckets whose counts are summed up, never by gathering a
    shard in one task. grown_shard is the shard after one more of new_weight (the mean weight unless given) is added: it is
    either shard or the new one. Repeated rows are kept, each with a slot. Other columns of docs are ignored.
    """
    more = sum(weights) / len(weights) if new_weight is None else new_weight
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    out = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.col(id_col)
    out = out.withColumn("shard", rendezvous(key, weights)).withColumn("grown_shard", rendezvous(key, [*weights, more]))
    order = [id_col, "text_crc32", "size"]
    out = common.ranked(out, "shard", F.struct(*order), order, "slot", max(256, docs.count() // (BUCKET_ROWS * len(weights))))
    return out.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
