"""Secret scanning over an incremental blob ledger, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger says which rule versions have seen a blob and what they
found; only unseen pairs of blob and rule version are scanned, each blob once whatever the number of paths that hold
it. Findings are then joined back to all paths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


class Rule(NamedTuple):
    """pattern: Java regular expression, matched leftmost and without overlaps; a match counts if group has least characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# A run of the character class is taken whole, so a least length of the run may stand in the pattern; not so in assign,
# where a match that is too short still uses up its characters.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

_SPAN = "struct<rule:string,start:long,end:long>"
_SPANS = f"array<{_SPAN}>"
#: A blob's row says which rule versions scanned it and what each found; a blob may have several rows.
LEDGER = f"blob binary, rules array<string>, spans {_SPANS}"
#: Matches that are added to one array: two levels of arrays keep the work in proportion to a text's matches.
CHUNK = 256


def _none() -> Column:
    return F.array().cast(_SPANS)


def spans_of(text: Column, rule: Rule) -> Column:
    """Spans of rule in text, in code points, end exclusive. What lies between two matches is what split() leaves there."""
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
        F.split(text, rule.pattern, -1).alias("gap"),
    )
    start = lambda acc, x: acc["at"] + F.length(x["gap"])
    span = lambda acc, x: F.struct(F.lit(rule.key).alias("rule"), start(acc, x).alias("start"), (start(acc, x) + F.length(x["all"])).alias("end"))
    step = lambda acc, x: F.struct(
        (start(acc, x) + F.coalesce(F.length(x["all"]), F.lit(0))).alias("at"),
        F.when(F.length(x["part"]) >= rule.least, F.array_append(acc["out"], span(acc, x))).otherwise(acc["out"]).alias("out"),
    )
    state = f"struct<at:long,out:{_SPANS}>"
    chunk = lambda at, part: F.aggregate(part, F.struct(at.alias("at"), _none().alias("out")).cast(state), lambda acc, x: step(acc, x).cast(state))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(found, k * CHUNK + 1, CHUNK))
    whole = f"struct<last:{state},done:array<{_SPANS}>>"
    zero = F.struct(F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out")).alias("last"), F.array().cast(f"array<{_SPANS}>").alias("done")).cast(whole)
    more = lambda acc, part: F.struct(chunk(acc["last"]["at"], part).alias("last"), F.array_append(acc["done"], acc["last"]["out"]).alias("done")).cast(whole)
    folded = F.aggregate(parts, zero, more, lambda acc: F.flatten(F.array_append(acc["done"], acc["last"]["out"])))
    return F.when(text.rlike(rule.pattern), folded).otherwise(_none())


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, blob): the content address of each row's text (null: the empty text)."""
    return docs.select(id_col, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", paths: DataFrame | None = None) -> DataFrame:
    """New rows of the ledger (LEDGER) for the blobs of docs: the rule versions that had not seen them and what they found.

    A blob is scanned at one of its paths, the one with the smallest id; texts go through one shuffle and are read whole.
    Blobs that all rules have seen are left out before that.
    """
    heads = (blobs(docs, id_col, text_col) if paths is None else paths).groupBy("blob").agg(F.min(id_col).alias("head"))
    if ledger is None:
        todo = heads.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = heads.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    todo = todo.withColumn("rules", F.array_except(wanted, "seen")).where(F.size("rules") > 0).select("blob", "head", "rules")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("blob_of", F.unhex(F.sha2("text", 256)))
    at = texts.join(todo.hint("shuffle_hash"), (texts["blob_of"] == todo["blob"]) & texts["id"].eqNullSafe(todo["head"]))
    found = [F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r)).otherwise(_none()) for r in rules]
    # a row that is there twice is scanned twice, and counted once
    return at.select("blob", "rules", F.concat(*found).alias("spans")).dropDuplicates(["blob"])


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id") -> DataFrame:
    """(id_col, spans): for every path the spans of its blob, by start, then kind in the order of rules. Findings of other
    versions of a rule stay in the ledger and don't count."""
    key = F.explode("spans").alias("s")
    place = F.create_map(*(F.lit(y) for i, r in enumerate(rules) for y in (r.key, i)))
    kind = F.create_map(*(F.lit(y) for r in rules for y in (r.key, r.kind)))
    have = ledger.where(F.size("spans") > 0).select("blob", key).where(F.col("s.rule").isin([r.key for r in rules]))
    have = have.select("blob", F.struct(F.col("s.start").alias("start"), place[F.col("s.rule")].alias("place"), F.col("s.end").alias("end"), kind[F.col("s.rule")].alias("kind")).alias("s"))
    have = have.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    return paths.join(have, "blob", "left").select(id_col, "spans")


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs.

    The counts and base_sha256 are of the base rules, spans of all rules: "kind:start:end" by start, then kind, joined by
    commas. Null text is the empty text. A text without findings has zeros and the digest of the empty string. Repeated
    rows and null ids are kept; other columns of docs are ignored; an empty table gives no rows. The new ledger rows are
    written before they are joined: appended to the Parquet table at ledger_path, which is read as the ledger if it is there
    already, so that the next run scans only what is new; without a path, to the shared folder.
    """
    spark = docs.sparkSession
    if ledger_path and ledger is None and common.exists(spark, ledger_path):
        ledger = common.materialise(spark.read.schema(LEDGER).parquet(ledger_path), "ledger-before")  # what is there now
    paths = common.materialise(blobs(docs, id_col, text_col), "paths")
    rows = common.materialise(scan(docs, ledger, rules, id_col, text_col, paths), "ledger")
    if ledger_path:
        rows.write.mode("append").parquet(ledger_path)
    every = rows if ledger is None else ledger.select("blob", "rules", "spans").unionByName(rows)
    base = [r.kind for r in rules if r.base]
    out = findings(paths, every, rules, id_col).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return out.select(id_col, *(count(k) for k in base), F.sha2(said(of_base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
