"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Hash buckets of the character trigrams.
DIM = 2048
#: Bound of the training sample, over all languages together.
SAMPLE = 2000

# Families of languages by ISO 639-1 code. A language without an entry is a family of its own.
FAMILY = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
    "et": "uralic", "fi": "uralic", "hu": "uralic",
}


def _letters() -> np.ndarray:
    """For each code point below 65536 its lower case if it is a letter, else a space; letters above stay."""
    out = np.full(65536, 32, np.uint32)
    for c in range(65536):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: np.ndarray | None = None


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased words of text, one space around each; empty if text has no letter."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _letters()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = codes >= 65536
    out = _TABLE[np.where(high, 0, codes)]
    if high.any():
        out[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
    out = np.concatenate([[32], out, [32]]).astype(np.uint32)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    out = out[keep]
    return out if len(out) > 1 else out[:0]


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Square roots of the hashed trigram counts over the whole text, scaled to length 1; None without any letter."""
    codes = letters(text or "")
    if not len(codes):
        return None
    with np.errstate(over="ignore"):
        h = codes[:-2] * np.uint32(2654435761) + codes[1:-1] * np.uint32(2246822519) + codes[2:] * np.uint32(3266489917)
        h ^= h >> np.uint32(15)
        h *= np.uint32(668265263)
    x = np.sqrt(np.bincount(h >> np.uint32(16) & np.uint32(dim - 1), minlength=dim)).astype(np.float32)
    return x / np.float32(np.sqrt((x * x).sum(dtype=np.float64)))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 5) -> np.ndarray:
    """Weights and bias of a linear support vector machine (hinge loss, dual coordinate descent); y is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    # both classes weigh the same, however many rows each has
    bound = c * np.where(y > 0, (y < 0).mean(), (y > 0).mean()) * 2
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            to = min(max(a[i] - (y[i] * (x[i] @ w) - 1) / q[i], 0.0), bound[i])
            if to != a[i]:
                w += (to - a[i]) * y[i] * x[i]
                moved = max(moved, abs(to - a[i]))
                a[i] = to
        if moved < 1e-3:
            break
    return w


class Model(NamedTuple):
    """Names are sorted; pairs (i, j) with i < j have positive values for i. families: name to the languages in it."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    within: dict[tuple[str, str], np.ndarray]


def train(x: np.ndarray, langs: list[str], family: dict[str, str] = FAMILY) -> Model:
    """Fit on rows of features and their languages."""
    of = np.array([family.get(n, n) for n in langs], dtype=object)
    lang = np.array(langs, dtype=object)
    families = {f: sorted(set(lang[of == f])) for f in sorted(set(of))}

    def pairs(names: list[str], label: np.ndarray) -> dict:
        out = {}
        for p, q in itertools.combinations(names, 2):
            at = (label == p) | (label == q)
            out[p, q] = linear_svm(x[at], np.where(label[at] == p, 1.0, -1.0))
        return out

    within: dict = {}
    for names in families.values():
        within |= pairs(names, lang)
    return Model(families, pairs(list(families), of), within)


def _elect(names: list[str], machines: dict[tuple[str, str], np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the name with the most votes, then the largest sum of margins; and how sure its
    closest duel was, 0.5 to 1."""
    if len(names) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    votes, margin, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.full((len(x), len(names)), np.inf)
    duels = list(itertools.combinations(range(len(names)), 2))
    w = np.stack([machines[names[i], names[j]] for i, j in duels])
    m = x @ w[:, :-1].T + w[:, -1]
    for k, (i, j) in enumerate(duels):
        for n, v, won in ((i, m[:, k], m[:, k] >= 0), (j, -m[:, k], m[:, k] < 0)):
            votes[:, n] += won
            margin[:, n] += v
            least[:, n] = np.minimum(least[:, n], v)
    best = np.where(votes == votes.max(axis=1, keepdims=True), margin, -np.inf).argmax(axis=1)
    return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(x)), best], -20, 20)))


def predict_all(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores of whole texts; a score is the less sure of the two steps. No letter: ("und", 0)."""
    langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    found = [(i, x) for i, t in enumerate(texts) if (x := features(t)) is not None] if model.families else []
    if found:
        at, x = np.array([i for i, _ in found]), np.stack([x for _, x in found]).astype(np.float64)
        names = list(model.families)
        family, sure = _elect(names, model.between, x)
        for f in np.unique(family):
            rows, inside = np.flatnonzero(family == f), model.families[names[f]]
            lang, here = _elect(inside, model.within, x[rows])
            langs[at[rows]] = np.array(inside, object)[lang]
            scores[at[rows]] = np.round(np.minimum(sure[rows], here), 9)  # the last digits depend on the batch
    return langs.tolist(), scores.tolist()


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, score) of a whole text."""
    langs, scores = predict_all(model, [text])
    return langs[0], scores[0]


#: Steps of the hash threshold for each halving: a sample is at most a quarter larger than it has to be before it is cut.
STEPS = 4


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from text and language of the rows that are not held out, on a sample of at most `sample` rows.

    Rows are drawn by a hash of their id, as many of each language: partial aggregates count the ids by language and size of
    hash, the counts give each language a threshold, and rows beyond it are passed over where they are read. The drawn texts
    are read whole and become features on the executors; one task, which sees no more than about the sample, trains, and
    only weights come to the driver. Of more than `sample` languages, that many are learned; rows with a null id are not learned from.
    """
    common.arrow_rows(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))).withColumn("h", F.xxhash64("id"))
    small = F.greatest(F.col("h").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(1))
    rows = rows.withColumn("rank", F.floor(STEPS * (63 - F.log2(small))).cast("int"))
    counts = rows.groupBy("lang", "rank").agg(F.approx_count_distinct("h").alias("n")).limit(63 * STEPS * sample).collect()
    by: dict[str, dict[int, int]] = {}
    for r in counts:
        by.setdefault(r["lang"], {})[r["rank"]] = r["n"]
    if not by:
        return Model({}, {}, {})
    by = dict(sorted(by.items())[:sample])
    each = max(1, sample // len(by))
    least = []
    for lang, n in by.items():
        rank, got = max(n), 0
        while rank >= 0 and (got := got + n.get(rank, 0)) < 1.3 * each:  # the counts are within some per cent
            rank -= 1
        least.append((lang, max(rank, 0)))
    limits = F.broadcast(spark.createDataFrame(least, "lang string, least int"))  # `sample` rows at most
    drawn = rows.join(limits, "lang").where(F.col("rank") >= F.col("least")).select("lang", "h", "text")

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            xs = [(n, h, x) for n, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _, _ in xs], pa.string()), pa.array([h for _, h, _ in xs], pa.int64()), pa.array([x.tobytes() for _, _, x in xs], pa.binary())], ["lang", "h", "x"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, list[tuple[int, bytes]]] = {}
        for b in batches:
            for n, h, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of.setdefault(n, []).append((h & ((1 << 63) - 1), x))
        got = [(n, x) for n in sorted(of) for _, x in sorted(of[n])[:each]]
        if got:
            model = train(np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(len(got), -1), [n for n, _ in got])
            rows = [("lang", n, None, None) for names in model.families.values() for n in names]
            rows += [(step, *pair, w.tobytes()) for step in ("between", "within") for pair, w in getattr(model, step).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(),) * 3 + (pa.binary(),), strict=True)], ["step", "p", "q", "w"])

    # an id that is there often counts once
    samples = drawn.mapInArrow(features_of, "lang string, h long, x binary").groupBy("lang", "h").agg(F.min("x").alias("x"))
    learned = samples.repartition(1).mapInArrow(learn, "step string, p string, q string, w binary").collect()
    model, names = Model({}, {}, {}), sorted(r["p"] for r in learned if r["step"] == "lang")
    for f in sorted({FAMILY.get(n, n) for n in names}):
        model.families[f] = [n for n in names if FAMILY.get(n, n) == f]
    for r in learned:
        if r["w"] is not None:
            getattr(model, r["step"])[r["p"], r["q"]] = np.frombuffer(bytes(r["w"]), np.float64)
    return model


def held_out(key):
    """Rows kept from learning: a fifth, by CRC-32 of the id as text. A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def predictions(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns and lang_pred, score for each row, from the whole text alone; columns of these names are replaced."""
    common.arrow_rows(docs.sparkSession)
    docs = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            langs, scores = predict_all(model, b.column(at).to_pylist())
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(id_col, held_out, lang_pred, score) for each row of docs.

    A fifth of the rows, by a hash of the id, is held out from learning. lang_pred is a learned language, or "und" with
    score 0 if the text is null, empty or without a letter, or if nothing could be learned. Prediction uses nothing but
    the text. Repeated rows and null ids are kept; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs, id_col, text_col, lang_col, sample)
    out = predictions(docs.select(id_col, text_col), model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0) -> DataFrame:
    """docs without the rows that language identification rejects: no language, or a score under least. Columns stay.

    Columns keep their values whatever their names. With least = 0 only texts that are null, empty or without a letter go, whatever the score; so too where nothing could be
    learned.
    """
    model = fit(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column(at).to_pylist()
            if model.families:
                said = [n != UNKNOWN and s >= least for n, s in zip(*predict_all(model, texts), strict=True)]
            else:
                said = [features(t) is not None for t in texts]
            yield b.filter(pa.array(said, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
