"""Benchmark decontamination by edit distance, without misses.

An item of m characters may be met with k edits. Cut into pieces of q characters, each edit spoils one piece at most, so at
least m // q - k pieces stand unchanged in the text, and as no path of k edits strays further, on k + 1 diagonals (place in
the text minus place in the item). Of two neighbours either both have no edit or, where they count for one, one of them has
one: a piece counts only if its neighbour is within an edit. Pieces found are counted by item and diagonals; where enough
meet, a bit-parallel banded edit distance of many places at a time decides, and what is left is measured exactly. No step
drops a place in reach.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

#: Items of fewer words are found as they stand, as whole words: a few edits would make other words of them.
LEAST_WORDS = 5
#: Edits that a part of an item may have at most: its band of diagonals then fits a machine word.
PART_EDITS = 47
#: Classes that characters are put in for the banded distance; two in one class only let more pass.
CLASSES = 64
#: Characters of text searched at a time; places measured at a time.
CHUNK, PLACES = 64_000, 4096
#: Bytes and rows of items that one pass over the documents takes along; more items are taken in further passes.
ITEM_BYTES = 4 << 20
ITEM_ROWS = 20_000

_WORDS = re.compile(r"[^\W_]+").finditer
_FIND = re.compile(r"[^\W_]+").findall


# scripts written without spaces: each of their characters counts as a word
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_SYMBOLS = re.compile(f"[{_UNSPACED}]|[^\\W_{_UNSPACED}]+").findall
_ALONE = re.compile(f"[{_UNSPACED}]").match


def edit_distance_within(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the part of text closest to item in edits of characters, the first such end; None if over most.

    Bit-parallel dynamic programming over the columns of the table, as many bits as item has characters.
    """
    m = len(item)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


class Items(NamedTuple):
    """Benchmark items made ready: ids, texts as they are compared, and whether an item must be met without edits."""

    ids: list
    texts: list[str]
    exact: list[bool]


def normal(text: str) -> str:
    """The text's words, lower-cased, with one space between: what is compared."""
    return " ".join(_FIND(text.lower()))


def prepare(rows: list[tuple]) -> Items:
    """From (id, text) rows; those without a word are left out. Items that must be met exactly get spaces around their words."""
    ids, texts, exact = [], [], []
    for i, text in rows:
        plain = normal(text or "")
        if plain:
            short = len(_SYMBOLS(plain)) < LEAST_WORDS
            ids.append(i)
            exact.append(short)
            texts.append(plain if not short else " " * (not _ALONE(plain[0])) + plain + " " * (not _ALONE(plain[-1])))
    return Items(ids, texts, exact)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint32)
    for j in range(q):
        h *= np.uint32(0x01000193 * 8 + 5)
        h += points[j : j + n]
    return h


def _twos(points: np.ndarray) -> np.ndarray:
    """Two characters from each place on as one number; further characters may share a number."""
    return points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)


def _keys(pieces: np.ndarray, twos: np.ndarray | None, bits: int) -> np.ndarray:
    h = pieces * np.uint32(0xC2B2AE35) if twos is None else pieces * np.uint32(0xC2B2AE35) + twos
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - bits)
    return h


class Pieces(NamedTuple):
    """Some pieces of q characters by a hash of the piece and two characters of its neighbour: whether a hash has
    pieces, where they start and how many they are; each one's part and place. offsets: how far from a piece in the text the two characters may start; None
    for pieces that count by themselves. unless: pieces whose neighbour has these two characters at unless_at have been
    counted already."""

    q: int
    offsets: tuple
    any: np.ndarray
    first: np.ndarray
    many: np.ndarray
    part: np.ndarray
    place: np.ndarray
    unless: np.ndarray | None
    unless_at: int


class Matcher:
    """Finds the items in texts. similarity: 1 - edits / characters of the item.

    An item with many edits is cut into parts: one of s parts has a share 1/s of the edits at most.
    """

    def __init__(self, items: Items, similarity: float = 0.8):
        self.items = items
        self._most = [0 if e else int((1 - similarity) * len(t) + 1e-9) for t, e in zip(items.texts, items.exact, strict=True)]
        item, at, length, edits, q, cut = [], [], [], [], [], []
        for k, (text, most) in enumerate(zip(items.texts, self._most, strict=True)):
            n = -(-(most + 1) // (PART_EDITS + 1))
            n = max(n, -(-len(text) // 512))  # parts of few edits are short as well: the places measured at a time are alike
            for lo, hi in itertools.pairwise(len(text) * j // n for j in range(n + 1)):
                item.append(k)
                at.append(lo)
                length.append(hi - lo)
                edits.append(most // n)
                # the longest pieces of which some more than one must stand, or one at least
                q.append(next((x for more in (2, 0) for x in (8, 7, 6, 5, 4, 3, 2) if (hi - lo) // x > most // n + more), 1))
                cut.append(text[lo:hi])
        self._item, self._at, self._length, self._edits = (np.array(x, np.int64) for x in (item, at, length, edits))
        q = np.array(q, np.int64)
        many = self._length // np.maximum(q, 1)
        # the last piece of an odd number has no neighbour: it is left out where enough others are needed
        lone = (q < 4) | (many % 2 == 1) & (many - self._edits < 3)
        self._need = np.maximum(1, many - (many % 2) * ~lone - self._edits)
        self._width = self._edits + 1  # of a bin of diagonals: any edits + 1 of them are in two bins
        self._longest = int(self._length.max(initial=0))
        self._bits = int(np.clip(np.ceil(np.log2(1 + many.sum() / 2)) + 5, 16, 22))
        self._pieces = [t for x in np.unique(q) for t in self._tables(int(x), np.flatnonzero(q == x), cut, lone)]
        self._words = (63 + self._longest + 64) // 64 + 3
        self._masks = self._mask_table(cut)

    def _tables(self, q: int, parts: np.ndarray, cut: list[str], lone: np.ndarray) -> list[Pieces]:
        """The pieces of parts: those that count by themselves, and pairs of neighbours both ways. A neighbour within an edit
        has the two characters next to the piece in their place, or those furthest from it at most one place off."""
        rows: dict[str, list[tuple]] = {"alone": [], "after": [], "before": []}
        for p in parts:
            points = _points(cut[p])
            h, two, n = _pieces(points, q), _twos(points), len(cut[p]) // q
            for k in range(n):
                at = k * q
                if q < 4 or (n % 2 and k == n - 1):
                    if q < 4 or lone[p]:
                        rows["alone"].append((p, at, h[at], 0, 0))
                elif k % 2:
                    rows["before"].append((p, at, h[at], two[at - 2], two[at - q]))
                else:
                    rows["after"].append((p, at, h[at], two[at + q], two[at + 2 * q - 2]))
        out = []
        for kind, got in rows.items():
            if not got:
                continue
            part, place = (np.array([r[c] for r in got], np.int32) for c in (0, 1))
            h, near, far = (np.array([r[c] for r in got], np.uint32) for c in (2, 3, 4))
            near_at, far_at = (q, 2 * q - 2) if kind == "after" else (-2, -q)
            sorts = [((), None, None, 0)] if kind == "alone" else [((near_at,), near, None, 0), ((far_at - 1, far_at, far_at + 1), far, near, near_at)]
            for offsets, two, unless, unless_at in sorts:
                keys = _keys(h, two, self._bits)
                order = np.argsort(keys, kind="stable")
                first = np.searchsorted(keys[order], np.arange((1 << self._bits) + 1)).astype(np.int32)
                many = np.diff(first)
                out.append(Pieces(q, offsets, many > 0, first[:-1], many, part[order], place[order], None if unless is None else unless[order], unless_at))
        return out

    def _mask_table(self, cut: list[str]) -> np.ndarray:
        """For each part and class of characters, the places of the class: 63 that any character fits, the part, any again."""
        alphabet = np.unique(np.concatenate([_points(c) for c in cut] or [np.zeros(0, np.uint32)]))
        self._class = np.zeros(0x110000, np.uint8)  # class 0: in no item
        self._class[alphabet] = 1 + np.arange(len(alphabet)) % (CLASSES - 1)
        masks = np.zeros((len(cut), CLASSES, self._words), np.uint64)
        for p, c in enumerate(cut):
            bits = np.zeros((CLASSES, self._words * 64), np.uint8)
            bits[:, :63] = bits[:, 63 + len(c) :] = 1
            bits[self._class[_points(c)], 63 + np.arange(len(c))] = 1
            masks[p] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        return masks.reshape(-1)

    def _near(self, points: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
        """(part, first diagonal): 64 diagonals from there may hold enough pieces of a part; lead: places before the text."""
        counts = (len(points) + lead) // self._width + 3
        base = np.cumsum(counts) - counts
        shift, scale = (base + lead // self._width).astype(np.float64), 1.0 / self._width
        shift += (lead % self._width + 0.5) * scale  # bin = base + (diagonal + lead) // width
        two, pieces, hits, places = _twos(points), {}, [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for t in self._pieces:
            h = pieces[t.q] = pieces[t.q] if t.q in pieces else _pieces(points, t.q)
            for off in t.offsets or (None,):
                lo, hi = (0, len(h)) if off is None else (max(0, -off), min(len(h), len(two) - off))
                if lo >= hi:
                    continue
                keys = _keys(h[lo:hi], None if off is None else two[lo + off : hi + off], self._bits)
                at = np.flatnonzero(t.any.take(keys))
                if not len(at):
                    continue
                keys = keys[at]
                many = t.many.take(keys)
                at += lo
                ends = np.cumsum(many)
                which = np.repeat(t.first.take(keys) - (ends - many), many)
                which += np.arange(len(which))
                at = np.repeat(at, many)
                if t.unless is not None:
                    new = np.flatnonzero(two.take(at + t.unless_at, mode="clip") != t.unless.take(which))
                    which, at = which.take(new), at.take(new)
                part, place = t.part.take(which), t.place.take(which)
                places.append(place)
                hits.append(((at - place) * scale.take(part) + shift.take(part)).astype(np.int64))
        hit, place, total = np.concatenate(hits), np.concatenate(places), int(counts.sum())
        bins = np.minimum(np.bincount(hit, minlength=total), 10000).astype(np.int16)
        least = np.repeat(np.minimum(self._need, 10000).astype(np.int16), counts)[:-1]
        found = np.flatnonzero(bins[:-1] + bins[1:] >= least)
        # a piece that is met several times in a bin stands for one
        near = np.zeros(total, bool)
        near[found] = near[found + 1] = True
        some = np.flatnonzero(near.take(hit))
        one = np.unique(hit.take(some) * (self._longest + 1) + place.take(some)) // (self._longest + 1)
        bins = np.bincount(one, minlength=total)
        found = found[bins[found] + bins[found + 1] >= least[found]]
        part = np.searchsorted(base, found, "right") - 1
        start = (found - base[part]) * self._width[part] - lead
        # as many bands of 64 diagonals as hold all runs of a bin's width that start in the bin
        step = 65 - self._width[part]
        bands = -(-self._width[part] // step)
        n = np.arange(bands.sum()) - np.repeat(np.cumsum(bands) - bands, bands)
        return np.repeat(part, bands), np.repeat(start, bands) + n * np.repeat(step, bands)

    def _within(self, classes: np.ndarray, part: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which places hold the part with its edits on the 64 diagonals from start: bit-parallel, banded."""
        one, top = np.uint64(1), np.uint64(63)
        vp, vn, score = (np.zeros(len(part), np.uint64) for _ in range(3))
        row, words = part * (CLASSES * self._words), np.int64(self._words)
        out, alive = np.zeros(len(part), bool), np.arange(len(part))
        shortest, steps = int(self._length[part].min(initial=0)), int(self._length[part].max(initial=0)) + 63
        # a column whose least value is over the edits ends the search there: most places that only look alike go early
        checks = {63 + shortest * k // 10 for k in (4, 6)} | {steps - 1}
        for j in range(steps):
            x = classes.take(start + j) * words
            x += row
            x += j >> 6
            pm = self._masks.take(x)
            if j & 63:
                pm >>= np.uint64(j & 63)
                x += 1
                pm |= self._masks.take(x) << np.uint64(64 - (j & 63))
            d0 = pm & vp
            d0 += vp
            d0 ^= vp
            d0 |= pm
            d0 |= vn
            hp = ~(d0 | vp)
            hp |= vn
            vp &= d0
            score += one
            score -= d0 >> top
            d0 >>= one
            vn = d0 & hp
            d0 |= hp
            vp |= ~d0
            if j in checks:
                here = score.astype(np.int64)
                best = here.copy()
                for b in range(62, -1, -1):
                    here += ((vn >> np.uint64(b)) & one).astype(np.int64) - ((vp >> np.uint64(b)) & one).astype(np.int64)
                    np.minimum(best, here, out=best)
                keep = best <= self._edits[part]
                part, start, row, vp, vn, score, alive = (a[keep] for a in (part, start, row, vp, vn, score, alive))
                if not len(alive):
                    return out
        out[alive] = True
        return out

    def places(self, text: str) -> list[tuple[int, int, int]]:
        """(item, begin, end) of the stretches of text that may hold the item; any that does lies in one of them whole."""
        lead = self._longest + 128
        out = []
        points = _points(text)
        classes = np.zeros(len(points) + 3 * lead + 64, np.int64)
        classes[lead : lead + len(points)] = self._class[points]
        parts, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(points), CHUNK):
            # a part that starts before CHUNK more characters ends within twice its length
            part, start = self._near(points[at : at + CHUNK + 2 * self._longest], lead)
            parts.append(part)
            starts.append(start + at)
        part, start = np.concatenate(parts), np.concatenate(starts)
        sizes = np.array([len(t) for t in self.items.texts], np.int64)
        order = np.argsort(self._length[part], kind="stable")
        for i in range(0, len(order), PLACES):
            some = order[i : i + PLACES]
            p, s = part[some], np.clip(start[some], -lead, len(points))
            ok = self._within(classes, p, s + lead)
            p, s = p[ok], s[ok]
            most, size = np.array(self._most, np.int64)[self._item[p]], sizes[self._item[p]]
            lo, hi = s - self._at[p] - most, s + 64 + size - self._at[p] + most
            out += zip(self._item[p].tolist(), np.maximum(lo, 0).tolist(), np.minimum(hi, len(points)).tolist(), strict=True)
        joined: list[tuple[int, int, int]] = []
        for k, lo, hi in sorted(out):
            if joined and joined[-1][0] == k and lo <= joined[-1][2]:
                joined[-1] = (k, joined[-1][1], max(hi, joined[-1][2]))
            else:
                joined.append((k, lo, hi))
        return joined

    def find_all(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of each item found in the whole texts, at its best place; positions in characters."""
        if not self.items.texts:
            return []
        lows = [(t or "").lower() for t in texts]
        plain = [f" {' '.join(_FIND(x))} " for x in lows]
        ends = np.cumsum([len(x) for x in plain])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, lo, hi in self.places("".join(plain)):
            item, row = self.items.texts[k], int(np.searchsorted(ends, lo, "right"))
            while row < len(plain) and (begin := int(ends[row]) - len(plain[row])) < hi:
                a, b = max(lo - begin, 0), min(hi - begin, len(plain[row]))
                got = edit_distance_within(item, plain[row][a:b], self._most[k])
                if got and ((row, k) not in best or got[0] < best[row, k][0]):
                    back = edit_distance_within(item[::-1], plain[row][a : a + got[1]][::-1], self._most[k])
                    best[row, k] = (got[0], a + got[1] - back[1], a + got[1])
                row += 1
        out = []
        for (row, k), (d, lo, hi) in sorted(best.items()):
            text = plain[row]
            lo, hi = lo + (text[lo] == " "), hi - (text[hi - 1] == " ")
            at = [(m.start(), m.end()) for m in itertools.islice(_WORDS(lows[row]), text.count(" ", 0, lo) - 1, text.count(" ", 0, hi))]
            out.append((row, k, d, at[0][0], at[-1][1]))
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id_col, item_col, edits, begin, end): the items found in each document, whole texts searched.

    Case, punctuation and white space don't count. An item is found where some part of the document is within (1 -
    similarity) edits for each of the item's characters; edits is the least number, begin and end (code points of the
    lower-cased text) hold that part. Items of fewer than five words are found as whole words without any edit; in scripts
    without spaces each character counts as a word. Null items and those without a word are never found; null and empty
    documents hold none. Repeated documents are each reported, repeated items too; other columns are ignored.

    Documents stay where they are: each task compares its rows with all items. Items of more than ITEM_BYTES are
    taken in blocks of about that size, one pass over the documents for each, so what is sent along is bounded.
    """
    common.arrow_rows(docs.sparkSession)
    item_kind, kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits int, begin int, end int"
    texts = docs.select(F.col(id_col), F.col(text_col))
    out = None
    for rows in item_blocks(items, item_col, item_text_col):
        found = texts.mapInArrow(_search(rows, similarity, id_col, item_col, item_type), schema)
        out = found if out is None else out.unionByName(found)
    return out


def item_blocks(items: DataFrame, item_col: str, item_text_col: str) -> list[list[tuple]]:
    """The items (id, text) in blocks of about ITEM_BYTES and ITEM_ROWS, by a hash: one block at least."""
    rows = items.select(F.col(item_col), F.col(item_text_col).alias("_t")).where("_t is not null")
    size, many = rows.agg(F.sum(F.octet_length("_t")), F.count("_t")).first()
    blocks = max(1, math.ceil((size or 0) / ITEM_BYTES), math.ceil(many / ITEM_ROWS))
    return [sorted(map(tuple, rows.where(F.pmod(F.xxhash64(item_col, "_t"), F.lit(blocks)) == k).collect()), key=repr) for k in range(blocks)]


def _groups(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of as many texts at a time as hold about `chars` characters."""
    start = held = 0
    for row, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or row + 1 == len(texts):
            yield start, row + 1
            start, held = row + 1, 0


def _search(rows: list[tuple], similarity: float, id_name: str, item_name: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(prepare(rows), similarity)
        ids = matcher.items.ids
        for b in common.slices(batches):
            texts = b.column(1).to_pylist()
            for start, end in _groups(texts):
                found = matcher.find_all(texts[start:end])
                cols = [b.column(0).take(pa.array([start + f[0] for f in found], pa.int64())), pa.array([ids[f[1]] for f in found], item_type)]
                cols += [pa.array([f[c] for f in found], pa.int32()) for c in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays(cols, [id_name, item_name, "edits", "begin", "end"])

    return run


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose text holds an item, found as contaminated() does. Columns and repeated rows stay.

    Each row is judged by its own text, so ids that are null or repeat make no difference; texts are not moved.
    """
    common.arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)

    def without(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(prepare(rows), similarity)
            for b in common.slices(batches):
                texts = b.column(at).to_pylist()
                clean = np.ones(len(texts), bool)
                for start, end in _groups(texts):
                    clean[[start + f[0] for f in matcher.find_all(texts[start:end])]] = False
                yield b.filter(pa.array(clean))

        return run

    for rows in item_blocks(items, item_col, item_text_col):
        docs = docs.mapInArrow(without(rows), docs.schema)
    return docs
