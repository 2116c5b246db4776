"""Evaluation texts leaking into training text (problem 9).

Both sides become streams of letters and digits, so that case, punctuation, layout and look-alike
characters do not count. Another word may be of any length and moves what follows to another diagonal,
so the q-gram lemma is applied to what lies between other words: of 10 s words of an item with s others
among them, the longest unbroken run keeps at least its share of the letters, hence a known number of
q-grams in a row. A text without such a row of q-grams is passed over at once; for the rest shared
q-grams are counted in overlapping diagonal bands, and bands that meet the bound are verified by a
banded alignment of the item's words, as wide as the words around can shift it.

The evaluation items are a small fixed set (their number is checked); every document is read
whole, in one pass without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factloom.llm.lookalikes import NON_ASCII, unmask

Q = 8
WORDS = 20  # consecutive words that make a case
ONE_IN = 10  # up to one word in so many may be another
BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)
BAND = 16  # width of a diagonal band in characters; bands overlap by half
SEGMENT, STEP = 120, 60  # words of an item that are aligned at once; see Items
MOST = 5  # other words in the shortest run that makes a case
MAX_ITEMS = 20_000  # bound of the broadcast side; more items are searched in turns
BLOCK = 1 << 21

_DROP = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))


def stream(text: str) -> bytes:
    """Letters and digits only, in lower case; characters beyond ASCII in UTF-8."""
    if not text.isascii():
        text = NON_ASCII.sub(lambda m: m.group() if m.group().isalnum() else "", unmask(text))
    return text.lower().encode("utf-8").translate(None, _DROP)


def grams(b: np.ndarray) -> np.ndarray:
    """All q-grams (eight bytes) as integers."""
    n = len(b) - Q + 1
    return np.ndarray((n,), "<u8", b, strides=(1,)).copy() if n > 0 else np.empty(0, np.uint64)


def bounds_of(sizes: np.ndarray) -> tuple[int, np.ndarray]:
    """(q-grams in a row, windows) of any case within words of these lengths.

    The shortest run of words that makes a case has fewer than 60 words, hence at most MOST others: a
    longer one would split into two runs of which one is a case too. With s others there are at
    least 10 s words, and the others leave at most s + 1 unbroken runs for the remaining letters.
    Some window (first word, word after the last, q-grams in all) has as many q-grams as it says.
    """
    row, windows = [], []
    for s in range(WORDS // ONE_IN, min(MOST, len(sizes) // ONE_IN) + 1):
        n = s * ONE_IN
        words = np.lib.stride_tricks.sliding_window_view(sizes, n)
        left = words.sum(1) - np.sort(words, axis=1)[:, -s:].sum(1)
        row.append(-(-int(left.min()) // (s + 1)) - Q + 1)
        first = np.arange(len(left))
        windows.append(np.stack([first, first + n, np.maximum(1, left - (s + 1) * (Q - 1))], axis=1))
    return max(1, min(row)), np.concatenate(windows)


class Items:
    """Index of the evaluation items: their streams, q-grams, bounds and the first filter.

    A long item is indexed in segments of SEGMENT words that overlap by half, so that every run of
    fewer than 60 words lies within one; a segment is found and aligned like an item of its own.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.texts, self.starts, self.bounds = [], [], [], [], []
        base, bases, windows = 0, [], []
        values, owners, places = [], [], []
        for item_id, text in items:
            every = [w for w in (stream(x) for x in (text or "").split()) if w]
            for cut in range(0, max(1, len(every) - STEP), STEP):
                words = every[cut:cut + SEGMENT]
                if len(words) < WORDS:
                    continue
                sizes = np.array([len(w) for w in words])
                k, whole = len(self.ids), np.frombuffer(b"".join(words), np.uint8)
                g = grams(whole)
                self.ids.append(item_id)
                self.words.append(words)
                self.texts.append(whole)
                self.starts.append(np.concatenate([[0], np.cumsum(sizes)]))
                row, window = bounds_of(sizes)
                self.bounds.append(row)
                at = self.starts[-1]
                windows.append(np.stack([np.full(len(window), k), base + at[window[:, 0]], base + np.maximum(at[window[:, 0]], at[window[:, 1]] - Q + 1), window[:, 2]], axis=1))
                bases.append(base)
                base += len(whole)
                values.append(g)
                owners.append(np.full(len(g), k, np.int32))
                places.append(np.arange(len(g), dtype=np.int32))
        v = np.concatenate(values) if values else np.empty(0, np.uint64)
        order = np.argsort(v, kind="stable")
        self.values = v[order]
        self.owners = np.concatenate(owners)[order] if values else np.empty(0, np.int32)
        self.places = np.concatenate(places)[order] if values else np.empty(0, np.int32)
        self.filter = np.zeros(1 << BITS, np.uint8)
        self.filter[(self.values * MIX) >> np.uint64(64 - BITS)] = 1
        #: Windows of all items: item, first and last place (of the letters of all items in one row), q-grams in all.
        self.windows = np.concatenate(windows).T if windows else np.empty((4, 0), np.int64)
        self.bases, self.letters = np.array(bases, np.int64), base
        self.least, self.least_total = min(self.bounds, default=1), int(self.windows[3].min(initial=1 << 30))

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of text, item id) for every text that holds enough of an item."""
        found: list[tuple[int, int]] = []
        part, index, size = [], [], 0
        for i, t in enumerate(texts):
            s = stream(t) if t else b""
            if len(s) >= Q and self.ids:
                part.append(s)
                index.append(i)
                size += len(s) + Q
                if size > BLOCK:
                    found += self._block(part, index, texts)
                    part, index, size = [], [], 0
        return found + (self._block(part, index, texts) if part else [])

    def _block(self, part: list[bytes], index: list[int], texts: list[str | None]) -> list[tuple[int, int]]:
        gap = b"\0" * Q
        b = np.frombuffer(gap.join(part) + gap, np.uint8)
        g = grams(b)
        hit = self.filter[(g * MIX) >> np.uint64(64 - BITS)]
        total = np.concatenate([[0], np.cumsum(hit, dtype=np.int32), np.zeros(Q - 1, np.int32)])
        total[len(hit) + 1:] = total[len(hit)]
        rows = np.nonzero(total[self.least:] - total[:-self.least] == self.least)[0] if len(total) > self.least else []
        if not len(rows):
            return []
        starts = np.cumsum([0] + [len(s) + Q for s in part])
        out = []
        for k in np.unique(np.searchsorted(starts, rows, side="right") - 1):
            if k >= len(part) or total[starts[k + 1]] - total[starts[k]] < self.least_total:
                continue
            lo, hi = starts[k], starts[k] + len(part[k]) - Q + 1
            at = np.nonzero(hit[lo:hi])[0]
            out += [(index[k], item) for item in self._bands(part[k], texts[index[k]], g[lo:hi], at)]
        return out

    def _bands(self, doc: bytes, text: str, g: np.ndarray, at: np.ndarray) -> list[int]:
        left, right = np.searchsorted(self.values, g[at], "left"), np.searchsorted(self.values, g[at], "right")
        n = right - left
        if not n.sum():
            return []
        pos = np.repeat(at, n)
        entry = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        met = np.unique(entry)
        there = np.zeros(self.letters + 1, np.int32)
        there[1 + self.bases[self.owners[met]] + self.places[met]] = 1
        there = np.cumsum(there)
        item, lo, hi, need = self.windows
        likely = np.zeros(len(self.ids), bool)
        likely[item[there[hi] - there[lo] >= need]] = True
        if not likely.any():
            return []
        keep = likely[self.owners[entry]]
        pos, entry = pos[keep], entry[keep]
        owner, diagonal = self.owners[entry].astype(np.int64), pos - self.places[entry] + (1 << 24)
        half = BAND // 2
        cell = np.concatenate([(owner << 32) + (diagonal // half), (owner << 32) + (diagonal // half) - 1])
        keys, counts = np.unique(cell, return_counts=True)
        best: dict[int, list[int]] = {}
        for key, count in zip(keys.tolist(), counts.tolist()):
            item = key >> 32
            if count >= self.bounds[item]:
                best.setdefault(item, []).append(((key & 0xFFFFFFFF) * half) - (1 << 24) + half)
        if not best:
            return []
        codes = np.frombuffer(doc, np.uint8)
        sizes = np.array([n for n in (len(stream(w)) for w in text.split()) if n] or [0])
        ends = np.cumsum(sizes)
        found: set[int] = set()
        for item, centres in best.items():
            if self.ids[item] not in found and self._near(codes, sizes, ends, item, centres):
                found.add(self.ids[item])
        return sorted(found)

    def _near(self, doc: np.ndarray, sizes: np.ndarray, ends: np.ndarray, item: int, centres: list[int]) -> bool:
        """Aligns the item along the retained bands; bands that can reach each other are aligned at once.

        Other words shift the diagonal by no more than MOST times the longest word of the item or
        of the document around (``sizes`` and ``ends`` are its words).
        """
        long, longest = len(self.texts[item]), int(np.diff(self.starts[item]).max())
        spans: list[list[int]] = []
        for centre in sorted(centres):
            a = max(0, int(np.searchsorted(ends, max(centre, 0))) - SEGMENT)
            near = sizes[a:int(np.searchsorted(ends, max(centre, 0) + long)) + SEGMENT]
            reach = BAND + MOST * max(int(near.max(initial=0)), longest)
            if spans and centre - reach <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], centre + reach)
            else:
                spans.append([centre - reach, centre + reach])
        return any(self.verify(doc, item, lo, hi - lo + 1) for lo, hi in spans)

    def verify(self, doc: np.ndarray, item: int, lo: int, width: int) -> bool:
        """Banded alignment: each word of the item stands on one of ``width`` diagonals from ``lo`` on or is another word.

        Only a word that is another may shift the diagonal. The case holds if some run of at least
        WORDS words, its first and last as in the item, has at most one other word in ONE_IN.
        """
        starts, text = self.starts[item], self.texts[item]
        long, words = len(text), len(starts) - 1
        around = np.zeros(long + width - 1, np.uint8)
        begin, end = max(lo, 0), min(lo + len(around), len(doc))
        if end > begin:
            around[begin - lo:end - lo] = doc[begin:end]
        # Wherever the words stand: words - ONE_IN x (words that stand nowhere) is not negative over some WORDS or more.
        there = around.tobytes()
        gain = np.cumsum([0] + [1 if w in there else 1 - ONE_IN for w in self.words[item]])
        if words < WORDS or (gain[WORDS:] < np.minimum.accumulate(gain)[:-WORDS]).all():
            return False
        # Diagonal d: the item laid on the document from lo + d on; a word stands there if all its characters agree.
        same = np.empty((words, width), bool)
        laid = np.lib.stride_tricks.sliding_window_view(around, long)
        for d in range(0, width, 4096):
            same[:, d:d + 4096] = np.logical_and.reduceat(laid[d:d + 4096] == text, starts[:-1], axis=1).T
        # runs[s, d]: length of the longest run with s other words that ends at this word, on diagonal d.
        runs = np.zeros((MOST + 1, width), np.int32)
        need = np.maximum(WORDS, ONE_IN * np.arange(MOST + 1))[:, None]
        for i in range(words):
            on = runs > 0
            on[0] = True
            exact = np.where(on & same[i], runs + 1, 0)
            if (exact >= need).any():
                return True
            best = runs.max(1)
            other = np.concatenate([[0], np.where(best[:-1] > 0, best[:-1] + 1, 0)])
            runs = np.maximum(exact, other[:, None])
        return False


def _scan(cast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Items = cast.value
        for batch in batches:
            found = index.search(batch.column(1).to_pylist())
            if found:
                rows = batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([x for _, x in found], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p9_found (doc_id, item_id): the document holds 20 or more words of the item.

    Null, empty and blank texts hold nothing; items of fewer than 20 words cannot leak; rows of a
    document or item that repeat count once; extra columns are ignored; an empty side gives an
    empty result. Texts of any length are searched whole.
    """
    spark = documents.sparkSession
    rows = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    parts = max(1, -(-rows.count() // MAX_ITEMS))
    out = None
    for k in range(parts):  # one turn for each MAX_ITEMS items; the sets of this kind take one
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k)
        index = Items(sorted((r["item_id"], r["text"]) for r in mine.collect()))
        cast = spark.sparkContext.broadcast(index)
        found = documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_scan(cast), "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
