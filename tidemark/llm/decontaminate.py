"""Benchmark decontamination: BM25 over the test items, block-max WAND, and overlap of question and answer.

The test items are indexed; every training passage is a query. An item's BM25 score is divided by the score it has
for its own text, so that one threshold holds for all items. Passages are windows of twice as many words as the longest
item has, at half steps: an item that stands in a text stands whole in some passage.

A passage is looked at more closely only if the rarer terms it has could lift some item over the threshold (the frequent
terms cannot do so alone in any item): first by the terms' greatest impacts, then by their impacts on each item. These
bounds are computed for all passages of a slice at once and lose nothing. Block-max WAND then retrieves every item above the threshold, and an item counts
as leaked if enough of the word shingles of its question and of its answer stand in the passage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices
from tidemark.llm.hashing import mix, span_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of the shingles of its question and of its answer.
MIN_SCORE = 0.6
MIN_OVERLAP = 0.6
SHINGLE = 5
#: Postings of a block.
BLOCK = 16
#: Characters of test items in one index, which every executor holds; more items take several indexes and passes.
INDEX_CHARS = 20_000_000
#: Slices of texts that are searched at a time.
SLICE = 1_000_000

SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (lower case; runs of a-z, digits and all that is not ASCII), and words per text."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    inside[1:] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return span_hashes(data, starts, ends), np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than size are one shingle."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mix(out))


def overlap(part: np.ndarray, size: int, passage: np.ndarray) -> float:
    """Share of a part's shingles, of size words, that stand in a passage; 1 for a part without words."""
    return float(np.isin(part, shingles(passage, size)).mean()) if len(part) else 1.0


def question_and_answer(text: str) -> tuple[str, str]:
    """The two parts of an item: at the first line end or question mark, else in the middle of its words."""
    text = text.strip()
    for mark in ("\n", "?"):
        head, found, tail = text.partition(mark)
        if found and head.strip() and tail.strip():
            return head, tail
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


class Index:
    """Inverted index with block maxima over (item_id, text) rows. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [t for _, t in items]
        words, counts = word_hashes(texts) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ends = np.cumsum(counts)
        cut = [words[e - c : e] for e, c in zip(ends, counts, strict=True)]
        live = [i for i, w in enumerate(cut) if len(w)]
        self.ids = [items[i][0] for i in live]
        self.longest = max((len(cut[i]) for i in live), default=1)
        self.parts = []
        for i in live:
            hashed, sizes = word_hashes(list(question_and_answer(texts[i])))
            self.parts.append([(shingles(w), min(SHINGLE, len(w))) for w in (hashed[: sizes[0]], hashed[sizes[0] :])])
        self.terms = np.unique(np.concatenate([cut[i] for i in live])) if live else np.zeros(0, np.uint64)
        n, mean = len(live), sum(len(cut[i]) for i in live) / max(1, len(live))
        rows: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for number, i in enumerate(live):
            found, times = np.unique(cut[i], return_counts=True)
            for t, tf in zip(np.searchsorted(self.terms, found).tolist(), times.tolist(), strict=True):
                rows[t].append((number, tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(cut[i]) / mean))))
        weights = [math.log(1 + (n - len(r) + 0.5) / (len(r) + 0.5)) for r in rows]
        own = np.zeros(n)
        for r, idf in zip(rows, weights, strict=True):
            for number, w in r:
                own[number] += idf * w
        self.postings = [[(number, idf * w / own[number]) for number, w in r] for r, idf in zip(rows, weights, strict=True)]
        self.most = np.array([max(w for _, w in p) for p in self.postings]) if live else np.zeros(0)
        self.blocks = [[(p[min(at + BLOCK, len(p)) - 1][0], max(w for _, w in p[at : at + BLOCK])) for at in range(0, len(p), BLOCK)] for p in self.postings]
        # Frequent terms that even together leave every item below half the threshold.
        held, frequent = np.zeros(n), np.zeros(len(rows), bool)
        for t in sorted(range(len(rows)), key=lambda t: -len(rows[t])):
            more = held.copy()
            for number, w in self.postings[t]:
                more[number] += w
            if n and more.max() >= MIN_SCORE / 2:
                break
            held, frequent[t] = more, True
        self.rare = np.where(frequent, 0.0, self.most)
        self.needed = MIN_SCORE - (held.max() if n else 0.0) - 1e-9
        rare = [[] if often else p for often, p in zip(frequent, self.postings, strict=True)]
        self.begin = np.cumsum([0, *map(len, rare)])
        self.items = np.array([number for p in rare for number, _ in p], np.int64)
        self.impacts = np.array([w for p in rare for _, w in p], np.float64)
        self.quick = np.zeros(1 << 18, bool)
        self.quick[(self.terms >> np.uint64(46)).astype(np.int64)] = True

    def term_numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of the words that are terms, the terms' numbers)."""
        at = np.flatnonzero(self.quick[(words >> np.uint64(46)).astype(np.int64)])
        found = np.searchsorted(self.terms, words[at])
        found[found == len(self.terms)] = 0
        same = self.terms[found] == words[at]
        return at[same], found[same]

    def hopeful(self, passage: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Of (passage, term) pairs in order of passages, the passages in which rare terms could lift an item over the threshold."""
        bounds = np.bincount(passage, weights=self.rare[terms], minlength=1)
        live = np.flatnonzero((bounds >= self.needed)[passage] & (self.rare[terms] > 0))
        out: list[np.ndarray] = []
        for at in range(0, len(live), 200_000):
            # Cut between passages: a passage in two cuts would have two halves of its bound.
            part = live[at : at + 200_000]
            if at:
                part = part[passage[part] != passage[live[at - 1]]]
            if at + 200_000 < len(live):
                more = live[at + 200_000 : np.searchsorted(passage[live], passage[live[at + 200_000 - 1]], side="right")]
                part = np.concatenate([part, more])
            t = terms[part]
            many = self.begin[t + 1] - self.begin[t]
            where = np.repeat(self.begin[t] - np.cumsum(many) + many, many) + np.arange(many.sum())
            keys, inverse = np.unique(np.repeat(passage[part], many) * len(self.ids) + self.items[where], return_inverse=True)
            scores = np.bincount(inverse, weights=self.impacts[where], minlength=len(keys))
            out.append(np.unique(keys[scores >= self.needed] // len(self.ids)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def retrieve(self, terms: list[int], least: float = MIN_SCORE) -> list[tuple[int, float]]:
        """All (item number, score) of at least this score for a query of distinct terms, by block-max WAND."""
        least -= 1e-9
        # A cursor: current item, position, postings, blocks, the list's greatest impact.
        cursors = [[self.postings[t][0][0], 0, self.postings[t], self.blocks[t], float(self.most[t])] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[4]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # The blocks that hold the pivot item, and the first item behind the nearest of their ends.
            bound, beyond = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                number = c[1] // BLOCK
                while number < len(c[3]) and c[3][number][0] < item:
                    number += 1
                if number < len(c[3]):
                    bound += c[3][number][1]
                    beyond = min(beyond, c[3][number][0] + 1)
            if bound < least:
                target = max(beyond, item + 1)
            else:
                target = item + 1
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._advance(c, item)
                    if c[0] == item:
                        score += c[2][c[1]][1]
                if score >= least:
                    found.append((item, score))
            for c in cursors[: pivot + 1]:
                self._advance(c, target)
            cursors = [c for c in cursors if c[0] < 1 << 60]
        return found

    @staticmethod
    def _advance(cursor: list, item: int) -> None:
        if cursor[0] >= item:
            return
        at, postings, blocks = cursor[1], cursor[2], cursor[3]
        number = at // BLOCK
        while number < len(blocks) and blocks[number][0] < item:
            number += 1
        at = max(at, number * BLOCK)
        while at < len(postings) and postings[at][0] < item:
            at += 1
        cursor[0], cursor[1] = (postings[at][0] if at < len(postings) else 1 << 60), at

    def search(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """For each text the leaked (item_id, score, question overlap, answer overlap), the best passage of each item."""
        out: list[list[tuple[int, float, float, float]]] = [[] for _ in texts]
        if not self.ids:
            return out
        words, counts = word_hashes(texts)
        ends = np.cumsum(counts)
        begins = ends - counts
        at, terms = self.term_numbers(words)
        # Half passages are numbered through, with an unused number before and behind each text's.
        halves = -(-counts // self.longest) + 1
        first = np.cumsum(halves) - halves + 1
        text = np.searchsorted(ends, at, side="right")
        half = first[text] + (at - begins[text]) // self.longest
        # Passage p holds the halves p and p + 1.
        n = len(self.terms)
        pairs = np.unique(np.concatenate([half * n + terms, (half - 1) * n + terms]))
        passage = pairs // n
        best: dict[tuple[int, int], tuple[int, float, float, float]] = {}
        for p in self.hopeful(passage, pairs % n).tolist():
            lo, hi = np.searchsorted(passage, [p, p + 1])
            hits = self.retrieve((pairs[lo:hi] % n).tolist())
            if not hits:
                continue
            i = int(np.searchsorted(first, p + 1, side="right")) - 1
            start = begins[i] + (p - first[i]) * self.longest
            inside = words[max(begins[i], start) : min(ends[i], start + 2 * self.longest)]
            for number, score in hits:
                question, answer = (overlap(*part, inside) for part in self.parts[number])
                if min(question, answer) >= MIN_OVERLAP:
                    row = (self.ids[number], score, question, answer)
                    if (i, number) not in best or row[1:] > best[i, number][1:]:
                        best[i, number] = row
        for (i, _), row in sorted(best.items()):
            out[i].append(row)
        return out


def build_indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", max_chars: int = INDEX_CHARS) -> Iterator[Index]:
    """Indexes over all items, one after the other, each of at most max_chars characters (or one item).

    Null texts are left out; so are items without words. Items are streamed to the driver, which holds one index's items at
    a time; the indexes themselves go to the executors as broadcasts.
    """
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    held: list[tuple[int, str]] = []
    size, built = 0, False
    for r in rows.distinct().sort("i", "t").toLocalIterator():
        if held and size + len(r.t) > max_chars:
            yield Index(held)
            held, size, built = [], 0, True
        held.append((r.i, r.t))
        size += len(r.t)
    if held or not built:
        yield Index(held)


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, item_id, score, question_overlap, answer_overlap) for each document and test item that leaked into it.

    Every passage of every whole text is a query against all items. Null and empty texts have no leaks; null ids stay
    null; repeated rows repeat their leaks; equal items under several ids all count; other columns are ignored; without
    documents or items the result is empty.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for index in build_indexes(items):
        found = docs.mapInArrow(_finder(df.sparkSession.sparkContext.broadcast(index)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64()] + [pa.float64()] * 3
        for part in slices(batches, "text", SLICE):
            ids = part.column("doc_id").to_pylist()
            rows = [(i, *leak) for i, leaks in zip(ids, shipped.value.search([t or "" for t in part.column("text").to_pylist()]), strict=True) for leak in leaks]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return frugal(run)


def drop_leaks(df: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text holds no leaked item, all columns as they are; nothing is shuffled.

    Null and empty texts stay, as do null ids and repeated rows; without items all rows stay; an empty table stays empty.
    """
    out = df
    for index in build_indexes(items):
        shipped = df.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col, SLICE):
                leaks = shipped.value.search([t or "" for t in part.column(text_col).to_pylist()])
                yield part.filter(pa.array([not x for x in leaks], pa.bool_()))

        out = out.mapInArrow(frugal(run), df.schema)
    return out
