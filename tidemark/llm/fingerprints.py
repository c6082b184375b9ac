"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; a long one is cut further at places that depend on the letters just before, so that
an edit changes the pieces around it alone. Each piece's digest goes into one cell of every third of a sketch (how
often, sum of digests, sum of check values). The cells of a third are a power of two: a sketch folds into all smaller
ones. Two versions' sketches are folded and subtracted cell by cell; peeling cells that hold one digest recovers the
digests in which the versions differ. Where peeling gets stuck, larger foldings are tried. A published sketch is large
enough to peel to nothing by itself, so that any two of them tell their difference in the end.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, partitions, slices
from tidemark.llm.hashing import mix

#: Cells of a third of the smallest sketch, and how much larger the next folding is after a failure.
THIRD = 4
GROWTH = 4
#: Cells of a third for each digest, from which a sketch's size is tried.
LOAD = 0.45
#: Characters of a paragraph that is not cut, mean length of a piece of a longer one, and characters that decide on a cut.
LONG = 160
MEAN = 96
_REACH = 16

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Check values are summed modulo 2**32.
_LOW = np.uint64(0xFFFFFFFF)


def pieces(text: str) -> list[str]:
    """The paragraphs, with their line ends, long ones in several pieces; together they are the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = np.concatenate([[0], np.flatnonzero(codes == 10) + 1, [len(codes)]])
    lengths = np.diff(bounds)
    if (lengths > LONG).any():
        h = codes.astype(np.uint64)
        step = 1
        while step < _REACH:
            h = h * (_GOLDEN + np.uint64(2 * step)) + np.concatenate([np.zeros(step, np.uint64), h])[: len(h)]
            step *= 2
        cuts = np.flatnonzero(mix(h) % np.uint64(MEAN) == 0)
        line = np.searchsorted(bounds, cuts, side="right") - 1
        cuts = cuts[(lengths[line] > LONG) & (cuts - bounds[line] >= _REACH)] + 1
        bounds = np.union1d(bounds, cuts)
    at = bounds.tolist()
    return [text[i:j] for i, j in zip(at, at[1:], strict=False) if i < j]


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the text's pieces, in ascending order; the k-th copy of a piece has a digest of its own."""
    hashes = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in pieces(text)], np.uint64)
    hashes.sort()
    if len(hashes) > 1:
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        copy = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
        if copy.any():
            hashes = np.sort(np.where(copy > 0, mix(hashes + copy.astype(np.uint64) * _GOLDEN), hashes))
    return hashes


def _checks(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA5A5A5A55A5A5A5A)) & _LOW


class Sketches:
    """Sketches of several documents or differences, side by side; thirds has the cells of a third of each."""

    def __init__(self, thirds: np.ndarray):
        self.thirds = thirds.astype(np.int64)
        self.starts = np.cumsum(3 * self.thirds) - 3 * self.thirds
        size = int(3 * self.thirds.sum())
        self.owners = np.repeat(np.arange(len(thirds)), 3 * self.thirds)
        self.counts = np.zeros(size, np.int64)
        self.keys = np.zeros(size, np.uint64)
        self.checks = np.zeros(size, np.uint64)

    def _put(self, at: np.ndarray, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        np.add.at(self.counts, at, counts)
        np.add.at(self.keys, at, keys)
        np.add.at(self.checks, at, checks)

    def add(self, owners: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        """Add (sign 1) or take away (sign -1) digests."""
        signed = sign.astype(np.uint64)  # modulo 2**64
        checks = _checks(keys) * signed
        third = self.thirds[owners]
        for j in range(3):
            cell = (mix(keys + np.uint64((j + 1) * int(_GOLDEN) % 2**64)) & (third - 1).astype(np.uint64)).astype(np.int64)
            self._put(self.starts[owners] + j * third + cell, sign, keys * signed, checks)

    def folded(self, chosen: np.ndarray, third: int) -> Sketches:
        """The chosen sketches with thirds of so many cells, at most as many as they have."""
        out = Sketches(np.full(len(chosen), third))
        sizes = 3 * self.thirds[chosen]
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(chosen)), sizes)
        cell = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        own = self.thirds[chosen][owner]
        at = self.starts[chosen][owner] + cell
        out._put(3 * third * owner + cell // own * third + cell % own % third, self.counts[at], self.keys[at], self.checks[at])
        return out

    def picked(self, chosen: np.ndarray) -> Sketches:
        """The chosen sketches in their own sizes."""
        out = Sketches(self.thirds[chosen])
        sizes = 3 * self.thirds[chosen]
        at = np.arange(len(out.counts)) + np.repeat(self.starts[chosen] - out.starts, sizes)
        out.counts, out.keys, out.checks = self.counts[at], self.keys[at], self.checks[at]
        return out

    def subtract(self, other: Sketches) -> None:
        self.counts -= other.counts
        self.keys -= other.keys
        self.checks -= other.checks

    def peel(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For each owner the digests recovered with sign 1 and with sign -1, ascending; and which sketches came out whole."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # A sketch of differences that don't peel could go in circles; a digest more than there are cells is one.
        for _ in range(len(self.counts) + 1):
            at = np.flatnonzero(np.abs(self.counts) == 1)
            sign = self.counts[at]
            keys = self.keys[at] * sign.astype(np.uint64)
            pure = ((_checks(keys) * sign.astype(np.uint64) - self.checks[at]) & _LOW) == 0
            at, sign, keys = at[pure], sign[pure], keys[pure]
            if not len(at):
                break
            owners = self.owners[at]
            # A digest that is alone in two or three of its cells is taken once.
            order = np.lexsort((keys, owners))
            owners, keys, sign = owners[order], keys[order], sign[order]
            new = np.ones(len(owners), bool)
            new[1:] = (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1])
            owners, keys, sign = owners[new], keys[new], sign[new]
            found.append((owners, keys, sign))
            self.add(owners, keys, -sign)
        whole = np.ones(len(self.thirds), bool)
        whole[self.owners[(self.counts != 0) | (self.keys != 0) | (self.checks & _LOW != 0)]] = False
        empty = np.zeros(0, np.int64)
        owners, keys, signs = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (empty, empty.astype(np.uint64), empty)
        sides = []
        for side in (1, -1):
            o, k = owners[signs == side], keys[signs == side]
            order = np.lexsort((k, o))
            sides.append(np.split(k[order], np.cumsum(np.bincount(o, minlength=len(self.thirds)))[:-1]))
        return sides[0], sides[1], whole

    def text(self, owner: int, size: int) -> str:
        """The published form: number of digests, cells, and each cell's count, digest sum and check sum."""
        cut = slice(int(self.starts[owner]), int(self.starts[owner] + 3 * self.thirds[owner]))
        body = self.counts[cut].astype("<i2").tobytes() + self.keys[cut].astype("<u8").tobytes() + self.checks[cut].astype("<u4").tobytes()
        return f"{size}.{3 * self.thirds[owner]}.{base64.b64encode(body).decode()}"

    @staticmethod
    def from_texts(fingerprints: list[str]) -> tuple[Sketches, np.ndarray]:
        """The sketches and numbers of digests behind published fingerprints."""
        cut = [f.split(".", 2) for f in fingerprints]
        out = Sketches(np.array([int(cells) // 3 for _, cells, _ in cut], np.int64))
        for start, (_, cells, body) in zip(out.starts.tolist(), cut, strict=True):
            raw, n = base64.b64decode(body), int(cells)
            out.counts[start : start + n] = np.frombuffer(raw, "<i2", n)
            out.keys[start : start + n] = np.frombuffer(raw, "<u8", n, 2 * n)
            out.checks[start : start + n] = np.frombuffer(raw, "<u4", n, 10 * n)
        return out, np.array([int(size) for size, _, _ in cut], np.int64)


def _filled(sets: list[np.ndarray], thirds: np.ndarray) -> Sketches:
    out = Sketches(thirds)
    if sets:
        owners = np.repeat(np.arange(len(sets)), list(map(len, sets)))
        out.add(owners, np.concatenate(sets), np.ones(len(owners), np.int64))
    return out


def sketch(sets: list[np.ndarray]) -> Sketches:
    """Sketches of digest sets, each the smallest from LOAD on that peels to nothing."""
    thirds = np.array([max(THIRD, 1 << max(0, int(np.ceil(LOAD * len(s))) - 1).bit_length()) for s in sets], np.int64)
    todo = np.arange(len(sets))
    while len(todo):
        _, _, whole = _filled([sets[i] for i in todo], thirds[todo]).peel()
        todo = todo[~whole]
        thirds[todo] *= 2
    return _filled(sets, thirds)


def differences(left: Sketches, right: Sketches) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sketches the digests only in the left and only in the right one, by foldings of growing size. Where
    the smaller sketch's own size is not enough either, both are peeled by themselves."""
    out: list = [None] * len(left.thirds)
    most = np.minimum(left.thirds, right.thirds)
    todo, third = np.arange(len(out)), THIRD
    while len(todo):
        tried = todo[most[todo] >= third]
        alone = todo[most[todo] < third]
        if len(alone):
            mine, _, _ = left.picked(alone).peel()
            theirs, _, _ = right.picked(alone).peel()
            for i, a, b in zip(alone.tolist(), mine, theirs, strict=True):
                out[i] = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
        if not len(tried):
            break
        diff = left.folded(tried, third)
        diff.subtract(right.folded(tried, third))
        only_left, only_right, whole = diff.peel()
        for j in np.flatnonzero(whole).tolist():
            out[tried[j]] = only_left[j], only_right[j]
        todo, third = tried[~whole], third * GROWTH
    return out


def likeness(sizes: tuple[int, int], difference: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity from the sizes and the recovered difference; 1 for two empty texts."""
    shared = sizes[0] - len(difference[0])
    union = shared + len(difference[0]) + len(difference[1])
    return shared / union if union else 1.0


def compare(left: list[str], right: list[str]) -> list[float]:
    """The likeness of each pair of published fingerprints, from these alone."""
    (a, n), (b, m) = Sketches.from_texts(left), Sketches.from_texts(right)
    return [likeness(sizes, d) for sizes, d in zip(zip(n.tolist(), m.tolist(), strict=True), differences(a, b), strict=True)]


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(bounds: list[int]) -> Column:
    """The number of bounds up to the id, by a binary search over them; 0 for a null id."""
    held = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, ids.to_numpy(), side="right").astype(np.int32))

    return F.when(F.col("id").isNull(), F.lit(0)).otherwise(place(F.coalesce(F.col("id"), F.lit(0))))


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows (p, tail, id, h, text) such that sorted within p by (tail, id, h) every row but the last is followed by the
    next document; the last one (tail) is a copy of the first row of the next p, and of the first document for the last p."""
    spark = docs.sparkSession
    number = 4 * partitions(spark)
    at = docs.agg(F.percentile_approx("id", [i / number for i in range(1, number)], 100 * number), F.min("id"), F.count_if(F.col("id").isNull())).first()
    bounds = sorted(set(at[0] or []) - {at[1]})
    part = _range_of(bounds) if bounds else F.lit(0)
    heads = [*bounds, *([at[1]] if at[1] is not None and not at[2] else [])]
    chosen = F.col("id").isin(heads) if heads else F.lit(False)
    if at[2]:
        chosen = chosen | F.col("id").isNull()
    first = docs.filter(chosen).groupBy("id").agg(F.min(F.struct("h", "text")).alias("r")).select("id", "r.h", "r.text")
    head = F.when(F.col("id").isNull() | (F.col("id") == F.lit(at[1])) if not at[2] else F.col("id").isNull(), F.lit(len(bounds))).otherwise(part - 1)
    tails = first.select(head.alias("p"), F.lit(1).alias("tail"), "id", "h", "text")
    return docs.select(part.alias("p"), F.lit(0).alias("tail"), "id", "h", "text").unionByName(tails)


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of df.

    Every document is fingerprinted, its edited text (see edited) and the next document by ascending id (after the last,
    the first). A null text counts as empty; a null id comes before all others; rows with one id are ordered by a hash
    of their texts, then by the texts. Only one document: it is its own next. Other columns are ignored; an empty table
    gives an empty result. Documents are dealt to tasks by ranges of ids, each with a copy of the next range's first.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def packed(rows: list[tuple[int | None, str]], last: str) -> pa.RecordBatch:
        """rows: documents in order; last: the text that follows them."""
        texts = [t for _, t in rows] + [last]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        sets = [digests(t) for t in texts] + [digests(t) for t in changed]
        sizes, n = list(map(len, sets)), len(rows)
        prints = sketch(sets)
        own, other = np.tile(np.arange(n), 2), np.concatenate([n + 1 + np.arange(n), 1 + np.arange(n)])
        found = differences(prints.picked(own), prints.picked(other))
        near = [likeness((sizes[a], sizes[b]), d) for a, b, d in zip(own.tolist(), other.tolist(), found, strict=True)]
        columns = [
            [i for i, _ in rows],
            [len(t) for _, t in rows],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            [prints.text(i, sizes[i]) for i in range(n)],
            [prints.text(n + 1 + i, sizes[n + 1 + i]) for i in range(n)],
            near[:n],
            near[n:],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        at = None
        for part in slices(batches, "text"):
            for p, tail, i, text in zip(*(part.column(c).to_pylist() for c in ("p", "tail", "id", "text")), strict=True):
                if tail:
                    if held and p == at:
                        yield packed(held, text)
                    held = []
                else:
                    at = p
                    held.append((i, text))
            if len(held) > 1:
                yield packed(held[:-1], held[-1][1])
                held = held[-1:]

    dealt = _dealt(docs).repartition(partitions(df.sparkSession), "p").sortWithinPartitions("p", "tail", F.asc_nulls_first("id"), "h", "text")
    return dealt.drop("h").mapInArrow(frugal(run), SCHEMA)
