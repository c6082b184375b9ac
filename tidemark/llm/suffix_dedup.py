"""Repeated substrings by a suffix array built with the difference-cover algorithm, distributed over content buckets.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier. All work is on windows: strings of
LENGTH bytes that start somewhere in a document.

1. Cover. In every window one k-gram is the anchor: the one whose hash is least, the leftmost on a tie. The choice
   depends on the window's bytes alone, so equal windows have equal anchors at equal offsets: the anchors are a
   difference cover that follows the content. Windows whose anchor occurs once cannot repeat and are left out.
2. Buckets. Neighbouring windows with one anchor form a segment. Equal segments of a task collapse to the earliest before
   anything is shuffled; the others mark their bytes. What is left is dealt to tasks by the anchors' hashes; all
   occurrences of a window meet in one bucket. The windows of anchors with more than HOT segments are dealt out one by
   one, by hashes of their bytes, so that no anchor makes one task long.
3. Suffix array. The suffixes of a bucket's distinct segments are sorted by the difference-cover algorithm: sampled
   triples are sorted and named, the names' string is sorted by recursion, the remaining suffixes are merged in. The
   recursion ends when names are distinct or stand for LENGTH bytes and more.
4. Neighbours in the array whose common prefix has LENGTH bytes are occurrences of one window; all but the earliest mark
   their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop_folder, frugal, partitions, slices, written
from tidemark.llm.hashing import mix, span_hashes

#: Bytes of a string that counts as repeated, and of the k-grams among which anchors are chosen.
LENGTH = 100
GRAM = 24
#: Segments of an anchor from which its windows are dealt out one by one; doubled until at most HOT_KEYS anchors are hot.
HOT = 4_000
HOT_KEYS = 100_000
#: Bits of the filter that tells tasks which anchors repeat: for each such anchor, and at most. A fuller filter lets more
#: segments pass than need to; a join then sorts these out.
FILTER_BITS = 16
MAX_FILTER_BITS = 1 << 27
#: Bytes of segments that a task holds to collapse equal ones.
HELD_BYTES = 4_000_000
#: Bytes of distinct segments that one suffix array is built over. Larger buckets are taken apart into single windows.
ARRAY_BYTES = 500_000
NULL_ID = -(2**63)

_POSITION_BITS = 23
#: Bytes of a slice: positions must fit into _POSITION_BITS.
SLICE = 500_000


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every position where there are as many."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    n = len(data)
    words = np.empty((n + 7) // 8 * 8, "<u8")
    for o in range(8):
        part = padded[o : o + (n + 7 - o) // 8 * 8]
        whole = part[: len(part) // 8 * 8].view("<u8")
        words[o::8][: len(whole)] = whole
    words = words[:n]
    m = n - GRAM + 1
    h = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    for o in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[o : o + m]
        h *= np.uint64(0xD6E8FEB86659FD93)
    return mix(h)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of x[i : i + w] for every i."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have : w - have + len(x) - w + 1])


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, number of windows, anchor hash) of every segment, in order, over one slice of texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    if len(data) >= 1 << _POSITION_BITS:
        return _long_segments(texts)
    hashes = _gram_hashes(data)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_window_min(keys, LENGTH - GRAM + 1) & low).astype(np.int64)
    stops = np.cumsum(lengths)
    valid = np.zeros(len(anchor) + 1, bool)
    for start, stop in zip((stops - lengths).tolist(), (stops - LENGTH + 1).tolist(), strict=True):
        valid[start : max(start, stop)] = True
    valid = valid[:-1] if len(valid) > len(anchor) else valid
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    ends = np.flatnonzero(last)
    number = np.searchsorted(stops, starts, side="right")
    return number, starts - (stops - lengths)[number], ends - starts + 1, hashes[anchor[starts]]


def _long_segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same where a text is too long for one slice: in overlapping pieces. A segment that is cut is two segments."""
    out = []
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), SLICE):
            _, start, count, anchor = segments([text[at : at + SLICE + LENGTH - 1]])
            out.append((np.full(len(start), number), start + at, count, anchor))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Names from 1 on for the keys, in their order, and how many differ."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = ordered[1:] != ordered[:-1]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_ranks(s: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The rank of every suffix of s (values from 1 on) among all, by the difference-cover algorithm; suffixes that agree
    on depth values and more may be ordered either way."""
    n = len(s)
    if n < 3:
        return _few(s)
    padded = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    most = int(padded.max()) + 1
    if most > 2_000_000:
        padded[:n], most = _dense(padded[:n])
        most += 1
    # Sort the sampled triples and name them. With n divisible by 3 left over, an empty sample ends the first class.
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    padded = np.concatenate([padded, np.zeros(3, np.int64)])
    names, distinct = _dense((padded[sample] * most + padded[sample + 1]) * most + padded[sample + 2])
    if distinct < len(sample) and depth > 3:
        # Recurse on the names: first those of the class 1, then those of the class 2.
        names = suffix_ranks(names, -(-depth // 3)) + 1
    rank = np.zeros(n + 6, np.int64)
    rank[sample] = names
    # Merge the remaining suffixes: each is compared with the class 1 by one value and a rank, with the class 2 by two.
    rest = np.arange(0, n, 3)
    width = int(rank.max()) + 2
    rest = rest[np.argsort(padded[rest] * width + rank[rest + 1], kind="stable")]
    ordered = sample[np.argsort(names, kind="stable")]
    ordered = ordered[ordered < n]
    in_one, in_two = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    by_one = np.searchsorted(_rising(padded[in_one] * width + rank[in_one + 1]), padded[rest] * width + rank[rest + 1])
    pair = lambda i: (padded[i] * most + padded[i + 1]) * width + rank[i + 2]
    by_two = np.searchsorted(_rising(pair(in_two)), pair(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + by_one + by_two
    taken = np.zeros(n, bool)
    # Where ties are left open two places could clash; the rest moves on in order.
    place = np.maximum.accumulate(place - np.arange(len(rest))) + np.arange(len(rest))
    taken[place] = True
    out[rest] = place
    out[ordered] = np.flatnonzero(~taken)
    return out


def _rising(keys: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(keys) if len(keys) else keys


def _few(s: np.ndarray) -> np.ndarray:
    suffixes = [tuple(s[i:].tolist()) for i in range(len(s))]
    order = sorted(suffixes)
    return np.array([order.index(x) for x in suffixes], np.int64)


def repeated_windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of every window in the parts, laid end to end with one value between two; equal windows have one class.

    Positions are in the laid-out text. Windows are told apart by the suffix array: neighbours are compared on LENGTH bytes.
    """
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\x00".join(parts) + b"\x00", np.uint8)
    text = data.astype(np.int64) + 2
    text[starts + lengths] = 1
    rank = suffix_ranks(text)
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + np.maximum(lengths - LENGTH + 1, 0), -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    windows = windows[np.argsort(rank[windows], kind="stable")]
    same = np.zeros(len(windows), bool)
    for at in range(1, len(windows), 20_000):
        stop = min(len(windows), at + 20_000)
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        rows = view[windows[at - 1 : stop]]
        same[at:stop] = (rows[1:] == rows[:-1]).all(axis=1)
    return windows, np.cumsum(~same)


Segment = tuple[int, int, int, int]  # id, text hash, first window, number of windows
Mark = tuple[int, int, int, int]  # id, text hash, first byte to remove, byte after the last


def whole(owner: Segment) -> Mark:
    """The mark of all bytes of a segment."""
    i, h, start, count = owner
    return i, h, start, start + count - 1 + LENGTH


class Distinct:
    """Distinct contents, each with its earliest owner; add returns the owner that comes later, if it repeats another one."""

    def __init__(self) -> None:
        self.first: dict[bytes, Segment] = {}

    def add(self, owner: Segment, content: bytes) -> Segment | None:
        known = self.first.setdefault(content, owner)
        # A row that stands twice has one owner twice and does not repeat itself.
        if owner == known:
            return None
        if owner < known:
            self.first[content] = owner
            return known
        return owner


def single_windows(owners: list[Segment], contents: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of the segment, position in it) of every window."""
    counts = np.fromiter((o[3] for o in owners), np.int64, len(owners))
    lengths = counts + LENGTH - 1
    number = np.repeat(np.arange(len(owners)), counts)
    position = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(lengths) - lengths)[number] + position
    return span_hashes(np.frombuffer(b"".join(contents), np.uint8), starts, starts + LENGTH).view(np.int64), number, position


def taken_apart(first: dict[bytes, Segment]) -> Iterator[Mark]:
    """Marks for a bucket whose distinct segments are too many for one suffix array: their windows meet one by one, a
    share of the windows' hashes at a time."""
    items = list(first.items())
    shares = -(-sum(o[3] for _, o in items) // (ARRAY_BYTES // LENGTH))
    for share in range(shares):
        windows = Distinct()
        for at in range(0, len(items), 2_000):
            contents, owners = map(list, zip(*items[at : at + 2_000], strict=True))
            keys, number, position = single_windows(owners, contents)
            mine = np.flatnonzero(keys.view(np.uint64) % np.uint64(shares) == share)
            for n, p in zip(number[mine].tolist(), position[mine].tolist(), strict=True):
                i, h, start, _ = owners[n]
                again = windows.add((i, h, start + p, 1), contents[n][p : p + LENGTH])
                if again is not None:
                    yield whole(again)


def bucket_marks(buckets: list[tuple[list[Segment], list[bytes]]]) -> list[Mark]:
    """What to remove, for segments that come with their bytes, bucket by bucket."""
    marks: list[Mark] = []
    held: list[dict[bytes, Segment]] = []
    size = 0
    for owners, contents in buckets:
        bucket = Distinct()
        later = (bucket.add(o, c) for o, c in zip(owners, contents, strict=True))
        marks += [whole(o) for o in later if o is not None]
        if len(bucket.first) < 2:
            continue
        n = sum(map(len, bucket.first))
        if n > 2 * ARRAY_BYTES:
            marks += taken_apart(bucket.first)
            continue
        if size + n > 2 * ARRAY_BYTES:
            marks += _array_marks(held)
            held, size = [], 0
        held.append(bucket.first)
        size += n
    return _joined(marks + _array_marks(held))


def _array_marks(buckets: list[dict[bytes, Segment]]) -> list[Mark]:
    """Marks for windows that repeat within the buckets' distinct segments, by one suffix array over all of these."""
    kept = [o for b in buckets for o in b.values()]
    parts = [c for b in buckets for c in b]
    if not parts:
        return []
    windows, classes = repeated_windows(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    offsets = np.cumsum(lengths) - lengths
    part = np.searchsorted(offsets, windows, side="right") - 1
    # The order in which the parts' windows start: id, text hash, position.
    ids = np.array([k[0] for k in kept], np.int64)[part]
    hashes = np.array([k[1] for k in kept], np.int64)[part]
    positions = windows - offsets[part] + np.array([k[2] for k in kept], np.int64)[part]
    order = np.lexsort((positions, hashes, ids, classes))
    later = np.zeros(len(order), bool)
    later[1:] = classes[order][1:] == classes[order][:-1]
    # The same window of the same document can be in two segments of one bucket only where a row repeats.
    first_of = np.maximum.accumulate(np.where(later, 0, np.arange(len(order))))
    same_as_first = (ids[order] == ids[order][first_of]) & (hashes[order] == hashes[order][first_of]) & (positions[order] == positions[order][first_of])
    hit = order[later & ~same_as_first]
    return _runs(ids[hit], hashes[hit], positions[hit])


def _joined(marks: list[Mark]) -> list[Mark]:
    """The marks with those that overlap or touch made one."""
    out: list[Mark] = []
    for i, h, start, stop in sorted(marks):
        if out and out[-1][:2] == (i, h) and start <= out[-1][3]:
            if stop > out[-1][3]:
                out[-1] = (i, h, out[-1][2], stop)
        else:
            out.append((i, h, start, stop))
    return out


def _runs(ids: np.ndarray, hashes: np.ndarray, positions: np.ndarray) -> list[Mark]:
    """Marks for windows, neighbours joined."""
    if not len(ids):
        return []
    order = np.lexsort((positions, hashes, ids))
    i, h, p = ids[order], hashes[order], positions[order]
    cut = np.ones(len(i), bool)
    cut[1:] = (i[1:] != i[:-1]) | (h[1:] != h[:-1]) | (p[1:] > p[:-1] + 1)
    starts = np.flatnonzero(cut)
    stops = np.append(starts[1:], len(i)) - 1
    return list(zip(i[starts].tolist(), h[starts].tolist(), p[starts].tolist(), (p[stops] + LENGTH).tolist(), strict=True))


def _rows_of(part: pa.RecordBatch) -> tuple[list[int], list[int], list[bytes]]:
    return part.column("id").to_pylist(), part.column("h").to_pylist(), [(t or "").encode() for t in part.column("text").to_pylist()]


class AnchorFilter:
    """Says of anchor hashes whether they may repeat: two bits for each repeated one, in blocks of 32,768 bits."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = np.uint64(bits - 1)
        self.data = np.zeros(bits // 8, np.uint8)
        for number, content in blocks.items():
            self.data[number * 4096 : number * 4096 + len(content)] = np.frombuffer(content, np.uint8)

    def _has(self, x: np.ndarray) -> np.ndarray:
        x = x & self.bits
        return self.data[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1 == 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(hashes) & self._has(hashes >> np.uint64(32))


def _anchor_filter(repeated: DataFrame, n: int) -> AnchorFilter:
    """Of at most MAX_FILTER_BITS bits."""
    bits = min(MAX_FILTER_BITS, max(1 << 15, 1 << (max(1, n * FILTER_BITS) - 1).bit_length()))
    last = F.lit(bits - 1).cast("long")
    at = repeated.select(F.explode(F.array(F.col("a").bitwiseAND(last), F.shiftrightunsigned("a", 32).bitwiseAND(last))).alias("i"))
    blocks = at.groupBy(F.expr("i div 32768").alias("block")).agg(F.bitmap_construct_agg(F.expr("i % 32768")).alias("content"))
    return AnchorFilter(bits, {r["block"]: bytes(r["content"]) for r in blocks.toLocalIterator()})


_ROW = "a long, id long, h long, start long, count int, bytes binary"


def _rows(keys: list, owners: list[Segment], contents: list) -> pa.RecordBatch:
    columns = list(zip(*owners, strict=True)) if owners else [[]] * 4
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    arrays = [pa.array(keys, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array(contents, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "id", "h", "start", "count", "bytes"])


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, str]:
    """id, h, start, stop: bytes to remove (spans may overlap), for docs with the columns id (not null), h, text; and the
    folder that holds them."""
    spark = docs.sparkSession
    sc = spark.sparkContext

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(segments(_rows_of(part)[2])[3].view(np.int64))], names=["a"])

    counts = docs.mapInArrow(frugal(anchors), "a long").groupBy("a").agg(F.count("*").alias("n")).filter("n > 1")
    repeated, repeated_path = written(counts, "anchors")
    n = repeated.count()
    limit = hot
    while repeated.filter(F.col("n") > limit).count() > HOT_KEYS:
        limit *= 2
    hot_keys = sc.broadcast(np.sort(np.array([r["a"] for r in repeated.filter(F.col("n") > limit).select("a").limit(HOT_KEYS).collect()], np.int64)))
    shipped = sc.broadcast(_anchor_filter(repeated, n))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct segments with their bytes, and without bytes the segments that repeat one of them."""
        held, keys, size = Distinct(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            cold = [(keys[c], o, c) for c, o in held.first.items() if keys[c] is not None]
            if cold:
                yield _rows(*map(list, zip(*cold, strict=True)))
            warm = [(o, c) for c, o in held.first.items() if keys[c] is None]
            for at in range(0, len(warm), 200):
                owners, contents = map(list, zip(*warm[at : at + 200], strict=True))
                dealt, number, position = single_windows(owners, contents)
                singles = [(*owners[k][:2], owners[k][2] + p, 1) for k, p in zip(number.tolist(), position.tolist(), strict=True)]
                yield _rows(dealt, singles, [contents[k][p : p + LENGTH] for k, p in zip(number.tolist(), position.tolist(), strict=True)])

        for part in slices(batches, "text", SLICE):
            ids, hashes, texts = _rows_of(part)
            number, start, count, anchor = segments(texts)
            pick = np.flatnonzero(shipped.value(anchor))
            found = anchor.view(np.int64)[pick]
            warm = np.isin(found, hot_keys.value)
            later: list[Segment] = []
            for x, s, c, a, w in zip(number[pick].tolist(), start[pick].tolist(), count[pick].tolist(), found.tolist(), warm.tolist(), strict=True):
                content = texts[x][s : s + c - 1 + LENGTH]
                again = held.add((ids[x], hashes[x], s, c), content)
                if again is not None:
                    later.append(again)
                elif content not in keys:
                    keys[content] = None if w else a
                    size += len(content)
            if later:
                # Marks need no bucket; they are dealt evenly.
                yield _rows([i ^ h ^ s for i, h, s, _ in later], later, [None] * len(later))
            if size > HELD_BYTES:
                yield from flush()
                held, keys, size = Distinct(), {}, 0
        yield from flush()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[Mark]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [[]] * 4)], names=["id", "h", "start", "stop"])

        key, buckets, size = None, [], 0
        for batch in batches:
            marks: list[Mark] = []
            for a, i, h, start, count, content in zip(*(batch.column(c).to_pylist() for c in ("a", "id", "h", "start", "count", "bytes")), strict=True):
                if content is None:
                    marks.append(whole((i, h, start, count)))
                    continue
                if a != key or not buckets:
                    if size >= ARRAY_BYTES:
                        yield packed(bucket_marks(buckets))
                        buckets, size = [], 0
                    key = a
                    buckets.append(([], []))
                buckets[-1][0].append((i, h, start, count))
                buckets[-1][1].append(content)
                size += len(content)
            if marks:
                yield packed(_joined(marks))
        if buckets:
            yield packed(bucket_marks(buckets))

    rows = docs.mapInArrow(frugal(collect), _ROW)
    if n * FILTER_BITS > MAX_FILTER_BITS:
        # The windows of hot anchors and the marks have other keys; there are no others that the filter let pass wrongly.
        known = repeated.filter(F.col("n") <= limit).select("a")
        cold = rows.filter("bytes IS NOT NULL AND count > 1")
        rows = rows.filter("bytes IS NULL OR count = 1").unionByName(cold.join(known, "a", "left_semi"))
    dealt = rows.repartition(partitions(spark), "a").sortWithinPartitions("a")
    spans, spans_path = written(dealt.mapInArrow(frugal(mark), "id long, h long, start long, stop long"), "spans")
    drop_folder(spark, repeated_path)
    return spans, spans_path


def _with_spans(df: DataFrame, id_col: str, text_col: str, hot: int) -> DataFrame:
    """The rows of df as struct r, with their text (never null) and spans to remove (null if none)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    # Rows without an id are told from those whose id is NULL_ID by their hashes.
    own = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col).cast("string"), F.lit("no id"))).otherwise(F.xxhash64(F.col(text_col).cast("string")))
    spans, _ = repeated_spans(df.select(key.alias("id"), own.alias("h"), text.alias("text")), hot)
    # A document's spans are as many as its bytes at most.
    gathered = spans.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = df.select(F.struct(*df.columns).alias("r"), key.alias("id"), own.alias("h")).join(gathered, ["id", "h"], "left")
    return rows.select("r", F.coalesce(F.col(f"r.{text_col}").cast("string"), F.lit("")).alias("text"), "spans")


def _cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) for spans that may overlap or touch."""
    kept, removed, runs, stop = [], 0, 0, -1
    for start, end in sorted((s["start"], s["stop"]) for s in spans or ()):
        if start > stop:
            runs += 1
            kept.append(data[max(stop, 0) : start])
            removed += end - start
        else:
            removed += max(0, end - stop)
        stop = max(stop, end)
    kept.append(data[max(stop, 0) :])
    return b"".join(kept), removed, runs


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left) for every row of df.

    A null text counts as empty. A null id comes before all others. Rows that repeat an id with one text are one
    document: they do not repeat each other and share their result. Rows with one id and different texts are ordered by
    a hash of the text. Other columns are ignored; an empty table gives an empty result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc_id, text, found in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                data = text.encode()
                kept, removed, runs = _cut(data, found)
                rows.append((doc_id, len(data), removed, runs, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    only = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _with_spans(only, "doc_id", "text", hot).select(F.col("r.doc_id").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(frugal(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The rows of df with the repeats cut out of their texts; nulls stay null, other columns stay as they are.

    Where a cut goes through a character, the character's remaining bytes go too, so that the text stays text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [
                _cut(text.encode(), found)[0].decode("utf-8", "ignore") if found else text
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column("r"), pa.array(texts, pa.string())], names=["r", "cut"])

    rows = _with_spans(df, id_col, text_col, hot)
    was_null = F.col(f"r.{text_col}").isNull()
    slim = rows.select(F.struct(F.col("r").dropFields(text_col).alias("rest"), was_null.alias("was_null")).alias("r"), "text", "spans")
    out = slim.mapInArrow(frugal(cut), f"r {slim.schema['r'].dataType.simpleString()}, cut string")
    text = F.when(~F.col("r.was_null"), F.col("cut"))
    return out.select(*(text.alias(c) if c == text_col else F.col(f"r.rest.{c}").alias(c) for c in df.columns))
