"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard verification.

One permutation scrambles the shingles of a document; a second one, shifted circularly by k, gives the k-th signature
coordinate as the least value over the set. Both permutations are bijections of 32-bit values. Signatures are cut into
bands; documents that share a band are candidates.

Documents with equal shingle sets form a class and are represented by their smallest id, so copies cost no candidates.
In a bucket every member is first compared with a centre (a star, not all pairs): the member that shares buckets with
most others. Members that the links so far leave in another component than most of the bucket are then, in blocks,
compared with the members of other components, unless the sets' sizes by ranges of hashes show that they can't share
enough; so no link of a bucket is lost. Links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop_folder, frugal, partitions, slices, written
from tidemark.llm.components import components
from tidemark.llm.hashing import mix, shingle_sets

#: 24 bands of 3 coordinates: of pairs at a similarity of 0.8, one in 30 million shares no band.
BANDS = 24
ROWS = 3
SIZE = 4
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Classes of more documents than this, and than the table's rows divided by HOT_CLASSES, are joined by a broadcast.
HOT = 10_000
HOT_CLASSES = 50_000
#: Candidates that one copy of a centre's text is compared with.
GROUP = 64
#: Ranges of hashes that a set's sizes are told by.
BINS = 256
#: Members outside a bucket's main component, and members, that one task compares; and the same for fetched texts.
BLOCK = 1_024
TEXT_BLOCK = 256

_SIGMA = np.uint32(0x85EBCA6B)


def _permuted(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of circulant MinHash coordinates for each non-empty set."""
    if not sets:
        return np.zeros((0, coordinates), np.uint32)
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(lengths) - lengths
    first = _permuted((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) * _SIGMA)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        # Shifting the second permutation by k is the same as shifting what it is applied to.
        out[:, k] = np.minimum.reduceat(_permuted(first + np.uint32(k)), starts)
    return out


def sizes_by_range(s: np.ndarray) -> np.ndarray:
    """How many of a set's hashes are in each of BINS ranges; 255 everywhere if some range has as many or more."""
    sizes = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=BINS)
    return np.full(BINS, 255, np.uint8) if sizes.max() >= 255 else sizes.astype(np.uint8)


def may_link(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of two lists, given by their sizes by ranges (rows) and sizes, could be similar enough: False only where
    what they share at most, range by range, is too little."""
    shared = np.minimum(left[:, None, :], right[None, :, :]).sum(axis=2, dtype=np.int64)
    unknown = (left[:, 0] == 255)[:, None] | (right[:, 0] == 255)[None, :]
    least = np.minimum(n_left[:, None], n_right[None, :])
    shared = np.where(unknown, least, shared)
    return 100 * shared >= percent * (n_left[:, None] + n_right[None, :] - shared)


def _profile(df: DataFrame, size: int) -> DataFrame:
    """id, n (set size), s1 and s2 (128 bits that name the set; null if empty), bands (a 64-bit key each), brief (see briefs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full])
            keys = np.zeros((len(full), BANDS), np.uint64)
            for b in range(BANDS):
                key = np.full(len(full), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r])
                keys[:, b] = key
            names = np.zeros((len(sets), 2), np.uint64)
            for i in full:
                with np.errstate(over="ignore"):
                    names[i] = mix(sets[i]).sum(dtype=np.uint64), mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            empty = np.array([not len(s) for s in sets], bool)
            bands: list = [None] * len(sets)
            brief: list = [None] * len(sets)
            for row, i in enumerate(full):
                bands[i] = keys[row].view(np.int64)
                brief[i] = sizes_by_range(sets[i]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(names[:, 0].view(np.int64), mask=empty),
                    pa.array(names[:, 1].view(np.int64), mask=empty),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(brief, pa.binary()),
                ],
                names=["id", "n", "s1", "s2", "bands", "brief"],
            )

    return df.mapInArrow(frugal(run), "id long, n long, s1 long, s2 long, bands array<long>, brief binary")


def _verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough.

    Texts are fetched by one join. A centre (a) is dealt out with its candidates in groups of about GROUP, each with one
    copy of the centre's text, so that a centre with very many candidates is shared among tasks.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    dealt = pairs.join(counts, "a").withColumn("g", F.pmod(F.xxhash64("b"), F.col("groups")))
    asked = dealt.select(F.col("b").alias("id"), "a", "g", F.lit(1).alias("kind")).unionByName(
        dealt.select(F.col("a").alias("id"), "a", "g", F.lit(0).alias("kind")).distinct()
    )
    rows = docs.join(asked, "id").select("a", "g", "kind", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, []
        for part in slices(batches, "text"):
            sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)
            out_a, out_b = [], []
            for a, g, kind, b, s in zip(*(part.column(c).to_pylist() for c in ("a", "g", "kind", "id")), sets, strict=True):
                if kind == 0:
                    # An id that names several texts has several sets.
                    held = [*held, s] if centre == (a, g) else [s]
                    centre = (a, g)
                elif centre == (a, g):
                    shared = [(len(np.intersect1d(h, s, assume_unique=True)), len(h) + len(s)) for h in held]
                    if any(100 * both >= percent * (all_ - both) for both, all_ in shared):
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.repartition(partitions(docs.sparkSession), "a", "g").sortWithinPartitions("a", "g", "kind").mapInArrow(frugal(run), "a long, b long")


def _possible(split: DataFrame, briefs: DataFrame, percent: int) -> DataFrame:
    """main, id, component, outsider: the members of split buckets that may link an outsider, and these outsiders.

    In each bucket the outsiders are compared with all members of other components, BLOCK of the ones with BLOCK of the
    others at a time, so that a large bucket is dealt to many tasks; pairs are not put out.
    """
    rows = split.join(briefs.join(split.select("id").distinct(), "id", "left_semi").distinct(), "id")
    rows = rows.withColumn("groups", F.ceil(F.col("size") / BLOCK).cast("int"))
    blocks = F.ceil(F.col("outside") / BLOCK).cast("int")
    own = F.xxhash64("id")
    outsiders = rows.filter("component <> main").select(
        "*", F.pmod(own, blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(0).alias("kind")
    )
    everyone = rows.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(own, F.col("groups")).cast("int").alias("group"), F.lit(1).alias("kind"))
    dealt = outsiders.unionByName(everyone).repartition(partitions(split.sparkSession), "key", "block", "group").sortWithinPartitions("key", "block", "group", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []
        known: tuple | None = None
        for batch in batches:
            out: set[tuple[int, int, int, bool]] = set()
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("key", "block", "group", "kind", "id", "component", "main", "n", "brief")), strict=True))
            i = 0
            while i < len(rows):
                place, kind = rows[i][:3], rows[i][3]
                if place != at:
                    at, held, known = place, [], None
                j = i
                while j < len(rows) and rows[j][:4] == (*place, kind):
                    j += 1
                part = [r[4:] for r in rows[i:j]]
                i = j
                if kind == 0:
                    held += part
                    continue
                if not held:
                    continue
                known = known or _laid_out(held)
                main = part[0][2]
                for start in range(0, len(part), 32):
                    some = part[start : start + 32]
                    components, n, signs = _laid_out(some)
                    near = may_link(known[2], known[1], signs, n, percent) & (known[0][:, None] != components[None, :])
                    out.update((main, held[o][0], held[o][1], True) for o in np.flatnonzero(near.any(axis=1)).tolist())
                    out.update((main, some[m][0], some[m][1], False) for m in np.flatnonzero(near.any(axis=0)).tolist())
            columns = zip(*sorted(out), strict=True) if out else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["main", "id", "component", "outsider"])

    chosen = dealt.select("key", "block", "group", "kind", "id", "component", "main", "n", "brief")
    return chosen.mapInArrow(frugal(run), "main long, id long, component long, outsider boolean").distinct()


def _laid_out(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """components, sizes and sizes by ranges of (id, component, main, n, brief) rows."""
    return np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)


def _verified_blocks(asked: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links of outsiders with members of other components, one for each such component of a task's members.

    Outsiders of one main component are cut into blocks of about TEXT_BLOCK; every group of members meets every block.
    """
    counts = asked.groupBy("main").agg(F.count_if("outsider").alias("o"), F.count_if(~F.col("outsider")).alias("m"))
    counts = counts.select("main", F.ceil(F.col("o") / TEXT_BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / (4 * GROUP)).cast("int").alias("groups"))
    rows = asked.join(counts, "main").join(docs, "id")
    own = F.xxhash64("id")
    outsiders = rows.filter("outsider").select("*", F.pmod(own, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("kind"))
    everyone = rows.filter("NOT outsider").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(own, F.col("groups")).cast("int").alias("g"), F.lit(1).alias("kind"))
    dealt = outsiders.filter("groups > 0").unionByName(everyone.filter("blocks > 0"))
    dealt = dealt.select("main", "block", "g", "kind", "id", "component", "text").repartition(partitions(docs.sparkSession), "main", "block", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index, done = None, [], None, set()
        for part in slices(batches, "text"):
            sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)
            out = []
            for *place, kind, i, component, s in zip(*(part.column(c).to_pylist() for c in ("main", "block", "g", "kind", "id", "component")), sets, strict=True):
                if place != at:
                    at, held, index, done = place, [], None, set()
                if kind == 0:
                    held.append((i, component, s))
                    continue
                if not held:
                    continue
                if index is None:
                    keys = np.concatenate([h[2] for h in held])
                    owners = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
                    order = np.argsort(keys, kind="stable")
                    index = keys[order], owners[order], np.array([len(h[2]) for h in held])
                lo, hi = np.searchsorted(index[0], s, side="left"), np.searchsorted(index[0], s, side="right")
                many = hi - lo
                where = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = np.bincount(index[1][where], minlength=len(held))
                for o in np.flatnonzero(100 * both >= percent * (index[2] + len(s) - both)).tolist():
                    # One link joins two components as well as many.
                    if held[o][1] != component and (held[o][0], component) not in done:
                        done.add((held[o][0], component))
                        out.append((held[o][0], i))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 2)], names=["a", "b"])

    return dealt.sortWithinPartitions("main", "block", "g", "kind").mapInArrow(frugal(run), "a long, b long")


def _different(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """docs without rows that repeat a document; texts are only compared where an id has several sets."""
    several = profiles.groupBy("id").agg(F.count_distinct("s1").alias("sets")).filter("sets > 1").select("id")
    once = docs.join(several, "id", "left_anti").dropDuplicates(["id"])
    return once.unionByName(docs.join(several, "id", "left_semi").distinct())


def link(df: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id) for every row.

    Null or wordless text: no shingles, linked with nothing. A null id is in no component and not kept. Rows that
    repeat an id are one document: with several texts it has the links of each, and each row its own n_shingles. Other
    columns are ignored; an empty table gives an empty result. A percent under PERCENT is an error, as bands would lose
    links.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands are for similarities of {PERCENT} percent and more: {percent}")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles, _ = written(_profile(docs, size), "profiles")
    classes = profiles.filter("id IS NOT NULL AND s1 IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes, _ = written(classes, "classes")

    firsts = classes.select(F.col("first").alias("id"))
    entries = profiles.select("id", F.explode("bands").alias("key")).join(firsts, "id", "left_semi").distinct()
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members, members_path = written(entries.join(sizes, "key").select("key", "id", "size"), "members")
    shared = members.groupBy("id").agg(F.sum("size").alias("shared"))
    centres = members.join(shared, "id").groupBy("key").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("a"))
    stars = members.join(centres, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    texts, texts_path = written(_different(docs.join(shared.select("id"), "id", "left_semi"), profiles), "texts")
    links, links_path = written(_verified(stars, texts, size, percent), "verified")
    reached, _ = components(links)

    # Members outside the component that most of a bucket belongs to.
    placed = members.select("key", "id", "size").join(reached, "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("outside"))
    split, split_path = written(placed.join(main.filter("parts > 1"), "key").drop("parts"), "split")
    if split.take(1):
        asked, asked_path = written(_possible(split, profiles.filter("brief IS NOT NULL").select("id", "n", "brief"), percent), "asked")
        more, more_path = written(_verified_blocks(asked, texts, size, percent), "verified")
        if more.take(1):
            reached, _ = components(links.unionByName(more))
        drop_folder(spark, asked_path)
        drop_folder(spark, more_path)
    for path in (members_path, texts_path, links_path, split_path):
        drop_folder(spark, path)

    named = classes.join(reached, F.col("first") == F.col("id"), "left").select("s1", "s2", "first", "copies", F.coalesce("component", "first").alias("component"))
    named = named.filter("copies > 1 OR component <> first")
    # A class that holds a large part of the rows would make one task long; such classes are few, and broadcast.
    hot = F.col("copies") > max(HOT, profiles.count() // HOT_CLASSES)
    large = named.filter(hot).select(F.col("s1").alias("l1"), F.col("s2").alias("l2"), F.col("component").alias("large"))
    rows = profiles.select("id", "n", "s1", "s2").join(F.broadcast(large), (F.col("s1") == F.col("l1")) & (F.col("s2") == F.col("l2")), "left")
    # Their rows, and those without a set, are spread by their ids and find no partner in the second join.
    apart = F.col("large").isNotNull() | F.col("s1").isNull()
    rows = rows.select("id", "n", "large", F.when(apart, F.col("id")).otherwise(F.col("s1")).alias("s1"), F.when(~apart, F.col("s2")).alias("s2"))
    out = rows.join(named.filter(~hot).select("s1", "s2", F.col("component").alias("small")), ["s1", "s2"], "left").withColumn("component", F.coalesce("large", "small"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
