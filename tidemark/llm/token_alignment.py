"""Aligning two tokenizers: groups of tokens that cover the same bytes, and links between tokens that end together.

Python only tokenises: it gives both token sequences of a text as numbers of end offset in bytes and id, and the ends as
numbers that sort behind the tokens that end there. The common ends (array_intersect) cut both sequences into groups: those that
are not common, sorted into their sequence, join its ids, and transform, zip_with and aggregate build groups, links and their
digest inside the rows. Both tokenizers end a token before each single space: those ends are common without a look, and are
only counted. Links are then counted by pair of ids over the whole corpus; the counts of pairs that occur often, a bounded number,
are broadcast to the links, those of all others are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import frugal, kept, slices, written
from tidemark.llm.chunk_encoders import ByteLevelEncoder, Cut, PieceEncoder, Remembered, at_spaces, encoded

#: Pairs of ids whose counts are broadcast at most; rarer ones are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: Half of the chunks that a worker remembers.
HELD_CHUNKS = 150_000
MAX_FILE_BYTES = 64_000_000
#: Bytes of text that are encoded together.
TEXT_BYTES = 2_000_000
#: A token is its end * 2 ** ID_BITS + its id; a mark is the same with MARK for the id, which no token has.
ID_BITS = 20
MARK = 2**ID_BITS - 1

#: Tokens and marks of both sides. No element is null, which lets Spark sort them as plain numbers.
PACKED = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType(), False)) for c in ("a", "a_marks", "b", "b_marks"))])

#: The same without the marks of ends at single spaces and at the text's end, whose number is sure.
SPACED = T.StructType([*PACKED.fields, T.StructField("sure", T.IntegerType(), False)])


class Side:
    """One tokenizer, with the bytes of its ids."""

    def __init__(self, encoder: ByteLevelEncoder | PieceEncoder):
        self.encoder, pieces = encoder, encoder.pieces()
        if len(pieces) > MARK:
            raise ValueError(f"a vocabulary of more than {MARK} ids")
        self.bytes = pa.array(pieces, pa.large_binary())
        self.lengths = np.array([len(p) for p in pieces], np.int64)

    def gives_back(self, made: Sequence[bytes], strings: list[str]) -> np.ndarray:
        """Of chunks and their ids: whether the ids' bytes are a space and the chunk."""
        taken = self.bytes.take(pa.array(np.frombuffer(b"".join(made), "<u4")))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        joined, at = bytes(taken.buffers()[2] or b"")[ends[0] : ends[-1]], ends[np.cumsum([0, *map(len, made)]) // 4] - ends[0]
        spaced = [f" {s}".encode() for s in strings]
        if joined == b"".join(spaced) and np.array_equal(np.diff(at), np.fromiter(map(len, spaced), np.int64, len(spaced))):
            return np.ones(len(spaced), bool)
        return np.array([joined[i:j] == want for i, j, want in zip(at.tolist(), at[1:].tolist(), spaced, strict=False)], bool)

    def tokens(self, texts: list[str], whole: list[bytes], cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Of a space and each text, end to end: ids and their ends in bytes; where in them each text's begin (and the last
        ends); and whether each text's tokens have whole's bytes, which are the text's."""
        ids, bounds = self.encoder.flat(texts, cut)
        taken = self.bytes.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, 8 * taken.offset)
        joined = bytes(taken.buffers()[2] or b"")[ends[0] : ends[-1]]
        ends = ends - ends[0]
        at = ends[bounds].tolist()
        return ids.astype(np.int64), ends[1:], bounds, [joined[i:j] == want for i, j, want in zip(at, at[1:], whole, strict=False)]


class Pair:
    """Both tokenizers."""

    def __init__(self, definition: str, model: bytes):
        self.sides = [Side(ByteLevelEncoder(definition, plain=True, held=HELD_CHUNKS)), Side(PieceEncoder(model, held=HELD_CHUNKS))]
        self.known: Remembered[tuple[bytes, bytes]] = Remembered(HELD_CHUNKS)

    def _made(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each chunk by A and by B."""
        a, b = (side.encoder.chunk_ids(chunks) for side in self.sides)
        return list(zip(a, b, strict=True))

    def spaced(self, texts: list[str | None]) -> list[pa.Array]:
        """SPACED's columns behind doc_id. Texts with a sign of the piece library's own, or with a chunk whose bytes its tokens are
        not, are taken whole: tokens' columns, and no end is sure."""
        # A text without chunks of its own has any one in its stead: an empty one would have all texts cut the longer way.
        own = np.array([bool(t) and "▁" not in t for t in texts], bool)
        chunks, bounds, strings, found = encoded(self.known, [t if x else "a" for t, x in zip(texts, own.tolist(), strict=True)], self._made)
        places, counts = np.asarray(chunks.indices), np.diff(bounds)
        made = list(zip(*found, strict=True))
        good = np.logical_and.reduce([side.gives_back(x, strings) for side, x in zip(self.sides, made, strict=True)])
        if not good.all():
            own &= np.diff(np.concatenate([[0], np.cumsum(~good[places])])[bounds]) == 0
        if not own.all():
            places, counts = places[np.repeat(own, counts)], np.where(own, counts, 0)
        bounds, out = np.concatenate([[0], np.cumsum(counts)]), []
        for side, x in zip(self.sides, made, strict=True):
            taken = pa.array(x, pa.large_binary()).take(pa.array(places))
            stops = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) // 4
            ids = np.frombuffer(taken.buffers()[2] or b"", "<u4", stops[-1] - stops[0], 4 * stops[0])
            stops = stops - stops[0]
            at = stops[bounds]
            ends = np.cumsum(side.lengths[ids])
            ends = (ends - np.repeat(np.concatenate([[0], ends])[at[:-1]], np.diff(at))) << ID_BITS
            inner = np.ones(len(ids), bool)
            inner[stops[1:] - 1] = False
            for values, offsets in ((ends | ids, at), ((ends | MARK)[inner], at - bounds)):
                out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values)))
        out.append(pa.array(counts.astype(np.int32)))
        if own.all():
            return out
        rest = np.flatnonzero(~own)
        whole = [*self.tokens([texts[i] for i in rest.tolist()]), pa.array(np.zeros(len(rest), np.int32))]
        order = np.arange(len(texts))
        order[rest] = len(texts) + np.arange(len(rest))
        return [pa.concat_arrays([x, y]).take(pa.array(order)) for x, y in zip(out, whole, strict=True)]

    def tokens(self, texts: list[str | None]) -> list[pa.Array]:
        """Tokens and marks by A, and by B, of a space and each text; all empty if either's tokens are not its bytes."""
        given = [t or "" for t in texts]
        whole = [f" {t}".encode() for t in given]
        cut = at_spaces(given)
        found = [side.tokens(given, whole, cut) for side in self.sides]
        used = np.array([bool(t) and all(same) for t, *same in zip(given, *(f[3] for f in found), strict=True)], bool)
        out = []
        for ids, ends, bounds, _ in found:
            counts = np.diff(bounds)
            before = np.concatenate([[0], ends])[bounds[:-1]]
            ends = (ends - np.repeat(before, counts)) << ID_BITS
            if not used.all():
                kept_ = np.repeat(used, counts)
                ids, ends, counts = ids[kept_], ends[kept_], np.where(used, counts, 0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            out += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ends | ids, ends | MARK)]
        return out


def _rows(df: DataFrame, a_file: str, b_file: str, id_col: str, text_col: str, schema: T.StructType, columns: Callable[[Pair, list[str | None]], list[pa.Array]]) -> DataFrame:
    """A row for each row of df: its id, and columns of its text. a_file is a byte-level .json file, b_file a .model file; see
    ByteLevelEncoder and PieceEncoder for those that are refused."""
    paths = [Path(a_file), Path(b_file)]
    if any(p.stat().st_size > MAX_FILE_BYTES for p in paths):
        raise ValueError(f"a file is larger than {MAX_FILE_BYTES} bytes")
    definition, model = paths[0].read_text(encoding="utf-8"), paths[1].read_bytes()
    Pair(definition, model)
    shipped, key = df.sparkSession.sparkContext.broadcast((definition, model)), ("token_alignment", *map(str, paths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept(key, lambda: Pair(*shipped.value))
        for part in slices(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns(pair, part.column("text").to_pylist())], names=schema.names)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(frugal(run, key), schema)


def packed(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df, as in PACKED; see _rows for the files."""
    return _rows(df, a_file, b_file, id_col, text_col, PACKED, Pair.tokens)


def spaced(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df, as in SPACED; see _rows for the files."""
    return _rows(df, a_file, b_file, id_col, text_col, SPACED, Pair.spaced)


def tokenise(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """packed's rows, and their ids and ends in bytes: doc_id, a, a_marks, b, b_marks, a_ids, a_ends, b_ids, b_ends."""
    ids = lambda c: F.transform(c, lambda x: x.bitwiseAND(MARK).cast("int")).alias(f"{c}_ids")
    ends = lambda c: F.transform(c, lambda x: F.shiftright(x, ID_BITS)).alias(f"{c}_ends")
    return packed(df, a_file, b_file, id_col, text_col).select("*", ids("a"), ends("a"), ids("b"), ends("b"))


def _groups(side: str) -> Column:
    """A side's groups, each as its ids joined by commas, of its tokens with the marks of those behind which no group ends."""
    ids = F.array_join(F.transform(side, lambda x: x.bitwiseAND(MARK)).cast("array<string>"), "|")
    return F.split(F.replace(ids, F.lit(f"|{MARK}|"), F.lit(",")), r"\|")


def align(tokens: DataFrame, groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, links_a, links_b of rows as in PACKED or SPACED; with groups, also groups and n_single.

    groups: array of (a, b), the ids of both sides in their order, whose texts are the same bytes; n_single: groups of one
    token each. links_a, links_b: the ids of the tokens that end together: no token is empty, so that each group has one link,
    of its last tokens. groups_sha256: SHA-256 of the groups as a1,a2|b1;a3|b2,b3. Rows without tokens have no groups, and an
    empty string.
    """
    # Each step's arrays are named more than once in the next one: Spark then works them out in compiled code before the
    # lambdas, which it interprets together with all that is below them.
    sure = F.col("sure") if "sure" in tokens.columns else F.lit(0)
    cut = tokens.select("doc_id", "a", "b", "a_marks", "b_marks", sure.alias("sure"), F.array_intersect("a_marks", "b_marks").alias("cuts"))
    inner = lambda c: F.sort_array(F.concat(c, F.array_except(f"{c}_marks", "cuts"))).alias(c)
    merged = cut.select("doc_id", (F.size("cuts") + F.col("sure")).alias("n_groups"), inner("a"), inner("b"))
    # Each group's last token has no mark beside it, every other one has.
    count = lambda c: F.shiftright(F.size(c) + F.col("n_groups"), 1).alias(f"n_{c}")
    sides = merged.select("doc_id", count("a"), count("b"), "n_groups", _groups("a").alias("a"), _groups("b").alias("b"))
    some = F.col("n_groups") > 0
    text = F.array_join(F.zip_with("a", "b", lambda a, b: F.concat(a, F.lit("|"), b)), ";")
    last = lambda c: F.when(some, F.transform(c, lambda g: F.substring_index(g, ",", -1)).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    fields = [F.when(some, F.sha2(text, 256)).otherwise("").alias("groups_sha256"), last("a").alias("links_a"), last("b").alias("links_b")]
    if groups:
        ids = lambda g: F.split(g, ",").cast("array<int>")
        pairs = F.zip_with("a", "b", lambda a, b: F.struct(ids(a).alias("a"), ids(b).alias("b")))
        fields.append(F.when(some, pairs).otherwise(F.array().cast("array<struct<a:array<int>,b:array<int>>>")).alias("groups"))
    out = sides.select("doc_id", "n_a", "n_b", "n_groups", *fields)
    if groups:
        single = F.aggregate("groups", F.lit(0), lambda n, g: n + F.when((F.size(g["a"]) == 1) & (F.size(g["b"]) == 1), 1).otherwise(0))
        out = out.withColumn("n_single", single)
    return out


def count_pairs(links: DataFrame) -> DataFrame:
    """Of links (a, b): a, b, n (links of the pair of ids), best (whether no other pair with the same b has more), as a table. A b has at most
    as many pairs as the other vocabulary has ids."""
    pairs = links.groupBy("a", "b").agg(F.count("*").alias("n"))
    return written(pairs.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))), "pairs")[0]


def _rare_below(pairs: DataFrame) -> int:
    """The least power of two that at most BROADCAST_PAIRS pairs occur as often as."""
    sizes = pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect()
    power, left = max((r["p"] for r in sizes), default=0) + 1, BROADCAST_PAIRS
    for r in sorted(sizes, key=lambda r: -r["p"]):
        left -= r["count"]
        if left < 0:
            break
        power = r["p"]
    return 2**power


def align_tokenizers(df: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of df, over whole texts.

    n_best: links of a pair that none with the same B id exceeds in the corpus; count_sum: the sum of the counts of its
    links' pairs. Texts that are null or empty, or that a tokenizer does not give back byte by byte, have no tokens: zeros and
    an empty string. A null id stays null; repeated rows stay, and count; other columns of df are ignored, whatever their
    names; an empty table gives an empty result.
    """
    # Rows are told apart by a number of their own, as ids may repeat; the table fixes it, and nothing is tokenised twice.
    rows, _ = written(align(spaced(df, a_file, b_file, id_col, text_col), groups=False).withColumn("row", F.monotonically_increasing_id()), "links")
    links = rows.select("row", F.inline(F.arrays_zip(F.col("links_a").alias("a"), F.col("links_b").alias("b"))))
    pairs = count_pairs(links)
    least = _rare_below(pairs)
    frequent, rare = pairs.filter(F.col("n") >= least), pairs.filter(F.col("n") < least)
    counted = links.join(F.broadcast(frequent), ["a", "b"])
    if least > 1:
        counted = counted.unionByName(links.join(F.broadcast(frequent.select("a", "b")), ["a", "b"], "left_anti").join(rare, ["a", "b"]))
    sums = counted.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    count = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0)).alias(name)
    return rows.drop("links_a", "links_b").join(sums, "row", "left").select(
        "doc_id", *map(count, ("n_a", "n_b", "n_groups")), count("n_groups").alias("n_links"), count("n_best"), count("count_sum"), "groups_sha256"
    )
