"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A task gathers the distinct pre-tokens it has not met yet, lays them out as token-position rows (word, position, id)
and lets a recursive query join neighbours to the merge table and contract each word's leftmost pair of least rank
until nothing is left to merge. The ids of the pre-tokens make up the documents' token-position rows; an ordered
aggregation over these, joined to the vocabulary, gives the bytes that every document's ids decode to.
Texts are never shuffled; a bounded table keeps the words that a task has encoded, and the new and recurring ones of them
for the worker's next task.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, kept, slices
from tidemark.llm.pretokens import SPACED_WORDS, all_plain

#: Entries of a task's table of encoded words, how many of these a worker holds for its next task (those that are new
#: or came up again), and the longest word in the table; only memory and time depend on these.
CACHE_ENTRIES = 800_000
KEPT_ENTRIES = 500_000
MAX_KEPT = 64
#: Bytes of words that one recursive query handles; a longer word has a query of its own.
QUERY_BYTES = 500_000
#: Tokens that one decoding query handles; a longer document is decoded in parts, one behind the other.
DECODE_TOKENS = 300_000
#: Bytes of text that a task splits at a time.
SLICE = 4_000_000
MAX_FILE_BYTES = 64_000_000

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: k is a word's number and a token's position in it. All places of a word's least pair are contracted in one step, from
#: the left (in a run of overlapping places, as in aaaa, every second one). This equals one place after the other, as
#: nothing that comes up meanwhile ranks lower - but for pairs marked as single, of which only the leftmost is contracted.
_ENCODE = """
WITH RECURSIVE s AS (
  SELECT (w::BIGINT << 24) | pos AS k, id, false AS done FROM start
  UNION ALL
  (WITH p AS (SELECT k, id, lead(k) OVER q AS nk, lead(id) OVER q AS nid FROM s WHERE NOT done WINDOW q AS (ORDER BY k)),
        c AS (SELECT p.k, p.id, p.nk, p.nid, m.r, m.single
              FROM p LEFT JOIN merge m ON m.ab = (p.id::BIGINT << 32) | p.nid AND p.k >> 24 = p.nk >> 24),
        best AS (SELECT k >> 24 AS w, min((r::BIGINT << 24) | (k & 16777215)) AS b FROM c GROUP BY k >> 24),
        a AS (SELECT c.*, b, r = b >> 24 AND (NOT single OR k & 16777215 = b & 16777215) AS hit FROM c JOIN best ON c.k >> 24 = w),
        runs AS (SELECT k, nk, sum(fresh) OVER (ORDER BY k) AS run
                 FROM (SELECT k, nk, CASE WHEN lag(nk) OVER (ORDER BY k) = k THEN 0 ELSE 1 END AS fresh FROM a WHERE hit AND id = nid)),
        kept AS (SELECT k, nk FROM a WHERE hit AND id <> nid UNION ALL
                 SELECT k, nk FROM (SELECT k, nk, row_number() OVER (PARTITION BY run ORDER BY k) AS n FROM runs) WHERE n % 2 = 1)
   SELECT a.k, CASE WHEN h.k IS NULL THEN a.id ELSE a.r END, b IS NULL
   FROM a LEFT JOIN kept h ON h.k = a.k ANTI JOIN kept g ON g.nk = a.k)
)
SELECT list(id ORDER BY k) AS ids FROM s WHERE done GROUP BY k >> 24 ORDER BY k >> 24
"""

#: Pieces are kept as Latin-1 letters, one for each byte.
_DECODE = """
SELECT t.part AS part, string_agg(v.piece, '' ORDER BY t.pos) AS decoded
FROM token t JOIN vocabulary v ON v.id = t.id GROUP BY t.part ORDER BY t.part
"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """ab (two ids that stand side by side), r (the id that they make), single (whether contracting all places of the
    pair at once could go wrong: the token that it makes is part of a pair that ranks below it)."""
    a, b, r, risky = [], [], [], set()
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                a.append(left)
                b.append(right)
                r.append(rank)
                risky.update(x for x in (left, right) if x > rank)
    return pa.table({"ab": (np.array(a, np.int64) << 32) | np.array(b, np.int64), "r": np.array(r, np.int32), "single": np.isin(r, sorted(risky))})


class Codec:
    """Encodes and decodes texts by the tables of a rank file, with a database in memory."""

    def __init__(self, merges: pa.Table, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        # Nothing is spilled: queries are bounded by QUERY_BYTES and DECODE_TOKENS.
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        pieces = {rank: token.decode("latin-1") for token, rank in ranks.items()}
        for name, rows in (("merge", merges), ("vocabulary", pa.table({"id": pa.array(pieces.keys(), pa.int32()), "piece": list(pieces.values())}))):
            self.db.register("incoming", rows)
            self.db.execute(f"CREATE TEMP TABLE {name} AS SELECT * FROM incoming")
            self.db.unregister("incoming")
        self.names = {rank: b"%d" % rank for rank in pieces}
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self._forget()

    def _forget(self) -> None:
        # Word -> number; word number n has the ids flat[begin[n] : begin[n] + count[n]].
        self.numbers: dict[str, int] = {}
        self.learned = self.carried = 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.begin, self.count, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def trim(self) -> None:
        """Keep the words that are new or came up again since the last time: KEPT_ENTRIES at most, those of most slices and
        then the latest."""
        words, numbers = list(self.numbers), np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        chosen = np.flatnonzero((self.uses[numbers] > 1) | (numbers >= self.carried))
        chosen = chosen[np.lexsort((-numbers[chosen], -self.uses[numbers[chosen]]))[:KEPT_ENTRIES]]
        begin, count, flat = self.begin[numbers[chosen]], self.count[numbers[chosen]], self.flat
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        self._forget()
        self.flat = np.concatenate([flat[np.arange(total) + np.repeat(begin - ends + count, count)], self.flat])
        spare = np.zeros(1 << 14, np.int64)
        self.begin, self.count, self.uses = (np.concatenate([x, spare]) for x in (ends - count, count, np.ones_like(count)))
        self.numbers = {words[i]: n for n, i in enumerate(chosen.tolist())}
        self.learned = self.carried = len(chosen)
        self.used = total

    def _asked(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        """The result of a query over rows by that name."""
        self.db.register(name, rows)
        out = self.db.sql(query).to_arrow_table()
        self.db.unregister(name)
        return out

    def encode_words(self, words: list[bytes]) -> pa.ListArray:
        """The ids of each word, none of which is empty."""
        lengths = np.array([len(x) for x in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        positions = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        start = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": positions.astype(np.int32), "id": ids})
        return self._asked(_ENCODE, "start", start).column("ids").combine_chunks()

    def _learn(self, words: list[str]) -> None:
        """Give numbers to words that have none yet."""
        todo: list[str] = []
        size = 0

        raw: list[bytes] = []

        def flush() -> None:
            nonlocal size
            if not todo:
                return
            ids = self.encode_words(raw)
            values, offsets = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
            first = self.learned
            while self.used + len(values) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while first + len(todo) > len(self.begin):
                self.begin, self.count, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.uses))
            self.flat[self.used : self.used + offsets[-1] - offsets[0]] = values[offsets[0] : offsets[-1]]
            self.begin[first : first + len(todo)] = self.used + offsets[:-1] - offsets[0]
            self.count[first : first + len(todo)] = np.diff(offsets)
            self.used += int(offsets[-1] - offsets[0])
            self.learned += len(todo)
            self.numbers.update(zip(todo, range(first, first + len(todo)), strict=True))
            todo.clear()
            raw.clear()
            size = 0

        for word, data in zip(words, map(str.encode, words), strict=True):
            if size + len(data) > QUERY_BYTES:
                flush()
            todo.append(word)
            raw.append(data)
            size += len(data)
        flush()

    def split(self, text: str) -> list[str]:
        return SPACED_WORDS.findall(text) if self.plain_pattern and all_plain(text) else self.pattern.findall(text)

    @property
    def plain_pattern(self) -> bool:
        import public_tokenizers

        return self.pattern.pattern == public_tokenizers.PATTERN

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.split(t) for t in texts]
        if self.learned > CACHE_ENTRIES:
            self.trim()
        known = self.numbers
        new = list(set(chain.from_iterable(cut)).difference(known))
        self._learn(new)
        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        self.uses[np.unique(numbers)] += 1
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[numbers] - ends + counts, counts)]
        for word in new:
            if len(word) > MAX_KEPT:
                del known[word]
        words = np.cumsum([len(x) for x in cut])
        return np.split(ids, [int(ends[n - 1]) if n else 0 for n in words[:-1].tolist()]) if texts else []

    def decode(self, documents: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
        """For each document the digests of its ids, joined by commas, and of the bytes that they decode to."""
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in documents]
        for number, ids, raw in self.decoded(documents):
            hashes[number][0].update(ids)
            hashes[number][1].update(raw)
        return [(a.hexdigest(), b.hexdigest()) for a, b in hashes]

    def decoded(self, documents: list[np.ndarray]) -> Iterator[tuple[int, bytes, bytes]]:
        """(document, ids joined by commas, bytes): the parts of documents in order; of a document without tokens none."""
        held: list[tuple[int, np.ndarray, bool]] = []
        size = 0
        for number, ids in enumerate(documents):
            for at in range(0, len(ids), DECODE_TOKENS):
                part = ids[at : at + DECODE_TOKENS]
                if held and size + len(part) > DECODE_TOKENS:
                    yield from self._decoded(held)
                    held, size = [], 0
                held.append((number, part, at > 0))
                size += len(part)
        if held:
            yield from self._decoded(held)

    def _decoded(self, held: list[tuple[int, np.ndarray, bool]]) -> Iterator[tuple[int, bytes, bytes]]:
        ids = np.concatenate([x for _, x, _ in held])
        part = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for _, x, _ in held])
        found = self._asked(_DECODE, "token", pa.table({"part": part, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        for (number, own, again), raw in zip(held, found.column("decoded").to_pylist(), strict=True):
            names = b",".join(map(self.names.__getitem__, own.tolist()))
            yield number, b"," + names if again else names, raw.encode("latin-1")


def encode_decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of df; with keep_ids also ids (array) and decoded (binary).

    The digests are of the ids in decimal, joined by commas, and of the bytes that the ids decode to. A null text counts
    as empty: no tokens, and the digests of nothing. Null ids stay null, repeated rows stay repeated, other columns are
    ignored, an empty table gives an empty result.
    """
    path = Path(rank_file)
    if path.stat().st_size > MAX_FILE_BYTES:
        raise ValueError(f"{rank_file} is larger than {MAX_FILE_BYTES} bytes")
    data = path.read_bytes()
    ranks = read_ranks(data)
    shipped = df.sparkSession.sparkContext.broadcast((merge_table(ranks), ranks))
    key = ("codec", hashlib.sha256(data).hexdigest(), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(key, lambda: Codec(*shipped.value, pattern))
        for part in slices(batches, "text", SLICE):
            documents = codec.encode([t or "" for t in part.column("text").to_pylist()])
            digests = codec.decode(documents)
            arrays = [part.column("doc_id"), pa.array(map(len, documents), pa.int64()), pa.array([a for a, _ in digests]), pa.array([b for _, b in digests])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                texts: list[bytes] = [b""] * len(documents)
                for number, _, raw in codec.decoded(documents):
                    texts[number] += raw
                arrays += [pa.array(documents, pa.list_(pa.int32())), pa.array(texts, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        codec.trim()

    schema = SCHEMA + (", ids array<int>, decoded binary" if keep_ids else "")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run, key), schema)
