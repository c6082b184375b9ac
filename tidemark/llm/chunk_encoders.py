"""Encoding texts chunk by chunk, each distinct chunk by its tokenizer's library and once in a while only.

Both kinds of tokenizer place a token boundary before a single space, so that the ids of a text are the ids of its
space-separated chunks one behind the other. Arrow cuts the texts and finds their distinct chunks, and puts the chunks' ids
in the texts' order: Python looks at distinct chunks only. Ids are handled as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
from collections.abc import Callable
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.token_counts import byte_letters

#: Half of the chunks that a worker remembers, and the longest of them; only memory and time depend on these.
HELD_CHUNKS = 300_000
MAX_HELD = 64
#: A chunk of over this many characters is cut further, before white space that follows something else.
LONG_CHUNK = 100_000

#: White space behind something else; \x1c to \x1f are white space to Python alone.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Characters of plain chunks: Latin letters, digits, and ASCII signs without the apostrophe, which begins contractions, and
#: angle brackets, which most special strings have.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!\"#$%&()*+,\-./:;=?@\\^_`{}~|\[\]"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
#: What the byte-level pattern makes of plain chunks with a space before each.
_PARTS = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n")
#: Chunks that sentencepiece gets as one text.
PIECE_CHUNKS = 200

#: The chunks of texts, where in them each text's begin (and the last ends), and the distinct chunks.
Cut = tuple[pa.DictionaryArray, np.ndarray, list[str]]
Made = TypeVar("Made")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteLevelEncoder:
    """Ids of texts as a .json file of the tokenizers library gives them with add_special_tokens=False. Special strings in a
    text are special tokens, as is the library's default, or ordinary text if plain. ValueError for a file whose ids could
    depend on more than a chunk: only byte-level BPE with the pattern of its own and without a normalizer is taken."""

    def __init__(self, definition: str, plain: bool = False, held: int = HELD_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        split = parsed.get("pre_tokenizer") or {}
        if parsed["model"]["type"] != "BPE" or parsed["model"].get("dropout") is not None or parsed.get("normalizer") is not None:
            raise ValueError("only BPE files without dropout and normalizer can be encoded by chunks")
        if (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) != ("ByteLevel", False, True):
            raise ValueError("only the byte-level pre-tokenizer without a space of its own can be encoded by chunks")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in parsed.get("added_tokens") or []):
            raise ValueError("added tokens that take in what is beside them can't be encoded by chunks")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        self.spaced = np.array([p.startswith(b" ") for p in self.pieces()])
        self.known = Remembered(held)
        self.model = self.tokenizer.model
        letters = byte_letters()
        # Byte 0 parts the words that are turned into letters together; no plain chunk has it.
        self.letters = "\0" + "".join(letters[b] for b in range(1, 256))
        self.plain_parts = not any(_PLAIN.fullmatch(a["content"]) for a in parsed.get("added_tokens") or [])

    def pieces(self) -> list[bytes]:
        """Every id's bytes; those of added tokens are their strings."""
        back = {letter: byte for byte, letter in byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for piece, number in vocabulary.items():
            out[number] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
        return out

    def _ids(self, text: str) -> bytes:
        parts = _BEFORE_SPACE.split(text) if len(text) > LONG_CHUNK else [text]
        return b"".join(_packed(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in parts)

    def _plain(self, text: str) -> list[int]:
        """The ids of plain chunks, by the library's model alone: _PARTS are the words that its pattern would give."""
        words = codecs.charmap_decode("\0".join(_PARTS.findall(text)).encode(), "strict", self.letters)[0].split("\0")
        return [t.id for tokens in map(self.model.tokenize, words) for t in tokens]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, a space before it."""
        plain = list(map(_PLAIN.fullmatch, chunks)) if self.plain_parts else [None] * len(chunks)
        if all(plain):
            return _cut(np.array(self._plain(" " + " ".join(chunks)), "<u4"), self.spaced)
        if any(plain):
            rest = iter(self.chunk_ids([c for c, p in zip(chunks, plain, strict=True) if not p]))
            made = iter(self.chunk_ids([c for c, p in zip(chunks, plain, strict=True) if p]))
            return [next(made if p else rest) for p in plain]
        # A chunk that holds or ends in white space of another kind could not be told from its neighbours.
        alone = [len(c) > LONG_CHUNK or " " in c or not c or c[-1].isspace() for c in chunks]
        joined = [c for c, x in zip(chunks, alone, strict=True) if not x]
        found = iter(_cut(np.array(self.tokenizer.encode_batch_fast([" " + " ".join(joined)], add_special_tokens=False)[0].ids, "<u4"), self.spaced) if joined else [])
        return [self._ids(f" {c}") if x else next(found) for c, x in zip(chunks, alone, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        parts = [_SINGLE_SPACE.split(t, maxsplit=1) for t in texts]
        rest = iter(self.encode_spaced([p[1] for p in parts if len(p) > 1]))
        first = lambda c: _packed(self._plain(c)) if self.plain_parts and len(c) <= MAX_HELD and _PLAIN.fullmatch(c) else self._ids(c)
        return [first(p[0]) + (next(rest) if len(p) > 1 else b"") for p in parts]

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        """The ids of a space and each text."""
        return _parted(*self.flat(texts))

    def flat(self, texts: list[str], cut: Cut | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each text, end to end, and where in them each text's begin (and the last ends). cut: at_spaces
        of the texts, where it is there already."""
        return _joined(self.known, texts, self.chunk_ids, cut)

    def alone(self, text: str) -> bytes:
        """The ids of a space and a text, without looking at its chunks."""
        return self._ids(f" {text}")


class PieceEncoder:
    """Ids of texts as a .model file of sentencepiece gives them, with the space that it puts before a text. ValueError for a
    model with pieces that go on over a space."""

    def __init__(self, model: bytes, held: int = HELD_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        if any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(self.model.get_piece_size())):
            raise ValueError("a model with pieces that go on over a space can't be encoded by chunks")
        self.spaced = np.array([p.startswith(b" ") for p in self.pieces()])
        self.known = Remembered(held)

    def pieces(self) -> list[bytes]:
        """Every id's bytes: a byte piece's byte, or the piece with spaces for its marks."""
        model = self.model
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, with the space that the library puts before it."""
        out: list[bytes] = []
        for i in range(0, len(chunks), PIECE_CHUNKS):
            some = chunks[i : i + PIECE_CHUNKS]
            joined = " ".join(some)
            if "" in some or "▁" in joined or joined.count(" ") >= len(some):
                out += [_packed(self.model.encode(c)) for c in some]
            else:
                out += _cut(np.array(self.model.encode(joined), "<u4"), self.spaced)
        return out

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with the space that the library puts before it."""
        return _parted(*self.flat(texts))

    def flat(self, texts: list[str], cut: Cut | None = None) -> tuple[np.ndarray, np.ndarray]:
        """encode_spaced's ids, end to end, and where in them each text's begin (and the last ends). cut: at_spaces of the texts,
        where it is there already."""
        if not any("▁" in t for t in texts):
            return _joined(self.known, texts, self.chunk_ids, cut)
        rest = iter(_parted(*_joined(self.known, [t for t in texts if "▁" not in t], self.chunk_ids)))
        found = [self.alone(t) if "▁" in t else next(rest) for t in texts]
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum([0, *(len(x) // 4 for x in found)])

    def alone(self, text: str) -> bytes:
        """The ids of a text, without looking at its chunks; one that holds the library's own sign for a space needs that."""
        return _packed(self.model.encode(text))


def _cut(ids: np.ndarray, spaced: np.ndarray) -> list[bytes]:
    """The ids of chunks that were encoded as one text: a token that begins with a space begins a chunk."""
    starts, data = (4 * np.flatnonzero(spaced[ids])).tolist(), ids.tobytes()
    return [data[i:j] for i, j in zip(starts, [*starts[1:], len(data)], strict=True)]


def _parted(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    data, at = ids.tobytes(), (4 * bounds).tolist()
    return [data[i:j] for i, j in zip(at, at[1:], strict=False)]


class Remembered(Generic[Made]):
    """What was made of chunks: their ids. Once held of them are there they make up the older half; of the older ones only those that come up
    again stay when the newer half is full."""

    def __init__(self, held: int) -> None:
        self.held = held
        self.newer: dict[str, Made] = {}
        self.older: dict[str, Made] = {}

    def found(self, chunks: list[str]) -> tuple[list[Made | None], list[int]]:
        """What is held of distinct chunks, and the places of those that are missing."""
        out = list(map(self.newer.get, chunks))
        missing = [i for i, x in enumerate(out) if x is None]
        if self.older and missing:
            again = list(map(self.older.get, [chunks[i] for i in missing]))
            for i, x in zip(missing, again, strict=True):
                if x is not None:
                    self.newer[chunks[i]] = out[i] = x
            missing = [i for i, x in zip(missing, again, strict=True) if x is None]
        return out, missing

    def add(self, chunks: list[str], made: list[Made]) -> None:
        """Take in what was missing, and forget the older half when the newer one is full."""
        self.newer.update(zip(chunks, made, strict=True))
        if len(self.newer) >= self.held:
            self.newer, self.older = {}, self.newer


def _strings(chunks: pa.DictionaryArray) -> list[str]:
    return chunks.dictionary.to_numpy(zero_copy_only=False).tolist()


def at_spaces(texts: list[str]) -> Cut:
    """The texts cut at each space."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    chunks = lists.flatten().dictionary_encode()
    return chunks, np.asarray(lists.offsets).astype(np.int64), _strings(chunks)


def _unsure(strings: list[str], places: list[int]) -> set[int]:
    """The places whose chunks are empty or end in white space: the space behind them may be no place to cut, and the library
    could not tell them from their neighbours. No such chunk is remembered."""
    return {i for i in places if not (c := strings[i]) or c[-1].isspace()}


def encoded(known: Remembered, texts: list[str], make: Callable[[list[str]], list[Made]], cut: Cut | None = None) -> tuple[pa.DictionaryArray, np.ndarray, list[str], list[Made]]:
    """The chunks of texts, where in them each text's begin (and the last ends), the distinct chunks and what make gives for each of
    them; what is missing is made for all texts at once. Texts with unsure chunks are cut the longer way."""
    chunks, bounds, strings = cut or at_spaces(texts)
    found, missing = known.found(strings)
    odd = _unsure(strings, missing)
    if odd:
        before = np.concatenate([[0], np.cumsum(np.isin(np.asarray(chunks.indices), list(odd)))])[bounds]
        parts = [_SINGLE_SPACE.split(t) if x else t.split(" ") for t, x in zip(texts, np.diff(before).tolist(), strict=True)]
        chunks, bounds = pa.array([c for p in parts for c in p], pa.string()).dictionary_encode(), np.cumsum([0, *map(len, parts)])
        strings = _strings(chunks)
        found, missing = known.found(strings)
        odd = _unsure(strings, missing)
    # A chunk that is not remembered is made by itself.
    passing = odd | {i for i in missing if len(strings[i]) > MAX_HELD}
    for i in passing:
        found[i] = make([strings[i]])[0]
    missing = [i for i in missing if i not in passing] if passing else missing
    if missing:
        new = [strings[i] for i in missing]
        made = make(new)
        for i, x in zip(missing, made, strict=True):
            found[i] = x
        known.add(new, made)
    return chunks, bounds, strings, found


def _joined(known: Remembered, texts: list[str], make: Callable[[list[str]], list[bytes]], cut: Cut | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a space and each text, end to end, and where in them each text's begin (and the last ends)."""
    if not texts:
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    chunks, bounds, _, found = encoded(known, texts, make, cut)
    ids = pa.array(found, pa.large_binary()).take(chunks.indices)
    ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)
    data = np.frombuffer(ids.buffers()[2] or b"", "<u4", (ends[-1] - ends[0]) // 4, ends[0])
    return data, (ends[bounds] - ends[0]) // 4
