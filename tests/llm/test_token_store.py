import random
import struct
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from tidemark.llm import chunk_encoders, token_store

FILE = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(text):
    return Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids


def noise(n=60):
    rng = random.Random(4)
    letters = [*" ab'st1!é\n\t\x1c\xa0　 ", "  ", " the", "<|endoftext|>", " 's", "▁", "日本", "\u0000"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(n)]


def test_chunks_equal_the_library(monkeypatch):
    library, definition = Tokenizer.from_file(FILE), Path(FILE).read_text(encoding="utf-8")
    for long_chunk in (5, 100_000):
        monkeypatch.setattr(chunk_encoders, "LONG_CHUNK", long_chunk)
        encoder = chunk_encoders.ByteLevelEncoder(definition)
        for text in noise(3_000):
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgetting_changes_nothing():
    encoder = chunk_encoders.ByteLevelEncoder(Path(FILE).read_text(encoding="utf-8"), held=3)
    for text in noise(300):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library_ids(text)


def test_plain_words_need_no_pattern_and_odd_neighbours_no_loop(monkeypatch):
    """New plain words go to the library's model alone, whatever else is new beside them, and each distinct chunk once."""
    encoder = chunk_encoders.ByteLevelEncoder(Path(FILE).read_text(encoding="utf-8"))
    made = []
    plain, alone = encoder._plain, encoder._ids
    monkeypatch.setattr(encoder, "_plain", lambda text: made.append(text) or plain(text))
    monkeypatch.setattr(encoder, "_ids", lambda text: made.append(text) or alone(text))
    texts = ["Über weitgehend.\nNeue Wörter## word, word, 12.5", "two  spaces beside", "don't <|endoftext|> 日本 x", "x\n\ny beside"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library_ids(text), text
    joined = max(made, key=len)
    assert all(f" {w}" in joined for w in ("weitgehend.\nNeue", "Wörter##", "12.5", "x")) and joined.count(" word,") == 1
    assert " beside" in joined and " beside" not in made


def test_plain_chunks_equal_the_pattern():
    """Every character of the plain ones in every company."""
    library, encoder = Tokenizer.from_file(FILE), chunk_encoders.ByteLevelEncoder(Path(FILE).read_text(encoding="utf-8"))
    letters = [c for c in map(chr, range(0x250)) if chunk_encoders._PLAIN.fullmatch(c)]
    assert len(letters) > 450
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices([*"aB1.\n", *letters], k=rng.randrange(1, 7))) for _ in range(20)) for _ in range(2_000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(docs, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 100)
    texts = odd + noise() + ["long text " * 3_000]
    ids = [*range(len(texts))]
    random.Random(5).shuffle(ids)
    got = {r.doc_id: r for r in token_store.round_trip(docs(texts, ids), str(tmp_path / "t"), FILE, 2).collect()}
    start = 0
    for i in range(len(texts)):
        tokens = [*library_ids(texts[ids.index(i)]), 2]
        assert (got[i].start, got[i].n_tokens) == (start, len(tokens))
        assert got[i].ids_crc32 == zlib.crc32(struct.pack(f"<{len(tokens)}I", *tokens))
        start += len(tokens)


def test_chosen_documents_and_a_plain_decoder(spark, docs, odd, tmp_path):
    folder = tmp_path / "t"
    token_store.write_tokens(docs(odd), str(folder), FILE, 2)
    all_ids = [[*library_ids(t), 2] for t in odd]
    files = sorted(folder.glob("*.ids.zst"))
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(f.open("rb"), read_across_frames=True).read() for f in files)
    assert np.frombuffer(plain, "<u4").tolist() == [t for ids in all_ids for t in ids]
    some = {r.doc_id: r for r in token_store.read_tokens(spark, str(folder), [3, 8, 77]).collect()}
    assert {i: list(r.token_ids) for i, r in some.items()} == {i: all_ids[i] for i in (3, 8)}
    assert some[8].start == sum(map(len, all_ids[:8]))


class Counted:
    def __init__(self, file):
        self.file, self.bytes = file, 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        self.bytes += n
        return self.file.read(n)


def written_file(path, documents):
    with path.open("wb") as out:
        writer = token_store.Writer(out)
        for doc_id, ids in documents:
            writer.add(doc_id, np.array(ids, "<u4").tobytes())
        writer.close()
    return path.stat().st_size


def test_a_reader_fetches_only_what_is_asked_for(tmp_path):
    rng = np.random.default_rng(1)
    size = written_file(tmp_path / "f", [(i, rng.integers(0, 50_000, 5_000)) for i in range(50)])
    with (tmp_path / "f").open("rb") as f:
        counted = Counted(f)
        reader = token_store.Reader(counted, size)
        assert len(reader.document(7)) == 20_000 and counted.bytes < size / 20


def test_frames_are_independent_and_follow_the_seekable_format(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 3)
    size = written_file(tmp_path / "f", [(9, [1, 2, 3, 4]), (None, [5]), (10, [])])
    data = (tmp_path / "f").read_bytes()
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (n, flags, magic) == (4, 0x80, 0x8F92EAB1)
    assert struct.unpack("<II", data[size - 17 - 12 * n :][:8]) == (0x184D2A5E, 12 * n + 9)
    entries = [struct.unpack_from("<III", data, size - 9 - 12 * n + 12 * i) for i in range(n)]
    assert [e[1] for e in entries] == [12, 4, 4, 0]
    at = 0
    for length, decoded, _ in entries[:-1]:
        assert len(zstandard.ZstdDecompressor().decompress(data[at : at + length])) == decoded
        at += length
    with (tmp_path / "f").open("rb") as f:
        assert [(i, s, len(b)) for i, s, b in token_store.Reader(f, size).documents()] == [(9, 0, 16), (None, 4, 4), (10, 5, 0)]


@pytest.mark.parametrize("spoil", ["frame", "checksum", "directory", "end", "short"])
def test_broken_files_are_refused(tmp_path, spoil):
    size = written_file(tmp_path / "f", [(1, range(1000)), (2, range(50))])
    data = bytearray((tmp_path / "f").read_bytes())
    at = {"frame": 30, "checksum": size - 9 - 36 + 8, "directory": size - 17 - 36 - 10, "end": size - 1}.get(spoil)
    if at is None:
        data = data[:10]
    else:
        data[at] ^= 255
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(token_store.StoreError), (tmp_path / "f").open("rb") as f:
        list(token_store.Reader(f, len(data)).documents())


def test_null_ids_repeats_and_several_files(spark, docs, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    texts, ids = ["b", "a", "a", None, "c c", "a"], [5, 5, 5, None, -1, None]
    found = token_store.round_trip(docs(texts, ids), folder, FILE, 2).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, -1, 5, 5, 5]
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(6)]
    assert token_store.round_trip(docs([]), str(tmp_path / "e"), FILE, 2).collect() == []


def test_files_close_by_size(spark, docs, tmp_path):
    """Within a partition, start goes on from file to file."""
    rng = random.Random(6)
    texts = [" ".join(str(rng.random()) for _ in range(200)) for _ in range(40)]
    token_store.write_tokens(docs(texts).coalesce(1), str(tmp_path / "t"), FILE, 2)
    rows = token_store.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(40)]
    # The same documents, two files in each partition.
    base = tmp_path / "two"
    base.mkdir()
    for part in range(2):
        for number in range(2):
            written_file(base / f"{part:07d}-{number:05d}.ids.zst", [(r.doc_id, r.token_ids) for r in rows[20 * part + 10 * number :][:10]])
    assert token_store.read_tokens(spark, str(base)).orderBy("doc_id").collect() == rows


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        chunk_encoders.ByteLevelEncoder(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"))
