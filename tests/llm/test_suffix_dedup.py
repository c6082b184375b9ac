import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup


def brute(rows):
    """rows: (id, bytes) in order. {id: (n, removed, spans, digest)}."""
    seen, out = set(), {}
    for i, data in rows:
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            w = data[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(rng):
    letters = "abcdefgh é"
    passage = lambda n: "".join(rng.choice(letters) for _ in range(n))
    common = [passage(n) for n in (99, 100, 101, 150, 400)]
    texts = []
    for _ in range(60):
        texts.append("".join(rng.choice([passage(rng.randint(1, 200)), rng.choice(common), "ab" * 80, "a" * 130]) for _ in range(rng.randint(1, 6))))
    return texts + texts[:6] + ["x" * 99, "x" * 100, "x" * 350]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(docs, odd, hot):
    """Also with nearly all repeated anchors hot, which takes the other way through."""
    rng = random.Random(11)
    texts = [t for t in odd if t != "word " * 5_000] + ["word " * 200] + corpus(rng)
    ids = rng.sample(range(10_000), len(texts))
    want = brute(sorted((i, (t or "").encode()) for i, t in zip(ids, texts, strict=True)))
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(texts, ids), hot=hot).collect()}
    assert got == want


def test_join_behind_a_full_filter(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_FILTER_BITS", 1 << 15)
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 10**6)
    texts = corpus(random.Random(3))
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs(texts)).collect()} == want


def test_buckets_larger_than_an_array(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 1_000)
    rng = random.Random(5)
    texts = [t.encode() for t in corpus(rng)[:40]]
    owners = [(i, 0, 0, len(t) - 99) for i, t in enumerate(texts) if len(t) >= 100]
    marks = suffix_dedup.bucket_marks([(owners, [texts[o[0]] for o in owners])])
    gone = {i: set() for i in range(len(texts))}
    for i, _, start, stop in marks:
        gone[i].update(range(start, stop))
    want = brute(list(enumerate(texts)))
    assert {i: len(g) for i, g in gone.items()} == {i: w[1] for i, w in want.items()} and len(marks) > 10


def test_text_longer_than_a_slice(docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    monkeypatch.setattr(suffix_dedup, "_POSITION_BITS", 9)
    texts = corpus(random.Random(4))[:25]
    want = brute([(i, t.encode()) for i, t in enumerate(texts)])
    segments = suffix_dedup.segments([t.encode() for t in texts])
    assert len(segments[0])
    covered = {(n, p) for n, s, c in zip(*(x.tolist() for x in segments[:3]), strict=True) for p in range(s, s + c)}
    assert covered == {(n, p) for n, t in enumerate(texts) for p in range(len(t.encode()) - 99)}
    assert want


def test_cut_texts_keeps_columns_and_nulls(docs):
    block = "é".join(hashlib.sha256(b"x").hexdigest())
    out = {r.doc_id: r for r in suffix_dedup.cut_texts(docs([None, "", block, "z" + block])).collect()}
    assert out[0].text is None and out[1].text == "" and out[2].text == block and out[3].text == "z"
    assert out[3].h == "y" and out[3].id == "x"
    assert suffix_dedup.remove_repeats(docs([])).collect() == []


def test_a_null_id_is_not_the_least_id(docs):
    text = "q" * 50 + "".join(chr(97 + i % 23) for i in range(120))
    got = sorted(suffix_dedup.remove_repeats(docs([text, text], [None, -(2**63)])).collect(), key=lambda r: r.n_removed)
    assert len(got) == 2 and got[0].n_removed < len(text) and got[1].n_removed == len(text)


def test_null_and_repeated_ids(docs):
    text = "q" * 50 + "".join(chr(97 + i % 23) for i in range(120))
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.remove_repeats(docs([text, text, text], [7, 7, None])).collect())
    assert got == [(-1, 0), (7, len(text)), (7, len(text))]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_a_repeated_row_keeps_its_text(docs, hot):
    text = "q" * 50 + "".join(chr(97 + i % 23) for i in range(120))
    for ids in ([7, 7], [None, None], [7, 7, 7]):
        got = suffix_dedup.remove_repeats(docs([text] * len(ids), ids), hot=hot).collect()
        want = brute([(None, text.encode())])[None]
        assert [tuple(r) for r in got] == [(i, *want) for i in ids]
    got = sorted(tuple(r)[:3] for r in suffix_dedup.remove_repeats(docs([text, text, "z" + text], [7, 7, 8]), hot=hot).collect())
    removed = brute([(7, text.encode()), (8, b"z" + text.encode())])
    assert got == [(i, *removed[i][:2]) for i in (7, 7, 8)]


def test_suffix_ranks():
    rng = random.Random(0)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 70))]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        want = np.empty(len(s), int)
        want[order] = range(len(s))
        assert (suffix_dedup.suffix_ranks(np.array(s), 10**6) == want).all()
