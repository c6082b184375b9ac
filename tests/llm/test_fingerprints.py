import hashlib
import random

import numpy as np

from tidemark.llm import fingerprints


def jaccard(a, b):
    a, b = (set(fingerprints.digests(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_equals_brute_force(docs, odd):
    rng = random.Random(2)
    texts = odd + [" ".join(rng.choice(("one", "two", "three.", "four\n", "five!")) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    ids = rng.sample(range(1000), len(texts))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs(texts, ids)).collect()}
    order = sorted(range(len(texts)), key=lambda k: ids[k])
    prints = {}
    for n, k in enumerate(order):
        text, following = texts[k] or "", texts[order[(n + 1) % len(order)]] or ""
        changed = fingerprints.edited(text, following)
        r = got[ids[k]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(text, changed)) < 1e-12 and abs(r.near_next - jaccard(text, following)) < 1e-12
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_sketches_recover_differences():
    rng = np.random.default_rng(1)
    left = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 5, 40, 900, 900, 3)]
    right = [x[: len(x) // 2] for x in left[:5]] + [left[4][:899], left[4]]
    found = fingerprints.differences(fingerprints.sketch(left), fingerprints.sketch(right))
    for a, b, (only_a, only_b) in zip(left, right, found, strict=True):
        assert only_a.tolist() == np.setdiff1d(a, b).tolist() and only_b.tolist() == np.setdiff1d(b, a).tolist()


def test_foldings_are_the_smaller_sketches():
    sets = [np.random.default_rng(k).integers(0, 2**64, 50, dtype=np.uint64) for k in range(3)]
    large, small = fingerprints._filled(sets, np.array([64, 32, 128])), fingerprints._filled(sets, np.full(3, 8))
    folded = large.folded(np.arange(3), 8)
    assert (folded.counts == small.counts).all() and (folded.keys == small.keys).all() and (folded.checks == small.checks).all()


def test_likeness_follows_from_the_published_fingerprints(docs, odd):
    rng = random.Random(4)
    texts = odd + ["\n".join(" ".join(rng.choice(("one", "two", "three", "four")) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    rows = sorted(fingerprints.fingerprint_edits(docs(texts)).collect(), key=lambda r: r.doc_id)
    own = [r.fingerprint for r in rows]
    assert fingerprints.compare(own, [r.edited_fingerprint for r in rows]) == [r.near_edited for r in rows]
    assert fingerprints.compare(own, own[1:] + own[:1]) == [r.near_next for r in rows]
    # Every published sketch gives all its digests.
    held, sizes = fingerprints.Sketches.from_texts(own)
    found, none, whole = held.peel()
    assert whole.all() and [len(x) for x in found] == sizes.tolist() and not any(map(len, none))


def test_small_edits_and_empty_lines():
    rng = random.Random(6)
    line = " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(800))
    near = lambda a, b: fingerprints.compare(*([fingerprints.sketch([d]).text(0, len(d))] for d in map(fingerprints.digests, (a, b))))[0]
    assert near(line, "x" + line) > 0.9
    assert near("a\nb\n\nc", "a\nb\nc") < 1.0
    # A paragraph that repeats in one of them does not hide what they share.
    assert near("one\ntwo\nthree\n", "one\ntwo\nthree\none\n") == 3 / 4
    assert "".join(fingerprints.pieces(line + "\n\n" + line)) == line + "\n\n" + line


def test_small_tables(docs):
    assert fingerprints.fingerprint_edits(docs([])).collect() == []
    one = fingerprints.fingerprint_edits(docs(["alone here. yes"])).first()
    assert one.near_next == 1.0
    got = fingerprints.fingerprint_edits(docs(["a b", None, "a b"], [None, 4, 4])).collect()
    assert len(got) == 3
