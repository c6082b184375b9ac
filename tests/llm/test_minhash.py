import random
import re

import pytest

from tidemark.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= size:
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    return {tuple(words)} if words else set()


def brute(ids, texts, size, percent):
    sets = [shingle_set(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(texts)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (len(sets[i]), min(groups[find(i)])) for i in range(len(texts))}


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 80, 2), (5, 80, 2048)])
def test_components_equal_brute_force(docs, odd, monkeypatch, size, percent, block):
    """Families whose members lie around the threshold, so that a star alone does not settle them; small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TEXT_BLOCK", block)
    monkeypatch.setattr(minhash, "GROUP", 3)
    rng = random.Random(5)
    texts = list(odd)
    for _ in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(150)]
        family = [edited(rng, base, rng.choice((0.01, 0.02, 0.03, 0.04))) for _ in range(40)]
        chain = " ".join(base).split()
        for _ in range(12):
            chain = edited(rng, chain, 0.03).split()
            family.append(" ".join(chain))
        texts += family + family[:5]
    texts += ["A b C d e", "a B c D e", "a b c", "a b c"]
    ids = rng.sample(range(10_000), len(texts))
    want = brute(ids, texts, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.link(docs(texts, ids), size, percent).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_nulls_repeats_and_empty(docs):
    got = minhash.link(docs(["a b c d e", "a b c d e", "a b c d e", None], [3, 3, None, 1])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, False), (1, 1, True), (3, 3, True), (3, 3, True)]
    assert minhash.link(docs([])).collect() == []


def test_an_id_with_several_texts(docs):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), "other words stand here alone", "other words stand here alone", " ".join(base[1:]), "x y z"]
    got = minhash.link(docs(texts, [5, 5, 9, 2, 5])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(2, 56, 2, True), (5, 1, 2, False), (5, 2, 2, False), (5, 57, 2, False), (9, 2, 2, False)]


def test_hot_classes(docs, monkeypatch):
    """Copies of a text and empty texts, with nearly every class hot."""
    monkeypatch.setattr(minhash, "HOT", 2)
    texts = ["a b c d e"] * 7 + ["f g h i j"] * 4 + ["k l m n o"] * 2 + [None] * 5
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(docs(texts)).collect()}
    assert got == brute(list(range(len(texts))), texts, 4, 80)


def test_sizes_by_range_never_rule_a_link_out():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, shared in [(1, 1), (5, 4), (9, 8), (40, 32), (300, 240), (3_000, 2_400), (90_000, 72_000)] * 3:
        union = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        rng.shuffle(union)
        spare = (len(union) - shared) // 2
        a, b = union[: len(union) - spare], union[spare:]
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 80 * len(union)
        sizes = [np.array([minhash.sizes_by_range(x)]) for x in (a, b)]
        may = minhash.may_link(sizes[0], np.array([len(a)]), sizes[1], np.array([len(b)]), 80)[0, 0]
        assert may or not linked
    a, b = (np.array([minhash.sizes_by_range(rng.integers(0, 2**64, 300, dtype=np.uint64))]) for _ in range(2))
    assert not minhash.may_link(a, np.array([300]), b, np.array([300]), 80).any()


def test_signatures_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    b = np.concatenate([a[:1600], np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))])
    s = minhash.signatures([a, b], 1024)
    assert abs((s[0] == s[1]).mean() - 1600 / 2400) < 0.06


def test_similarities_that_the_filters_are_not_made_for_fail(docs):
    with pytest.raises(ValueError, match="80 percent"):
        minhash.link(docs(["a b c d e"]), percent=79)
