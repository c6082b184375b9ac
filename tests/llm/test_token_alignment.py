import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def letters_of_bytes():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in printable}
    table |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return table


def brute(texts):
    """The contract, text by text, over the libraries' own encodings of whole texts."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, table = sentencepiece.SentencePieceProcessor(model_file=B), letters_of_bytes()
    rows = []
    for t in texts:
        ta = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + (t or ""), add_special_tokens=False).ids]
        tb = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t or "")]
        if not t or any(b"".join(x for _, x in side) != (" " + t).encode() for side in (ta, tb)):
            ta = tb = []
        ends = []
        for side in (ta, tb):
            at, out = 0, []
            for i, x in side:
                at += len(x)
                out.append((at, i))
            ends.append(out)
        links = [(i, j) for e, i in ends[0] for f, j in ends[1] if e == f] if len(ta) < 3_000 else [(i, dict(ends[1])[e]) for e, i in ends[0] if e in dict(ends[1])]
        groups, before = [], 0
        for cut in sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]}):
            groups.append("|".join(",".join(str(i) for e, i in side if before < e <= cut) for side in ends))
            before = cut
        rows.append((len(ta), len(tb), groups, links))
    counts = Counter(p for r in rows for p in r[3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return [
        (na, nb, len(g), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, g, links in rows
    ]


def texts():
    rng = random.Random(7)
    pieces = [*" ab'st1!é\n\t\xa0　", "  ", " the", "<|endoftext|>", " 's", "▁", "日本", "<0x41>", "<s>", "ﬁ", " internationalisation", " don't", "🙂", "\u0000"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(80)] + ["the cat sat on the mat", " the cat", "the cat ", "a▁b", "Grundstücksverkehrsgenehmigung " * 300]


@pytest.mark.parametrize("broadcast", [500_000, 3])
def test_equals_brute_force(docs, odd, monkeypatch, broadcast):
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", broadcast)
    given = [t for t in odd + texts() if t is None or len(t) < 12_000] + ["the cat sat on the mat"]
    got = {r.doc_id: r for r in token_alignment.align_tokenizers(docs(given), A, B).collect()}
    assert len(got) == len(given)
    for i, want in enumerate(brute(given)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, repr(given[i])


def test_groups_and_links(docs):
    tokens = token_alignment.tokenise(docs(["the cat sat internationalisation", None]), A, B)
    row, none = token_alignment.align(tokens).orderBy("doc_id").collect()
    kept = tokens.orderBy("doc_id").first()
    assert [i for g in row.groups for i in g.a] == list(kept.a_ids) and [i for g in row.groups for i in g.b] == list(kept.b_ids)
    assert [(g.a[-1], g.b[-1]) for g in row.groups] == list(zip(row.links_a, row.links_b, strict=True))
    assert row.n_single == sum(len(g.a) == len(g.b) == 1 for g in row.groups)
    assert (none.n_a, none.n_b, none.n_groups, none.groups, none.links_a, none.links_b) == (0, 0, 0, [], [], [])


def test_a_long_text_takes_time_in_proportion(docs):
    """The places of the cuts come from a merge, not from searches."""
    import time

    start = time.time()
    row = token_alignment.align(token_alignment.tokenise(docs(["some longer text of many words, " * 20_000]), A, B)).select("n_a", "n_groups").first()
    assert row.n_a == row.n_groups == 140_000 + 1
    assert time.time() - start < 60


def test_repeats_null_ids_and_empty_tables(docs):
    rows = token_alignment.align_tokenizers(docs(["a b", "a b", "a b"], [1, 1, None]), A, B).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in rows) == [(0, 2, 6), (1, 2, 6), (1, 2, 6)]
    assert token_alignment.align_tokenizers(docs([]), A, B).collect() == []


def test_tokens_are_packed_and_sorted_in_compiled_code(docs):
    """Marks sort behind the tokens that end there, and no lambda has the sort below it, which Spark would interpret then."""
    tokens = token_alignment.packed(docs(["über 日本 internationalisation"]), A, B)
    row = tokens.first()
    for side, marks in ((row.a, row.a_marks), (row.b, row.b_marks)):
        assert [x >> token_alignment.ID_BITS for x in side] == [m >> token_alignment.ID_BITS for m in marks]
        assert sorted(side + marks) == [x for pair in zip(side, marks, strict=True) for x in pair]
    plan = token_alignment.align(tokens, groups=False)._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(" in plan and "transform(sort_array(" not in plan


def test_ends_at_single_spaces_are_counted_and_not_compared(docs, odd):
    """Rows of the query have marks within chunks only, and align to the same as those with all marks."""
    given = [t for t in odd + texts() if t is None or len(t) < 12_000] + ["the internationalisation sat", "a b c", "x  y ", "▁ a b"]
    spaced, packed = token_alignment.spaced(docs(given), A, B), token_alignment.packed(docs(given), A, B)
    rows = {r.doc_id: r for r in spaced.collect()}
    assert all(len(side) - len(marks) == r.sure for r in rows.values() if r.sure for side, marks in ((r.a, r.a_marks), (r.b, r.b_marks)))
    assert [rows[given.index(t)].sure for t in ("the internationalisation sat", "▁ a b", None)] == [3, 0, 0]
    got, want = (sorted(token_alignment.align(x, groups=False).collect()) for x in (spaced, packed))
    assert got == want and len(got) == len(given)
