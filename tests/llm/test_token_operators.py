import base64
import hashlib
import random

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, token_counts

COUNT_FILE = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def hard_texts():
    rng = random.Random(1)
    noise = ["".join(rng.choice(" ab\n\t's1!é½²İΣ_\x1c　") for _ in range(80)) for _ in range(120)]
    return noise + ["a" * 700, "ab" * 500 + "é" * 90, "<|startoftext|>x<|endoftext|> y", "  two  spaces  ", "ΣΑΣ İstanbul ﬁ", "é x", "١٢٣ ½ Ⅳ"]


def test_counts_equal_the_library(docs, odd):
    texts = odd + hard_texts()
    tokenizer = Tokenizer.from_file(COUNT_FILE)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(texts), COUNT_FILE, limit=20).collect()}
    for i, t in enumerate(texts):
        want = len(tokenizer.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (want, len((t or "").encode()), want > 20), repr(t)


def test_codec_equals_the_library(docs, odd):
    texts = odd + hard_texts()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANK_FILE, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_codec.encode_decode(docs(texts), RANK_FILE, public_tokenizers.PATTERN, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert list(got[i].ids) == ids, repr(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(got[i].decoded) == (t or "").encode()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_a_trimmed_table_still_encodes(monkeypatch):
    monkeypatch.setattr(bpe_codec, "CACHE_ENTRIES", 30)
    monkeypatch.setattr(bpe_codec, "KEPT_ENTRIES", 20)
    ranks = bpe_codec.read_ranks(open(RANK_FILE, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.Codec(bpe_codec.merge_table(ranks), ranks, public_tokenizers.PATTERN)
    rng = random.Random(5)
    sizes = set()
    for _ in range(60):
        texts = [" ".join(f"wordlike{rng.randrange(60)}zq" for _ in range(rng.randint(0, 12))) for _ in range(3)] + ["x" * 200]
        assert [x.tolist() for x in codec.encode(texts)] == [library.encode_ordinary(t) for t in texts]
        if rng.random() < 0.3:
            codec.trim()
            sizes.add(len(codec.numbers))
    assert max(sizes) <= 20 and len(sizes) > 1


def test_words_of_one_slice_stay_for_the_next_task(monkeypatch):
    """Those that came up most often stay first, then the latest; none of them is encoded again in the next task."""
    monkeypatch.setattr(bpe_codec, "KEPT_ENTRIES", 3)
    ranks = bpe_codec.read_ranks(open(RANK_FILE, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe_codec.Codec(bpe_codec.merge_table(ranks), ranks, public_tokenizers.PATTERN)
    for text in ("often", "often", "once", "later", "latest"):
        codec.encode([text])
    codec.trim()
    assert set(codec.numbers) == {"often", "later", "latest"}
    monkeypatch.setattr(codec, "encode_words", None)
    for text in ("often", "later", "latest"):
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_empty_table_and_null_id(docs):
    assert token_counts.count_tokens(docs([]), COUNT_FILE).collect() == []
    assert bpe_codec.encode_decode(docs([]), RANK_FILE, public_tokenizers.PATTERN).collect() == []
    assert token_counts.count_tokens(docs(["a b"], [None]), COUNT_FILE).first().doc_id is None
