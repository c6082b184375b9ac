"""Each stage of the pipeline against a brute-force version, on its own input."""

import hashlib
import random

import public_tokenizers
import test_language
import test_minhash
import test_suffix_dedup
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe_codec, language


def world():
    rng = random.Random(9)
    rows = [(lang, text) for lang, text in test_language.corpus(120, 8)]
    words = [f"word{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(120)]
    rows += [("aa", test_minhash.edited(rng, base, 0.01)) for _ in range(6)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [("aa", f"start {i} {' '.join(rng.sample(words, 30))} {passage}") for i in range(5)]
    items = [f"{' '.join(rng.sample(words, 12))}?\n{' '.join(rng.sample(words, 12))}" for _ in range(5)]
    rows += [("bb", f"{' '.join(rng.sample(words, 40))} {items[k]} {' '.join(rng.sample(words, 40))}") for k in range(3)]
    return rows + [("aa", None), ("aa", "123 456"), rows[0], rows[1]], items


def test_stages(spark, docs, tmp_path):
    rows, items = world()
    table = docs([t for _, t in rows], langs=[x for x, _ in rows]).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    current, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in current.collect()}
        stage(spark, current, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        out = spark.read.parquet(f"{tmp_path}/{number}")
        after = {r.doc_id: r for r in out.collect()}
        if number < 4:
            assert out.columns == current.columns, name
        kept.append((before, after))
        current = out
    ids = lambda x: set(x)

    before, after = kept[0]
    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.learn_dictionaries(source.filter(~language.held_out()))
    accepted = {r.doc_id for r in language.classify(source, model).filter("accepted").collect()}
    assert ids(after) == accepted and all(after[i] == before[i] for i in after)
    assert not any(not any(c.isalpha() for c in before[i].text or "") for i in accepted) and accepted >= set(range(120))

    before, after = kept[1]
    order = sorted(before)
    parts = test_minhash.brute(order, [before[i].text for i in order], 5, 80)
    assert ids(after) == {i for i, (_, c) in parts.items() if i == c}

    before, after = kept[2]
    left = test_suffix_dedup.brute([(i, before[i].text.encode()) for i in sorted(before)])
    for i in before:
        if left[i][1] == left[i][0]:
            assert i not in after
        else:
            assert hashlib.sha256(after[i].text.encode()).hexdigest() == left[i][3] and after[i].n_chars == len(after[i].text)
    assert sum(n for _, n, _, _ in left.values()) > 4 * 300

    before, after = kept[3]
    assert ids(before) - ids(after) == {i for i, r in before.items() if any(t in r.text for t in items)} and len(before) - len(after) == 3

    before, after = kept[4]
    ranks = bpe_codec.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids(before) == ids(after)
    assert all(after[i].n_tokens == len(library.encode_ordinary(r.text)) for i, r in before.items())

    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, after.values()))


def test_a_row_that_stands_twice_is_not_lost(spark, docs, tmp_path):
    text = hashlib.sha256(b"y").hexdigest() * 2 + "".join(chr(97 + i % 23) for i in range(120))
    table = docs([text, text], [7, 7]).select("doc_id", "text", "lang", "source", "n_chars")
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.cut_repeats):
        table = stage(spark, table, str(tmp_path))
    left = brute_of(text)
    assert [(r.doc_id, r.text) for r in table.collect()] == [(7, left)] * 2


def test_empty_tables(spark, docs, tmp_path):
    empty = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def brute_of(text):
    """text without what it repeats of itself, by brute force."""
    data, seen, gone = text.encode(), set(), set()
    for p in range(len(data) - 99):
        if data[p : p + 100] in seen:
            gone.update(range(p, p + 100))
        seen.add(data[p : p + 100])
    return bytes(x for i, x in enumerate(data) if i not in gone).decode()
