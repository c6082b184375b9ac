import random
import zlib

from pyspark.sql import functions as F

from tidemark.llm import language

SYLLABLES = {"aa": "ba ko tu mi re la", "bb": "sch ung ver ich ein auf", "cc": "tion eau oui les dre vre"}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        parts = SYLLABLES[lang].split()
        out.append((lang, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60)))))
    return out


def test_held_out_accuracy_and_rejection(docs, odd):
    rows = corpus(400, 2)
    table = docs([t for _, t in rows] + odd, langs=[x for x, _ in rows] + [None] * len(odd))
    model = language.learn_dictionaries(table.filter(~language.held_out()))
    assert sorted(model) == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in language.classify(table, model).withColumn("held_out", language.held_out()).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in range(400))
    assert sum(got[i].lang_pred == rows[i][0] for i in held) >= 0.97 * len(held)
    for i, t in enumerate(odd, 400):
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
        else:
            assert got[i].lang_pred in model and 0 <= got[i].score <= 1
    kept = {r.doc_id for r in language.keep_accepted(table, model).collect()}
    assert kept == {i for i, r in got.items() if r.accepted}


def test_labels_of_held_out_rows_do_not_matter(docs):
    rows = corpus(120, 3)
    plain = docs([t for _, t in rows], langs=[x for x, _ in rows])
    other = plain.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    assert language.learn_dictionaries(plain.filter(~language.held_out())) == language.learn_dictionaries(other.filter(~language.held_out()))


def test_no_labels_and_empty(docs):
    table = docs(["some text"], langs=[None])
    model = language.learn_dictionaries(table)
    assert model == {}
    assert language.classify(table, model).first().lang_pred == "und"
    assert language.classify(docs([]), model).collect() == []


def test_equals_brute_force(docs):
    """Every encoding anew, without the classifier: whole texts, block by block, with each dictionary."""
    import zstandard as zstd

    rows = corpus(90, 5) + [("aa", " ".join(t for _, t in corpus(400, 6)))]
    table = docs([t for _, t in rows], langs=[x for x, _ in rows])
    model = language.learn_dictionaries(table.filter(~language.held_out()))
    parameters = zstd.ZstdCompressionParameters.from_level(language.LEVEL, min_match=language.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
    got = {r.doc_id: r for r in language.classify(table, model).collect()}
    for i, (_, text) in enumerate(rows):
        data, sizes = language.letters(text), {}
        for lang, content in model.items():
            coder = zstd.ZstdCompressor(compression_params=parameters, dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT))
            sizes[lang] = sum(len(coder.compress(data[at : at + 4096] + b" " * language.PADDING)) for at in range(0, len(data), 4096))
        best, second = sorted(sizes.values())[:2]
        assert sizes[got[i].lang_pred] == best and abs(got[i].score - (1 - best / second)) < 1e-12


def test_dictionaries_hold_whole_texts(docs, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3_000)) for _ in range(30)]
    model = language.learn_dictionaries(docs([*texts, *texts[:9]], langs=["en"] * 39))
    assert len(model["en"]) > 29 * 2_900 and all(language.letters(t) in model["en"] for t in texts)
    monkeypatch.setattr(language, "SAMPLE_DOCS", 5)
    few = language.learn_dictionaries(docs([*texts, *texts[:9]], langs=["en"] * 39))["en"]
    assert sum(language.letters(t) in few for t in texts) == 5
    monkeypatch.setattr(language, "SAMPLE_BYTES", 100)
    assert sum(language.letters(t) in language.learn_dictionaries(docs(texts))["en"] for t in texts) == 5


def test_keep_accepted_of_nothing(docs):
    table = docs(["some text", None, "12"], [None, 2, 3])
    assert language.keep_accepted(table.limit(0), {"en": b"text " * 10, "de": b"und " * 10}).collect() == []
    assert [r.text for r in language.keep_accepted(table, {"en": b"some text " * 10, "de": b"qrst uvw " * 10}).collect()] == ["some text"]
