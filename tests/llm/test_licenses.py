import re

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns_equal_brute_force(docs, odd):
    texts = odd + ["CC-BY cc by cc  by-sa", "General\nPublic, License. All rights   reserved; all rights reserved", "ccby xcc by", "cc by general public license cc by", "GENERAL PUBLIC LICENSEé", "éall rights reserved"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:6] == brute(t), repr(t)
        assert set(filter(None, got[i].base_labels.split(","))) <= set(filter(None, got[i].labels.split(",")))
        assert 0 <= got[i].score <= 1
    assert licenses.scan_licenses(docs([])).collect() == []


def test_null_ids_and_repeated_rows(docs):
    got = licenses.scan_licenses(docs(["cc by", "cc by", None], [None, None, None])).collect()
    assert sorted((r.doc_id, r.n_base) for r in got) == [(None, 0), (None, 1), (None, 1)]


def test_expressions():
    parse = licenses.parse_expression
    assert parse("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert parse("(MIT OR GPL-2.0) AND X WITH Y */ rest") == ["mit", "gpl-2.0", "or", "x", "y", "with", "and"]
    assert parse("MIT trailing words") == ["mit"]
    assert parse("MIT OR") == ["mit"]
    assert parse("(MIT") is None and parse("") is None and parse("OR MIT") is None
    assert licenses.evaluate(parse("GPL-2.0 OR MIT"))[1] is True
    assert licenses.evaluate(parse("GPL-2.0 AND MIT"))[1] is False
    assert "spdx:mit" in licenses.Scanner().scan("# SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode")[5]


def test_long_expression_is_read_to_its_end():
    names = [f"mit-{i}" for i in range(50_000)]
    scan = licenses.Scanner().scan
    got = scan(f"SPDX-License-Identifier: {' AND '.join(names)} AND GPL-3.0-only\nOR zlib")
    assert set(got[5].split(",")) >= {f"spdx:{x}" for x in [*names, "gpl-3.0-only"]} and got[6] == 1.0
    assert scan(f"SPDX-License-Identifier: {' AND '.join(names)}\nAND GPL-3.0-only")[6] == 0.5
    two = scan("SPDX-License-Identifier: MIT */ x SPDX-License-Identifier: Zlib")[5]
    assert two == "spdx:mit,spdx:zlib"
