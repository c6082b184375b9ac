import random
import re
from itertools import permutations

from tidemark.llm import filter_audit


def brute(rows, labels):
    """The contract, row by row: rows are (doc_id, text, source), labels (doc_id, quality, toxic)."""
    parts = {}
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {c for c, bad in zip("ABCD", [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t)], strict=True) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        good, toxic = (any(k == i and r[c] == 1 for k, *r in labels if i is not None) for c in (0, 1))
        parts.setdefault(source or "", []).append((fails, good, toxic))
    out, shapley = {}, {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, c in enumerate(order, 1):
                gone, left = [d for d in left if c in d[0]], [d for d in left if c not in d[0]]
                failing = [d for d in docs if c in d[0]]
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[0] == {c} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def texts(rng):
    plain = " ".join(f"w{i}" for i in range(210))
    return [None, "", plain, plain.upper(), "same " * 300, plain + " #", "A b", "x" * 50, "é\u0000 ß\x1f " * 120, "$", "AB" + "c" * 98, "ABC" + "d" * 97, " \t\n\x0b\x0c\r", *(rng.choice([plain, "a b", "", "Q Q"]) for _ in range(25))]


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts(rng))]
    # Repeated rows, ids with several texts, rows without an id.
    rows += [rows[2], rows[2], (2, "other", "a"), (None, "a b", "a"), (None, "a b", "a"), (-5, "", "b"), (-5, "", "b")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 40, 2)] + [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, part int, digest string, label int").repartition(3)
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    found = filter_audit.audit_filters(df, marks)
    assert got(found) == brute(rows, labels)
    assert all(r.filter == r.filter_order[r.step - 1] for r in found.collect())


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(df, marks).collect() == []
    some = filter_audit.audit_filters(spark.createDataFrame([(1, None, None)], df.schema), marks).collect()
    assert len(some) == 600 and {(r.part, r.kept + r.removed + r.redundant) for r in some} <= {("", 0), ("", 1)}


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for j, order in enumerate(filter_audit.orders()):
        for mask in range(32):
            want = next((s for s, c in enumerate(order) if mask >> "ABCDE".index(c) & 1), 5)
            assert table[mask, j] == want


def test_many_parts_and_slices(spark, monkeypatch):
    """Counts handed on in between, and parts that several tasks share, add up."""
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(30)}", rng.randrange(32), rng.randrange(4), rng.randrange(1, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "part string, mask int, label int, n long").repartition(4)
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    monkeypatch.setattr(filter_audit, "LOOKUP_ROWS", 7)
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.interactions(df).collect()}
    assert len(found) == 600 * len({r[0] for r in rows})
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        r = found[part, "CADBE", 2]
        assert r.removed == sum(n for _, m, _, n in mine if not m & 4 and m & 1)
        assert r.good_lost == sum(n for _, m, label, n in mine if not m & 4 and m & 1 and label & 1)
        assert r.kept == sum(n for _, m, _, n in mine if not m & 5)
        assert r.unique_fails == sum(n for _, m, _, n in mine if m == 1)
