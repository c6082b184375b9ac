import math
import random
import re
from collections import Counter

from tidemark.llm import decontaminate


def world(rng):
    words = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and"]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    items = [f"{sentence(rng.randint(6, 30))}?\n{sentence(rng.randint(1, 30))}" for _ in range(60)]
    texts, leaked = [], set()
    for i in range(150):
        text = [sentence(rng.randint(0, 200))]
        for k in rng.sample(range(60), rng.choice((0, 0, 1, 2))):
            text += [items[k].upper() if rng.random() < 0.3 else items[k], sentence(20)]
            leaked.add((i, k))
        texts.append(" . ".join(text))
    return items, texts, leaked


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")


def test_finds_what_was_planted(spark, docs, odd):
    items, texts, leaked = world(random.Random(1))
    table = docs(texts + odd)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, items_table(spark, items)).collect()}
    assert got == leaked
    kept = {r.doc_id for r in decontaminate.drop_leaks(table, items_table(spark, items)).collect()}
    assert kept == set(range(len(texts) + len(odd))) - {i for i, _ in leaked}


def test_half_an_item_is_no_leak(spark, docs):
    items, _, _ = world(random.Random(2))
    table = docs([t.split("\n")[0] for t in items if len(t.split("\n")[1].split()) > 8])
    assert decontaminate.find_leaks(table, items_table(spark, items)).count() == 0


def test_retrieval_equals_exhaustive_scores():
    rng = random.Random(3)
    items, texts, _ = world(rng)
    index = decontaminate.Index(list(enumerate(items)))
    for _ in range(200):
        query = sorted(set(rng.sample(range(len(index.terms)), 40)) | {t for t in range(len(index.terms)) if any(n == 7 for n, _ in index.postings[t]) and rng.random() < 0.7})
        scores = {}
        for t in query:
            for n, w in index.postings[t]:
                scores[n] = scores.get(n, 0.0) + w
        assert {n for n, s in scores.items() if s >= 0.3} == {n for n, _ in index.retrieve(query, 0.3)}


def test_several_indexes_nulls_and_empty(spark, docs):
    items, texts, leaked = world(random.Random(4))
    rows = items_table(spark, [*items, None, "", "?"])
    assert len(list(decontaminate.build_indexes(rows, max_chars=500))) > 3
    assert decontaminate.find_leaks(docs([]), rows).collect() == []
    assert decontaminate.find_leaks(docs(texts), items_table(spark, [])).collect() == []


def brute_leaks(texts, items):
    """{(text, item): (score, question overlap, answer overlap)}: every passage against every item, BM25 worked out in full."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    cut = [words(t) for t in items]
    live = [k for k, w in enumerate(cut) if w]
    mean, longest = sum(len(cut[k]) for k in live) / len(live), max(len(cut[k]) for k in live)
    times = [Counter(cut[k]) for k in range(len(items))]
    held = Counter(w for k in live for w in times[k])
    idf = {w: math.log(1 + (len(live) - n + 0.5) / (n + 0.5)) for w, n in held.items()}
    weight = lambda k, w: idf[w] * times[k][w] * 2.2 / (times[k][w] + 1.2 * (0.25 + 0.75 * len(cut[k]) / mean))
    own = {k: sum(weight(k, w) for w in times[k]) for k in live}
    parts = {k: [words(x) for x in decontaminate.question_and_answer(items[k])] for k in live}
    grams = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if n else set()
    out = {}
    for i, text in enumerate(texts):
        ws = words(text or "")
        for start in range(-longest, len(ws), longest):
            passage = ws[max(0, start) : start + 2 * longest]
            seen = set(passage)
            for k in live:
                score = sum(weight(k, w) for w in times[k] if w in seen) / own[k]
                if score < 0.6 - 1e-9:
                    continue
                overlaps = []
                for part in parts[k]:
                    size = min(5, len(part))
                    mine = grams(part, size)
                    overlaps.append(len(mine & grams(passage, min(size, len(passage)))) / len(mine) if mine else 1.0)
                if min(overlaps) >= 0.6:
                    out[i, k] = max(out.get((i, k), ()), (round(score, 9), *(round(x, 9) for x in overlaps)))
    return out


def test_equals_brute_force(spark, docs, odd):
    rng = random.Random(8)
    items, texts, _ = world(rng)
    # Damaged items too, around the thresholds.
    for _ in range(60):
        words = rng.choice(items).replace("\n", " ").split()
        texts.append(" ".join(w for w in words if rng.random() > rng.choice((0.02, 0.1, 0.3))))
    texts += odd
    got = decontaminate.find_leaks(docs(texts), items_table(spark, items)).collect()
    assert {(r.doc_id, r.item_id): tuple(round(x, 9) for x in r[2:]) for r in got} == brute_leaks(texts, items)
