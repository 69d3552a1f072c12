import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import leakage as lk

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("bel", "dor", "fin", "gos", "hum", "jat", "kil", "lum", "mar", "nox")]


def items_of(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) + r.choice(["", "s", "ed"]) for _ in range(80)) + ".") for i in range(n)]


def filler(r, n):
    return " ".join(r.choice(["the", "queue", "ran", "over", "again", "because", "rows", "were", "late", "so", "we", "paused", "it"]) for _ in range(n))


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ids": F.lit("x"), "key": F.lit(1), "n": F.lit(2)})
    return d, spark.createDataFrame(items, "item_id long, text string")


def pairs(spark, docs, items, **how):
    found = lk.leaks(*frames(spark, docs, items), how=lk.Leak(**how)).where("kind = 'passage'").collect()
    return {(x.doc_id, x.item_id) for x in found}


def test_runs_disguises_and_near_misses(spark):
    r, items = random.Random(1), items_of(8)
    w = [t.split() for _, t in items]
    cut = lambda i, n, at=10: w[i][at : at + n]
    around = lambda x: f"{filler(r, 30)}. {x} {filler(r, 30)}."
    one_off = lambda ws: [x if i % 11 != 5 else "changed" for i, x in enumerate(ws)]
    shuffled = cut(5, 40)
    r.shuffle(shuffled)
    docs = [
        (1, around(" ".join(cut(0, 20)))),
        (2, around(" ".join(cut(1, 19)))),
        (3, around("\n> ".join([" ".join(cut(2, 30)[i : i + 5]).upper() for i in range(0, 30, 5)]))),
        (4, around(" ".join(one_off(cut(3, 40))))),
        (5, around(" ".join(x if i % 5 else "changed" for i, x in enumerate(cut(4, 60, 3))))),
        (6, around(" ".join(shuffled))),
        (7, around(" ".join(f"<b>“{x}”</b>" for x in cut(6, 25)))),
        (8, around(" ".join(x for i, x in enumerate(cut(7, 40)) if i % 12 != 6))),
        (9, around(" ".join(y for i, x in enumerate(cut(0, 33)) for y in ([x, "indeed"] if i % 12 == 6 else [x])))),
        (10, around(" ".join(x[:2] + " " + x[2:] if i % 12 == 6 else x for i, x in enumerate(cut(1, 36))))),
        (11, around(" ".join(cut(2, 24)).replace("a", "а", 2))),
        (12, items[3][1]), (13, items[3][1]),
        (14, None), (15, ""), (16, "  \n"), (17, filler(r, 60_000) + " " + " ".join(cut(4, 22)) + " " + filler(r, 20_000)),
        (18, around(" ".join(cut(0, 22)) + " " + filler(r, 3) + " " + " ".join(cut(6, 22)))),
    ]
    want = {(1, 0), (3, 2), (4, 3), (7, 6), (8, 7), (9, 0), (10, 1), (11, 2), (12, 3), (13, 3), (17, 4), (18, 0), (18, 6)}
    assert pairs(spark, docs, items) == want
    assert pairs(spark, docs, items, block=250) == want  # items in blocks


def test_candidates_lose_no_case(spark):
    """Recall of the cosine search against aligning every pair."""
    r, items = random.Random(2), items_of(40, 7)
    docs = []
    for i in range(150):
        k, n, at = r.randrange(40), r.randint(12, 40), r.randint(0, 40)
        ws = items[k][1].split()[at : at + n]
        ws = [x for x in ws if r.random() > 0.04]
        docs.append((i, f"{filler(r, 20)} {' '.join(ws)} {filler(r, 20)}"))
    how = lk.Leak()
    its = lk.Items(items, how)
    want = set()
    for i, t in docs:
        ws = lk.words_of(t)
        ids = [its.ids.get(x, -1) for x in ws]
        joined = [its.ids.get(a + b, -1) for a, b in zip(ws, ws[1:])] + [-1]
        want |= {(i, k) for k, words in zip(its.keys, its.words, strict=True) if lk.aligned(words, ids, joined, how)}
    assert len(want) > 40 and pairs(spark, docs, items) == want


def test_paraphrase(spark):
    """Every sixth word is another: no run of 20 with two errors, but most words in order, names among them."""
    r, items = random.Random(4), items_of(3, 9)
    ws = items[1][1].rstrip(".").split()
    plain = set(ws[::6])  # words that many texts have; the others are the item's own
    swapped = [filler(r, 1) if x in plain else x for x in ws]
    docs = [(1, " ".join(swapped)), (2, filler(r, 200)), (3, " ".join(r.sample(ws, len(ws)))), (4, " ".join(ws[:10]))]
    docs += [(10 + i, " ".join(sorted(plain)[:17])) for i in range(10)]
    got = [(x.doc_id, x.item_id) for x in lk.leaks(*frames(spark, docs, items), how=lk.Leak(cosine=0.3)).where("kind = 'paraphrase'").collect()]
    assert got == [(1, 1)]


def test_balls_lose_nothing():
    r = np.random.default_rng(3)
    centres = r.standard_normal((12, 24))
    v = np.concatenate([c + 0.4 * r.standard_normal((20, 24)) for c in centres]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    z = np.concatenate([v[::3] + 0.1 * r.standard_normal((80, 24)).astype(np.float32), r.standard_normal((60, 24)).astype(np.float32)])
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for least in (0.5, 0.75, 0.95):
        balls = lk.Balls(v, least)
        assert sorted(np.concatenate(balls.members)) == list(range(len(v)))
        looked = 0
        for x in z:
            some = set(balls.near(x[None], 0.7).tolist())
            looked += len(some)
            assert set(np.flatnonzero(v @ x >= 0.7)) <= some
        assert least == 0.5 or looked < len(z) * len(v) * 0.6


def test_sums_in_rounds_equal_one_sum(spark):
    r = random.Random(6)
    items = lk.Items(items_of(4), lk.Leak())
    texts = [[r.randrange(-1, items.size) for _ in range(r.randint(18, 60))] for _ in range(90)]
    idf = np.linspace(1, 3, items.size)
    basis = np.random.default_rng(1).standard_normal((items.size, 8)).astype(np.float32)
    rows = spark.createDataFrame([(x,) for x in texts], "ids array<int>")
    a = np.concatenate([lk._tfidf(lk._windows(np.array(x), lk.Leak()), idf) for x in texts] + [lk._tfidf(items.windows, idf)]).astype(np.float64)
    want = a.T @ (a @ basis)
    for parts in (1, 5, 40):  # none, one and two rounds
        got = lk._gram_times(rows.repartition(parts), parts, idf, basis, items.windows, lk.Leak())
        assert np.allclose(got, want, atol=1e-2)


def test_every_run_has_the_common_subsequence():
    """What the alignment takes is never refused by the subsequence before it."""
    r, how = random.Random(7), lk.Leak()
    for _ in range(400):
        item = [r.randrange(60) for _ in range(40)]
        text, joined = [], []
        for w in item[5:30]:
            c = r.random()
            text += [] if c < 0.04 else [99] if c < 0.08 else [w, 98] if c < 0.12 else [w]
        joined = [-1] * len(text)
        if lk.aligned(item, text, joined, how):
            assert lk.common_subsequence(item, text, joined) >= how.words - how.words // how.per_error


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "text")], items_of(2))
    assert lk.leaks(docs.limit(0), items).count() == 0
    assert lk.leaks(docs, items.limit(0)).count() == 0
    assert lk.leaks(docs, items.withColumn("text", F.lit("too short"))).count() == 0
    assert lk.leaks(docs, items).count() == 0


def test_common_subsequence():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 5, 12).tolist(), r.integers(0, 5, 15).tolist()
        t = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert lk.common_subsequence(a, b) == t[12, 15]


@pytest.mark.parametrize(("text", "words"), [("A<br>b &amp; C-d", ["a", "b", "c", "d"]), ("ﬁne “Ｘ” can't", ["fine", "x", "can", "t"]), ("pаss", ["pass"]), ("", [])])
def test_words(text, words):
    assert lk.words_of(text) == words


@pytest.mark.parametrize(("text", "words"), [("a<!-- one two\nthree <b> --->b", ["a", "b"]), ("a <!-- x --> b <!--y--> c", ["a", "b", "c"]), ("a <!-- not closed", ["a", "not", "closed"]), ("<!--" * 200_000 + "b", ["b"])])
def test_comments_are_no_words(text, words):
    assert lk.words_of(text) == words
