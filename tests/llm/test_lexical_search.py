"""Ranked lexical search against a plain version."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from bedside.llm import lexical_search as s

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    texts = [(d, Counter(plain_terms(t)), len(plain_terms(t))) for d, t in docs if plain_terms(t)]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    merged = {}
    for i, t in items:
        merged.setdefault(i, Counter()).update(plain_terms(t))
    out = []
    for i, wanted in merged.items():
        scored = []
        for d, c, n in texts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, d, -minus) for r, (minus, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


@pytest.fixture
def tables(spark):
    def build(docs, items):
        return (
            spark.createDataFrame([(*r, 1.0) for r in docs], "doc_id bigint, text string, score double").repartition(5),
            spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, rank string"),
        )

    return build


def words(rnd, n):
    return " ".join(rnd.choice(["The", "and", "ﬁsh", "ÉTÉ", "été", "KK", "it's", "a-b", "x1", "1x", "ſ", "日本語", "é", "_", "--", f"w{rnd.randrange(60)}"]) for _ in range(n))


def test_terms():
    text = "Ab_c-D1 ÉK日本 x y z\t\n\x00end@[`{~ 9"
    assert [t.decode() for t in s.terms(text.encode())] == plain_terms(text)


@pytest.mark.parametrize("postings", [200_000, 40])
def test_against_brute_force(spark, scratch, tables, monkeypatch, postings):
    monkeypatch.setattr(s, "POSTINGS", postings)
    rnd = random.Random(3)
    docs = [(i, words(rnd, rnd.randrange(60))) for i in range(150)] + [(None, words(rnd, 20)), (None, None), (500, None), (501, ""), (502, "-- !!"), (503, "the " * 40_000)]
    docs += docs[:20] + [(900 + i, docs[3][1]) for i in range(30)]
    items = [(i, words(rnd, rnd.randrange(1, 40))) for i in range(25)] + [(30, None), (31, ""), (32, "unheard words"), (None, "the fish"), (33, "the " * 500), (3, "été x1")]
    items += items[:2]
    d, i = tables(docs, items)
    got = Counter(tuple(r) for r in s.rank(d, i, 4, scratch).collect())
    assert got == brute(docs, items, 4)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None), (2, "..")], [(1, "a"), (2, "")])])
def test_nothing_to_find(spark, scratch, tables, docs, items):
    d, i = tables(docs, items)
    got = s.rank(d, i, 10, scratch)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.collect() == []


def test_sums_stay_exact():
    out = np.zeros((2, 3), np.int64)
    values = np.array([2**55 + 1, 2**54 + 3, 5, 1], np.int64)
    s._add(out, np.array([1, 1, 5, 1]), values)
    assert out.tolist() == [[0, 2**55 + 2**54 + 5, 0], [0, 0, 5]]


def test_best_keeps_ties_by_id():
    best = s.Best(2, 2)
    best.update([9, 4, None], np.array([[5, 0], [5, 1], [5, 0]]))
    best.update([3, None, 1], np.array([[5, 0], [7, 0], [4, 1]]))
    found = sorted(zip(best.item.tolist(), best.score.tolist(), [None if n else d for n, d in zip(best.nameless, best.doc.tolist())]), key=str)
    assert found == [(0, 5, 3), (0, 7, None), (1, 1, 1), (1, 1, 4)]


def test_scores_do_not_depend_on_how_much_is_held(monkeypatch):
    from types import SimpleNamespace as Row

    rnd = random.Random(6)
    items = [Counter(plain_terms(words(rnd, 30))) for _ in range(20)]
    index = s.Index([Row(item=i, term=t.encode(), n=n) for i, c in enumerate(items) for t, n in c.items()])
    found = [s.terms(words(rnd, rnd.randrange(50)).encode()) for _ in range(40)] + [[]]
    index.weigh({s.N_DOCS: 40, s.N_TERMS: 900} | {t: 1 + t % 30 for t in range(len(index.weights))})
    whole = index.scores(found)
    monkeypatch.setattr(s, "CELLS", 7)
    assert (index.scores(found) == whole).all() and whole.any()
