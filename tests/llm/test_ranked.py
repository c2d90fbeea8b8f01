import collections
import math
import re

import numpy as np
import pytest
from wattline.llm import ranked, text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "extra string, doc_id long, text string, rank int"
ITEMS = "item_id long, text string, score int"


def terms(said):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in said or ""))


def brute(docs, items, k):
    known = [(i, terms(t)) for i, t in docs]
    known = [(i, t, collections.Counter(t)) for i, t in known if t]
    n, total = len(known), sum(len(t) for _, t, _ in known)
    df = collections.Counter(x for _, _, c in known for x in c)
    out = []
    for item, said in items:
        found = []
        for i, t, c in known:
            m = 50 + (50 * len(t) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(said)) if x in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def check(spark, docs, items, k=5):
    d = spark.createDataFrame([("x", i, t, 7) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)
    found = ranked.top(d, q, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, k)


def test_ranks_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ranked, "POSTINGS", 400)
    monkeypatch.setattr(ranked, "SPLITS", 3)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÜNDER", "Case", "case", "a1b2", "naïve"]
    odds = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=odds / odds.sum()))) for i in rng.permutation(300)]
    docs += [(3, docs[0][1]), (None, docs[1][1]), (None, docs[1][1]), (901, ""), (902, None), (903, "..!? --"), (904, "w1,w2;W3\tw4\x00w5")] + [(1000 + i, "tie tie breaker") for i in range(20)]
    items = [(i, " ".join(rng.choice(words, 12))) for i in range(12)] + [(50, "tie w3"), (50, "tie w3"), (51, None), (52, ""), (None, "breaker unseen"), (53, "unseen"), (54, "Case, case; CASE")]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b")])
    check(spark, [(1, "a b")], [])
    check(spark, [(1, None), (2, "")], [(1, "a b")])


def test_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(ranked, "CELLS", 8)  # ranks by binary search
    check(spark, [(1, "long word " * 200_000 + "rare"), (2, "rare word"), (3, "x" * 300_000 + " rare")], [(1, "rare word"), (2, "long")])


def test_interval_bounds_and_splits():
    """Every interval's bound is reached by no document, and its split document has the largest impact in it."""
    rng = np.random.default_rng(2)
    n, hits = 200, rng.random((7, 200)) < 0.3
    impact = rng.integers(1, 10**6, hits.shape) * hits
    places = np.concatenate([np.flatnonzero(x) for x in hits])
    part = ranked.Segment(places, np.concatenate([x[x > 0] for x in impact]), hits.sum(axis=1), n)
    lo = rng.integers(0, n - 1, 400)
    hi = lo + rng.integers(1, 40, 400).clip(max=n - lo)
    total, top = part.bounds(np.arange(7), lo, hi)
    for a, z, bound, at in zip(lo, hi, total, top):
        assert bound == impact[:, a:z].max(axis=1).sum() >= impact[:, a:z].sum(axis=0).max()
        if bound:
            assert a <= at < z and impact[:, at].max() == impact[:, a:z].max()


def test_most_documents_stay_unscored():
    rng = np.random.default_rng(3)
    n = 4000
    hits = rng.random((6, n)) < np.array([[0.5], [0.3], [0.1], [0.02], [0.01], [0.005]])
    impact = hits * rng.integers(1, 100, hits.shape) * np.array([[1], [5], [20], [100], [400], [1000]])
    part = ranked.Segment(np.concatenate([np.flatnonzero(x) for x in hits]), np.concatenate([x[x > 0] for x in impact]).astype(np.int64), hits.sum(axis=1), n)
    best = ranked.Best(10)
    ranked.search(part, np.arange(6), np.zeros(n, bool), np.arange(n), best)
    wanted = np.lexsort((np.arange(n), -impact.sum(axis=0)))[:10]
    assert best.id.tolist() == wanted.tolist() and best.splits < n / 4


def test_clashing_names(spark):
    with pytest.raises(ValueError):
        ranked.top(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, text string"), item="doc_id")


def test_lists_are_sorted_by_text():
    n, term, doc, times = ranked.counted(np.frombuffer(b"b a b" b"a", np.uint8), np.array([0, 5, 6]))
    assert n.tolist() == [3, 1] and len(term) == 3 and sorted(times.tolist()) == [1, 1, 2]
    assert len(np.unique(text.signed(term))) == 2
