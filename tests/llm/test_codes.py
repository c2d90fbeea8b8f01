import hashlib
import math

import numpy as np
from wattline.llm import codes

SCHEMA = "part string, vec_id long, embedding array<double>, label int, error double"
NAN, INF = float("nan"), float("inf")


def brute(rows):
    kept = [(i, v, g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    lengths = [len(v) for _, v, _ in kept]
    d = max(sorted(set(lengths)), key=lengths.count)
    kept = [(i, [max(-codes.LIMIT, min(codes.LIMIT, math.floor(1024 * x))) for x in v], g, v) for i, v, g in kept if len(v) == d]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cuts = [(int(x[0]), int(x[-1]) + 1) if len(x) else (0, 0) for x in np.array_split(np.arange(d), 4)]
    books = [[r[1][a:z] for r in kept[:256]] for a, z in cuts]
    for step in range(5):
        near = [[min((sum((x - y) ** 2 for x, y in zip(r[1][a:z], e)), k) for k, e in enumerate(book)) for book, (a, z) in zip(books, cuts)] for r in kept]
        if step == 4:
            break
        for p, (a, z) in enumerate(cuts):
            for k in range(len(books[p])):
                own = [r[1][a:z] for r, n in zip(kept, near) if n[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    error = [sum(x[0] for x in n) for n in near]
    by = {}
    for r, e in zip(kept, error):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{x[1]:02x}" for x in n), e, by[r[2]], digest) for r, n, e in zip(kept, near, error)), key=str)


def check(spark, rows):
    df = spark.createDataFrame([("p", i, v, g, 0.5) for i, v, g in rows], SCHEMA)
    found = codes.codes(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_codes_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 200)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=8).round(3).tolist(), int(i) % 3 or None) for i in rng.permutation(420)]
    rows += [(5, rows[0][1], 1), (None, rows[1][1], None), (None, rows[1][1], None), (7, None, 1), (8, [], 1), (9, [1.0, None] * 4, 2), (10, [NAN] * 8, 0), (11, [0.0] * 7 + [-INF], 0), (12, [1.0] * 7, 0)]
    rows += [(1000 + i, [0.25] * 8, 9) for i in range(30)] + [(2000, [1e30, -1e30, 4e38, 0.0, 0.0, 0.0, 0.0, -0.0], 9)]
    check(spark, rows)


def test_few_uneven_and_no_vectors(spark):
    check(spark, [(i, [i * 0.1, -0.3, i % 2 * 1.0, 0.5, 0.25, 2.0], None) for i in range(9)])
    check(spark, [(1, [0.5, 0.5], 1)])
    check(spark, [])
    check(spark, [(1, None, 1)])


def rounds_of(x, k, times):
    """Entries by bounds and by a full scan, and distances worked out, of a few rounds."""
    history, b, scanned = codes.History([x[:k]]), None, []
    for r in range(times):
        now = codes.Now(r, history.books[-1], history.groups, history.displaced())
        b = codes.first_look(x, now) if b is None else codes.closest(x, now, b)
        full = codes.squared(x, now.book)
        assert (b.entry == full.argmin(axis=1)).all() and (b.error == full.min(axis=1)).all()
        # every stored bound, less the displacement since its round, holds
        full = np.sqrt(full.astype(float))
        full[np.arange(len(x)), b.entry] = np.inf
        moved = history.displaced()
        for g, members in enumerate(history.groups):
            assert (b.lower[:, g] <= full[:, members].min(axis=1)).all() or (b.lower[:, g] - moved[b.stamp[:, g], g] <= full[:, members].min(axis=1)).all()
        scanned.append(b.scanned)
        history.books.append(np.array([x[b.entry == j].sum(axis=0) // max((b.entry == j).sum(), 1) if (b.entry == j).any() else now.book[j] for j in range(k)]))
    return scanned, history


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 6)) * 2000
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 6)) * 60).astype(np.int64)
    scanned, history = rounds_of(x, 64, 6)
    assert scanned[0] > 3000 * 64 and sum(scanned[2:]) < 4 * 3000 * 64 / 2
    stamps = history.displaced()
    drifts = [np.sqrt(((a - b).astype(float) ** 2).sum(axis=1)) for a, b in zip(history.books, history.books[1:])]
    for r in range(len(drifts)):  # net displacement is never more than the drifts of the rounds between
        total = sum(drifts[r:])
        assert all(stamps[r, g] <= total[m].max() + 1e-6 for g, m in enumerate(history.groups))


def test_ties_go_to_the_lower_entry():
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (2000, 2))
    rounds_of(x, 30, 6)


def test_exact_distances_of_large_numbers():
    x = np.array([[codes.LIMIT, -codes.LIMIT] * 20, [1, 2] * 20])
    assert codes.squared(x, -x).tolist() == [[sum((int(a) + int(b)) ** 2 for a, b in zip(u, v)) for v in x] for u in x]
