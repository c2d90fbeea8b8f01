import hashlib

import numpy as np
import pytest
from wattline.llm import bytespans, induced

SCHEMA = "first int, doc_id long, text string, n_bytes int"


def brute(rows, window):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), [None] * len(rows)
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - window + 1):
            s = raw[a : a + window]
            if s in seen:
                gone[a : a + window] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (rows[i][0], len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return sorted(out, key=str)


def check(spark, rows, window=64):
    found = bytespans.repeats(spark.createDataFrame([(1, i, t, 2) for i, t in rows], SCHEMA), window)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, window)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeñü"), rng.integers(2, 7))) for _ in range(200)]

    def said(n):
        return " ".join(rng.choice(words, n))

    shared = [said(30) for _ in range(6)]
    rows = []
    for i in rng.permutation(120):
        parts = [said(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            s = shared[rng.integers(0, 6)]
            a = int(rng.integers(0, 60))
            parts += [s[a : a + int(rng.integers(40, 200))], said(int(rng.integers(0, 10)))]
        rows.append((int(i), "".join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(20)] + [(300 + k, rows[k][1].replace("a", "b", 2)) for k in range(30)]
    return rows + [(500, None), (501, ""), (502, "short"), (503, "ab" * 300), (504, "z" * 500), (505, "z" * 63), (506, "q" + "z" * 64), (507, shared[0] * 5)]


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bytespans, "BLOCK", 3000)
    monkeypatch.setattr(bytespans, "SHARD", 2000)
    check(spark, corpus(1))


def test_null_and_repeated_ids(spark):
    rows = corpus(2)[:60]
    # of copies the first stays; all share id and text, so their order can't show
    check(spark, rows + [(None, rows[0][1]), (700, rows[3][1]), (700, rows[3][1]), (700, rows[3][1])])


def test_segments_in_pieces(monkeypatch):
    """Every window is in one segment, equal windows have equal anchors, and equal segments equal hashes."""
    raw = [(t or "").encode() for _, t in corpus(4)[:40]]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for piece in (1 << 19, 100):
        monkeypatch.setattr(bytespans, "PIECE", piece)
        anchors, wholes, seen = {}, {}, set()
        for doc, first, count, anchor, whole in zip(*(x.tolist() for x in bytespans.segments(data, offsets, 64, 28))):
            assert wholes.setdefault(whole, raw[doc][first : first + count + 63]) == raw[doc][first : first + count + 63]
            for a in range(first, first + count):
                assert (doc, a) not in seen and anchors.setdefault(raw[doc][a : a + 64], anchor) == anchor
                seen.add((doc, a))
        assert len(seen) == sum(max(len(x) - 63, 0) for x in raw)


def test_later_windows_across_waves(monkeypatch):
    rng = np.random.default_rng(8)
    for wave in (2, 3, 1 << 20):
        monkeypatch.setattr(induced, "WAVE", wave)
        for _ in range(40):
            t = rng.integers(1, 3, 80).astype(np.uint16)
            starts = rng.random(80) < 0.7
            starts[-4:] = False
            seen, wanted = set(), []
            for i in np.flatnonzero(starts):
                s = tuple(t[i : i + 5])
                wanted.append(s in seen)
                seen.add(s)
            assert bytespans.later(t, starts, 5)[starts].tolist() == wanted


def test_empty_tables(spark):
    check(spark, [])
    check(spark, [(1, None), (2, "")])


def test_a_very_long_text(spark):
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("abcdefgh "), 3_000_000))
    found = {r.doc_id: r for r in bytespans.repeats(spark.createDataFrame([(1, 5, long, 0), (1, 6, long[1_000_000:1_500_000] + "x" + long[7:2007], 0), (1, 7, "y" * 400_000, 0)], SCHEMA)).collect()}
    assert found[5].n_removed == 0 and found[5].kept_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert (found[6].n_removed, found[6].n_spans, found[6].kept_sha256) == (502_000, 2, hashlib.sha256(b"x").hexdigest())
    # the first 100 bytes start nowhere earlier, all later strings do, and cover all but the first byte
    assert (found[7].n_removed, found[7].n_spans) == (399_999, 1)


def test_window_bounds(spark):
    with pytest.raises(ValueError):
        bytespans.repeats(spark.createDataFrame([], SCHEMA), 10)


@pytest.mark.parametrize("base,small,wave", [(1 << 20, 1 << 10, 1 << 20), (2, 3, 3), (2, 1 << 10, 5)])
def test_suffixes_and_prefixes(monkeypatch, tmp_path, base, small, wave):
    """By recursion and in memory, in queues in memory and on disk."""
    monkeypatch.setattr(induced, "BASE", base)
    monkeypatch.setattr(induced, "SMALL", small)
    monkeypatch.setattr(induced, "WAVE", wave)
    rng = np.random.default_rng(base + wave)
    for trial in range(60):
        if trial == 30:
            monkeypatch.setattr(induced, "MEMORY", 0)
            monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
        n, size, cap = int(rng.integers(1, 90)), int(rng.integers(1, 6)), int(rng.integers(1, 20))
        t = rng.integers(0, size, n).astype(np.uint16)
        t = np.tile(t[:7], 9) if trial % 5 == 0 else np.zeros(n, np.uint16) if trial % 7 == 0 else t
        order, prefix = (np.concatenate(x) for x in zip(*induced.suffixes(t, size, cap)))
        wanted = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        heads = [t[i : i + cap].tolist() for i in wanted]
        assert sorted(order) == list(range(len(t))) and [t[i : i + cap].tolist() for i in order] == heads
        shared = [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip([[], *heads], heads)]
        assert prefix.tolist() == shared
    assert not list(tmp_path.iterdir())
