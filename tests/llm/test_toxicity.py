import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from wattline.llm import text, toxicity


def lessons_of(spark, rows):
    """Lessons (model, text, toxic), compressed."""
    df = spark.createDataFrame([(m, t.encode(), x) for m, t, x in rows], "model int, text binary, toxic int")
    return toxicity.squeezed(df.select("model", "text", "toxic").select(F.struct("model", "toxic").alias("k"), "text")).select("k.model", "k.toxic", F.col("text").alias("body"))


def whole(texts):
    raw = [x.encode() for x in texts]
    return text.Words(np.frombuffer(b"".join(raw), np.uint8), text.offsets_of(np.array([len(x) for x in raw])), lower=True)


def key_of(word):
    return int(whole([word]).hashes()[0])


def unpacked(table, wide):
    """Counts by hash."""
    out = {}
    for r in table.collect():
        rows = toxicity.unpack(r.rows).reshape(wide, -1)
        out.update(zip(toxicity.unpack(r.keys, np.uint64).tolist(), rows.T.tolist()))
    return out


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(0, " ".join(f"w{i} hub" for i in range(3000)), 0), (1, "red fox red fox blue", 1), (0, "late word late", 1), (1, "red blue", 0)]
    pairs = toxicity.pair_counts(lessons_of(spark, rows), (2, 3))
    table = toxicity.word_counts(pairs)
    return rows, pairs, table, unpacked(table, 14)


def about(words, word, name, model=1):
    return words[key_of(word)][7 * model + toxicity.ABOUT_WORD.index(name)]


def test_contexts_have_no_ceiling(counted):
    *_, words = counted
    assert about(words, "hub", "after0") == 3000 and about(words, "hub", "kinds") == 2999


def test_every_bigram_is_stored(counted):
    rows, pairs, *_ = counted
    seen = collections.Counter()
    for model, said, toxic in rows:
        seen.update((a, b, 2 * model + toxic) for a, b in zip(["", *said.split()], said.split()))
    hashed = {}
    for (a, b, kind), n in seen.items():
        before = toxicity.START if not a else np.uint64(key_of(a))
        pair = int(toxicity.both(np.array([before]), np.array([key_of(b)], np.uint64))[0])
        hashed.setdefault(pair, [0] * 4)[kind] += n
    assert unpacked(pairs.where("kind = 0"), 4) == hashed


def test_passages_and_means():
    texts = ["a b c d e f g", "", "a", "b a " * 9]
    w = whole(texts)
    value = np.random.default_rng(1).normal(size=len(w.starts))
    n, mean, _, *tops = toxicity.features(w, [value, value])
    assert n.tolist() == [7, 0, 1, 18]
    for at, (a, z) in enumerate(zip(w.first[:-1], w.first[1:])):
        assert mean[at] == pytest.approx(value[a:z].mean() if z > a else 0)
        for k, length in enumerate(toxicity.PASSAGES):
            best = max((value[i : i + length].mean() for i in range(a, z - length + 1)), default=mean[at])
            assert tops[2 * k][at] == pytest.approx(best)
    assert min(toxicity.PASSAGES) > 1 and "ln(1 + words)" in toxicity.Curve().inputs()


def test_an_expression_seen_once_counts(counted):
    _, pairs, table, words = counted
    size = toxicity.sizes(pairs, table)[1]
    assert all(0 < d < 1 for d in (*size.word_discount, *size.discount))
    w = whole(["late blue late"])
    numbers, keys = toxicity.asked(w)
    known = np.array([words.get(k, [0] * 14)[7:] for k in keys[0].tolist()]).T
    alone, after = toxicity.ratios(size, numbers, [known, np.zeros((2, len(keys[1])), np.int64)])
    rest = [size.word_discount[c] * size.kinds[c] / size.total[c] / size.known for c in (0, 1)]
    once = [max(n - size.word_discount[c], 0) / size.total[c] + rest[c] for c, n in enumerate((0, 2))]
    assert alone[0] == pytest.approx(math.log(once[1] / once[0])) and alone[0] > 0
    assert np.isfinite(after).all()


def test_all_lessons_teach_the_last_model(counted):
    *_, words = counted
    assert about(words, "red", "after1") == 2 and about(words, "red", "after1", 0) == 0
    assert about(words, "late", "after1") == about(words, "late", "after1", 0) == 2


class Plain:
    """Kneser-Ney of words and bigrams in dictionaries."""

    def __init__(self, lessons):
        self.n = [collections.Counter(), collections.Counter()]
        for said, toxic in lessons:
            self.n[toxic].update(zip([None, *said], said))
        vocabulary = {w for c in self.n for p in c for w in p} - {None} | {None}
        self.known = len(vocabulary if any(self.n) else [1])
        self.after, self.total, self.follow = [], [], []
        everything = self.n[0] + self.n[1]
        for c in (*self.n, everything):
            self.after.append(collections.Counter(w for _, w in c))
            f = collections.defaultdict(lambda: [0, 0])
            for (b, _), k in c.items():
                f[b][0] += k
                f[b][1] += 1
            self.follow.append(f)
        self.n.append(everything)

        def discount(counts):
            n1, n2 = (sum(v == k for v in counts) for k in (1, 2))
            return (n1 + 1) / (n1 + 2 * n2 + 2)

        self.words = [discount(a.values()) for a in self.after[:2]]
        self.pairs = [discount(c.values()) for c in self.n]

    def ratios(self, said):
        alone, pairs = [], []
        for before, word in zip([None, *said], said):
            p, q = [], []
            for c in (0, 1):
                total = sum(self.after[c].values())
                rest = self.words[c] * len(self.after[c]) / total if total else 1.0
                p.append(max(self.after[c][word] - self.words[c], 0) / max(total, 1) + rest / self.known)

                def over(base, k):
                    seen, kinds = self.follow[k].get(before, (0, 0))
                    back = self.pairs[k] * kinds / seen if seen else 1.0
                    return max(self.n[k][before, word] - self.pairs[k], 0) / max(seen, 1) + back * base

                q.append(over(over(p[c], 2), c))
            alone.append(math.log(p[1] / p[0]))
            pairs.append(math.log(q[1] / q[0]))
        return alone, pairs

    def row(self, said):
        values = self.ratios(said)
        means = [sum(v) / max(len(said), 1) for v in values]
        tops = [max((sum(v[i : i + n]) / n for i in range(len(said) - n + 1)), default=m) for n in toxicity.PASSAGES for v, m in zip(values, means)]
        return [len(said), *means, *tops]


def test_scores_as_plain_python(spark):
    rng = np.random.default_rng(9)
    clean, bad = [f"w{i}" for i in range(80)], ["vile", "scum", "foul", "rot"]
    docs, labels = [], []
    for i in range(240):
        said = list(rng.choice(clean, rng.integers(0, 40)))
        toxic = bool(rng.random() < 0.3)
        if toxic:
            said.insert(int(rng.integers(0, len(said) + 1)), " ".join(rng.choice(bad, 2)))
        docs.append((i, " ".join(said)))
        if i % 10:
            labels.append((i, int(toxic)))
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in docs}
    truth, said = dict(labels), {i: t.split() for i, t in docs}
    early, last = (Plain([(said[i], y) for i, y in labels if fold[i] in folds]) for folds in ((0, 1), (0, 1, 3)))
    teach = [(early.row(said[i]), truth[i]) for i in truth if fold[i] == 3 and said[i]]
    x, y = np.array([r for r, _ in teach]), np.array([t for _, t in teach])

    def inputs(rows, k):
        return np.column_stack([rows[:, 1], rows[:, 2], rows[:, 3 + 2 * k], rows[:, 4 + 2 * k], np.log1p(rows[:, 0]), np.ones(len(rows))])

    k, best = min(((k, toxicity.logistic(inputs(x, k), y, n)) for k, n in enumerate(toxicity.PASSAGES)), key=lambda b: b[1][0])
    rows = np.array([last.row(said[i]) for i, _ in docs])
    wanted = np.where(rows[:, 0] == 0, 0, 1 / (1 + np.exp(-inputs(rows, k) @ np.array(best[1].weights))))
    found = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.doc_id: r.held_out for r in found} == {i: fold[i] == 2 for i, _ in docs}
    assert [r.score for r in sorted(found)] == pytest.approx(wanted.tolist(), abs=1e-6)
    assert [r.predicted for r in sorted(found)] == (wanted >= 0.3).astype(int).tolist()


def test_a_very_long_text_and_repeated_rows(spark):
    rng = np.random.default_rng(10)
    long = " ".join(rng.choice([f"w{i}" for i in range(500)], 400_000))
    docs = [(1, long + " vile scum"), (1, long), (2, "x" * 400_000), (3, "vile scum"), (3, "vile scum"), (4, None), (None, "vile"), (5, "w1 w2 w3"), (6, "w4 w5")]
    labels = [(i, int(i in (3, 7))) for i in range(1, 8)] + [(3, 0), (None, 1), (5, None)]
    found = toxicity.score(spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = found.collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in docs)
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 3}) == 1


def test_the_sample_is_gone_before_documents_are_scored(spark, monkeypatch):
    import os
    import re

    from wattline import lineage

    folder = re.sub("^file:", "", lineage.shared_dir(spark))
    old, seen, measure = set(os.listdir(folder)), [], toxicity.measured

    def measured(of_docs, *args):
        seen.append(({re.sub("-[0-9a-f]{32}$", "", x) for x in os.listdir(folder) if x not in old}, of_docs.count()))
        return measure(of_docs, *args)

    monkeypatch.setattr(toxicity, "measured", measured)
    monkeypatch.setattr(toxicity, "BLOCK", 1)
    docs = spark.createDataFrame([(i, f"some words of {i} and {i % 7}") for i in range(160)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 160
    assert "sample" in seen[0][0] and not any("sample" in names for names, _ in seen[1:])
    assert sum(n for _, n in seen[1:]) == 160 and max(n for _, n in seen[1:]) <= 160 // 4


def test_no_task_holds_two_python_workers(spark, monkeypatch):
    import re

    from wattline import lineage

    def workers(df):
        """Python steps on a way through the plan without an exchange between, at most."""
        path, most = [], 0
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            lead = re.match(r"[ :+-]*", line)[0]
            del path[len(lead) // 3 :]
            name = re.sub(r"^[*^]?(\(\d+\) )?", "", line[len(lead) :])
            above = path[-1] if path else 0
            path.append(0 if re.match(r"\w*Exchange", name) else above + bool(re.search(r"^\w*(Arrow|Python|Pandas)", name)))
            most = max(most, path[-1])
        return most

    seen = {}

    def stage(df, name="stage"):
        seen[name] = max(seen.get(name, 0), workers(df))
        return lineage.stage(df, name)

    monkeypatch.setattr(toxicity, "stage", stage)
    docs = spark.createDataFrame([(i, f"some words of {i} and {i % 7}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.kept(docs, labels)
    assert {"lessons", "sample", "pairs", "words", "blocks", "measured"} <= set(seen)
    assert max(seen.values()) == 1, seen


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_opened_texts_come_in_the_blocks_they_make(monkeypatch, limit):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(toxicity, "BLOCK", limit)
    texts = [b"", b"x" * 30, b"y" * 10, b"z" * 90, b"", b"w" * 7, b"v" * 40]
    batch = pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor().compress(x) for x in texts]), pa.array(range(7), pa.int32())], names=["text", "toxic"])
    plain = pa.RecordBatch.from_arrays([pa.array(texts), batch.column(1)], names=["text", "toxic"])
    wanted = [rows.to_pylist() for rows, _, _ in text.blocks(iter([plain]), "text", limit)]
    found = [rows.to_pylist() for rows, _, _ in text.blocks(toxicity.swollen(iter([batch, batch.slice(0, 0)]), "text"), "text", limit)]
    assert found == wanted
