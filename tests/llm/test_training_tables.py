"""Operators on embeddings, URLs and conversations, and the pipeline, against plain Python."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from compare import compare, connect

import corpus_pipeline
from wattline.llm import chat, neighbours, queries, urls
from wattline.llm.components import components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4200)] + [(None, 3), (7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            top[high] = low
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(x, find(x)) for x in top}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 10))
    near = [centres[i % 12] + rng.normal(scale=0.12, size=10) for i in range(200)]
    rows = [(i, [float(x) for x in np.float32(v)], 1.0) for i, v in enumerate(near)]
    rows += [(300 + i, rows[5][1], 1.0) for i in range(30)] + [(400, [3 * x for x in rows[9][1]], 1.0), (401, None, 1.0), (402, [0.0] * 10, 1.0), (403, [float("nan")] * 10, 1.0), (404, [None, *[1.0] * 9], 1.0)]
    rows += [(405, [], 1.0), (406, rows[2][1][:5], 1.0), (407, [1e-38] * 10, 1.0), (408, [3e38] * 10, 1.0), (None, rows[7][1], 1.0), (0, rows[0][1], 1.0), (409, [float("inf"), *[1.0] * 9], 1.0)]
    found = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links double")).collect()
    unit = {}
    for i, (_, v, _) in enumerate(rows):
        if v and None not in v and all(math.isfinite(x) for x in np.float32(v)) and any(np.float32(v)):
            x = np.float32(v).astype(float)
            x /= np.abs(x).max()
            unit[i] = x / np.sqrt((x * x).sum())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    count = collections.Counter()
    for i in unit:
        for j in unit:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                count[i] += 1
                count[j] += 1
                top[find(i)] = find(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    expected = [(k, count[i], least.get(find(i)), k is not None and k == least.get(find(i))) for i, (k, *_) in enumerate(rows)]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, expected)) and len(count) > 100
    assert neighbours.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def ratio_of(url, counts, order=urls.ORDER):
    """Mean log-ratio by the same model, one character after the other."""
    total, padded = 0, urls.EDGE * order + url
    for i in range(len(url)):
        window = padded[i : i + order + 1]
        chance = {}
        for c in (1, 0):
            p = 1 / urls.ALPHABET
            for k in range(1, order + 2):
                gram = window[-k:]
                after = counts[c][k].get(gram[:-1])
                if after:
                    p = (after[gram[-1]] + len(after) * p) / (sum(after.values()) + len(after))
            chance[c] = p
        total += round((math.log(chance[1]) - math.log(chance[0])) * urls.UNIT)
    return total / len(url) / urls.UNIT if url else 0.0


URLS = [
    (900, None), (901, ""), (902, "no scheme"), (903, "http://A.Example.COM"), (904, "http://example.com/en/x?y#z"), (905, "http://WWW.example.com/en/1"), (906, "x://badexample.com/en/1"),
    (907, "http://q.net/es/2"), (908, "http://q.net/esx"), (909, "http://h.org/p"), (910, "http://u/a://b.net/fr/"), (911, "http://example.com:80/en/"), (None, "http://e.net/fr/9"), (909, "http://h.org/p"),
]


def test_urls_equal_plain_python(spark):
    rng = random.Random(8)
    rows = list(URLS)
    for i in range(400):
        host = "".join(rng.choices("abcd", k=4)) + rng.choice([".example.com", ".example.net", ".other.com", ".example.org"])
        rows.append((i, f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.randrange(1000)}"))
    found = urls.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, host string")).collect()

    def parts(u):
        rest = (u or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        return rest[:cut].lower(), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]

    def rule(host, path):
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    kept = {r.url for r in spark.createDataFrame([(u,) for _, u in rows if u], "url string").where(f"pmod(xxhash64(url), {urls.FOLDS}) = 0").collect()}
    counts = {c: {k: collections.defaultdict(collections.Counter) for k in range(1, urls.ORDER + 2)} for c in (0, 1)}
    for _, u in rows:
        verdict = rule(*parts(u))[1]
        if u and verdict and u not in kept:
            padded = urls.EDGE * urls.ORDER + u
            for i in range(len(u)):
                window = padded[i : i + urls.ORDER + 1]
                for k in range(1, urls.ORDER + 2):
                    counts[int(verdict == "allow")][k][window[-k:][:-1]][window[-1]] += 1
    scores = {u: ratio_of(u or "", counts) for _, u in rows}
    held = [(math.floor(round(scores[u] * urls.UNIT * len(u)) / len(u) / (urls.UNIT // urls.BIN)), rule(*parts(u))[1]) for _, u in rows if u in kept and rule(*parts(u))[1]]
    n = collections.Counter(v for _, v in held)
    best = max(sorted({b for b, _ in held}), key=lambda b: sum(x >= b and v == "allow" for x, v in held) / n["allow"] + sum(x < b and v == "block" for x, v in held) / n["block"])
    expected = []
    for i, u in rows:
        host, path = parts(u)
        name, verdict = rule(host, path)
        expected.append((i, host, path, name, round(scores[u], 5), verdict or ("allow" if scores[u] >= best / urls.BIN else "block")))
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, round(r.score, 5), r.verdict) for r in found))) == sorted(map(str, expected))
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    alone = urls.judge(spark.createDataFrame([(1, None), (2, "http://a.org/")], "page_id long, url string")).collect()
    assert {r.verdict for r in alone} == {"allow"}


def test_chat_round_trip(spark):
    said = [
        (1, 0, "user", "a <|im_end|> b <\\|x|> <\\\\|"), (1, 1, "assistant", "\n\n日本 😀 <|im_start|>assistant\n"), (1, 2, "assistant", ""), (1, 3, "assistant", "  two in a row "), (2, 0, None, None),
        (2, None, "user", "null turn first"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tia"), (None, 0, "user", "no id"), (3, 0, "ro\nle<|im_sep|>", "<|endoftext|>"), (3, 1, "assistant", "x " * 30_000),
    ]
    df = spark.createDataFrame([(*r, "y") for r in said], "conv_id long, turn long, role string, text string, formatted string")
    for part in (chat.PART, 50):
        found = chat.format_conversations(df, queries.TOKENIZER, part=part).collect()
        for conv in (1, 2, 3, None):
            rows = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.part)
            own = sorted((r for r in said if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
            assert [x for r in rows for x in chat.read_back(r.formatted)] == [(r[2] or "", r[3] or "") for r in own]
            assert [x for r in rows for x in chat.loss_texts(r.formatted, r.offsets, r.mask)] == [r[3] for r in own if r[2] == "assistant" and r[3]]
            assert sum(r.n_turns for r in rows) == len(own) and all(len(r.ids) == len(r.mask) == len(r.offsets) for r in rows)
            decoded = "".join(chat.encoder(queries.TOKENIZER).decode(r.ids, skip_special_tokens=False) for r in rows)
            assert decoded == "".join(r.formatted for r in rows)
    assert chat.format_conversations(df.where("false"), queries.TOKENIZER).count() == 0
    assert hashlib.sha256(b"").hexdigest()


def test_pipeline(spark):
    docs = queries.read(spark, FOLDER, "documents")
    by = {r.doc_id: r for r in docs.collect()}
    seen = None
    for name, apply in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.stage(apply(spark, docs, FOLDER), name)
        assert docs.columns == before.columns and docs.schema == before.schema
        seen = {r.doc_id: r for r in docs.collect()}
        assert set(seen) <= {r.doc_id for r in before.select("doc_id").collect()}
    changed = [i for i, r in seen.items() if r != by[i]]
    assert all("[secret]" in seen[i].text and seen[i].n_chars == len(seen[i].text) for i in changed)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_double_vectors_are_not_narrowed(spark):
    huge, near = [4e38, 1.0], 1.0 + 1e-9
    rows = [(1, huge), (2, huge), (3, [0.0, 1.0]), (4, [near, 1.0]), (5, [1.0, 1.0]), (6, [1e-300, 1e-300]), (7, [float("inf"), 1.0])]
    found = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7)}


def test_a_vector_travels_once_to_a_region(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ASKING", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x[300:] = x[:300] + rng.normal(scale=0.05, size=(300, 16))
    vectors = spark.createDataFrame([(i, 1, [float(c) for c in v]) for i, v in enumerate(x)], f"{neighbours.ROW} long, copies long, embedding array<double>").cache()
    index, reach = neighbours.fit(vectors, 600, 16), math.sqrt(0.1)
    assert len(index.centres) == 24 and sorted(index.region) == list(index.region) and 1 < len(set(index.region)) <= 3
    rows = neighbours.coded(vectors, index, reach).cache()
    assert rows.where("asks").groupBy(neighbours.ROW, "region").count().where("count > 1").isEmpty()
    assert rows.count() <= 600 * (1 + len(set(index.region))) and rows.where("NOT asks").count() == 600
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    wanted = (unit @ unit.T >= 0.95).sum(1) - 1
    found = {r[0]: r[1] for r in neighbours.searched(rows, index, 0.95).groupBy(neighbours.ROW).agg({"n": "sum"}).collect()}
    assert [found.get(i, 0) for i in range(600)] == wanted.tolist() and wanted.sum() > 400
