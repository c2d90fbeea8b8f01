"""Operators on documents against plain Python, on rows chosen to be awkward."""

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from wattline.llm import contamination, overlap, packing, queries, secrets, shards, substrings, tokens, toxicity

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, piece int, _row string, component_id long, _k string, n_chars long"


def words_of(t):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode()) if w]


@pytest.fixture(scope="module")
def rows():
    """Null, empty, blank and very long texts, null and repeated ids, exact and near copies, shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(2, 6))) for _ in range(3000)]

    def prose(n):
        return rng.choices(vocabulary, k=n)

    passage, base, out = prose(60), prose(120), []
    for i in range(60):
        body = prose(rng.choice([1, 3, 4, 5, 34, 35, 36, 80, 200]))
        if i % 4 == 0:
            body = body[: len(body) // 2] + passage + body[len(body) // 2 :]
        if i % 5 == 0:
            body = list(base)
            body[rng.randrange(len(body))] = "other"
        out.append((i, rng.choice([" ", "\n", "  "]).join(body)))
    out += [(100, None), (101, ""), (102, " \n\t "), (103, " ".join(prose(30_000))), (None, "no id here at all"), (None, "no id here at all")]
    out += [(104, " ".join(base)), (105, " ".join(base).upper()), (106, "THE Same five Words here"), (107, "the same FIVE words HERE"), (106, "another text under a used id"), (0, out[0][1])]
    out += [(108, " ".join(passage * 3)), (109, "a" * 5000), (110, "one two"), (111, "one two")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", 3, "k", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats_of(rows, window):
    texts = [words_of(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, texts, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [2000, 1])
def test_repeats_equal_brute_force(docs, rows, monkeypatch, large):
    monkeypatch.setattr(substrings, "LARGE", large)
    found = substrings.repeats(docs)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=str) == repeats_of(rows, substrings.WINDOW)
    for r in found.where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def groups_of(rows):
    sets = []
    for _, t in rows:
        w = [x.translate(LOW) for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 75 * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


@pytest.mark.parametrize("short", [64, 1])
def test_groups_equal_brute_force(docs, rows, monkeypatch, short):
    monkeypatch.setattr(overlap, "SHORT", short)
    found = overlap.classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in found), key=str) == groups_of(rows)


def test_one_document_of_each_group_stays(docs, rows):
    kept = overlap.one_each(docs)
    assert kept.columns == docs.columns
    groups = {(g, n) for _, n, g in groups_of(rows) if n and g is not None}
    ids = [r.doc_id for r in kept.where("trim(text) <> '' AND doc_id IS NOT NULL").collect()]
    assert {g for g, _ in groups} <= set(ids)
    assert kept.where("doc_id IN (100, 101, 102)").count() == 3 and kept.where("doc_id IS NULL").count() == 1


def test_containment_equals_brute_force(spark, docs, rows):
    by = {i: (t or "").split() for i, t in rows if i is not None}
    items = [(1, " ".join(by[0][10:50])), (2, None), (3, ""), (4, "one two"), (5, " ".join(by[4][:12])), (5, " ".join(by[4][:12])), (6, "never seen anywhere in these documents"), (7, " ".join(by[103][20_000:20_100]).upper())]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")

    def shingles(t, m):
        w = (t or "").lower().split()
        return {tuple(w[i : i + m]) for i in range(len(w) - m + 1)}

    expected = set()
    for i, x in items:
        m = min(5, len((x or "").split()))
        wanted = shingles(x, m) if m else set()
        expected |= {(k, i, len(shingles(t, m) & wanted), len(wanted)) for k, t in rows if wanted and len(shingles(t, m) & wanted) >= 0.75 * len(wanted)}
    found = contamination.contained(docs, bench)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()} == expected and expected
    bad = {k for k, *_ in expected}
    assert {r.doc_id for r in contamination.clean(docs, bench).collect()} == {k for k, _ in rows if k not in bad or k in (0, 106)} - (bad & {0})


SECRETS = [
    (1, "password=abc123 and Token: \"zz-9.Q/x\"\nAPI_KEY='short' apikey = longer_one"), (2, "AKIA" + "Z9" * 8), (3, "AKIA" + "Z" * 15), (4, "é" * 7 + "deadbeef" * 4 + "g" + "0" * 23),
    (5, None), (6, ""), (7, "secret=token=abcdef secret: x"), (8, "ghp_" + "a" * 36 + " xoxb-1234567890ab -----BEGIN RSA PRIVATE KEY-----"), (9, "nothing to see"),
    (9, "nothing to see"), (10, "passwd: " + "f" * 30 + " " * 20_000 + "secret:abcdefgh"), (None, "token=nullid99"), (1, "token=otherid9"),
]


def spans_of(text, rule):
    return [(m.start(), m.end()) for m in re.finditer(rule.pattern, text or "", re.ASCII) if len(m.group(rule.group)) >= rule.least]


def test_secrets_equal_a_plain_scan(spark):
    df = spark.createDataFrame([(i, t, "k") for i, t in SECRETS], "doc_id long, text string, kind string")
    expected = {(i, r.kind, a, z) for i, t in SECRETS for r in secrets.RULES for a, z in spans_of(t, r)}
    assert {(r.doc_id, r.kind, r.start, r.end) for r in secrets.spans(df).collect()} == expected
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.count() == len(SECRETS)
    for i, t in [(r.doc_id, r.text) for r in clean.collect()]:
        assert not any(spans_of(t, r) for r in secrets.RULES), (i, t)
    assert clean.where("doc_id = 9 AND text = 'nothing to see'").count() == 2


def test_trigram_queries():
    need = secrets.required(secrets.BASE[0].pattern)
    assert need == [{"password", "passwd", "secret", "token", "apikey", "api_key"}]
    assert secrets.required(r"[0-9a-f]{24,}") == [] and secrets.required(r"AKIA[A-Z0-9]{16,}") == [{"akia"}]
    assert secrets.trigrams("akia") == ["aki", "kia"]


def test_ids_equal_the_library():
    encode = tokens.encoder(queries.TOKENIZER)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "1", "23", "'s", "don't", ".", "ß", "\x1c", "\x85", "日本", "<|endoftext|>", "😀", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["a" * 100_000, " " * 100_000, ""]
    assert encode.ids(texts) == [encode.exact(t) for t in texts]


def test_ids_of_long_runs():
    encode = tokens.encoder(queries.TOKENIZER)
    n = 1 << 16
    texts = [" " * 1_500_000 + "x", "x" + " " * 1_500_000, " \n" * 700_000 + "a", *("a  b 1" * (n // 6) + "c" * k for k in range(4, 7)), "é " * n, " " * (n - 2) + "x"]
    for t in texts:
        assert encode.ids([t]) == [encode.exact(t)]


def test_ids_take_little_more_than_the_merges():
    encode = tokens.encoder(queries.TOKENIZER)
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 12))) for _ in range(300)) for _ in range(1500)]

    def seconds(do):
        at = time.process_time()
        do()
        return time.process_time() - at

    merges = min(seconds(lambda: [encode.core.encode_ordinary(t) for t in texts]) for _ in range(3))
    assert min(seconds(lambda: encode.ids(texts)) for _ in range(3)) < 1.6 * merges


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(50):
        capacity = rng.choice([8, 50, 2048])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, capacity]) for _ in range(rng.randint(1, 400))]
        steps = packing.plan(collections.Counter(lengths), capacity).tolist()
        filled, counts = collections.Counter(), collections.Counter(lengths)
        for k, (length, rank, first, each, _) in enumerate(steps):
            to = steps[k + 1][1] if k + 1 < len(steps) and steps[k + 1][0] == length else counts[length]
            for i in range(to - rank):
                filled[first + i // each] += length
        assert sorted(capacity - n for n in filled.values()) == best_fit(lengths, capacity)


def test_pieces_fill_sequences_without_gaps(docs, rows):
    found = packing.pieces(docs, queries.TOKENIZER, capacity=64)
    packed = packing.pack(found.drop("ids"), capacity=64).collect()
    encode = tokens.encoder(queries.TOKENIZER)
    assert len(packed) == found.count()
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(x) // 4 + 1 for x in encode.ids([t or "" for _, t in rows]))
    assert sum(r.length for r in packed) == total
    assert len(by) == len(best_fit([r.length for r in packed], 64))
    long = sorted((r.piece, r.start, r.length) for r in packed if r.doc_id == 103)
    assert all(n == 64 for _, _, n in long[1:]) and long[0][1] == 0 and long[-1][1] + 64 == sum(n for *_, n in long)


def test_feistel_is_a_permutation():
    import numpy as np

    for n in (1, 2, 3, 5, 64, 1000, 4097):
        slots = shards.permuted(np.arange(n), n, "k")
        assert sorted(slots.tolist()) == list(range(n))
        assert (shards.permuted(slots, n, "k", back=True) == np.arange(n)).all()
    assert (shards.permuted(np.arange(1000), 1000, "k") != shards.permuted(np.arange(1000), 1000, "other")).any()


def test_linked_sets_share_enough_of_what_is_searched():
    """At the threshold, whatever the hashes of the shared shingles, both queries hold ENOUGH of them."""
    import numpy as np

    rng = np.random.default_rng(12)
    for _ in range(300):
        union = int(rng.integers(70, 3000))
        both = -(-75 * union // 100)
        hashes = rng.permutation(np.arange(union))
        if rng.random() < 0.5:  # the worst order: what one set has alone comes first
            hashes = np.sort(hashes)[::-1]
        mine = int(rng.integers(0, union - both + 1))
        one, two = np.sort(hashes[: both + mine]), np.sort(np.append(hashes[:both], hashes[both + mine :]))
        asked = [x[:k] for x, k in zip((one, two), overlap.query_size(np.array([len(one), len(two)]), (75, 100)))]
        whole = -(-3 * (len(one) + len(two)) // 7)
        need = whole if max(len(one), len(two)) <= overlap.SKETCH else min(overlap.ENOUGH, whole)
        assert overlap.linked(one.astype(np.uint64), two.astype(np.uint64), (75, 100)) and len(np.intersect1d(*asked)) >= need


def test_links_at_the_threshold_of_large_sets(spark):
    rng = random.Random(13)
    texts = []
    for n in (66, 120, 153, 300, 900, 2000):
        # shingles of n words in a row; a changed tail of k words leaves n - k shared
        base = [f"w{n}x{i}" for i in range(n + 4)]
        for k in (n // 7, n // 7 + 1, n // 8):
            texts.append(" ".join(base[: n + 4 - k] + [f"y{rng.random()}" for _ in range(k)]))
        texts.append(" ".join(base))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    lead = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, z = sorted((lead[i], lead[j]))
                lead = [a if x == z else x for x in lead]
    found = overlap.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(lead)) and len(set(lead)) > 6


def test_short_items_inside_long_documents(spark):
    items = [(1, "Three words item"), (2, "one"), (3, "four words are HERE"), (4, ""), (5, None), (6, "a b c d e")]
    texts = [(1, "long text with three WORDS item in it"), (2, "three words and an item"), (3, "One"), (4, "x four words are here"), (5, "four words are"), (6, "someone a b c d e f"), (7, None), (8, "three\nwords  item")]
    found = contamination.contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in found.collect()) == [(1, 1, 1, 1), (3, 2, 1, 1), (4, 3, 1, 1), (6, 6, 1, 1), (8, 1, 1, 1)]
    left = contamination.clean(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == [2, 5, 7]


def test_shards_do_not_depend_on_splits(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    found = []
    for size in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        index = shards.materialise(spark.read.parquet(str(tmp_path / "docs")), queries.TOKENIZER, "key", folder=str(tmp_path / f"shards-{size}"), length=128, per_shard=100)
        found.append([(p.name, p.read_bytes()) for p in sorted((tmp_path / f"shards-{size}").glob("shard-*.bin"))])
        assert len(found[-1]) == index.select("shard").distinct().count() > 1
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1]


def test_shards_hold_every_token_once(spark, docs, rows, tmp_path):
    folder = str(tmp_path / "shards")
    index = shards.materialise(docs, queries.TOKENIZER, "key", folder=folder, length=128, per_shard=100).collect()
    n = len(index)
    assert sorted(r.slot for r in index) == list(range(n)) and sorted(r.sequence for r in index) == list(range(n))
    back = {r.slot: (r.sequence, r.ids) for r in shards.read_from(spark, folder).collect()}
    assert sorted(back) == list(range(n)) and all(back[r.slot][0] == r.sequence for r in index)
    stream = [i for _, ids in sorted(back.values()) for i in ids]
    encode, expected = tokens.encoder(queries.TOKENIZER), collections.Counter()
    import numpy as np

    for raw in encode.ids([t or "" for _, t in rows]):
        expected.update([*np.frombuffer(raw, "<u4").tolist(), 0])
    stream = stream[: sum(expected.values())]
    assert collections.Counter(stream) == expected
    assert [r.slot for r in shards.read_from(spark, folder, slot=150, until=260).orderBy("slot").collect()] == list(range(150, min(260, n)))


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(2)
    plain = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(500)]
    data, labels = [], []
    for i in range(1200):
        bad = i % 5 == 0
        body = rng.choices(plain, k=rng.randint(20, 200))
        for _ in range(len(body) // 30 + 1 if bad else 0):
            body[rng.randrange(len(body))] = rng.choice(["Scumbag", "moronic"])
        data.append((i, " ".join(body), 9.0))
        labels.append((i, int(bad)))
    data += [(2000, None, 1.0), (2001, "", 1.0), (None, "moronic scumbag", 1.0), (0, "a second text", 1.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, score double")
    known = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(df, known).collect()
    assert len(found) == len(data) and all(0 <= r.score <= 1 for r in found)
    truth = dict(labels)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert [r.predicted for r in found if r.doc_id is None] == [1] and not any(r.predicted for r in found if r.doc_id in (2000, 2001))
    kept = toxicity.kept(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}
    assert toxicity.score(df, known.where("toxic = 0")).select("score").distinct().count() >= 1


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for found in (
        substrings.repeats(none), overlap.classes(none), overlap.one_each(none), contamination.contained(none, bench), contamination.clean(none, bench), secrets.spans(none), secrets.redact(none),
        packing.pack(packing.pieces(none, queries.TOKENIZER).drop("ids")), shards.materialise(none, queries.TOKENIZER, "k"), toxicity.score(none, labels), toxicity.kept(none, labels),
    ):
        assert found.count() == 0
    one = spark.createDataFrame([(1, "x y z", 1)], "doc_id long, text string, n long")
    assert contamination.contained(one, bench.where("false")).count() == 0 and contamination.clean(one, bench.where("false")).count() == 1
    assert toxicity.score(one, labels.where("false")).count() == 1
    assert one.select(F.col("text")).count() == 1


def test_tables_of_the_jaccard_join_go_when_read(spark, monkeypatch):
    import os
    import re

    from wattline import lineage

    def there():
        return {re.sub("-[0-9a-f]{32}$", "", x) for x in os.listdir(re.sub("^file:", "", lineage.shared_dir(spark))) if x not in old}

    old = set(os.listdir(re.sub("^file:", "", lineage.shared_dir(spark))))
    seen, check = [], overlap.verified

    def verified(*args):
        seen.append(there())
        return check(*args)

    monkeypatch.setattr(overlap, "verified", verified)
    words = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, f"{words} x{i // 2} {words if i % 2 else ''} y{i}") for i in range(12)] + [(99, "")], "doc_id long, text string")
    found = overlap.classes(docs)
    assert len(seen) == 2 and all("sketches" in x and "described" not in x and "wanted" not in x for x in seen) and "postings" not in seen[1]
    assert not there() & {"described", "documents", "sets", "sketches", "lists", "postings", "active", "texts"}
    assert found.count() == 13


def test_near_copies_are_compared_slice_by_slice(spark, monkeypatch):
    """Where every document has near copies, no step writes all lists, and texts travel once to be stored."""
    monkeypatch.setattr(overlap, "SLICE_BYTES", 100, raising=False)
    monkeypatch.setattr(overlap, "MOST", 3, raising=False)
    written, write, limit = [], overlap.stage, "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)

    def stage(df, name="stage", *more):
        if name == "texts":
            spark.conf.set(limit, "-1")
            written.append(("travels", df._jdf.queryExecution().executedPlan().toString().count("Exchange")))
            spark.conf.set(limit, before)
        out = write(df, name, *more)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(overlap, "stage", stage)
    rng, rows = random.Random(7), []
    for g in range(4):
        words = [f"w{g}x{i}" for i in range(120)]
        for c in range(4):
            rows.append((100 * g + c, " ".join(words[:60] + [f"y{rng.random()}"] + words[60 + (c == 3) * 40 :])))
    rows += [rows[5], (None, rows[9][1]), (7, ""), (8, None)]
    found = overlap.classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in found), key=str) == groups_of(rows)
    posts = [n for name, n in written if name == "postings"]
    assert max(posts) < sum(posts) / 4
    # the texts, the rows they go to, and the two tables behind those
    assert [n for name, n in written if name == "travels"] == [2]


def test_documents_that_share_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(3)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in overlap.classes(docs).collect()) == [(0, 0), (1, 1), (2, 2)]
