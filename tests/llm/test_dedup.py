"""Near and exact duplicates against brute force."""

import hashlib
import random
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from medialedger.llm import common, rotated_codes, simhash, suffix_dedup


def roots_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_follow_spark_hash(spark):
    assert simhash.fingerprint(b"Ab cD") == spark.range(1).select(F.xxhash64(F.lit("ab cd"))).first()[0] % (1 << 64)


@pytest.mark.parametrize("block", [512, 3])
def test_simhash_is_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(12)]
    texts = []
    for k in range(90):
        w = list(base[k % 12])
        for _ in range(k % 4):
            w[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [texts[0], None, "", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert got == {i: (f, r) for i, (f, r) in enumerate(zip(fps, roots_of(len(fps), pairs), strict=True))}


def test_thresholds_fit_the_distance():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    for n in (10, 10**6, 10**9):
        chosen = simhash.plan(n, np.eye(64), sample, 3)
        m = sorted(b for p, _ in chosen for b in p)
        assert len(set(m)) == len(m)
        assert all(t >= 0 for _, t in chosen)


def test_allocation_is_least():
    cost = [[0, 5, 9], [0, 1, 2], [0, 7, 8]]
    best, t = simhash.allocate(cost, 0)
    want = min((sum(c[x + 1] for c, x in zip(cost, ts, strict=True)), ts) for ts in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)] if sum(ts) == 0)
    assert best == want[0]
    assert sum(t) == 0


def test_simhash_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert by[5]["component_id"] == 1
    assert simhash.near_duplicates(empty).count() == 0


def brute_removed(rows, width=100):
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        t = (text or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            w = t[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[d] = (len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("slice_bytes", [1 << 20, 700])
def test_repeats_are_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_bytes)
    rng = random.Random(1)
    ab = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 900))) for _ in range(12)]
    texts = [*ab, "abc" * 300, "a" * 500, "a" * 99, "a" * 100, "a" * 101, None, "", "xyz é" * 100, ab[0] + "q" + ab[1], ab[2][:400] + ab[3], "é" * 200, "é" * 150 + "z", *ab[4:6]]
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts += ["".join(rng.choice("ijklmn") for _ in range(60 + k)) + passage[k : 300 + k] + "".join(rng.choice("opq") for _ in range(80)) for k in range(20)]
    rows = list(enumerate(texts))
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_shared_hashes_without_shared_windows(spark):
    rng = random.Random(9)
    some = "".join(rng.choice("abcdefgh") for _ in range(70))
    rows = [(i, chr(65 + i) * 80 + some + chr(97 + i) * 80) for i in range(6)]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(0)
    for trial in range(60):
        body = rng.integers(2, 2 + rng.integers(2, 5), rng.integers(5, 300))
        if trial % 3 == 0:
            body = np.r_[np.tile(body[:7], 40), body]
        t = np.r_[body, 0].astype(np.uint16)
        t[:-1][rng.random(len(t) - 1) < 0.02] = 1
        sa = suffix_dedup.suffix_array(t, len(t))
        b = t.tolist()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert sa.tolist() == want
        plcp = suffix_dedup.common_prefixes(t, sa, 20)
        for x, y in zip(want, want[1:], strict=False):
            c = 0
            while c < 20 and max(x, y) + c < len(b) and b[x + c] == b[y + c]:
                c += 1
            assert plcp[y] == c


def test_repeats_odd_rows(spark, odd, empty):
    got = suffix_dedup.removal_report(odd)
    assert got.count() == odd.count()
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()}[8] == 15000 - 5  # its period stays
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns
    assert cut.count() == odd.count()
    assert suffix_dedup.removal_report(empty).count() == 0


def test_a_hash_of_many_runs_is_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT_RUNS", 5, raising=False)
    whole = suffix_dedup.later_windows

    def bounded(width):
        inner = whole(width)

        def go(batches):
            batches = list(batches)
            groups = Counter(k for b in batches for k in zip(*(b.column(c).to_pylist() for c in ("h", "part") if c in b.schema.names), strict=True))
            assert max(groups.values(), default=0) <= 25, groups
            return inner(iter(batches))

        return go

    monkeypatch.setattr(suffix_dedup, "later_windows", bounded)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(170)
    rows = [(i, some(90) + passage + some(90)) for i in range(60)]
    rows += [(60 + i, some(60) + passage[: 100 + 3 * i] + some(60)) for i in range(20)]
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.removal_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_removed(rows)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_are_told_apart(spark, doc_id):
    rng = random.Random(4)

    def some(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    passage = some(150)
    texts = [some(300), some(40) + passage + some(200), some(260) + passage, "short"]
    texts += [texts[0], "short"]
    rows = [(doc_id, t) for t in texts] + [(9, some(20) + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["n_bytes"], r["n_removed"]) for r in suffix_dedup.removal_report(df).collect()]
    # the passage stays in one row, one of two equal rows goes whole, nothing else is touched
    assert sorted(got) == sorted([(300, 0), (300, 300), *((len(t), n) for t, n in zip(texts[1:3], got_passage(df, texts[1:3]), strict=True)), (5, 0), (5, 0), (170, 150)])
    kept = [r["text"] for r in suffix_dedup.without_repeats(df).collect()]
    assert sum(passage in t for t in kept) == 1
    assert sorted(kept) == sorted([texts[0], "", *(t if passage in t and t in kept else t.replace(passage, "") for t in texts[1:3]), "short", "short", rows[-1][1].replace(passage, "")])


def got_passage(df, pair):
    """Bytes that go from each of two rows: none from the one whose text has the smaller hash, the passage from the other."""
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    return [0 if h[t] == min(map(h.get, pair)) else 150 for t in pair]


def test_cut_text_keeps_whole_characters(spark):
    t = "é" * 60 + "ü" * 60
    df = spark.createDataFrame([(1, t), (2, "x" + t + "yz"), (3, "é" * 120)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert got[1][:1] == "é"
    assert got[2] == "xyz"


def brute_links(rows):
    ok = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][2], float) / np.linalg.norm(rows[i][2]) for i in ok}
    return [(i, j) for i in ok for j in ok if j < i and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93]


@pytest.mark.parametrize("block", [512, 8])
def test_vectors_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rotated_codes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((20, 64))
    vec = [[float(x) for x in base[i % 20] + rng.standard_normal(64) * rng.choice([0, 0.15, 0.25, 0.35])] for i in range(240)]
    rows = [(i, i % 20 % 3 if i % 17 else None, v) for i, v in enumerate(vec)]
    rows += [(240, 1, None), (241, 1, [0.0] * 64), (242, 1, [float("nan")] + [1.0] * 63), (243, 1, [None] + [1.0] * 63), (244, 1, [1.0] * 10), (245, 1, [2.0] * 10), (246, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    pairs = brute_links(rows)
    count = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rotated_codes.near_vectors(df).collect()}
    assert got == {i: (int(c), r) for i, (c, r) in enumerate(zip(count, roots_of(len(rows), pairs), strict=True))}
    assert rotated_codes.near_vectors(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rotated_codes.Estimator(rotated_codes.codes_of(x), 64)
    i, j = np.arange(200), np.arange(200) + 200
    exact = np.einsum("nd,nd->n", x[i], x[j])
    got, bound = e.estimates(i, j)
    assert (got + bound >= exact).all()
    assert abs((got - exact).mean()) < 0.02
    assert sum(e.estimates(np.arange(199), np.arange(1, 200))).mean() < 0.6


def test_rows_of_one_vector_id_count_each(spark):
    v, w = [1.0] * 64, [1.0, -1.0] * 32
    rows = [(1, 0, v), (1, 0, w), (2, 0, v), (None, 0, w), (3, 1, v), (3, 1, v)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(map(tuple, rotated_codes.near_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 1, 3), (3, 1, 3)], key=str)


def test_planted_links_are_found(spark):
    """Recall of links near the threshold, at the production parameters."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 64))
    noise = rng.standard_normal((1500, 64)) * rng.uniform(0.05, 0.45, (1500, 1))
    vec = np.concatenate([base, base + noise])
    rows = [(i, i % 1500 % 4, v) for i, v in enumerate(vec.tolist())]
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    label = np.arange(3000) % 1500 % 4
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.93, 1) & (label[:, None] == label))
    want = np.bincount(np.r_[a, b], minlength=3000)
    got = {r["vec_id"]: r["n_links"] for r in rotated_codes.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    have = np.array([got[i] for i in range(3000)])
    assert (have <= want).all()
    assert want.sum() > 1000
    assert have.sum() >= 0.999 * want.sum()


def test_bands_miss_as_stated():
    bits, bands = rotated_codes.bands_for(5000)
    agree = (1 - np.arccos(0.93) / np.pi) ** bits
    assert (1 - agree) ** bands <= rotated_codes.MISS


def test_similar_texts_are_brute_force(spark):
    """Groups at similarity 0.8 of five-word shingles: none that brute force lacks, nearly all that it has."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(120)]
        for edits in (0, 0, 1, 2, 4, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One  TWO"]
    sets = [set(simhash.shingles((t or "").encode(), 5, 42).tolist()) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in range(len(texts)) for j in range(max(0, i - 6), i) if alike(sets[i], sets[j])]
    want = roots_of(len(texts), pairs)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    exact = {i for i, r in enumerate(want) if i == r}
    assert exact <= kept
    assert len(kept - exact) <= 0.15 * (len(texts) - len(exact))  # some just above the similarity are not met


@pytest.mark.parametrize(("block", "common"), [(512, 10_000), (7, 30)])
def test_all_similar_texts_are_joined(spark, monkeypatch, block, common):
    """Groups at the similarity are those of brute force over all pairs: also of pairs whose fingerprints are far apart, of texts
    around a frequent passage, and of lengths that make a difference.
    """
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    monkeypatch.setattr(simhash, "COMMON_TEXTS", common)
    rng = random.Random(block)
    words = [f"w{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(30)]
    texts = [None, "", " ", "one two", "One  TWO", "one two three four five", "one two three four five six"]
    for k in range(50):
        base = [rng.choice(words) for _ in range(rng.choice([6, 12, 40, 100]))] + passage * (k % 3)
        for edits in range(5):
            w = list(base)
            for _ in range(edits * len(w) // 110):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w + [rng.choice(words) for _ in range(rng.randrange(1 + len(w) // 8))]))
    sets = [set(simhash.shingles((t or "").encode(), 5, 42).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, r in enumerate(roots_of(len(texts), pairs)) if i == r}


def test_sketches_tell_no_more_than_differs():
    """Of sets of any sizes, and far more alike for like ones."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.r_[a[int(rng.integers(0, len(a))) :], rng.integers(0, 1 << 63, int(rng.integers(0, 2000))).astype(np.uint64)])
        raw = [simhash.sketch(x) for x in (a, b)]
        size = np.array([len(r) // 8 for r in raw])
        apart = simhash.bits_apart(np.frombuffer(b"".join(raw), "<u8"), np.cumsum(size) - size, size, np.array([0, 1, 0]), np.array([1, 0, 0]))
        differ = len(np.setxor1d(a, b))
        assert 0.25 * min(differ, min(size) * 64) <= apart[0] + 20 and apart[0] == apart[1] <= differ and apart[2] == 0


def test_large_groups_hand_on_few_pairs(spark, monkeypatch, tmp_path):
    """One large group of variants around the similarity: the pairs that blocks hand on don't grow with its square."""
    inner, folder = simhash.met, str(tmp_path)

    def counted(*settings):
        run = inner(*settings)

        def counting(batches):
            for out in run(batches):
                (Path(folder) / uuid.uuid4().hex).write_text(str(out.num_rows))
                yield out

        return counting

    monkeypatch.setattr(simhash, "met", counted)
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(4, 12)):
            w[rng.randrange(150)] = f"v{rng.randrange(400)}"
        texts.append(" ".join(w))
    sets = [set(simhash.shingles(t.encode(), 5, 42).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == {i for i, r in enumerate(roots_of(len(texts), pairs)) if i == r}
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 10 * len(texts)


def shuffled(spark):
    """Bytes that each stage so far has written for shuffles."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_texts_without_links_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Few of many long texts have links; the others stay where they are, and no table of a step stays at all."""
    rng = random.Random(12)
    texts = [" ".join(rng.randbytes(60).hex() for _ in range(120)) for _ in range(400)]
    texts += [t + " more" for t in texts[:6]] + texts[6:9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    (tmp_path / "shared").mkdir()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"{tmp_path}/shared")
    monkeypatch.setattr(simhash, "COMMON_TEXTS", 20)
    try:
        before = max(shuffled(spark))
        kept = simhash.one_of_each(spark.read.parquet(f"{tmp_path}/docs"))
        assert {r["doc_id"] for r in kept.select("doc_id", "text").collect()} == set(range(400))
        assert max(n for k, n in shuffled(spark).items() if k > before) < 0.25 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {f.name[:-33] for f in (tmp_path / "shared").iterdir()} == {"kept-rows", "texts-of-groups"}


@pytest.mark.parametrize("most", [64, 1 << 24])
def test_marks_leave_no_key_out(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MARKS", most)
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("x"))
    keys = rows.where("id % 50 = 3").select("x")
    for own, want in ((keys, {i for i in range(20_000) if i % 50 == 3}), (keys.where("false"), set())):
        got = {r["id"] for r in common.marked(rows, own, "x", "hit").where("hit").collect()}
        assert want <= got
        assert len(got) <= 20_000 * (1 if own is keys and most == 64 else 0.15)
    assert common.marked(rows, keys, "x", "hit").count() == 20_000


def test_passing_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: str(tmp_path))
    names = lambda: sorted(f.name[:-33] for f in tmp_path.iterdir())
    with common.passing_tables(spark):
        with common.passing_tables(spark):
            common.saved(spark.range(3), "inner")
            outer = common.saved(spark.range(4), "outer", lasting=True)
        assert names() == ["outer"]
        last = common.saved(outer, "last", lasting=True)
    assert names() == ["last"] and last.count() == 4
    with pytest.raises(ValueError), common.passing_tables(spark):
        common.saved(spark.range(3), "failed")
        raise ValueError
    assert names() == ["last"]


def test_forests_join_what_links_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        i, j = rng.integers(0, n, (2, 60))
        i, j = i[i != j], j[i != j]
        cost = rng.integers(0, 4, len(i))
        kept = common.spanning_pairs(n, i, j, cost)
        assert roots_of(n, zip(i[kept], j[kept], strict=True)) == roots_of(n, zip(i, j, strict=True))
        for c in range(4):  # at every cost, the links up to it
            a, b = kept[cost[kept] <= c], cost <= c
            assert roots_of(n, zip(i[a], j[a], strict=True)) == roots_of(n, zip(i[b], j[b], strict=True))


@pytest.mark.parametrize(("block", "closest"), [(512, False), (64, True), (10, False)])
def test_links_are_those_within_the_distance(spark, monkeypatch, block, closest):
    """All bits count, the sign's too; large groups and dealt ones join what brute force joins."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block)
    rng = random.Random(block)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = [1 << 63, 0, *base, *(b ^ 1 << 63 for b in base)]
    for _ in range(500):
        f = rng.choice(base)
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(simhash.signed(f), i) for i, f in enumerate(fps)], "fp long, rep long")
    got = [(r["a"], r["b"]) for r in simhash.links_within(nodes, 3, closest).collect()]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert roots_of(len(fps), got) == roots_of(len(fps), pairs)
    if closest:
        assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in got)
