"""Prefix tries, manifests and packing against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from medialedger.llm import merkle, packing, prefix_trie
from medialedger.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_merkle_manifest"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_is_its_sql(spark, name, sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("conversations", "documents"):
        con.sql(f"create view {t} as select * from '/root/testdata/{sf}/{t}.parquet'")
    got = QUERIES[name](spark, f"/root/testdata/{sf}")
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = {tuple(r[c] for c in want.columns) for r in got.collect()}
    assert rows == set(want.fetchall())
    assert got.count() == len(want.fetchall())


# --- conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        built[c] = turns.get(base, [])[:h] + turns[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in below if n)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), len(children), len(leaves), saved, sha(",".join(map(str, sorted(ends.get(node, [])))))))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(df):
    out = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.positions(df), "digest", "words"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


KINDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("share", [1000, 2])
def test_trie(spark, monkeypatch, share):
    """Nulls, ties, repeated rows, turnless and negative conversations, copies, a long one; with many and with few nodes broadcast."""
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", share)
    rng = random.Random(5)
    says = ["a b", "", None, "c", "one two three", " x "]
    rows = []
    for c in [*range(60), -3, -21, 400, 401, 402, 403]:
        for t in range(rng.choice((1, 1, 2, 3, 5))):
            rows.append((c, rng.choice((t, t, None)), rng.choice(("user", "assistant", None)), rng.choice(says)))
    rows += [(100 + k, t, "user", f"same {t}") for k in range(30) for t in range(6)]
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(300)]
    rows += [(None, 1, "user", "lost"), (7, 1, "user", "again"), (7, 1, "user", "again")]
    df = spark.createDataFrame(rows, KINDS).withColumns({"node": F.lit(1), "depth": F.lit(2), "pos": F.lit(3)}).repartition(5)
    assert trie_rows(df) == plain_trie(rows)


def test_trie_odd_tables(spark):
    assert trie_rows(spark.createDataFrame([], KINDS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "a", "b")], KINDS)) == []
    gone = [(1, 0, "user", "x")]  # its one turn would come from conversation 0, which is not there
    assert trie_rows(spark.createDataFrame(gone, KINDS)) == plain_trie(gone)
    long = [(20, 0, None, "word " * 300_000), (21, 0, None, "word " * 300_000)]
    assert trie_rows(spark.createDataFrame(long, KINDS)) == plain_trie(long)


def test_long_lists_of_ends_are_hashed_in_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(20 * k, t, "user", f"{t}") for k in range(50) for t in range(4)]
    assert trie_rows(spark.createDataFrame(rows, KINDS)) == plain_trie(rows)


def test_texts_of_nodes(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "bot", "b"), (20, 0, "user", "a"), (20, 1, "bot", "c")]
    df = spark.createDataFrame(rows, KINDS)
    nodes = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.positions(df), "digest", "words"))
    got = sorted((r["depth"], r["n_convs"], r["role"], r["text"]) for r in prefix_trie.texts(nodes, df).collect() if r["depth"])
    assert got == [(1, 2, "user", "a"), (2, 1, "bot", "b"), (2, 1, "bot", "c")]


# --- manifests


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_way(levels, i):
    way = []
    for nodes in levels[:-1]:
        run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
        way.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        i //= 8
    return way


def plain_manifest(groups):
    """(subroot, root, way) of each leaf; groups: digests in order, by name."""
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels(groups[g]) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names])
    return {g: [(d, trees[g][-1][0], top[-1][0], plain_way(trees[g], i) + plain_way(top, k)) for i, d in enumerate(groups[g])] for k, g in enumerate(names)}


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, monkeypatch, levels):
    """Groups of all shapes, in one tier and in several."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUILD", 8**levels)
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "é": 64, "z": 65, "日": 700, **{f"g{k}": 2 for k in range(70)}}
    groups = {g: [sha(f"{g}{i}") for i in range(n)] for g, n in sizes.items()}
    rows = [(g, i, d) for g, x in groups.items() for i, d in enumerate(x)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "grp string, at long, digest string").repartition(7)
    proofs, tiers = merkle.manifest(df.withColumn("row", F.struct("at")), "at")
    assert len(tiers) == (2 if levels == 3 else 4)
    got = defaultdict(dict)
    for r in proofs.withColumn("folded", merkle.folded(F.col("digest"), F.col("way"))).collect():
        assert r["idx"] == r["row"]["at"]
        assert r["folded"] == r["root"]
        got[r["grp"]][r["idx"]] = (r["digest"], r["subroot"], r["root"], [tuple(w) for w in r["way"]])
    want = plain_manifest(groups)
    assert {g: [x[k] for k in sorted(x)] for g, x in got.items()} == want
    # the log: no gap, every node after those below it, and the levels of the plain tree
    logs = defaultdict(list)
    for r in merkle.postorder(tiers).collect():
        logs[r["grp"]].append((r["position"], r["level"], r["digest"]))
    for g, log in logs.items():
        log.sort()
        assert [p for p, _, _ in log] == list(range(len(log)))
        plain = plain_levels(groups[g])
        assert [[d for _, at, d in log if at == level] for level in range(len(plain))] == plain
        below = [[] for _ in plain]
        for _, level, d in log:
            if level:
                assert d == sha("".join(below[level - 1]))
                below[level - 1] = []
            below[level].append(d)


def test_manifest_of_no_rows(spark):
    df = spark.createDataFrame([], "grp string, at long, digest string")
    assert merkle.manifest(df.withColumn("row", F.struct("at")), "at")[0].count() == 0


def text_value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def test_manifest_of_odd_documents(spark, odd, tmp_path):
    long = spark.createDataFrame([(11, "Ab" * 2_000_000, "en", "a", 9)], odd.schema)
    df = odd.unionByName(long).withColumns({"grp": F.lit(1), "idx": F.lit(2), "_k": F.lit(3)})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    rows = df.collect()
    leaves = sorted((r["lang"] or "", r["doc_id"] is not None, r["doc_id"] or 0, sha("".join(text_value(r[c]) for c in merkle.FIELDS))) for r in rows)
    groups = {g: [x[3] for x in leaves if x[0] == (g or "")] for g in {r["lang"] for r in rows}}
    want = sorted((d, s, root, sha("".join(a + b for a, b in way))) for x in plain_manifest(groups).values() for d, s, root, way in x)
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == want
    for r in got:
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["doc_id"] is not None
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        assert r["verified"] == (not (hit and text and text != text.lower()))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 512, 513, 600])
def test_positions_are_those_of_the_log(n):
    digests, h = [sha(str(k)) for k in range(n)], merkle.height(n)
    log = merkle.appended(digests, h)
    levels = plain_levels(digests)
    assert len(log) == sum(map(len, levels))
    for level, nodes in enumerate(levels):
        assert [log[p] for p in merkle.position(level, np.arange(len(nodes)), n, h)] == nodes


# --- packing


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def no_gaps(rows, capacity):
    """Each sequence is filled from 0 without gaps, up to the capacity at most; the lengths of sequences."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in x) for x in by.values()]


def test_documents_are_packed(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = packing.op13_best_fit_packing(spark, SF).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        by[r["doc_id"]].append(r)
    assert set(by) == set(docs)
    for d, text in docs.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cut = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        want = [(k, k * 2048, len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for k, x in enumerate(cut)]
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[d]] == want
    used = no_gaps(got, 2048)
    assert len(used) <= 1.03 * -(-sum(used) // 2048)


TRICKY = [
    "It's a test, isn't it? 'say X'S x.'s ''s !'s a»,b é, É.ß 12,3a4 á, ≠ ≮ ΑΣ İx ﬁ 日本 a b \x85 c\x1cd ÷x×y àé,ÿ",
    "it'll've 'd''m <|endoftext|> <|startoftext|>x",
    "a" * 5000 + " " + "é" * 300 + "!" * 400,
    "Σοφός ΣΑΣ. ІЇ,'ї 👍🏽👍 é, e,́x",
    " \n\t ",
    "x̧y q'.s 'S'T",
]


def test_ids_are_those_of_the_library(library):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        encode = packing.encoder(f.read())
    rng = random.Random(4)
    alphabet = "abzABZéÉß'’.,!-<=»«0٣9 \ń̸日Σ÷"
    for text in [*TRICKY, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(800))]:
        for _ in range(2):  # once learnt, once remembered
            assert list(memoryview(encode(text.encode())).cast("I")) == library.encode(text, add_special_tokens=False).ids, text


def test_odd_documents_are_packed(spark, odd, empty):
    long = spark.createDataFrame([(11, "word, " * 300_000, "en", "a", 9)], odd.schema)
    wide = odd.unionByName(long).withColumns({"length": F.lit("x"), "sequence_id": F.lit(1), "_row": F.lit(2)})
    pieces = packing.tokenized(wide)
    got = packing.pack(pieces).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (2, 3, 4)) == 3
    assert sum(r["doc_id"] == 5 for r in got) == 2
    assert sum(r["length"] for r in got if r["doc_id"] == 11) == 600_001
    used = no_gaps(got, 2048)
    assert len(used) == -(-sum(used) // 2048)
    whole = packing.sequences(packing.pack(pieces)).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(used)
    assert all(len(r["ids"]) == 4 * r["length"] == 4 * sum(d["length"] for d in r["documents"]) for r in whole)
    assert packing.pack(packing.tokenized(empty)).count() == 0


def test_packing_in_rounds(spark):
    """Many tasks, few bins: every piece stays, and what tasks leave open is packed again."""
    rng = random.Random(9)
    sizes = [rng.randint(1, 100) for _ in range(5000)] + [100] * 50 + [None]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    got = packing.pack(df, capacity=100, open_bins=64, task_pieces=600).fillna(0).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(sizes)))
    used = no_gaps(got, 100)
    assert len(used) <= 1.04 * sum(used) / 100
    again = packing.pack(df, capacity=100, open_bins=64, task_pieces=600).fillna(0).collect()
    assert {(r["doc_id"], r["sequence_id"], r["offset"]) for r in got} == {(r["doc_id"], r["sequence_id"], r["offset"]) for r in again}
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack(df, capacity=50).count()


def test_best_fit_in_bins():
    """Against a plain search among open bins."""
    rng = random.Random(3)
    bins, plain, made = packing.Bins(50, 5), {}, 0
    for _ in range(3000):
        size = rng.randint(1, 50)
        got, at = bins.place(size)
        fits = {b: s for b, s in plain.items() if s >= size}
        if fits:
            assert plain[got] == min(fits.values())
        else:
            if len(plain) == 5:
                least = min(plain.values())
                closed = {b for b, s in plain.items() if s == least} - bins.still_open()
                plain.pop(closed.pop() if closed else next(b for b, s in plain.items() if s == least))
            assert got == made
            made += 1
            plain[got] = 50
        assert at == 50 - plain[got]
        plain[got] -= size
        if not plain[got]:
            del plain[got]
        assert set(plain) == bins.still_open()
