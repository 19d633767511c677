"""Near-duplicate operators and components against brute force."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import embedding_neardup, simhash
from quillgraph.llm.components import connected_components


def classes_of(nodes, links):
    """node -> smallest reachable node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(30)] + [(100, 101), (101, 100), (None, 3)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df).df.collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    nodes = {n for e in real for n in e}
    want = classes_of(nodes, real)
    assert {n: got.get(n, n) for n in nodes} == want


# ---- embeddings


def brute_cosine(rows, least=0.98):
    ok = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is None or lab is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        ok[k] = np.array(v, dtype=np.float64)
    links = [(a, b) for a, b in itertools.combinations(ok, 2) if rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= least]
    n = {k: sum(k in x for x in links) for k in range(len(rows))}
    comp = classes_of([r[0] for r in rows if r[0] is not None], [(rows[a][0], rows[b][0]) for a, b in links])
    return sorted((r[0], n[k], comp[r[0]]) for k, r in enumerate(rows) if r[0] is not None)


def vectors(seed, n=160, dim=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(8)]
        v = (c + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2, 0.5])) * rng.choice([1e-3, 1.0, 1e4])
        rows.append((int(i * 3 + 1), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("tile", [8, 1024])
def test_embeddings_brute(spark, seed, tile):
    rows = vectors(seed)
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] + [1.0] * 23, 1), (1004, [float("inf")] + [1.0] * 23, 0), (1005, [None] + [1.0] * 23, 1), (1006, rows[0][1], None), (1007, rows[0][1][:5], 0), (1008, rows[0][1][:5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("key", "rep", "n", "tile", "i", "rows")})
    got = embedding_neardup.near_duplicates(df, tile=tile).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_cosine(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_embeddings_quantised_bound(spark):
    """The bound holds for every pair, and pairs at the threshold itself are decided in double precision."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 17)) * 10.0 ** rng.integers(-6, 6, (60, 1))
    import pyarrow as pa

    rows = pa.array([{"rep": k, "n": 1, "key": v.tobytes()} for k, v in enumerate(x)], pa.struct([("rep", pa.int64()), ("n", pa.int64()), ("key", pa.binary())]))
    t = embedding_neardup.Tile(rows)
    exact = t.unit @ t.unit.T
    near = (t.q.astype(float) @ t.q.astype(float).T) * t.s[:, None] * t.s[None, :]
    bound = t.a[:, None] * t.r[None, :] + t.r[:, None] * (t.a + t.r)[None, :]
    assert (np.abs(exact - near) <= bound + 1e-12).all()


def test_embeddings_repeats_and_empty(spark):
    rows = [(5, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (2, [1.0, 2.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_neardup.near_duplicates(df).collect())
    assert got == [(2, 0, 2), (3, 3, 3), (3, 3, 3), (5, 3, 3), (9, 3, 3)]
    assert embedding_neardup.near_duplicates(df.limit(0)).collect() == []


# ---- simhash


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_of_slices():
    """Every slice of a batch, with nulls, gives the fingerprints of its own texts."""
    import pyarrow as pa

    texts = [None if k % 11 == 5 else f"Wörter und WORDS {k} " * (k % 5) + "ÉCOLE END" for k in range(60)]
    want = [brute_fingerprint(t) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        whole = pa.array(texts, kind)
        for start, n in [(0, 60), (1, 59), (7, 13), (33, 1), (59, 1), (20, 0)]:
            got = simhash.fingerprints_of(whole.slice(start, n)).tolist()
            assert got == want[start : start + n], (kind, start, n)
            inner = whole.slice(start).slice(0, n).filter(pa.array([k % 2 == 0 for k in range(n)], pa.bool_()))
            assert simhash.fingerprints_of(inner).tolist() == want[start : start + n : 2]


def near_texts(seed, n=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{k}É" if k % 7 == 0 else f"Word{k}" for k in range(60)] + ["x" * 50]
    base = [[vocab[i] for i in rng.integers(0, 61, rng.integers(1, 90))] for _ in range(12)]
    out = []
    for i in range(n):
        w = list(base[rng.integers(12)])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(len(w))] = vocab[rng.integers(61)]
        out.append((int(1000 - i), rng.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize("crowd", [0, 3, 2000])
def test_simhash_brute(spark, crowd):
    rows = near_texts(5) + [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one two"), (6, "a b c\x0bd"), (7, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "rep", "key", "i", "t", "component")}).repartition(3)
    got = simhash.near_duplicates(df, crowd=crowd).select("doc_id", simhash.hex_of().alias("f"), "component").collect()
    fps = {i: brute_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    comp = classes_of(fps, links)
    assert sorted((r["doc_id"], r["f"], r["component"]) for r in got) == sorted((i, f"{fps[i]:016x}", comp[i]) for i in fps)


@pytest.mark.parametrize("crowd", [0, 20, 2000])
def test_simhash_links_of_close_fingerprints(spark, crowd):
    """Fingerprints in dense balls, chains and at distances 3 and 4, in both segments."""
    rng = np.random.default_rng(11)
    fps = {0}
    for centre in (0, 0xFFFFFFFFFFFFFFFF, 0x0123456789ABCDEF):
        for _ in range(60):
            bits = rng.choice(64, int(rng.integers(0, 5)), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in bits))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s, k) for k, s in enumerate(signed)], "fp long, rep long")
    got = [(r["a"], r["b"]) for r in simhash.links(df, crowd).collect()]
    want = classes_of(range(len(fps)), [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert classes_of(range(len(fps)), got) == want


def test_simhash_null_ids_repeats_empty_and_keep_first(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (4, "a b c d"), (9, "quite another text than that"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_later", F.lit("mine"))
    got = simhash.near_duplicates(df).collect()
    assert sorted((r["doc_id"] or -1, r["component"] or -1) for r in got) == [(-1, -1), (4, 4), (7, 4), (7, 4), (8, 8), (9, 9)]
    for small in (0, 1_000_000):
        kept = simhash.keep_first(df, small=small)
        assert kept.columns == df.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 4, 8, 9]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("crowd", [0, 2000])
def test_simhash_ids_of_text(spark, crowd):
    """Ids that are no numbers, of near texts whose smallest id isn't that of the smallest fingerprint."""
    rows = [(f"doc-{i}", t) for i, t in near_texts(6)]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id string, text string")
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = classes_of(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3])
    got = simhash.near_duplicates(df, crowd=crowd).where("doc_id is not null").collect()
    assert {r["doc_id"]: r["component"] for r in got} == comp and len(got) == len(rows) and len(set(comp.values())) < len(set(fps.values()))
    assert sorted(r["doc_id"] or "" for r in simhash.keep_first(df).collect()) == ["", *sorted(set(comp.values()))]


def test_cuts_are_dropped(spark):
    from quillgraph.llm._tables import Cut, scope

    with scope() as cuts:
        one, two = Cut(spark.range(3)), Cut(spark.range(4))
        cuts.remove(two)
    there = [c._files()[1].exists(c._files()[0]) for c in (one, two)]
    assert there == [False, True] and two.df.count() == 4
    two.drop()


def test_xxh64_and_majority():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 500)
    lengths = np.concatenate([np.arange(70), rng.integers(0, 99, 430)])
    got = simhash.xxh64(data, starts, lengths)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[s : s + n].tobytes(), 42) for s, n in zip(starts, lengths, strict=True)]
    h = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    for n in (0, 1, 2, 254, 255, 256, 511, 1500):
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[:n]) > n)
        assert int(simhash.majority(h[:n], np.array([n]))[0]) == want


def test_very_long_text(spark):
    text = " ".join(f"w{k % 977}" for k in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1}
