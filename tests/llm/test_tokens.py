"""BPE against the tokenizers library, packing by round trips."""

import hashlib
import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import bpe, token_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


HARD = [
    "", " ", "\n\t", "Hello, World!", "don't I'll we've", "ÉCOLE ß ẞ Σίσυφος ΣΑΣ ΣΣ", "é è́ Å", "日本語 テスト 한국어", "🙂👨‍👩‍👧 x", "<|endoftext|> a<|startoftext|>b < |x|>", "a b c​d",
    "x" * 500, "aaaaaaaaaaaaaaaaaaaaaaaab" * 20, "12345 1a2b3c ½ ² Ⅻ", "İstanbul ı", "''s 's'S 'LL", "\x00\x01\x7f\x85", "a b　c", "foo_bar-baz/qux://x.y?z=1&w=2#t", "ǅ ﬁ ﬀ ª º", "_" * 50, "!!!???...", "͸ \U000e0001",
]


@pytest.mark.parametrize("text", HARD)
def test_encode_hard(library, text):
    m = bpe.model(PATH)
    want = library.encode(text, add_special_tokens=False).ids
    assert m.encode(text) == want
    assert m.decode(want) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(st.characters(blacklist_categories=("Cs",)), max_size=60), st.text("abcdeth inoAÉß'.,1<|>endoftxsar", max_size=80)))
def test_encode_any(text):
    m, lib = bpe.model(PATH), _library()
    assert m.encode(text) == lib.encode(text, add_special_tokens=False).ids


_held = []


def _library():
    if not _held:
        t = Tokenizer.from_file(PATH)
        t.no_truncation()
        t.no_padding()
        _held.append(t)
    return _held[0]


def test_speculation_is_verified():
    """Greedy cuts that merging would not give are found and merged exactly."""
    m = bpe.WordBpe(PATH)
    words = [w for w in "internationalisation theretofore unbelievably zzxqj misunderstanding".split()] + [f"the{k}ing" for k in "abcdefghijk"]
    got = m.encode_words(words)
    assert got == [m.merged(w) for w in words]
    assert 0 < m.exact_words < m.all_words


def test_digests(spark, library):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(100, None), (100, "again"), (None, "no id"), (101, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS i", "2 AS t", "3 AS n_tokens")
    got = sorted(bpe.digests(df).collect(), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digests(df.limit(0)).collect() == []


def test_encode_decode_tables(spark):
    df = spark.createDataFrame([(1, "Some words here"), (2, None)], "doc_id long, text string")
    back = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(df)).collect()}
    assert back[2] == ([], "") and back[1][1].replace("</w>", "").split() == ["some", "words", "here"]


# ---- packing


def brute_best_fit(parts, size):
    rows = []
    for n in parts:
        fit = [r for r in rows if size - sum(r) >= n]
        best = min(fit, key=lambda r: size - sum(r)) if fit else None
        if best is None:
            rows.append([n])
        else:
            best.append(n)
    return rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 45), max_size=60), st.integers(1, 20))
def test_best_fit_decreasing(lengths, size):
    parts = sorted((min(size, n - s) for n in lengths for s in range(0, n, size)), reverse=True)
    rows: dict[int, list[tuple[int, int]]] = {}
    made = token_packing.plan(Counter(parts), size)
    for n, own in itertools.groupby(made, key=lambda p: p[0]):
        own = list(own)
        ends = [p[1] for p in own[1:]] + [parts.count(n)]
        for (_, rank, row, each, offset), end in zip(own, ends, strict=True):
            for k in range(end - rank):
                rows.setdefault(row + k // each, []).append((offset + k % each * n, n))
    for r in rows.values():  # segments follow each other
        assert [a for a, _ in sorted(r)] == [0, *itertools.accumulate(n for _, n in sorted(r))][:-1] and sum(n for _, n in r) <= size
    # which of two rows with equal room is taken is free; how full the rows get is not
    assert sorted(sum(n for _, n in r) for r in rows.values()) == sorted(map(sum, brute_best_fit(parts, size)))
    assert sorted(rows) == list(range(len(rows))) and sorted((n for r in rows.values() for _, n in r), reverse=True) == parts


def test_plan_is_small():
    """Many pieces of a length are placed at once: the plan grows with the number of lengths, not with that of the pieces."""
    rng = np.random.default_rng(4)
    counts = {n: int(c) for n, c in enumerate(rng.zipf(1.3, 2048) % 10_000_000 + 1, 1)}
    assert len(token_packing.plan(counts, 2048)) < 60_000


def unpack(rows, length):
    ids = token_packing.matrix(rows, length)
    out = {}
    for r, row in zip(rows, ids, strict=True):
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] <= length and cu == sorted(cu) and len(cu) == len(r["doc_ids"]) + 1
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest()
        for k, (d, s) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
            out.setdefault(d, []).append((s, row[cu[k] : cu[k + 1]].tolist()))
        assert (row[cu[-1] :] == 49407).all()
    return {d: [t for _, part in sorted(p) for t in part] for d, p in out.items()}


@pytest.mark.parametrize("length,small", [(16, 0), (2048, 1_000_000), (1, 10)])
def test_packing_round_trip(spark, length, small, monkeypatch):
    monkeypatch.setattr(token_packing, "SMALL", small)
    rows = [(k, f"text number {k} " * (k % 13)) for k in range(60)] + [(100, None), (101, ""), (102, "long words " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS ids", "6 AS row", "7 AS part", "8 AS n", "9 AS i", "0 AS t").repartition(3)
    packed = token_packing.packed(df, row_length=length).collect()
    m = bpe.model(PATH)
    parts = sorted((min(length, n - s) for _, t in rows for n in [len(m.encode(t)) + 1] for s in range(0, n, length)), reverse=True)
    assert sorted(r["n_tokens"] for r in packed) == sorted(map(sum, brute_best_fit(parts, length)))  # over the whole table
    assert sorted(r["row"] for r in packed) == list(range(len(packed)))
    assert unpack(packed, length) == {i: [*m.encode(t), 49407] for i, t in rows}
    assert all(p == 0 for r in packed for p in r["position_starts"])


def test_packing_repeats_null_ids_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = token_packing.packed(df, row_length=8).collect()
    assert sorted((d or 0) for r in rows for d in r["doc_ids"]) == [0, 1, 1]
    assert token_packing.packed(df.limit(0)).collect() == []
    token_packing.write(token_packing.packed(df, row_length=8), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert token_packing.matrix(back, 8).shape == (len(rows), 8)
    with pytest.raises(ValueError):
        token_packing.packed(df, row_length=0)
