"""Batches with more text than one piece: every row's result is that of its text alone."""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import bpe, decontaminate, html_extract, language_id, simhash, token_packing, toxicity
from quillgraph.llm._tables import PIECE_BYTES, pieces
from test_neardup import brute_fingerprint

PATH = public_tokenizers.path("word_bpe_49k.json")
ITEM = "a passage of the benchmark that is long enough to be found wherever it stands in a text of many other words, as it should be"


def texts():
    rng = np.random.default_rng(31)
    words = [f"Wort{k}é" if k % 5 == 0 else f"Word{k}" for k in range(3000)]
    out = []
    for k in range(260):
        body = " ".join(rng.choice(words, int(rng.integers(4000, 9000))))
        out.append(None if k % 41 == 7 else "" if k % 41 == 8 else f"{body} {ITEM} tail" if k % 50 == 3 else f"{body} you IDIOT" if k % 20 == 1 else body)
    return out


@pytest.fixture(scope="module")
def own():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, own):
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").coalesce(1)
    batch = pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["text"])
    assert sum(len((t or "").encode()) for t in own) > 3 * PIECE_BYTES and len(list(pieces(batch, "text"))) > 3
    return df


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_fingerprints(docs, own):
    got = {r["i"]: r["fp"] for r in simhash.fingerprints(docs).collect()}
    at = [*range(0, 260, 9), 7, 8, 259]
    assert [got[k] % (1 << 64) for k in at] == [brute_fingerprint(own[k]) for k in at]


def test_digests(docs, own):
    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    want = {}
    for k, e in enumerate(lib.encode_batch([t or "" for t in own], add_special_tokens=False)):
        want[k] = (len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
    assert by_id(bpe.digests(docs), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_packing(docs, own):
    m, ids = bpe.model(PATH), {}
    for r in token_packing.packed(docs).collect():
        row = np.frombuffer(bytes(r["ids"]), dtype="<u2")
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            ids.setdefault(d, {})[s] = row[a:b].tolist()
    for k in [*range(0, 260, 13), 7, 8]:
        assert [t for _, part in sorted(ids[k].items()) for t in part] == [*m.encode(own[k]), 49407]
    assert len(ids) == 260


def test_toxicity(docs, own):
    model = toxicity.Model({"idiot": 5.0, "moron": 4.0}, {}, [-2.0, 1.0, 1.0, 0.5, 0.5, 0.5], 0.1)
    m = model.matcher()
    got = by_id(toxicity.scored(docs, model), "score")
    assert {k: s for k, (s,) in got.items()} == pytest.approx({k: float(m.score(m.batch(pa.array([t], pa.string())))[0]) for k, t in enumerate(own)}, abs=1e-12) and got[1][0] > 0.3 > got[2][0]


def test_decontamination(spark, docs, own):
    bench = spark.createDataFrame([(5, ITEM)], "item_id long, text string")
    want = {k for k, t in enumerate(own) if t and ITEM in t}
    assert {r["doc_id"] for r in decontaminate.matches(docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(260)) - want


def test_language(docs, own):
    dicts = {"aa": b"word1 word2 word3 word4 " * 40, "bb": "wort5é wort10é wort15é ".encode() * 40}
    judge = language_id.Judge(tuple(sorted(dicts.items())))
    assert by_id(language_id.judged(docs, dicts), "lang_pred", "score", "accepted") == {k: judge.judge(t) for k, t in enumerate(own)}


def test_pages(docs, own):
    page = F.concat(F.lit("<nav>menu</nav><article><p>"), "text", F.lit(" &amp; </p></article>"))
    got = by_id(html_extract.extracted(docs.select("doc_id", page.alias("html"))), "text")
    assert got == {k: ("" if t is None else f"{t} &".strip(),) for k, t in enumerate(own)}
