"""Registered queries: contracts, SQL, held-out accuracy and the pipeline by another road."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quillgraph.llm import bpe, decontaminate, html_extract, language_id, token_packing, toxicity, url_filter
from quillgraph.llm._tables import table
from test_neardup import brute_fingerprint, classes_of
from test_text import brute_labels, brute_tree, brute_url
from test_tokens import brute_best_fit

DATA = "/root/testdata/sf0.001"
SHAPES = {
    "op1_embedding_neardup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op3_decontaminate": {"doc_id": "bigint", "item_id": "bigint"},
    "op4_simhash_neardup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_token_packing": {"doc_ids": "array<bigint>"},
    "op6_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_license_scan": {"doc_id": "bigint"},
    "op8_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op9_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op10_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


def columns(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pydict()


@pytest.fixture(scope="module")
def results(spark):
    return {n: entry.queries()[n](spark, DATA) for n in SHAPES}


@pytest.mark.parametrize("name", list(SHAPES))
def test_shape(results, name):
    types = dict(results[name].dtypes)
    assert {c: types.get(c) for c in SHAPES[name]} == SHAPES[name]
    table = {"op1": "embeddings", "op2": "pages", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name.split("_")[0] not in ("op3", "op5", "op7"):
        assert results[name].count() == len(next(iter(columns(table).values())))


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op7_license_scan"])
def test_sql(results, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    df = results[name]
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(repr, df.select(*want.columns).collect())) == sorted(repr(r) for r in df.sparkSession.createDataFrame(want.fetchall(), df.select(*want.columns).schema).collect())


def test_op4_brute(results):
    d = columns("documents")
    fps = {i: brute_fingerprint(t) for i, t in zip(d["doc_id"], d["text"], strict=True)}
    ids = sorted(fps)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    comp = classes_of(ids, links)
    assert sorted(map(tuple, results["op4_simhash_neardup"].select("doc_id", "fingerprint", "component_id").collect())) == [(i, f"{fps[i]:016x}", comp[i]) for i in ids]


def test_op2_brute(results):
    d = columns("pages")
    want = brute_tree(list(zip(d["page_id"], d["url"], strict=True)), url_filter.RULES)
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in results["op2_url_filter"].collect()}
    assert got == want
    for r in results["op2_url_filter"].collect():
        assert (r["host"], r["path"], r["rule"]) == brute_url(dict(zip(d["page_id"], d["url"], strict=True))[r["page_id"]])[:3]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_op5_brute(results, library):
    d = columns("documents")
    want = {i: [*e.ids, 49407] for i, e in zip(d["doc_id"], library.encode_batch([t or "" for t in d["text"]], add_special_tokens=False), strict=True)}
    rows, got = results["op5_token_packing"].collect(), {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), dtype="<u2")
        assert len(ids) == token_packing.LENGTH and r["cu_seqlens"][-1] == r["n_tokens"] and set(ids[r["n_tokens"] :].tolist()) <= {49407}
        for i, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"][:-1], r["cu_seqlens"][1:], strict=True):
            got.setdefault(i, []).append((s, ids[a:b].tolist()))
    assert {i: [t for _, part in sorted(p) for t in part] for i, p in got.items()} == want
    size = token_packing.LENGTH
    parts = sorted((min(size, len(x) - s) for x in want.values() for s in range(0, len(x), size)), reverse=True)
    assert sorted(r["n_tokens"] for r in rows) == sorted(map(sum, brute_best_fit(parts, size)))


def test_op9_library(results, library):
    d = columns("documents")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    encoded = library.encode_batch([t or "" for t in d["text"]], add_special_tokens=False)
    want = {i: (len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for i, e in zip(d["doc_id"], encoded, strict=True)}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in results["op9_bpe"].collect()} == want


def test_op10_brute(results):
    d = columns("pages")
    want = {}
    for i, page in zip(d["page_id"], d["html"], strict=True):
        found = html_extract.blocks(page or "")
        want[i] = "\n".join(b.text for b, x in zip(found, brute_labels(found), strict=True) if x == 1)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in results["op10_html_extract"].collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_op8_brute(spark, results):
    """Sizes by plain compressors, a new one for each text and language."""
    import zstandard

    d, dicts = columns("documents"), language_id.train(table(spark, DATA, "documents"))
    got = {r["doc_id"]: r["lang_pred"] for r in results["op8_language_id"].collect()}
    assert len(dicts) == 4
    for i, t in zip(d["doc_id"], d["text"], strict=True):
        data = language_id.letters(t or "")
        if not data:
            assert got[i] == "und"
            continue
        sizes = {}
        for lang, own in dicts.items():
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language_id.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(data[s : s + language_id.PIECE])) for s in range(0, len(data), language_id.PIECE))
        assert sizes[got[i]] <= min(sizes.values()) + 1, (i, sizes)


def test_held_out_flags_and_accuracy(results):
    d = columns("documents")
    lang = dict(zip(d["doc_id"], d["lang"], strict=True))
    rows = results["op8_language_id"].collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.9
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in results["op6_toxicity"].collect())


def test_pipeline_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_neardup", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_brute(spark):
    """The whole pipeline in plain Python, with the models that the stages learn."""
    import pyarrow as pa

    docs = table(spark, DATA, "documents")
    d = columns("documents")
    rows = dict(zip(d["doc_id"], d["text"], strict=True))
    m = toxicity.train(docs, table(spark, DATA, "labels")).matcher()
    kept = {i for i, s in zip(rows, m.score(m.batch(pa.array(list(rows.values()), pa.string()))), strict=True) if s < 0.3}
    judge = language_id.Judge(tuple(sorted(language_id.train(docs).items())))
    kept = {i for i in kept if judge.judge(rows[i])[2]}
    fps = {i: brute_fingerprint(rows[i]) for i in kept}
    ids = sorted(kept)
    comp = classes_of(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    kept = {i for i in ids if comp[i] == i}
    items = columns("benchmark")
    index = decontaminate.Index.build(sorted(zip(items["item_id"], items["text"], strict=True)))
    kept -= {r[0] for i in kept for r in decontaminate._found(index, [i], [rows[i]])}
    model = bpe.model(bpe.default_path())
    want = {i: (len(e := model.encode(rows[i])), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(model.decode(e).encode()).hexdigest()) for i in kept}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_pipeline_columns(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_pipeline_stages_take_empty_and_odd_tables(spark):
    docs = table(spark, DATA, "documents")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", 0), (None, "text without an id", None, None, 3)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs.limit(0), odd):
            assert stage(spark, df, DATA).count() <= df.count(), name
