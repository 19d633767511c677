"""Mapping, chunks, extraction, state, files and stores on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.operators import chunking as C
from quillgraph.operators import evaluate as E
from quillgraph.operators import extraction as X
from quillgraph.operators import mapping as M
from quillgraph.plans.ontology import Entity, Field, Ontology
from quillgraph.sources import files, store
from quillgraph.streaming import state as S

ONTO = Ontology(
    {"Place": None, "City": "Place", "Person": None}, (),
    (
        Entity("places", "Place", (Field("ruler", "ruledBy", "out"), Field("status", "status", "enum", ("past", "current")), Field("from_year", "fromYear", "integer"), Field("products", "produces", "list"), Field("rulers", "ruledBy", "out_list"), Field("holder", "holds", "in"), Field("twin", "twinOf", "both_list")), "type", {"city": "City"}, related={"ally": ("alliedWith", True), "other": ("relatedTo", False)}),
        Entity("people", "Person", (Field("title", "title", "literal"),)),
    ),
)


def mapped(spark, *bodies):
    rows = [("d1", k, k, "7", "book/One", b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)]
    return {(r["s"], r["p"], r["o"]) for r in M.quads(spark.createDataFrame(rows, "doc_id string, chunk_idx int, ord long, page string, book string, body string"), ONTO).collect()}


def test_mapping(spark):
    got = mapped(spark, {"places": [{"name": "Déjà Vu", "type": "CITY", "ruler": "Anna", "status": " PAST ", "from_year": "-1,000 YK", "products": ["Wine", "n/a", ""], "rulers": ["Bo", "unknown"], "holder": "Cy", "twin": ["Far Town"], "aliases": ["Vu", "Déjà Vu"], "relationships": [{"target": "Foe", "type": "ALLY"}, {"target": "Bar"}, {"target": "Baz", "type": "odd"}], "page_references": ["3", "4"]}]})
    me = "Déjà_Vu"
    assert {(me, "type", "City"), (me, "type", "Place"), (me, "label", "Déjà Vu"), (me, "mentionedIn", "book/One"), (me, "ruledBy", "Anna"), (me, "ruledBy", "Bo"), (me, "status", "past"), (me, "fromYear", "-1000"), (me, "produces", "Wine"), ("Cy", "holds", me), (me, "twinOf", "Far_Town"), ("Far_Town", "twinOf", me), (me, "alias", "Vu"), (me, "alliedWith", "Foe"), ("Foe", "alliedWith", me), (me, "relatedTo", "Bar")} <= got
    assert {o for s, p, o in got if p == "atPage"} == {"3", "4"} and not [x for x in got if "Baz" in x[2] or x[2] in ("n/a", "unknown")] and len([1 for s, p, o in got if p == "alias"]) == 1


def test_quads_come_once(spark):
    """Of one object, of several of an entity in a document, and of links that two entities give from both ends."""
    kept = ("label", "holds", "produces", "twinOf", "ruledBy", "hasMention", "atPage", "type")
    a = {"name": "Aa", "type": "city", "ruler": "Bo", "rulers": ["Bo", "Bo"], "products": ["Wine", "Wine"], "holder": "Cy", "twin": ["Bb", "Bb", "Aa"], "page_references": ["1", "1"]}
    b = {"name": "Bb", "twin": ["Aa"], "page_references": ["1"]}
    rows = [(d, k, k, "7", "book/One", json.dumps(x)) for d in ("d1", None) for k, x in enumerate([{"places": [a, a]}, {"places": [a, b]}, {"people": [{"name": "Bo", "title": "Sir"}]}])]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, ord long, page string, book string, body string")
    got = [tuple(r) for r in M.quads(df, ONTO).select("doc_id", "s", "p", "o", "o_kind", "datatype").collect()]
    assert len(got) == len(set(got)) and {d for d, *_ in got} == {"d1", None} and {(s, o) for _, s, p, o, *_ in got if p == "ruledBy"} == {("Aa", "Bo")} and {s for _, s, p, *_ in got if p == "title"} == {"Bo"}
    for p in {p for _, _, p, *_ in got} | set(kept):
        some = [tuple(r) for r in M.quads(df, ONTO, (p,).__contains__).select("doc_id", "s", "p", "o", "o_kind", "datatype").collect()]
        assert sorted(map(repr, some)) == sorted(repr(x) for x in got if x[2] == p), p


def test_quads_of_single_objects_are_not_shuffled(spark):
    rows = [("d1", k, k, "7", "book/One", json.dumps({"places": [{"name": f"N{k}", "products": ["Wine"]}]})) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, ord long, page string, book string, body string")
    made = M.quads(df, ONTO, ("label", "produces", "hasMention").__contains__)
    assert made.count() == 60 and "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("body", ["not json", "[1, 2]", "", '{"places": "text"}', '{"places": [{"name": "n/a"}, {"name": null}, {}]}', '{"other": [{"name": "x"}]}'])
def test_mapping_takes_broken_replies(spark, body):
    assert mapped(spark, body) == set()


@pytest.mark.parametrize("year,want", [("16,000 years ago", None), (True, None), (998, "998"), ("year 12", "12"), (None, None), ("none", None)])
def test_years(spark, year, want):
    got = [o for _, p, o in mapped(spark, {"places": [{"name": "X", "from_year": year}]}) if p == "fromYear"]
    assert got == ([want] if want else [])


@pytest.mark.parametrize("arrivals,kind,conflicts", [(["Place", "City"], "City", []), (["City", "Place"], "City", []), (["City", "Person"], "City", [("City", "Person")]), (["Person", "City"], "Person", [("Person", "City")])])
def test_type_fold(spark, arrivals, kind, conflicts):
    df = spark.createDataFrame([("x", k, 0, 0, t) for k, t in enumerate(arrivals)], "slug string, ord int, chunk_idx int, pos int, class string")
    r = M.type_fold(df, ONTO).first()
    assert r["class"] == kind and [tuple(c) for c in r["conflicts"]] == conflicts


def test_names(spark):
    df = spark.createDataFrame([("Maps/5E/Canon/My Book-2.pdf",), ("x.pdf",)], "p string")
    got = df.select(N.path_id(F.regexp_replace("p", r"\.pdf$", "")).alias("i"), N.path_parts(F.col("p"), files.EDITIONS, files.CANONS).alias("x")).collect()
    assert [r["i"] for r in got] == ["maps-5e-canon-my-book-2", "x"] and (got[0]["x"]["edition"], got[0]["x"]["canon_type"], got[0]["x"]["tags"]) == ("5e", "canon", ["Maps"])


MD = """<!-- page: 3 -->
# One

{a}

## Two

tiny

<!-- page: 4 -->
## Three
# Four
| a | b |
**12**
{a}

{a}
"""


def test_sections_and_chunks(spark):
    text = MD.format(a="Some words that make up a body of more than ten tokens, so it stays.")
    found = C.sections(C.classified(C.lines(spark.createDataFrame([("d", text)], "doc_id string, text string"))))
    got = {r["title"]: r for r in found.collect()}
    assert set(got) == {"One", "Three", "Four"} and got["Three"]["text"] == "" and got["One"]["page"] == 3 and got["Four"]["page"] == 4 and "**12**" not in got["Four"]["text"]
    made = C.chunks(found, context=1024, overhead=740).orderBy("chunk_idx").collect()
    assert made and all(r["token_count"] <= 256 for r in made)


def test_chunks_are_made_by_the_batch(spark):
    """A call for each document would cost milliseconds for each page; whole documents are rows of a batch, and none takes another's sections."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("# Alpha\n\n"), F.expr("repeat('one two three four five six ', 4)"), F.lit("\n\n## Beta\n\n"), F.expr("repeat('word ', 20)"), F.col("id").cast("string")).alias("text"))
    made = C.chunks(C.sections(C.classified(C.lines(docs))))
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in made.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got) == 300
    for d, own in got.items():
        own.sort(key=lambda r: r["chunk_idx"])
        assert own[0]["title"] == "Alpha" and own[0]["hierarchy"] == ["Alpha"] and own[-1]["text"].endswith(f" {d}") and [r["chunk_idx"] for r in own] == list(range(len(own)))


def test_hierarchy_merge_split():
    items = C.with_hierarchy([{"level": k, "title": t, "text": t, "token_count": 20} for k, t in ((1, "A"), (2, "B"), (3, "C"), (2, "D"))])
    assert [s["parent_index"] for s in items] == [None, 0, 1, 0] and items[2]["hierarchy"] == ["A", "B", "C"]
    merged = C.merge_small([{"title": "A", "text": "a " * 50, "token_count": 50}, {"title": "B", "text": "b", "token_count": 1}], 10, 100)
    assert merged == [{"title": "A", "text": "a " * 50 + "\n\nb", "token_count": 51}]
    assert C.split_large({"text": "one " * 30, "token_count": 30}, 10)[0]["sub_index"] is None
    parts = C.split_large({"text": "\n\n".join(["w " * 40] * 5), "token_count": 200}, 100)
    assert [p["sub_index"] for p in parts] == [0, 1, 2] and all(p["token_count"] <= 100 for p in parts)


def test_toc():
    two = ["Intro ..... 1", "Next ..... 5", "Body text"]
    assert C.toc_entries(two) == ([], two)
    entries, rest = C.toc_entries(["Intro ..... 1", "Next ..... 5", "", "Third .... 9", "Fourth .... 12", "Body text"])
    assert entries == [("Third", 9), ("Fourth", 12)] and rest[-1] == "Body text"


def test_toc_of_sections(spark):
    toc = "\n".join(["Preface ..... 1", "Start ..... 2", "Chapter 1: Land ..... 3", "Chapter 2: Sea ..... 9"])
    body = "A body of words that is long enough to be kept as a section of its own, so it stays."
    text = f"{toc}\n<!-- page: 4 -->\n# Hills\n{body}\n<!-- page: 12 -->\n# Waves\n{body}"
    docs = spark.createDataFrame([("d", text), ("e", f"# chapter 2 sea\n{body}"), ("n", None)], "doc_id string, text string")
    entries, rest = C.toc_and_body(docs)
    assert [(r["title"], r["start"], r["chapter"]) for r in entries.orderBy("ord").collect()] == [("Chapter 1: Land", 3, 1), ("Chapter 2: Sea", 9, 2)]
    found = C.with_toc(C.sections(C.classified(C.lines(rest))), entries.unionByName(entries.withColumn("doc_id", F.lit("e"))))
    assert {(r["doc_id"], r["title"]): r["toc_title"] for r in found.collect()} == {("d", "Hills"): "Chapter 1: Land", ("d", "Waves"): "Chapter 2: Sea", ("e", "chapter 2 sea"): "Chapter 2: Sea"}


def test_token_counts_agree(spark):
    texts = ["", "a b", "don't stop_now", "été e\u0301 日本", "x\u00a0y\u2003z \t!", "½ 12,5 🙂"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.tokens(F.col("t"))).collect()] == [C.count_tokens(t) for t in texts]


def test_extraction(spark):
    rows = [(1, '{"places": [{"name": "x"}]}'), (2, '```json\n{"places": []}\n```'), (3, '{"places": [{'), (4, "[1]"), (5, '{"places": "x"}'), (6, None), (7, '```\n{"places": [{}, {}]}')]
    got = {r["k"]: (r["ok"], r["n_places"]) for r in X.parsed(spark.createDataFrame(rows, "k int, body string"), ["places"]).collect()}
    assert got == {1: (True, 1), 2: (True, 0), 3: (False, 0), 4: (False, 0), 5: (True, 0), 6: (False, 0), 7: (True, 2)}

    class Fixed:
        def complete(self, prompt, text, max_tokens):
            return "SKIP" if "dull" in text else "ENTITIES" if "Reply" in prompt else "{}"

    chunks = spark.createDataFrame([("d", 0, "dull", 5), ("d", 1, "Anna of Bold", 900)], "doc_id string, chunk_idx int, text string, token_count int")
    out = {r["chunk_idx"]: (r["label"], r["body"]) for r in X.with_model(chunks, Fixed(), ONTO, 100).collect()}
    assert out == {0: ("SKIP", None), 1: ("ENTITIES", "{}")}

    class Broken:
        def complete(self, prompt, text, max_tokens):
            if "dull" in text:
                raise TimeoutError("too long")
            return "ENTITIES" if "Reply" in prompt else prompt

    out = {r["chunk_idx"]: (r["label"], r["body"], r["error"]) for r in X.with_model(chunks, Broken(), ONTO, 100, hint=["Karl", "Bold"]).collect()}
    assert out[0] == (None, None, "TimeoutError: too long") and out[1][1].endswith("Karl; Bold.") and out[1][2] is None
    kept, errors = X.fits(chunks, 500)
    assert kept.count() == 0 and "900" in errors.first()["error"]


def log(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, status string, t string").select("document_id", "status", F.col("t").cast("timestamp_ntz").alias("updated_at"))


def test_state(spark):
    df = log(spark, ("a", "PENDING", "2026-01-01 00:00:00"), ("a", "FAILED", "2026-01-01 00:05:00"), ("b", "LOADING_GRAPH", "2026-01-01 00:00:00"), ("c", "MARKDOWN_READY", "2026-01-01 00:00:00"), ("d", "COMPLETED", "2026-01-01 00:00:00"))
    now = F.lit("2026-01-01 00:10:01").cast("timestamp_ntz")
    ids = spark.createDataFrame([("a",), ("d",), ("zz",)], "document_id string")
    assert [r["document_id"] for r in S.stale(df, now).collect()] == ["b"] and [r["document_id"] for r in S.graph_candidates(df).collect()] == ["b", "c"]
    assert [(r["document_id"], r["status"]) for r in S.requeue(df, ids, now).collect()] == [("a", "PENDING")] and sorted(r["document_id"] for r in S.restart(df, ids, now).collect()) == ["a", "d"]
    assert [r["document_id"] for r in S.claimable(df, ids).collect()] == ["zz"] and S.get(df, "a").first()["status"] == "FAILED" and S.page_count(df).first()["pages"] == 1
    assert [r["document_id"] for r in S.listed(df, 1, 2).collect()] == ["a", "b"]


def test_claims(spark):
    at = lambda s: F.lit(f"2026-01-01 00:{s}").cast("timestamp_ntz")
    none = spark.createDataFrame([], "document_id string, owner string, claimed_at timestamp_ntz, until timestamp_ntz")
    ids = spark.createDataFrame([("a",), ("b",)], "document_id string")
    one = S.claimed(ids, none, "w1", at("00:00"), 60)
    two = S.claimed(ids, none, "w0", at("00:01"), 60)  # another driver that had not seen the first claim
    both = one.unionByName(two)
    assert {(r["document_id"], r["owner"]) for r in S.held(both, at("00:30")).collect()} == {("a", "w1"), ("b", "w1")}
    assert S.claimed(ids, both, "w2", at("00:30")).collect() == [] and S.renewed(both, "w2", at("00:30")).collect() == []
    longer = both.unionByName(S.renewed(both, "w1", at("00:50"), 300).where("document_id = 'a'"))
    assert {(r["document_id"], r["owner"]) for r in S.held(longer, at("03:00")).collect()} == {("a", "w1")}
    freed = longer.unionByName(S.renewed(longer, "w1", at("03:10"), 0))
    assert sorted(r["document_id"] for r in S.claimed(ids, freed, "w2", at("03:11")).collect()) == ["a", "b"]


def test_progress_rows(spark):
    df = log(spark, ("a", "CONVERTING_PDF", "2026-01-01 00:00:00"), ("b", "PENDING", "2026-01-01 00:00:00")).withColumns({c: F.lit(None).cast("int") for c in ("current_page", "total_pages", "current_chunk", "total_chunks", "entity_count")})
    step = spark.createDataFrame([("a", 3, 9)], "document_id string, current_page int, total_pages int").withColumn("updated_at", F.lit("2026-01-01 00:01:00").cast("timestamp_ntz"))
    more = S.advanced(df, step)
    assert more.columns == df.columns and {r["document_id"]: r["p"] for r in S.latest(df.unionByName(more)).select("document_id", S.progress().alias("p")).collect()} == {"a": "page 3/9", "b": ""}


def test_front_matter_and_missing_objects(spark):
    docs = spark.createDataFrame([("a", 'A "b"', ["x", "y"], 3, None, "# One")], "document_id string, title string, tags array<string>, pages int, edition string, markdown string")
    made = files.with_front_matter(docs).first()["markdown"]
    assert made == '---\ndocument_id: "a"\ntitle: "A \\"b\\""\ntags: ["x", "y"]\npages: 3\n---\n\n# One'
    back = C.front_matter(spark.createDataFrame([(made,)], "text string")).first()
    import yaml

    assert yaml.safe_load(back["meta"]) == {"document_id": "a", "title": 'A "b"', "tags": ["x", "y"], "pages": 3} and back["body"].strip() == "# One"
    got = files.markdown_of(spark.createDataFrame([("a",), ("b",)], "document_id string"), docs.select("document_id", "markdown")).orderBy("document_id").collect()
    assert [(r["status"], r["error"]) for r in got] == [("MARKDOWN_READY", None), ("FAILED", "no Markdown object for b")]


def test_watch_handles_each_file_once(spark, tmp_path):
    seen, schema = [], "document_id string, status string"
    for k in range(2):
        spark.createDataFrame([(f"d{k}", "PENDING")], schema).write.mode("append").parquet(str(tmp_path / "log"))
        S.watch(S.read_log(spark, str(tmp_path / "log"), schema), lambda df, _: seen.extend(r["document_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["d0", "d1"]


def test_store(spark, tmp_path):
    q = spark.createDataFrame([("d1", "s", "label", 'a "b"\\\n c', "lit", "string"), ("d1", "s", "year", "-5", "lit", "integer"), ("d2", "s", "p", "o", "iri", None)], store.QUADS)
    assert sorted(map(repr, store.parse_nquads(store.quad_lines(q)).select(*q.columns).collect())) == sorted(map(repr, q.collect()))
    path = str(tmp_path / "quads")
    store.write_quads(q, path)
    store.write_quads(q.where("doc_id = 'd1' and p = 'year'"), path)  # replaces d1, leaves d2
    assert sorted((r["doc_id"], r["p"]) for r in spark.read.parquet(path).collect()) == [("d1", "year"), ("d2", "p")]
    store.export_nquads(q, str(tmp_path / "nq"))
    back = str(tmp_path / "back")
    assert store.import_nquads(spark, str(tmp_path / "nq"), back, "0.2.7", "0.2.0") is True and spark.read.parquet(back).count() == 3
    assert store.import_nquads(spark, str(tmp_path / "nq"), back, "0.2.7", "0.2.0") is False
    for args in ((str(tmp_path / "new"), "0.3.0", "0.2.0"), (path, "0.2.0", "0.2.0"), (back, "0.2.8", "0.2.0")):
        with pytest.raises(ValueError):
            store.import_nquads(spark, str(tmp_path / "nq"), *args)
    odd = spark.createDataFrame([("d", "s", "label", x, "lit", "string") for x in ("a\\nb", "a\nb", "\r\t", "\\", '\\"', '"\\\\n"')], store.QUADS)
    assert sorted(map(repr, store.parse_nquads(store.quad_lines(odd)).select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert store.parse_nquads(spark.createDataFrame([("",), ("# note",)], "value string")).collect() == []
    long = '\\"a>b' * 100_000  # a literal of any length, with marks of an IRI in it
    assert [len(r["o"]) for r in store.parse_nquads(spark.createDataFrame([(f'<a> <b> "{long}" <c> .',)], "value string")).collect()] == [400_000]
    with pytest.raises(Exception, match="no N-Quads line"):
        store.parse_nquads(spark.createDataFrame([("<a> <b> c",)], "value string")).collect()
    store.drop_document(spark, path, "d1")
    assert {r["doc_id"] for r in spark.read.parquet(path).collect()} == {"d2"}


def test_files(spark, tmp_path):
    folder = tmp_path / "5e" / "canon"
    folder.mkdir(parents=True)
    (folder / "My_Book.pdf").write_bytes(b"%PDF")
    (folder / "note.txt").write_text("x")
    r = files.registered(files.scan(spark, str(tmp_path)), str(tmp_path)).first()
    assert (r["document_id"], r["title"], r["edition"], r["canon_type"]) == ("5e-canon-my-book", "My Book", "5e", "canon")
    asked = spark.createDataFrame([("a", "T", "5e", "canon"), ("b", "", "5e", "canon"), ("c", "T", "99e", "canon"), ("d", "T", "5e", "canon")], "document_id string, title string, edition string, canon_type string")
    got = {x["document_id"]: x["error"] for x in files.submitted(asked, spark.createDataFrame([("d",)], "document_id string")).collect()}
    assert got == {"a": None, "b": "missing: title", "c": "unknown edition", "d": "already submitted"}
    fields = files.parse_sidecars(spark.createDataFrame([("a", "title: X\n"), ("b", ": : ["), ("c", None)], "document_id string, value string")).collect()
    assert [x["fields"] for x in fields] == [{"title": "X"}, {}, {}]
    heads = spark.createDataFrame([("a", "# One"), ("a", "## Two"), ("b", "# One"), ("b", "# Two")], "doc_id string, line string")
    assert {x["doc_id"]: x["body_title"] for x in files.body_title(heads).collect()} == {"a": "One", "b": None}


def test_scores(spark):
    df = lambda *x: spark.createDataFrame([("q", i) for i in x], "question string, item string")
    r = E.score(df("A ", "b", "c"), df("a", "B", "d")).first()
    assert (r["precision"], r["recall"], r["f1"], r["hits"], r["extra"], r["missed"]) == (0.6667, 0.6667, 0.6667, 2, 1, 1)


class FakePdf(list):
    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class FakePage:
    def __init__(self, text):
        self.text = text

    def get_text(self):
        if self.text is None:
            raise ValueError("broken page")
        return self.text


def test_pdf_pages_and_files_that_cannot_be_read_have_notes():
    def opened(data):
        if not data:
            raise ValueError("no file")
        return FakePdf(FakePage(t) for t in ("one", None, "three"))

    assert files.pages_of("d", b"x", opened) == [("d", 1, "one"), ("d", 2, "[page 2 could not be read]"), ("d", 3, "three")]
    assert files.pages_of("d", None, opened) == [("d", 1, "[file could not be opened: ValueError]")]
