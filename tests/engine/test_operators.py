"""Rules of single operators on small inputs."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as X
from folioforge.operators import answer, blocks, chunks, cite, embed, evaluate, monitor, normalize, parse, retrieve
from folioforge.sources import files, pages
from folioforge.streaming import ingest, limiter

BLOCK = "doc_id long, block_seq long, page long, order_in_page long, doc_type string, block_type string, text string, is_ocr boolean, confidence double, heading_level long, section string"


def block(spark, *rows):
    """rows: dictionaries of what differs from a plain paragraph."""
    base = {"doc_id": 1, "page": 1, "order_in_page": 2, "doc_type": "web_document", "block_type": "paragraph", "text": "", "is_ocr": False, "confidence": 0.9, "heading_level": None, "section": "S"}
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return spark.createDataFrame([[{**base, "block_seq": i, **r}[n] for n in names] for i, r in enumerate(rows)], BLOCK)


def column(df, name, order="block_seq"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_vector_macros(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0, 5.0]), ([0.0, 0.0], [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(X.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1 / np.sqrt(27)) and got[1:] == [0.0, 0.0]
    assert df.select(X.l2_normalize(F.col("a"))).collect()[1][0] == [0.0, 0.0]


def test_artifacts_and_banners(spark):
    text = "Page 3 of 9\nreal line\n******\nConfidential\nGenerated by x"
    b = normalize.clean_artifacts(block(spark, {"text": text}, {"text": text, "doc_type": "contract"}, {"text": text, "block_type": "table"}))
    assert column(b, "text") == ["real line", "real line\nConfidential", text]
    assert column(b, "removed_lines") == [4, 3, 0]


def test_section_stack(spark):
    long = "A title of much more than forty characters, kept whole in every path"
    h = lambda n, t: {"heading_level": n, "block_type": "heading", "text": t, "section": None}
    rows = [{"text": "x", "section": " "}, h(None, long), h(3, "B"), h(2, "C"), {"text": "y"}, h(9, "deep"), {"text": "z", "section": None}, h(1, " "), h(2, "E"), h(2, "E")]
    b = normalize.section_paths(block(spark, *rows))
    assert column(b, "path") == ["", long, f"{long} > B", f"{long} > C", f"{long} > C", f"{long} > C > deep", f"{long} > C > deep", "Document", "Document > E", "Document > E"]
    assert column(b, "section") == ["Document", long, "B", "C", "S", "deep", "deep", "Document", "E", "E"]
    assert column(b, "parents")[3:6] == [[long], [long, "C"], [long, "C"]] and column(b, "section_path")[0] == ["Document"]


def test_tables_and_code(spark):
    b = normalize.normalize_tables(block(spark, {"block_type": "table", "text": "|a | b|\n|c|"}, {"block_type": "table", "text": "x\ty"}))
    assert column(b, "text") == ["| a | b |\n| --- | --- |\n| c |  |", "| x | y |"]
    assert column(b, "ragged") == [True, False]
    c = normalize.normalize_code(block(spark, {"block_type": "code", "text": "\n```SQL\r\nselect 1  \r\n"}))
    assert (column(c, "code_language"), column(c, "block_type"), column(c, "text")) == (["sql"], ["code_block"], ["```SQL\nselect 1"])


def test_ocr_and_chain(spark):
    rows = [{"is_ocr": True, "confidence": c, "text": "bro-\nken line and more words"} for c in (0.1, 0.3, 0.6, 0.9)]
    b = normalize.ocr_policy(block(spark, *rows))
    assert column(b, "ocr_action") == ["reject", "abstain", "pass", "pass"] and column(b, "ocr_bucket") == ["low", "low", "medium", "high"]
    assert column(b, "text")[0] == "broken line and more words"
    out = normalize.normalize(block(spark, *rows, {"text": "ﬁne  text​"}, {"text": "--"}))
    assert column(out, "block_index") == [0, 1, 2, 3] and column(out, "text")[-1] == "fine text"


def test_headers_go_entirely_and_copies_after_the_first(spark):
    rows = [{"page": p, "order_in_page": 1, "text": "Acme Report Header"} for p in range(1, 6)] + [{"text": "same words here"}, {"text": "Same  words here"}, {"text": "other"}]
    d = blocks.block_decisions(block(spark, *rows))
    assert column(d, "decision") == ["repeated_header"] * 5 + ["kept", "exact_duplicate", "kept"]
    assert column(d, "duplicate_of")[6] == 5


def test_greedy_near_duplicates_and_legal_bypass(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [{"text": " ".join(words)}, {"text": " ".join(words[:39])}, {"text": " ".join(words[:39] + ["x"]), "doc_type": "contract", "block_type": "clause"}, {"text": "unlike anything else"}]
    assert column(blocks.near_duplicate_greedy(block(spark, *rows)), "decision") == ["kept", "near_duplicate", "kept", "kept"]


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(30)]
    rows = [(i, "s", " ".join(rng.permutation(base)[: rng.integers(24, 31)])) for i in range(60)]
    sets = {i: frozenset(t.split()) for i, _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = blocks.near_pairs(spark.createDataFrame(rows, "id long, s string, text string"), "id", "s", 0.8).collect()
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a, b in want if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]}


def test_near_members_have_the_rest_of_each_class(spark):
    rows = [(1, "s", "b a"), (2, "s", "A  b a"), (3, "s", "a c"), (4, "t", "a b"), (5, "s", "a b"), (6, "s", ""), (7, "s", " "), (5, "s", "a b"), (3, "s", "c a")]
    got = blocks.near_members(spark.createDataFrame(rows, "id long, s string, text string"), "id", "s").collect()
    assert sorted(map(tuple, got)) == [("s", 1, 2), ("s", 1, 5), ("s", 6, 7)]


def test_quality_rules(spark):
    rows = [{"text": ""}, {"text": "too few"}, {"text": "a b c d e f", "is_ocr": True, "confidence": 0.3}, {"text": "one two three four five �"}, {"text": "1 2 3 4 5 a, b, c, d, e, f, ... 6 7 8 9 10 11"}, {"text": "one two three four five six"}, {"text": "Too  few"}, {"text": "code", "block_type": "code"}]
    d = blocks.quality_decisions(block(spark, *rows))
    assert column(d, "reason") == ["empty_text", "micro_block", "low_ocr_confidence", "junk_text", "parser_anomaly", None, "duplicate_of_dropped", None]


def test_windows_and_fixed_chunks(spark):
    b = block(spark, {"text": "a b c"}, {"text": " "}, {"text": "d e f g", "page": 2})
    got = [tuple(r) for r in chunks.fixed_chunks(b, 4, 1).select("window", "tokens", "blocks", "text", "page_end").orderBy("window").collect()]
    assert got == [(0, 4, "0,2", "a b c d", 2), (1, 4, "2", "d e f g", 2)]
    t = chunks.token_windows(spark.createDataFrame([(1, "a b c d e"), (2, "")], "k long, text string"), "k", 3, 1)
    assert [r["text"] for r in t.orderBy("window").collect()] == ["a b c", "c d e"]


def test_recursive_split():
    limits = chunks.Limits(2, 6, 8, 1)
    parts = chunks.split_recursively("one two three four five six. seven eight nine ten eleven. twelve", limits)
    assert parts == ["one two three four five six.", "seven eight nine ten eleven.\n\ntwelve"]
    assert chunks.split_recursively("  ", limits) == []
    assert all(len(p.split()) <= 8 for p in chunks.split_recursively("w" + " w" * 100, limits))


def test_semantic_chunks(spark):
    rows = [{"block_type": "heading", "text": "Scope", "heading_level": 1}, {"text": "first part"}, {"text": "second part"}, {"block_type": "table", "text": "| a |"}, {"block_type": "list", "text": "item"}, {"text": "after"}]
    got = chunks.semantic_chunks(block(spark, *rows)).orderBy("chunk_index").collect()
    assert [(r["strategy"], r["anchor"], r["blocks"]) for r in got] == [("semantic_merge", "Scope", "1,2"), ("table_aware", "Scope", "3"), ("semantic_merge", "S", "5")]
    assert got[0]["text"] == "S\n\nfirst part\n\nsecond part"


def test_page_references_and_quality(spark):
    df = spark.createDataFrame([("see p.4, (page12) page x",)], "t string")
    assert df.select(chunks.page_references(F.col("t"))).first()[0] == [4, 12]
    zero = df.select(chunks.quality_score(F.lit(0.0), F.lit(0.0), F.lit(True), F.lit(True), F.lit(False), F.lit(100))).first()[0]
    assert zero == pytest.approx(0.91)


def test_hash_embedding_and_budget(spark):
    v = embed.hash_vector("A b a")
    assert len(v) == 1024 and np.linalg.norm(v) == pytest.approx(1) and v == embed.hash_vector("a A  b")
    assert embed.hash_vector("") == [0.0] * 1024
    t = embed.truncated(spark.createDataFrame([("a b c",), ("a  b",)], "text string"), 2).collect()
    assert [(r["text"], r["tokens"], r["truncated"]) for r in t] == [("a b", 3, True), ("a  b", 2, False)]


def test_vector_decisions_compare_with_kept_ones_only(spark):
    e = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]
    rows = [(1, 1, e(0)), (2, 1, e(0.15)), (3, 1, e(0.3)), (4, 2, e(0)), (5, 1, e(2))]
    d = embed.vector_decisions(spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<double>"), 0.98)
    assert {r["chunk_id"]: r["decision"] for r in d.collect()} == {1: "kept", 2: "suppressed", 3: "kept", 4: "kept", 5: "kept"}


def test_publish_moves_the_pointer_last(spark, tmp_path):
    c = lambda *t: spark.createDataFrame(list(enumerate(t)), "chunk_id long, text string")
    embed.publish(c("a b", "b"), str(tmp_path), "v1")
    (tmp_path / "v2").mkdir()  # a version whose publishing broke off
    dense, sparse = embed.current(spark, str(tmp_path))
    assert dense.count() == 2 and sparse.count() == 3
    embed.publish(c("x"), str(tmp_path), "v2")
    assert embed.current(spark, str(tmp_path))[0].count() == 1


def test_filters(spark):
    pushed, rest = retrieve.split_filters({"document_type": {"eq": "a"}, "page": {"in": [2, None]}, "quality": {"eq": 1, "gte": 0}, "lang": None})
    assert pushed == {"doc_type": "a", "lang": None} and set(rest) == {"page_start", "quality"}
    with pytest.raises(ValueError):
        retrieve.split_filters({"x": {"like": "a"}})
    df = spark.createDataFrame([(1, 2), (2, None), (3, 5)], "id int, page_start int")
    assert [r["id"] for r in df.where(retrieve.residual({"page_start": {"in": [2, None]}})).collect()] == [1, 2]
    assert [r["id"] for r in df.where(retrieve.residual({"page_start": {"gt": 1}})).collect()] == [1, 3]
    assert [r["id"] for r in df.where(retrieve.equality({"page_start": None})).collect()] == [2]


def test_dense_top_breaks_ties_by_key(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50, 0, -1)] + [(99, [0.0, 0.0])], "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<double>")
    assert [r["chunk_id"] for r in retrieve.dense_top(q, v, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_fusion_keeps_dense_first(spark):
    h = lambda *k: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(k)], "query_id long, chunk_id long, rank long")
    assert [r["chunk_id"] for r in retrieve.fuse(h(5, 6), h(7, 6), 3).orderBy("rank").collect()] == [6, 5, 7]
    with pytest.raises(ValueError):
        retrieve.fuse(h(1), h(2), 1, w_dense=0, w_sparse=0)


def test_decomposition(spark):
    q = "What is the difference between contract law and tort law?"
    df = spark.createDataFrame([(q,), ("tvset one two three four five",), ("short and sweet",), ("",)], "q string")
    got = [(r[0], r[1]) for r in df.select(retrieve.is_multihop(F.col("q")), retrieve.decompose(F.col("q"))).collect()]
    assert got[0][0] and got[0][1][0] == "What is the difference" and got[0][1][1] == "What is the difference contract law"
    assert got[1][0] and not got[2][0] and got[2][1] == ["short and sweet"] and got[3][1] == []


def test_citations_and_answers(spark):
    a = spark.createDataFrame([("x [1] y [source 3, 9] z [a]",), ("I cannot determine it, mail a.b@c.de",)], "answer string")
    ids = F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 3)))
    r = cite.validate(a, ids).collect()
    assert (r[0]["orphans"], r[0]["uncited"], r[0]["valid"]) == ("9", "2", False) and r[1]["uncited"] == "1,2,3"
    assert [x[0] for x in a.select(answer.abstained(F.col("answer"))).collect()] == [False, True]
    assert not answer.validity(a, ids).collect()[1]["valid"]


def test_context_dedup_and_compression(spark):
    schema = "query_id long, chunk_id long, doc_id long, score double, rank long, quality double, page_start long, source string, text string"
    rows = [(1, 1, 1, 3.0, 1, 0.9, 1, "s", "alpha beta gamma"), (1, 2, 2, 2.0, 2, 0.2, 1, "s", "alpha beta gamma"), (1, 3, 3, 1.0, 3, 0.1, 1, "s", "only delta"), (1, 4, 4, 0.5, 4, 0.5, 1, "s", "alpha filler filler filler")]
    kept = cite.deduplicated(spark.createDataFrame(rows, schema))
    assert sorted(r["chunk_id"] for r in kept.collect()) == [1, 3, 4]
    out = cite.compressed(cite.ordered(kept), spark.createDataFrame([(1, "alpha delta")], "query_id long, question string"), 6)
    assert sorted(r["chunk_id"] for r in out.collect()) == [1, 3]


def test_containing_and_metrics(spark):
    c = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "quick"), (3, "x quick brown fox")], "chunk_id long, text string")
    p = spark.createDataFrame([(10, "quick brown fox"), (11, "quick")], "query_id long, passage string")
    assert sorted(tuple(r) for r in evaluate.containing(p, c).collect()) == [(10, 1), (10, 3), (11, 1), (11, 2), (11, 3)]
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, chunk_id long, rank long")
    gold = spark.createDataFrame([(1, 6), (1, 8)], "query_id long, chunk_id long")
    r = {x["query_id"]: x for x in evaluate.scores(q, hits, gold).collect()}
    assert (r[1]["mrr_at_5"], r[1]["recall_at_10"], r[2]["mrr_at_5"]) == (0.5, 0.5, 0.0)
    assert r[1]["ndcg_at_5"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)


def test_audit_counts_false_as_present(spark):
    c = spark.createDataFrame([("p", False, 0.0, " ")], "parser_used string, fallback_used boolean, parse_confidence double, heading_anchor string")
    r = monitor.audited(c).first()
    assert "fallback_used" not in r["missing"] and "parse_confidence" not in r["missing"] and "heading_anchor" in r["missing"]


def test_file_table(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("[Content_Types].xml", "x")
        f.writestr("word/document.xml", "x")
    for name, data in {"a.pdf": b"%PDF-1 /Encrypt", "b.pdf": b"no", "c.txt": b"hello", "d.txt": b"hello", "e.docx": z.getvalue(), "f.html": b"<HTML>", "sub/g.bin": b"\0\1", "h.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    f = files.scan(spark, str(tmp_path)).withColumn("ordinal", F.col("path"))
    empty = files.validated(spark.createDataFrame([("/h.txt", b"", 1)], "path string, content binary, ordinal int")).first()
    assert empty["failure_reason"] == "empty_file"
    v = {r["path"].rsplit("/", 1)[1]: r for r in files.validated(f).collect()}
    assert {k: v[k]["failure_reason"] for k in v} == {"a.pdf": "encrypted", "b.pdf": "corrupted", "c.txt": None, "d.txt": "duplicate", "e.docx": None, "f.html": None, "g.bin": "unsupported_extension"}
    kind = {r[0].rsplit("/", 1)[1]: r[1] for r in f.where(F.col("path").endswith(".docx")).select("path", files.container_type(F.col("content"))).collect()}
    assert kind["e.docx"].endswith("wordprocessingml.document")


def test_parse_falls_back(spark):
    def broken(path, content):
        raise ModuleNotFoundError("No module named x")

    f = spark.createDataFrame([("p", b"one\ftwo", ["docling", "unstructured", "pymupdf"])], "path string, content binary, parsers array<string>")
    a = parse.parse(f, {"docling": broken, "unstructured": lambda p, c: [" "], "pymupdf": lambda p, c: c.decode().split("\f")})
    assert [(r["parser"], r["ok"]) for r in a.orderBy("step").collect()] == [("docling", False), ("unstructured", False), ("pymupdf", True)]
    w = parse.winners(a).first()
    assert (w["parser"], w["attempts"], w["first_error"]) == ("pymupdf", 3, "No module named x")


def test_feed_and_qa(spark, tmp_path):
    (tmp_path / "feed.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/1.2</id><title>A\n  b</title><summary>s</summary><published>2020</published><author><name>N</name></author><author><name>M</name></author><link href="u" title="pdf"/></entry></feed>')
    r = pages.read_feed(spark, str(tmp_path / "feed.xml")).first()
    assert (r["id"], r["title"], r["authors"], r["pdf"]) == ("1.2", "A b", ["N", "M"], "u")
    (tmp_path / "qa.json").write_text('[{"question_id": "1", "question": "q", "gold_chunk_ids": ["c"]}]')
    assert pages.read_qa(spark, str(tmp_path / "qa.json")).first()["gold_chunk_ids"] == ["c"]


def test_stream_decides_as_the_batch_does(spark, tmp_path):
    from ..conftest import DATA

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    events.orderBy("ts", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = limiter.limited_stream(stream, "user_id", 2, 12 * 3600).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r) for r in limiter.limited(events, "user_id", 2, 12 * 3600).collect())
    assert sorted(tuple(r) for r in spark.table("decided").collect()) == want


def test_ingest_stream(spark, tmp_path):
    spark.createDataFrame([(1, "first line of text\nsecond line of text"), (2, "--")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["first line of text", "second line of text"]


def test_references_and_findings_have_places(spark):
    df = spark.createDataFrame([(1, "as said [1] and [SOURCE 2, 3], again [1].")], "k int, answer string")
    got = [tuple(r) for r in cite.reference_places(df).orderBy("start", "id").collect()]
    assert got == [(1, 1, 8, 11), (1, 2, 16, 29), (1, 3, 16, 29), (1, 1, 37, 40)]
    rows = spark.createDataFrame([(1, "é a.b@c.org or a.b@c.org, +49 (30) 1234-567")], "k int, text string")
    assert [(r["kind"], r["start"], r["end"]) for r in answer.findings(rows).collect()] == [("email", 2, 11), ("email", 15, 24), ("phone", 27, 43)]


def test_citation_confidence_counts_all_signals(spark):
    hits = spark.createDataFrame([("q", "c", 1, "d", 1, "/x/paper.pdf", "A > B", "a-b", "b1"), ("q", "e", 2, "z", 0, "", "", None, None)], "query_id string, chunk_id string, rank int, doc_id string, page_start int, source_path string, section_path string, heading_anchor string, source_block_ids string")
    known = spark.createDataFrame([("d", "Title", "v1")], "doc_id string, title string, version string")
    assert [r["confidence"] for r in cite.resolve(hits, known).orderBy("citation_id").collect()] == [1.0, 0.3]


def test_store_versions(spark, tmp_path):
    from folioforge.operators import store

    one = spark.createDataFrame([("a", "d", "x"), ("b", "d", "y"), ("c", "e", "z")], "chunk_id string, doc_id string, text string")
    two = spark.createDataFrame([("a", "d", "X"), ("a", "d", "X"), ("f", "d", "w")], one.schema)
    names = lambda df: sorted((r["chunk_id"], r["text"]) for r in df.collect())
    assert names(store.upsert(one, two)) == [("a", "X"), ("b", "y"), ("c", "z"), ("f", "w")]
    assert names(store.replace_documents(one, two)) == [("a", "X"), ("c", "z"), ("f", "w")]
    assert names(store.delete(one, two)) == [("b", "y"), ("c", "z")]
    at = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        store.current(spark, at, "dense")
    first = store.publish({"dense": one}, at)
    store.publish({"dense": store.upsert(one, two)}, at, "second")
    (tmp_path / "half" / "dense").mkdir(parents=True)  # what a lost job leaves
    assert store.current(spark, at, "dense").count() == 4
    assert store.restore(spark, at) == first and store.current(spark, at, "dense").count() == 3
    payload = store.dense_payload(one, ["doc_id"], F.lit("t")).first()
    assert payload["chunk_id"] == "a" and payload["metadata"] == '{"doc_id":"d"}' and payload["parser_used"] is None
    bad = spark.createDataFrame([([1.0],), ([],), ([1.0, 2.0],), (None,)], "e array<double>")
    assert [r[0] for r in bad.select(store.dimensions(F.col("e"), 2)).collect()] == ["dimension_mismatch", "missing_embedding", None, "missing_embedding"]


def test_versions_texts_and_flags(spark):
    v = spark.createDataFrame([(1, 1, "v1", [1.0, 0.0]), (2, 1, "v2", [1.0, 0.0]), (3, 1, None, [1.0, 0.0])], "chunk_id long, doc_id long, version string, embedding array<double>")
    got = {r["chunk_id"]: r["decision"] for r in embed.vector_decisions(v).collect()}
    assert got == {1: "kept", 2: "kept", 3: "suppressed"}
    t = spark.createDataFrame([(1, " a "), (2, "a"), (3, " "), (4, None)], "k int, text string")
    rows = {r["k"]: r["embedding"] for r in embed.embed_texts(t, F.array(F.length("text").cast("double"))).collect()}
    assert rows == {1: [1.0], 2: [1.0], 3: None, 4: None}
    q = t.select("k", embed.query_vector(F.array(F.lit(1.0), F.lit(2.0)), F.col("text"), 2).alias("v")).collect()
    assert [r["v"] for r in q] == [[1.0, 2.0], [1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    f = spark.createDataFrame([("and so", " lines \r\nx  ")], "a string, b string").select(chunks.starts_inside(F.col("a")), chunks.final_text(F.col("b"))).first()
    assert tuple(f) == (True, " lines\nx")


def _lines(spark):
    """40 documents of up to 60 lines from few words, some again, some blank."""
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(12)])
    rows = []
    for d in range(40):
        for i in range(int(r.integers(1, 60))):
            old = [x["text"] for x in rows if x["doc_id"] == d]
            new = " ".join(r.choice(words, int(r.integers(0, 40)))) if r.random() < 0.6 or not old else old[int(r.integers(len(old)))] + r.choice(["", " w1", " New"])
            rows.append({"doc_id": d, "block_seq": i, "text": new, "doc_type": ["contract", "web_document"][d % 2], "block_type": ["clause", "paragraph"][i % 2]})
    return rows


@pytest.fixture
def small_batches(spark):
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")
    yield
    spark.conf.set(key, old)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_near_duplicates_as_by_comparing_all(spark, small_batches):
    """One stream a task instead of a Python group a document, and the decisions of comparing every kept block."""
    rows = _lines(spark)
    got = blocks.near_duplicate_greedy(block(spark, *rows))
    assert "FlatMapGroupsInPandas" not in _plan(got) and "MapInArrow" in _plan(got)
    want = []
    for d in range(40):
        kept, seen = [], {}
        for x in (x for x in rows if x["doc_id"] == d):
            own, sig = set(x["text"].lower().split()), " ".join(x["text"].lower().split())
            best, at = max(((len(own & o) / len(own | o) if own | o else 1.0, -s) for s, o in kept), default=(0, 0))
            if sig in seen:
                want.append((d, x["block_seq"], "exact_duplicate", seen[sig]))
            elif best >= 0.95 and not (best < 0.99 and x["doc_type"] == "contract" and x["block_type"] == "clause"):
                want.append((d, x["block_seq"], "near_duplicate", -at))
            else:
                kept.append((x["block_seq"], own))
                seen[sig] = x["block_seq"]
                want.append((d, x["block_seq"], "kept", None))
    assert sorted((r["doc_id"], r["block_seq"], r["decision"], r["duplicate_of"]) for r in got.collect()) == sorted(want)
    assert {x[2] for x in want} == {"kept", "near_duplicate", "exact_duplicate"}


def test_semantic_chunks_are_a_stream(spark, small_batches):
    """Documents longer than a batch; every block in one chunk, in order; no Python group a document."""
    rows = _lines(spark)
    got = chunks.semantic_chunks(block(spark, *rows), chunks.Limits(least=20, target=60, most=90))
    assert "FlatMapGroupsInPandas" not in _plan(got) and "MapInArrow" in _plan(got)
    of = {}
    for c in got.orderBy("doc_id", "chunk_index").collect():
        of.setdefault(c["doc_id"], []).extend(map(int, c["blocks"].split(",")))
        assert c["tokens"] <= 90
    assert of == {d: [x["block_seq"] for x in rows if x["doc_id"] == d and x["text"].strip()] for d in of} and len(of) > 30


def test_adjacent_similarity_counts_each_token_once(spark, small_batches):
    from collections import Counter

    rows = _lines(spark)
    got = chunks.adjacent_similarity(block(spark, *rows))
    assert "lambda" not in _plan(got)  # before, every distinct token was counted by a pass over both blocks
    want = {}
    for x, y in zip(rows, rows[1:]):
        if x["doc_id"] == y["doc_id"]:
            a, b = Counter(x["text"].lower().split()), Counter(y["text"].lower().split())
            want[y["doc_id"], y["block_seq"]] = round(sum((a & b).values()) / sum((a | b).values()), 6) if a or b else 1.0
    assert {(r["doc_id"], r["block_seq"]): r["similarity"] for r in got.collect()} == pytest.approx(want, abs=1e-6)


def test_embeddings_and_splits_hold_a_few_rows_at_once(spark):
    """Arrow slices instead of a whole batch of Python lists; the values of the single functions."""
    texts = ["A b a", "", None, "one. two! three " * 700] + [f"w{i} x" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    e, parts = embed.hash_embeddings(df, 64), chunks.recursive_split(df, "doc_id")
    for made in (e, parts):
        assert "MapInArrow" in _plan(made) and "MapInPandas" not in _plan(made) and "ArrowEvalPython" not in _plan(made)
    assert {r["doc_id"]: r["embedding"] for r in e.collect()} == {i: embed.hash_vector(t or "", 64) for i, t in enumerate(texts)}
    assert sorted((r["doc_id"], r["part"], r["text"]) for r in parts.collect()) == [(i, k, p) for i, t in enumerate(texts) for k, p in enumerate(chunks.split_recursively(t or ""))]


def test_sha_embedding_exchanges_places_once(spark):
    """Rows of one key are added up; tokens aren't exchanged."""
    df = spark.createDataFrame([(1, "a B a"), (1, "b c"), (2, ""), (3, None), (None, "z")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "a b a b c"), (None, "Z")], "doc_id long, text string")
    got = embed.sha_embedding(df, "doc_id")
    rows = lambda d: sorted((r["doc_id"] or 0, r["dim"], r["value"]) for r in d.collect())
    assert rows(got) == rows(embed.sha_embedding(two, "doc_id")) and {r[0] for r in rows(got)} == {0, 1}
    assert embed.sha_embedding(df, "doc_id")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_cross_document_meets_copies_once(spark):
    """300 copies of a vector in 30 documents are one class (before, all their pairs met); results of comparing all."""
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    v = np.concatenate([base, base[:1].repeat(300, 0), base[5:15] + 0.05 * r.standard_normal((10, 16)), 3 * base[20:22], np.zeros((2, 16))])
    rows = [(i, i % 30, x.tolist()) for i, x in enumerate(v)] + [(len(v), 1, None)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = (u @ u.T).round(6)
    want = {}
    for i in range(len(v)):
        best = max(((s[i, j], -j) for j in range(len(v)) if j % 30 != i % 30 and s[i, j] >= 0.97), default=None)
        if best:
            want[i] = (-best[1], pytest.approx(best[0], abs=1e-6))
    made = []
    whole = embed.same_document_pairs
    embed.same_document_pairs = lambda x, t: made.append(x.count()) or whole(x, t)
    try:
        got = embed.cross_document(df).collect()
    finally:
        embed.same_document_pairs = whole
    assert {x["chunk_id"]: (x["other"], x["similarity"]) for x in got} == want and made[0] < 60


def test_sketches_grow_with_the_vectors():
    """Unrelated vectors meet in a sketch with a probability of 128 ** -codes: their pairs stay in proportion to the vectors."""
    for n in (10, 10_000, 1_000_000, 30_000_000):
        codes, sketches = embed.sketch_shape(n, 0.97)
        assert 128**codes >= n and sketches <= 100


def test_normalize_has_one_python_step(spark):
    """Spelled letters of uncertain OCR joined and compatibility forms replaced by one worker a task; protected text keeps its forms."""
    wide = "ﬁne w o r d １２"
    rows = [{"text": wide}, {"text": wide, "is_ocr": True, "confidence": 0.4}, {"text": wide, "block_type": "code_block", "is_ocr": True, "confidence": 0.4}]
    b = normalize.normalize(block(spark, *rows))
    assert _plan(b).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].count("ArrowEvalPython") == 1
    assert column(b, "text") == ["fine w o r d 12", "fine word 12", "ﬁne word １２"]
