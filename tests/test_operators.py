"""Edge cases that the SQL comparison does not reach."""

import http.server
import json
import math
import threading
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell import clients, errors, servers
from siftwell.functions import chunking as ch
from siftwell.functions import text as tx
from siftwell.functions import vectors as vx
from siftwell.operators import browse, observe, prompts, rag, ranking, rules, search, smart, store
from siftwell.sources import loaders
from siftwell.streaming import telemetry


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cosine_zero_and_other_dimension(spark):
    a = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.cosine(a, F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, vx.cosine(a, F.array(F.lit(1.0)))) is None


def test_blob_codec(spark):
    assert one(spark, vx.from_float64_bytes(vx.float64_bytes(F.array(F.lit(1.5), F.lit(-2.0))))) == [1.5, -2.0]


def test_chunk_text_edges(spark):
    c = lambda t, **k: one(spark, ch.chunk_text(F.lit(t).cast("string"), **k))
    assert c(None) == [] and c("") == [] and c(" a ") == [" a "]
    assert c("x" * 500) == ["x" * 500]
    assert [len(p) for p in c("x" * 501, size=500, overlap=50)] == [500, 51]
    assert [len(p) for p in c("x" * 950, size=500, overlap=50)] == [500, 500, 50]  # the tail window lies within the one before
    assert c("a\n\n\n\nb" + "c" * 500, size=10, overlap=0)[0] == "a"
    with pytest.raises(ValueError):
        c("x", size=10, overlap=10)


def test_sentences_with_pipe(spark):
    assert one(spark, tx.trim_all(F.lit("  x\t"))) == "x"
    assert one(spark, ch.sentences(F.lit("a|b. c"))) == ["a", "b.", "c"]
    assert one(spark, ch.chunk_sentences(F.lit("1. 2. 3. 4. 5. 6."), 5, 1)) == ["1. 2. 3. 4. 5.", "5. 6."]


def test_markdown_chunks():
    assert ch.markdown_chunks(None) == [None] and ch.markdown_chunks("short") == ["short"]
    text = "\n".join(["line of words"] * 40)
    parts = ch.markdown_chunks(text, 100, 100)
    assert len(parts) > 4 and all(len(p) <= 130 for p in parts)
    assert len(ch.markdown_chunks(text, 100, 10)[-1]) > 100  # a small overlap carries everything


def test_recency_and_sources(spark):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    assert one(spark, ranking.recency(F.lit("no date"), now)) == 0.5
    assert one(spark, ranking.recency(F.lit("2024-07-01"), now)) > 1
    assert math.isclose(one(spark, ranking.recency(F.lit("2010-01-01"), now)), 0.1)
    assert one(spark, ranking.source_quality(F.lit("Unofficial"))) == 1.0


def test_weights():
    assert ranking.normalize({"a": 0.995}) == {"a": 0.995}
    assert math.isclose(sum(ranking.normalize({"a": 0.6, "b": 0.6}).values()), 1)
    w = ranking.Weights()
    w.adjust("recency", 5)
    w.adjust("nothing", 1)
    assert math.isclose(sum(w.values.values()), 1)


def test_rules():
    e, context = rules.RuleEngine.with_defaults(), {"weights": dict(ranking.DEFAULT_WEIGHTS)}
    got = e.apply("latest error", context)
    assert got["appliedRules"] == ["boost-recent-for-news", "suggest-technical-filters"] and context["weights"]["recency"] == 0.4
    assert e.load(e.export([{"q": i} for i in range(30)])) == [{"q": i} for i in range(10, 30)]


def test_object_filter_is_strict(spark):
    rows = spark.createDataFrame([(1, '{"y": 2024}'), (2, '{"y": "2024"}'), (3, None), (4, '{"a": {"b": true}}'), (5, '{"y": null}')], "i long, j string").withColumn("meta", F.parse_json("j"))
    ids = lambda w: [r.i for r in search.apply_filter(rows, w).orderBy("i").collect()]
    assert ids({"y": 2024}) == [1] and ids({"y": "2024"}) == [2] and ids({"a.b": True}) == [4] and ids({"y": None}) == [5]


def test_store(spark):
    s = store.create_store(spark, "InMemory")
    rows = spark.createDataFrame([("a", "one", 0), ("b", "two", 1), ("a", "three", 2)], "id string, text string, batch_seq long").withColumn("meta", F.create_map(F.lit("k"), F.lit("v")))
    s.add(rows)
    assert [(r.id, r.text) for r in s.page().collect()] == [("a", "three"), ("b", "two")]
    s.update(spark.createDataFrame([("a", "four", {"l": "w"}), ("zz", "no", {})], "id string, text string, meta map<string,string>"))
    assert s.get("a").text == "four" and s.get("a").meta == {"k": "v", "l": "w"} and s.get("zz") is None
    q = spark.createDataFrame([(1, "four")], "query_id long, query string")
    assert s.search(q, 1).first().id == "a"
    s.delete(["a"])
    assert s.stats().first()["count"] == 1
    with pytest.raises(errors.VectorStoreError):
        s.add(spark.createDataFrame([("c", "", 0)], "id string, text string, batch_seq long"))
    with pytest.raises(errors.ConfigurationError):
        store.create_store(spark, "other")


def test_explain_and_retriever(spark):
    docs = spark.createDataFrame([(0, "Alpha beta"), (1, "gamma")], "seq long, text string")
    q = spark.createDataFrame([(7, "alpha zz?")], "query_id long, query string")
    e = search.Retriever(docs, k=5).get_relevant(q, explain=True).where("seq = 0").first().explanation
    assert e.queryTerms == ["alpha", "zz?"] and e.matchedTerms == ["alpha"] and e.matchRatio == 0.5


def test_prompt_fallback_and_variables(spark):
    ctx = spark.createDataFrame([("q$1", "c {who}")], "query string, context string")
    p = prompts.PromptManager("none", variables={"who": "$0"}).generate(ctx).first().prompt
    assert p.startswith("Context:\nc $0") and "q$1" in p


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.json").write_text('{"title": "T", "n": 1}')
    (tmp_path / "c.md").write_text("# H\n**b**")
    (tmp_path / "bad.docx").write_text("not a zip")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:t>Hello</w:t></w:p></w:document>')
    rows = {r.path.rpartition("/")[2]: r for r in loaders.load_directory(spark, str(tmp_path), text_field="title", strip=True).collect()}
    assert rows["a.txt"].text == "plain" and rows["b.json"].text == "T" and rows["c.md"].text == "H\nb" and rows["d.docx"].text == "Hello" and "bad.docx" not in rows


def test_stream_equals_batch(spark, tmp_path):
    e = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) AS ts, 'view' AS event_type, 1.0D AS value FROM range(200)")
    e.write.parquet(str(tmp_path / "in"))
    out = telemetry.windowed_counts(telemetry.read_events(spark, str(tmp_path / "in"), "ts timestamp, event_type string, value double"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("counts").collect()) == sorted(telemetry.windowed_counts(e).collect())


def test_errors_and_clients(spark):
    e = errors.RetrievalError.invalid_top_k(-1)
    assert errors.error_code(e) == "RETRIEVAL_ERROR" and errors.error_code(ValueError()) == "UNKNOWN_ERROR" and e.to_json()["metadata"] == {"k": -1}
    assert clients.fold_ndjson(['{"response": "a"}', "x", '{"message": {"content": "b"}}']) == "ab"
    assert clients.generate(spark.createDataFrame([("a\nb",)], "prompt string"), clients.Echo()).first().response == "b"


def test_store_in_a_folder_keeps_whole_versions(spark, tmp_path):
    path = str(tmp_path / "store")
    row = lambda *r: spark.createDataFrame(list(r), "id string, text string, batch_seq long, embedding array<double>").withColumn("meta", F.create_map(F.lit("k"), F.lit("v")))
    s = store.create_store(spark, "parquet", path=path)
    assert not (tmp_path / "store").exists()  # opening writes nothing
    s.add(row(("a", "one", 0, [1.0, 2.0]), ("b", "two", 1, None)))
    s.update(spark.createDataFrame([("b", "new", {"l": "w"})], "id string, text string, meta map<string,string>"))
    assert s.get("a").embedding == [1.0, 2.0] and len(s.get("b").embedding) == 128 and s.get("b").meta == {"k": "v", "l": "w"}
    s.update(spark.createDataFrame([("a", None, {"l": "x"})], "id string, text string, meta map<string,string>"))
    assert s.get("a").embedding == [1.0, 2.0] and s.get("a").text == "one"
    again = store.create_store(spark, "parquet", path=path)
    assert again.stats().first()["count"] == 2
    # A version that was not written whole does not count.
    (tmp_path / "store" / "v9").mkdir()
    (tmp_path / "store" / "v9" / "part-0.parquet").write_bytes(b"broken")
    assert store.create_store(spark, "parquet", path=path).get("b").text == "new"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file.txt").write_text("x")
    with pytest.raises(errors.VectorStoreError):
        store.create_store(spark, "parquet", path=str(tmp_path / "other"))
    assert (tmp_path / "other" / "file.txt").exists()
    again.close()
    with pytest.raises(errors.VectorStoreError):
        again.clear()


def test_store_adds_in_batches_with_progress(spark):
    seen = []
    s = store.DocumentStore(spark, batch=2, on_progress=lambda done, of: seen.append((done, of)))
    s.add(spark.createDataFrame([(None, f"t{i}", i) for i in range(5)], "id string, text string, batch_seq long"))
    assert seen == [(2, 5), (4, 5), (5, 5)] and s.stats().first()["count"] == 5
    assert s.docs.where("id LIKE 'doc_%'").select("id").distinct().count() == 5


def test_blocks_of_queries_give_what_one_matrix_gives(spark, monkeypatch):
    rng = __import__("random").Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(80)] + [(80, [1.0, 2.0]), (81, None)]
    docs = spark.createDataFrame(rows, "seq long, embedding array<double>")
    asked = docs.where("seq % 3 = 0 OR seq > 78").select(F.col("seq").alias("query_id"), "embedding")
    hits = lambda: sorted(map(tuple, search.top_k(asked, docs, 4).select("query_id", "rank", "seq", "score").collect()))
    whole = hits()
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    monkeypatch.setattr(search, "DOC_BLOCK", 7)
    assert hits() == whole and len(whole) > 100
    unit = lambda v: [x / (math.hypot(*v) or 1) for x in v]
    for q, v in rows[:80:3]:
        want = sorted(((-round(sum(a * b for a, b in zip(unit(v), unit(w), strict=True)), 12), i) for i, w in rows[:80]))[:4]
        assert [(s, -c) for i, r, s, c in whole if i == q] == [(i, c) for c, i in want]


def test_smart_retriever_learns(spark):
    docs = spark.createDataFrame([(i, t, "blog", "2024-05-30") for i, t in enumerate(["latest news here", "old words", "bug in the code", "code"])], "seq long, text string, source string, date string")
    s = smart.create_smart_retriever(search.Retriever(docs))
    q = spark.createDataFrame([(1, "latest"), (2, "code error"), (3, "plain words here")], "query_id long, query string")
    got = s.get_relevant(q, 2, as_of=F.lit("2024-06-01").cast("timestamp"), weights={"keywordMatch": 0.3})
    said = {r.query_id: r for r in got.decisions.collect()}
    assert said[1].applied_rules == ["boost-recent-for-news", "expand-short-query"] and said[2].applied_rules == ["suggest-technical-filters"] and said[3].applied_rules == []
    assert math.isclose(said[1].weights["recency"], 0.4 / 1.2) and math.isclose(said[3].weights["recency"], 0.15 / 1.1)
    assert got.results.groupBy("query_id").count().where("count = 2").count() == 3 and not said[1].results_modified
    short = spark.createDataFrame([(i, "short one", 0.1) for i in range(6)], "query_id long, query string, score double")
    s.provide_feedback(short)
    assert rules.LEARNED in s.rules and s.decide(q).where("query_id = 2").first().applied_rules[0] == rules.LEARNED
    rated = spark.createDataFrame([(i, "good code", 0.9) for i in range(12)], "query_id long, query string, score double")
    s.provide_feedback(rated, rated.select("query_id", F.lit(5).alias("rating")))
    assert s.patterns == ["good", "code"] and s.insights(spark)["rated"] == 12
    boosted = s.get_relevant(q, 2, as_of=F.lit("2024-06-01").cast("timestamp"))
    assert any(r.results_modified for r in boosted.decisions.collect())
    other = smart.SmartRetriever(search.Retriever(docs), enable_learning=False)
    other.import_knowledge(s.export_knowledge())
    other.provide_feedback(short)
    assert other.patterns == s.patterns and rules.LEARNED not in other.rules and len(other.history) == 18


def test_rag_entry_points(spark):
    docs = spark.createDataFrame([("a", "alpha beta", 0), ("b", "gamma", 1)], "id string, text string, batch_seq long")
    r = rag.init_rag(spark, docs, dim=32, k=1, base_dim=64)
    q = spark.createDataFrame([(1, "gamma")], "query_id long, query string")
    hits = r.retriever.get_relevant(q)
    assert [h.id for h in hits.collect()] == ["b"]
    got = rag.generate_with_rag(hits, clients.Echo(), "m", template=lambda q, c: F.concat(c, F.lit("\n"), q), system="Be exact.").first()
    assert got.prompt == "Be exact.\n\nDoc 1:\ngamma\ngamma" and got.response == "gamma" and got.prompt_length == len(got.prompt)
    assert rag.generate_legacy(r.retriever, q, clients.Echo(), "m", 1).first().response == "Assistant:"

    class Broken:  # here, so that it travels to the workers by value
        def generate(self, model, prompt):
            raise errors.GenerationError("no model")

    with pytest.raises(Exception, match="no model"):
        rag.generate_with_rag(hits, Broken(), "m").collect()


def test_metrics_and_telemetry(spark):
    m = observe.Metrics()

    @observe.measured("query", m)
    def find(q, k=3):
        return [{"score": 0.5}]

    @observe.measured("embedding", m)
    def embed(texts, dim):
        return [[0.0] * dim for _ in texts]

    @observe.measured("retrieval", m)
    def fail(q, k):
        raise errors.RetrievalError.invalid_top_k(k)

    find("x")
    embed(["a", "b"], 4)
    with pytest.raises(errors.RetrievalError):
        fail("q", -1)
    m.record_generation("m", 10, 20, 1000)
    s = m.summary(spark)
    assert s["query"]["total"] == 1 and s["query"]["avg_top_score"] == 0.5 and s["embedding"]["total_doc_count"] == 2 and s["generation"]["avg_tokens_per_second"] == 20 and s["error"]["total"] == 1
    assert m.raw()["error"][0]["code"] == "RETRIEVAL_ERROR" and "rag_documents_embedded 2" in m.export_prometheus(spark) and '"summary"' in m.export_json(spark)
    m.reset()
    assert m.summary(spark)["query"]["total"] == 0
    t = observe.Telemetry()
    t.track_query("secret words", "m", 3, 1.5)
    t.track_document_op(observe.EVENTS["DOCUMENT_ADD"], 2)
    t.track_error(ValueError("bad"), at="x")
    assert "secret" not in t.export() and t.summary()["totalEvents"] == 3 and len(t.by_type("rag.query")) == 1 and t.export("csv").startswith("timestamp,eventType,properties\n")
    assert t.frame(spark).count() == 3 and len(t.in_range(0, 2**60)) == 3
    assert all(observe.hash32(x) == one(spark, tx.hash32(F.lit(x))) for x in ("abc", "", "é😀" * 9))
    assert observe.hash32("abc") == 96354
    assert observe.base36(-37) == "-11" == one(spark, tx.base36(F.lit(-37)))
    with pytest.raises(errors.ConfigurationError):
        t.export("xml")
    t.clear()
    assert not t.events


def test_log_helpers(caplog):
    with caplog.at_level("INFO", logger="siftwell"):
        observe.child_logger("search", part="x").info("found")
        observe.log_performance("scan", 12.34, rows=3)
        observe.log_error(errors.RetrievalError.invalid_top_k(0))
    assert [r.getMessage() for r in caplog.records] == ['found {"part": "x"}', 'scan took 12.3 ms {"rows": 3}', 'RETRIEVAL_ERROR: Invalid k: 0 {"k": 0}']


class Handler(http.server.BaseHTTPRequestHandler):
    """A model server and a few pages."""

    def log_message(self, *args):
        pass

    def _send(self, body, status=200, kind="application/json"):
        raw = body.encode()
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        pages = {"/page": ("<p>Hi <b>you</b></p>", 200, "text/html; charset=utf-8"), "/raw": ("<p>", 200, "text/plain"), "/v1/models": ('{"data": [{"id": "m"}]}', 200, "application/json")}
        self._send(*pages.get(self.path, ("gone", 404, "text/plain")))

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if asked.get("model") == "none":
            return self._send("no such model", 404)
        texts = asked.get("input")
        vectors = [[float(len(x)), 1.0] for x in ([texts] if isinstance(texts, str) else texts or [])]
        answers = {
            "/api/generate": '{"response": "a"}\n{"response": "b"}\n', "/api/chat": '{"message": {"content": "c"}}', "/api/embed": json.dumps({"embeddings": vectors}),
            "/v1/embeddings": json.dumps({"data": [{"embedding": v} for v in vectors]}), "/v1/chat/completions": '{"choices": [{"message": {"content": "d"}}]}', "/v1/completions": '{"choices": [{"text": "e"}]}',
        }
        self._send(answers[self.path])


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_model_servers(spark, server):
    o, v, p = servers.Ollama(server), servers.OpenAIStyle(server), servers.Proxy(server)
    assert o.generate("m", "x") == "ab" and [*o.stream("m", "x")] == ["a", "b"] and o.chat("m", "x") == "c" and o.embed("m", ["abc", "d"]) == [[3.0, 1.0], [1.0, 1.0]]
    assert v.chat("m", "x") == "d" and v.generate("m", "x") == "e" and v.embed("m", "abcd") == [[4.0, 1.0]] and v.list_models() == ["m"]
    assert p.embed("m", "ab") == [[2.0, 1.0]] and p.generate("m", "x") == "ab"
    with pytest.raises(errors.EmbeddingError, match="not found"):
        o.embed("none", "x")
    with pytest.raises(errors.GenerationError):
        servers.Ollama("http://127.0.0.1:9").generate("m", "x")
    for shape in ([1, 2], [[1, 2]], {"embedding": [1, 2]}, {"data": [[1, 2]]}, [{"embedding": [1, 2]}], {"embeddings": [{"embedding": [1, 2]}]}):
        assert servers.vectors_of(shape) == [[1.0, 2.0]]
    with pytest.raises(errors.EmbeddingError):
        servers.vectors_of({})
    rows = spark.createDataFrame([(0, "abc"), (1, None), (2, "z")], "i long, text string")
    embed = clients.embedder(o.embed_texts("m"), 2, batch=1, concurrency=2)
    assert [r.e for r in rows.select("i", embed(F.col("text")).alias("e")).orderBy("i").collect()] == [[3.0, 1.0], None, [1.0, 1.0]]
    assert clients.generate(rows.select(F.col("text").alias("prompt")).where("prompt IS NOT NULL"), o).first().response == "ab"


def test_pages_by_http(spark, server):
    urls = spark.createDataFrame([(f"{server}{p}",) for p in ("/page", "/raw", "/none")] + [("http://127.0.0.1:9/x",)], "url string")
    got = {r.url.rpartition("/")[2]: r for r in loaders.load_urls(urls, keep_errors=True, timeout=5).collect()}
    assert got["page"].text == "Hi you" and got["raw"].text == "<p>" and got["page"].meta["contentType"].startswith("text/html")
    assert got["none"].error == "HTTP 404" and got["x"].error and loaders.load_urls(urls, timeout=5).count() == 2
    assert {r.status for r in loaders.fetch_pages(urls, timeout=5).collect()} == {200, 404, None}


def test_js_text():
    assert [loaders.js_text(v) for v in ("a", True, 1.0, 1.5, None, [1, None, "x"], {})] == ["a", "true", "1", "1.5", "null", "1,,x", "[object Object]"]


def test_markdown_chunks_keep_to_the_size():
    assert ch.markdown_chunks("abcd\nefghi\nxyz", 10, 100) == ["abcd", "abcd\n\nefghi", "efghi\n\nxyz"]
    fenced = "a\n```\n" + "\n".join(["code"] * 10) + "\n```\nend"
    parts = ch.markdown_chunks(fenced, 20, 50)
    assert parts[0] == "a\n```\n" + "\n".join(["code"] * 10) and parts[-1].endswith("end")  # no chunk ends while the fence is open


def test_slides_and_conversations(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for n, t in ((2, "second"), (10, "tenth"), (1, "first")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t} </a:t></a:r><a:r><a:t>slide</a:t></a:r></a:p></p:sld>')
    assert loaders.load(spark, str(tmp_path)).first().text == "first slide\n\nsecond slide\n\ntenth slide"
    one_more = browse.append_message(spark, spark.createDataFrame([(1, 0, "user", "hi")], browse.MESSAGE), 1, "assistant", "yes")
    assert browse.transcripts(one_more).first().transcript == "user: hi\nassistant: yes"
    assert browse.append_message(spark, one_more, 5, "user", "new").where("conv_id = 5").first().turn == 0
    lines = browse.export_conversations(one_more).unionByName(spark.createDataFrame([("no json",)], "value string"))
    assert sorted(map(tuple, browse.import_conversations(lines).collect())) == sorted(map(tuple, one_more.collect()))


def test_learning_from_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "good code", 5) for i in range(12)], "seq long, query string, feedback int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    learned = []
    derive = lambda history: learned.append([r.term for r in rules.mine_patterns(history).collect()])
    for _ in range(2):  # a second run finds nothing new and repeats nothing
        telemetry.learn_incrementally(stream, str(tmp_path / "history"), str(tmp_path / "ck"), derive).awaitTermination()
    assert learned == [["good", "code"]] and spark.read.parquet(str(tmp_path / "history")).count() == 12


def test_slides_windows_and_sessions(spark):
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * m))
    e = spark.range(1).select(F.explode(F.array(*(F.struct(at(m).alias("ts"), F.lit("v").alias("event_type"), F.lit(1.0).alias("value"), F.lit(u).alias("user_id")) for m, u in ((0, 1), (10, 1), (50, 1), (5, 2))))).alias("e")).select("e.*")
    got = telemetry.sessions(e).collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 2), (2, 1)]
    assert telemetry.windowed_counts(e, slide="30 minutes").agg(F.sum("n")).first()[0] == 8


def test_pdf(spark, tmp_path):
    shown = b"BT /F1 12 Tf 72 700 Td (Hello \\(big\\) world) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line)] TJ T* <48 69> Tj (\\351t\\351) ' ET"
    packed = zlib.compress(b"BT (page two) Tj ET")
    parts = [b"%%PDF-1.4\n1 0 obj\n<< /Length %d >>\nstream\n" % len(shown), shown, b"\nendstream\nendobj\n2 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed), packed, b"\nendstream\nendobj\n%%EOF"]
    (tmp_path / "a.pdf").write_bytes(b"".join(parts))
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    got = {r.path.rpartition("/")[2]: r for r in loaders.load_directory(spark, str(tmp_path), keep_errors=True).collect()}
    assert got["a.pdf"].text == "Hello (big) world\nSecond line\nHi\nété\n\npage two" and got["a.pdf"].format == "pdf"
    assert "DocumentLoadError" in got["bad.pdf"].error and "encrypted" in got["locked.pdf"].error
    assert loaders.load(spark, str(tmp_path), parsers={"pdf": lambda raw: "own"}).count() == 3
