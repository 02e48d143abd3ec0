"""Questions, prompts, events and reports."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.nlq import pipeline as P
from loomgraph.sources.graph import campus
from loomgraph.streaming import events as E

SF = "/root/testdata/sf0.001"
GOOD = "SELECT DISTINCT ?t WHERE { ?b a :Book ; :title ?t } ORDER BY ?t LIMIT 5"
BAD = "NOT VALID SPARQL !!!"


@pytest.fixture(scope="module")
def graph(spark):
    return campus(spark, SF)


def test_answer_shape(graph):
    a = P.ask(graph, "Which books?", P.Canned(f"```sparql\n{GOOD}\n```"))
    assert a.sparql == GOOD and a.retries == 0 and a.error is None
    rows = a.rows()
    assert rows["columns"] == ["t"] and len(rows["rows"]) == 5 and all(isinstance(r["t"], str) for r in rows["rows"])


def test_retry_uses_the_error(graph):
    translator = P.Canned(BAD, GOOD)
    a = P.ask(graph, "Which books?", translator)
    assert a.retries == 1 and a.error is None and BAD in translator.asked[1] and "expected" in translator.asked[1]
    assert a.output_tokens == len(BAD.split()) + len(GOOD.split())


def test_retries_end_without_running(graph):
    a = P.ask(graph, "Which books?", P.Canned(BAD))
    assert a.retries == 2 and a.error and a.table is None


def test_not_answerable_runs_nothing(graph):
    text = "# NOT_ANSWERABLE: question is out of scope"
    a = P.ask(graph, "Weather?", P.Canned(text))
    assert not a.answerable and a.table is None and a.error is None
    kinds = [k for k, _ in P.events(graph, "Weather?", "canned", "m", P.Canned(text))]
    assert kinds[-2:] == ["sparql_complete", "done"] and "results" not in kinds and "error" not in kinds
    assert not P.ask(graph, "?", P.Canned(BAD, text)).answerable


def test_event_order(graph):
    found = list(P.events(graph, "Which books?", "canned", "fixed-1", P.Canned(BAD, GOOD)))
    kinds = [k for k, _ in found]
    assert kinds[-3:] == ["sparql_complete", "results", "done"] and "sparql_retry" in kinds
    assert json.loads(found[-1][1])["retries"] == 1 and len(json.loads(found[-2][1])["rows"]) == 5
    assert [k for k, _ in P.events(graph, "?", "canned", "m", P.Canned(BAD))][-1] == "error"


def test_streams_tell_their_tokens(graph):
    made = list(P.Canned(GOOD).stream("a b", "c"))
    assert "".join(made[:-1]) == made[-1].text == GOOD and (made[-1].input_tokens, made[-1].output_tokens) == (3, len(GOOD.split()))

    class Silent(P.Canned):
        def stream(self, system, user, *, max_tokens=1024):
            yield from self.generate(system, user).text

    for translator in (P.Canned(GOOD), Silent(GOOD)):
        done = json.loads(list(P.events(graph, "Which books?", "canned", "m", translator))[-1][1])
        assert done["output_tokens"] == len(GOOD.split()) and done["input_tokens"] > 10


def test_unknown_provider():
    with pytest.raises(ValueError):
        P.provider("nope")


def test_templates(graph):
    made = P.Templates().generate("", "How many modules are there?").text
    assert P.ask(graph, "How many modules?", P.Templates()).rows()["rows"][0]["n"] == "1500" and "LIMIT" not in made
    assert "LIMIT 50" in P.Templates().generate("", "Which books?").text
    assert "LIMIT" not in P.Templates().generate("", "List all books").text


def test_cache(graph, spark, tmp_path):
    inner = P.Canned("first", "second")
    cached = P.Cached(inner, spark, str(tmp_path / "cache"), "canned", "m")
    assert cached.generate("s", "u").output_tokens == 1
    hit = cached.generate("s", "u")
    assert (hit.text, hit.input_tokens, hit.output_tokens) == ("first", 0, 0)
    assert cached.generate("s", "u", max_tokens=5).text == "second"
    assert P.Cached(inner, spark, str(tmp_path / "none"), "canned", "m", enabled=False).generate("s", "u").text == "second"
    assert not (tmp_path / "none").exists()


def test_text_steps(spark):
    assert T.fill("Hello {name}, WHERE { ?s ?p ?o } {unknown_slot}", name="{question}", question="x") == "Hello {question}, WHERE { ?s ?p ?o } {unknown_slot}"
    assert T.system_section("---\na: b\n---\n# System\nDo {x}.\n\n# User\nno") == "Do {x}."
    with pytest.raises(ValueError):
        T.system_section("# User\n")
    cases = ["```sparql\nSELECT 1\n```", "```\nASK {}\n```", "  SELECT 2 \n", "```SPARQL\na\n```\nb\n```", "x ```sparql\nno\n```", ""]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(T.clean(df.t)).collect()] == [T.clean_text(c) for c in cases]


def test_batch(spark, graph):
    rows = [(1, "How many books?", "templates", "rules-1"), (2, "  ", "templates", "rules-1"), (3, "Weather?", "templates", "rules-1"), (4, "Books?", "nobody", "m"), (5, "Books?", "templates", "rules-9")]
    asked = spark.createDataFrame(rows, "request_id bigint, question string, provider string, model string")
    found = {r.request_id: r for r in P.translate_batch(asked, graph).collect()}
    assert set(found) == {1, 3, 4, 5} and found[1].answerable and not found[3].answerable
    assert "nobody" in found[4].error and found[4].sparql is None and "rules-9" in found[5].error and found[5].input_tokens == 0


def test_batch_reads_what_single_questions_cached(spark, graph, tmp_path):
    path = str(tmp_path / "cache")
    P.ask(graph, "How many books?", P.Cached(P.Canned(GOOD), spark, path, "templates", "rules-1"), run=False)
    asked = spark.createDataFrame([(1, "How many books?", "templates", "rules-1"), (2, "How many modules?", "templates", "rules-1")], "request_id bigint, question string, provider string, model string")
    found = {r.request_id: r for r in P.translate_batch(asked, graph, cache=spark.read.parquet(path)).collect()}
    assert (found[1].sparql, found[1].input_tokens) == (GOOD, 0) and found[2].input_tokens > 0


ASKED = "request_id bigint, question string, provider string, model string"


def test_batch_runs_each_query_once_and_attaches_rows(spark, graph, monkeypatch):
    """Three requests for one query in two spellings: one run; rows in order, a cut result says so."""
    from loomgraph.nlq import batch as B

    monkeypatch.setitem(P.PROVIDERS, "twice", (lambda: P.Canned("SELECT  ?n WHERE { ?u a :University; :name ?n } ORDER BY DESC(?n)", "# NOT_ANSWERABLE: no"), ("m",)))
    rows = [(1, "a", "twice", "m"), (2, "How many books?", "templates", "rules-1"), (3, "How many books are there?", "templates", "rules-1"), (4, "Weather?", "templates", "rules-1"), (5, "x", "nobody", "m"), (6, "All modules", "templates", "rules-1")]
    compiled, plain = [], B.query
    monkeypatch.setattr(B, "query", lambda g, text, **more: compiled.append(text) or plain(g, text, **more))
    asked = spark.createDataFrame(rows, ASKED).coalesce(1)
    found = {r.request_id: r for r in B.answer_batch(asked, graph, most_rows=4).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6} and len(compiled) == 3
    assert found[2].rows == found[3].rows == [{"n": "200"}] and found[2].columns == ["n"] and found[2].complete
    names = [r["n"] for r in found[1].rows]
    assert len(names) == 4 and names == sorted(names, reverse=True) and not found[1].complete
    assert found[4].rows == [] and found[4].error is None and "nobody" in found[5].error and len(found[6].rows) == 4


def test_batch_tells_failures_apart(spark, graph):
    from loomgraph.nlq import batch as B

    queries = spark.createDataFrame([("a", "SELECT ?n WHERE { ?u :name ?n } LIMIT 2"), ("b", "SELECT ?x WHERE { GRAPH <http://none> { ?x ?p ?y } }"), ("c", "SELECT (COUNT(*) AS ?n) WHERE { ?x a :Book }")], "algebra string, sparql string")
    found = {r.algebra: r for r in B.run_queries(graph, queries).collect()}
    assert len(found["a"].rows) == 2 and found["c"].rows == [{"n": "200"}] and "unknown graph" in found["b"].failed and found["b"].rows == []


def test_batch_names_unknown_terms_and_spelling_is_one_algebra(spark, graph):
    from loomgraph.nlq import batch as B

    texts = ["SELECT ?x WHERE { ?x a :Book }", "PREFIX c: <" + graph.catalog.namespace + "> SELECT ?x { ?x a c:Book . }", "SELECT ?x WHERE { ?x :nothing ?y ; a :Nobody }"]
    made = B.by_algebra(graph, spark.createDataFrame(list(enumerate(texts)), "request_id bigint, sparql string"))
    keys = {r.request_id: r.algebra for r in made.collect()}
    assert keys[0] == keys[1] != keys[2]
    unknown = {r.algebra: r.unknown for r in B.unknown_terms(graph, made.filter("request_id <> 1")).collect()}
    assert unknown[keys[0]] == [] and [x.rpartition("#")[2] for x in unknown[keys[2]]] == ["nothing", "Nobody"]
    assert [x.rpartition("#")[2] for x in P.ask(graph, "?", P.Canned(texts[2])).unknown] == ["nothing", "Nobody"]


def test_batch_writes_the_cache_once(spark, graph, tmp_path):
    from loomgraph.nlq import batch as B
    from loomgraph.nlq.cache import CacheTable

    table = CacheTable(spark, str(tmp_path / "cache"))
    asked = spark.range(300).select(F.col("id").alias("request_id"), F.concat(F.lit("How many books, "), F.col("id").cast("string")).alias("question"), F.lit("templates").alias("provider"), F.lit("rules-1").alias("model"))
    assert {r.input_tokens > 0 for r in B.answer_batch(asked, graph, cache=table).collect()} == {True}
    assert len(table.writes()) == 1 and table.table().count() == 300
    assert {r.input_tokens for r in B.answer_batch(asked, graph, cache=table).collect()} == {0}
    table.append(asked.select(B.first_key(graph).alias("key"), F.lit("ZZZ").alias("value")))
    assert table.compact() == 2 and len(table.writes()) == 1 and table.table().count() == 300 and table.table().filter("value = 'ZZZ'").isEmpty()
    key = asked.limit(1).select(B.first_key(graph)).first()[0]
    assert table.lookup(key).startswith("SELECT") and table.lookup("none") is None
    plan = table._rows().filter(F.col("bucket") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_results_that_are_cut_say_so(graph):
    text = "SELECT ?n WHERE { ?u a :University ; :name ?n }"
    for most, complete in ((10, False), (25, True), (1000, True)):
        data = json.loads(dict(P.events(graph, "?", "canned", "m", P.Canned(text), most_rows=most))["results"])
        assert data.get("complete", True) == complete and len(data["rows"]) == min(most, 25)
    assert P.ask(graph, "?", P.Canned(text)).rows(3)["complete"] is False


def test_questions_have_a_time_limit(spark, graph, monkeypatch):
    monkeypatch.setattr(P, "query", lambda *_, **__: spark.range(1 << 40).select(F.max(F.xxhash64("id")).alias("n")))
    with pytest.raises(TimeoutError):
        P.ask(graph, "?", P.Canned(GOOD), seconds=1).rows()
    found = list(P.events(graph, "?", "canned", "m", P.Canned(GOOD), seconds=1))
    assert found[-1][0] == "error" and "within 1 seconds" in found[-1][1]


@pytest.mark.parametrize("bad", ["SELECT ?t WHERE { ?b :title ?t FILTER(nosuch(?t)) }", "SELECT ?t WHERE { ?b :title ?t FILTER(STRLEN(?t, 2)) }", "SELECT ?t WHERE { ?b :title ?t BIND(1 AS ?t) }", "SELECT ?t WHERE { ?b :title ?t FILTER(COUNT(?t) > 1) }"])
def test_meaningless_queries_cost_a_retry(graph, bad):
    assert P.ask(graph, "Which books?", P.Canned(bad, GOOD), run=False).retries == 1


def test_time_limit(spark):
    from pyspark.sql import functions as F

    assert P.with_timeout(spark, 60, spark.range(4).count) == 4
    endless = spark.range(1 << 40).select(F.max(F.xxhash64("id")))
    with pytest.raises(TimeoutError):
        P.with_timeout(spark, 1, endless.collect)
    assert spark.range(3).count() == 3


def test_prompts(spark, tmp_path):
    from loomgraph.nlq import prompts

    texts = {"nl-v1.md": "---\nname: x\n# System\n---\n# System\nDo {x}.\n\n## Part\nmore\n\n# User\nno", "nl-v2.md": "# System\nlast", "bad-v1.md": "# User\nno", "notes.md": "# System\nno version"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    table = prompts.read_prompts(spark, str(tmp_path))
    assert sorted((r.name, r.version) for r in table.collect()) == [("bad", 1), ("nl", 1), ("nl", 2)]
    assert prompts.load(table, "nl", 1) == T.system_section(texts["nl-v1.md"]) == "Do {x}.\n\n## Part\nmore" and prompts.load(table, "nl", 2) == "last"
    with pytest.raises(FileNotFoundError):
        prompts.load(table, "nl", 3)
    with pytest.raises(ValueError):
        prompts.load(table, "bad", 1)


def test_aborting_is_no_error(spark):
    rows = [("a", 1, "SUBMIT", None), ("a", 2, "TOKEN", "x"), ("a", 3, "ABORT", "cancelled")]
    assert [tuple(r) for r in E.fold(spark.createDataFrame(rows, "k string, seq int, event string, data string"), "k", ["seq"]).collect()] == [("a", "streaming", "x", None, None, None)]


def test_events_round_trip_and_multiline(spark):
    events = spark.createDataFrame([(1, 0, "token", "a\n b "), (1, 1, "done", "{}")], "request_id bigint, seq int, event string, data string")
    assert sorted(map(tuple, E.parse_events(E.format_events(events)).collect())) == [(1, 0, "token", "a\n b "), (1, 1, "done", "{}")]
    raw = spark.createDataFrame([(2, "event: x\n\ndata: y\n\nevent: z\ndata: w\n\n")], "request_id bigint, raw string")
    assert [tuple(r)[2:] for r in E.parse_events(raw).collect()] == [("z", "w")]


PLAY = [("a", 1, "TOKEN", "lost"), ("a", 2, "SUBMIT", None), ("a", 3, "TOKEN", "x"), ("a", 4, "TOKEN", "y"), ("a", 5, "DONE", "d"), ("a", 6, "TOKEN", "late"), ("b", 1, "SUBMIT", None), ("b", 2, "ERROR", "e"), ("b", 3, "SUBMIT", None), ("b", 4, "COMPLETE", "q"), ("c", 1, "ERROR", "m"), ("c", 2, "DISMISS", None)]
STATES = [("a", "done", "xy", None, "d", None), ("b", "streaming", "q", None, None, None), ("c", "idle", None, None, None, None)]


def test_fold(spark):
    df = spark.createDataFrame(PLAY, "k string, seq int, event string, data string")
    assert sorted(map(tuple, E.fold(df, "k", ["seq"]).collect())) == STATES


def test_fold_of_a_stream_is_the_same(spark, tmp_path):
    schema = "k string, seq int, event string, data string"
    spark.createDataFrame(PLAY, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "string", "seq")
    q = stream.writeStream.format("memory").queryName("folded").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("folded").collect())) == STATES


def test_a_streamed_fold_is_called_per_bucket_of_keys(spark, tmp_path):
    """Two starts on one checkpoint, few buckets, a key that is null and one beyond what a double holds."""
    schema, big = "k long, seq int, event string, data string", 2**53 + 1
    keys = [None, big, big - 1, *range(20)]
    told = {}
    for n, event in enumerate(("SUBMIT", "TOKEN")):
        spark.createDataFrame([(k, n, event, "x") for k in keys[n:]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = E.fold_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "bigint", "seq", buckets=3)
        q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: told.update({r[0]: tuple(r)[1:] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert told == {k: ("streaming", "" if k is None else "x", None, None, None) for k in keys}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_late_events_are_folded_in_order_and_idle_keys_go(spark, tmp_path):
    """Events shuffled over micro-batches, each a start of its own, end in the state of the batch fold."""
    import datetime
    import random

    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, begin, schema = random.Random(1), datetime.datetime(2024, 1, 1), "k string, ts timestamp, n int, event string, data string"
    kinds = ["SUBMIT", "TOKEN", "TOKEN", "COMPLETE", "RESULTS", "DONE", "ERROR", "DISMISS"]
    rows = [(f"k{rng.randint(0, 3)}", begin + datetime.timedelta(seconds=i // 2), i, rng.choice(kinds), f"d{i}") for i in range(80)]
    late = sorted(rows, key=lambda r: r[1].timestamp() + 15 * rng.random())
    ticks = [[("tick", begin + datetime.timedelta(hours=h), h, "TOKEN", "x")] for h in (1, 5, 9)]
    try:
        for batch in [late[:40], late[40:], *ticks]:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            folded = E.fold_ordered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "string", "ts", "n", delay="30 seconds", idle=3600)
            q = folded.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
        kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        spark.conf.unset(store)
    told = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        told.setdefault(r.key, []).append(tuple(r)[1:])
    wanted = {r[0]: tuple(r)[1:] for r in E.fold(spark.createDataFrame(rows, schema), "k", ["ts", "n"]).collect()}
    assert all(state in told[k] for k, state in wanted.items()) and kept <= 3


def test_files_of_events_are_read_once_wherever_they_are_cut(spark, tmp_path):
    from loomgraph.streaming import sse

    sse.register(spark)
    raw = "event: a\ndata: 1\n\nevent: b\r\ndata: x\r\ndata:  y\r\n\r\nno event\n\nevent: c\ndata: é\n\nevent: done\ndata: {}\n\n".encode()
    (tmp_path / "in").mkdir()
    read = lambda: spark.readStream.format("sse_files").option("path", str(tmp_path / "in")).load()
    for cut in (3, 17, 18, 47, 66, len(raw)):
        (tmp_path / "in" / "r1.sse").write_bytes(raw[:cut])
        if cut == 18:
            (tmp_path / "in" / "r2.000.sse").write_bytes(raw)
        q = read().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    wanted = [("a", "1"), ("b", "x\n y"), ("c", "é"), ("done", "{}")]
    assert [(r[2], r[3]) for r in found if r[0] == "r1"] == [(r[2], r[3]) for r in found if r[0] == "r2"] == wanted and len(found) == 8
    events = read().selectExpr("request_id", "at AS seq", "event", "data")
    for _ in range(2):
        q = events.writeStream.format("sse_files").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        q.awaitTermination()
    back = {f.name.split(".")[0]: f.read_bytes() for f in (tmp_path / "sink").glob("*.sse")}
    assert set(back) == {"r1", "r2"} and [sse.parse_block(b) for b in back["r1"].split(b"\n\n")[:-1]] == wanted
    reader = sse.Reader({"path": str(tmp_path / "in"), "archive": "true"})
    reader.commit(reader.latestOffset())
    assert not list((tmp_path / "in").glob("*.sse")) and len(list((tmp_path / "in" / "_read").glob("*.sse"))) == 2


def test_every_cut_of_a_stream_gives_every_block_once(tmp_path):
    from pyarrow import fs

    from loomgraph.streaming import sse

    raw = b"".join(b"event: e%d\ndata: %s\n\n" % (i, b"x" * (i % 7)) for i in range(30))
    (tmp_path / "f").write_bytes(raw)
    whole = [b for _, b in sse.blocks(fs.LocalFileSystem(), str(tmp_path / "f"), 0, len(raw))]
    for back in (4, 1 << 14):
        sse.BACK = back
        for step in (1, 5, 13, 100):
            cuts = [*range(0, len(raw), step), len(raw)]
            assert [b for a, z in zip(cuts, cuts[1:], strict=False) for _, b in sse.blocks(fs.LocalFileSystem(), str(tmp_path / "f"), a, z)] == whole


def test_report(graph, spark, tmp_path):
    from loomgraph.nlq.report import write_report

    write_report(graph, str(tmp_path / "report"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0] == "# Summary of the graph" and any("#Module` | 1,500 | " in x and x.count(", ") == 2 for x in lines) and any("#Book` | 200 | " in x for x in lines) and "## Namespaces" in lines and lines[-1] == "```"
