"""Operators on small fixtures."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quarrymill import sources, streaming
from quarrymill.functions import extraction, fulltext, kinds, ontology, text
from quarrymill.operators import chunking, citations, graph, recall, search, store
from quarrymill.plans import service


def test_sections_split_at_headings(spark):
    docs = spark.createDataFrame([(1, "intro\r\n# One\na\n## Two\nb"), (2, ""), (3, "# Only"), (4, None), (5, " \n\n# A\nx")], "doc_id long, text string")
    got = sorted((r.doc_id, r["rank"], r.heading, r.content) for r in chunking.chunk_markdown(docs).collect())
    assert got == [(1, 0, "Introduction", "intro"), (1, 1, "One", "# One\na"), (1, 2, "Two", "## Two\nb"), (3, 0, "Only", "# Only"), (5, 0, "A", "# A\nx")]


def test_token_windows_overlap_and_are_held_to_limits(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{chr(97 + k % 26)}" for k in range(180)))], "doc_id long, text string")
    got = chunking.chunk_markdown(docs, max_tokens=80, overlap=20).orderBy("rank").collect()
    assert [r.n_tokens for r in got] == [80, 80, 60] and got[1].content.split()[:20] == got[0].content.split()[60:]
    assert [r.n_tokens for r in chunking.chunk_markdown(docs, max_tokens=1, overlap=-5).orderBy("rank").collect()] == [64, 64, 52]


def test_large_sections_are_packed_from_paragraphs_sentences_and_pieces(spark):
    words = lambda n: " ".join(["word"] * n)
    whole = f"{words(30)}\n\n{words(30)}\n\n{words(10)}\n\n{words(40)}; {words(40)}; {words(200)}"
    got = [(r.n_tokens, r.content) for r in chunking.chunk_markdown(spark.createDataFrame([(1, whole)], "doc_id long, text string"), "heading_strict", 64).orderBy("rank").collect()]
    assert [n for n, _ in got] == [60, 10, 41, 41, 64, 64, 64, 8]
    assert " ".join(x for _, x in got).split() == whole.split()
    assert [len(x) for _, x in chunking.chunk("x" * 300, "heading_strict", 64, None, list)] == [64, 64, 64, 64, 44]
    assert chunking.packed(["a", "bbb", "c"], "-", 2, len, lambda x: list(x)) == ["a", "b", "b", "b", "c"]


def test_windows_cover_all_words(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25))))], "doc_id long, text string")
    got = chunking.word_windows(docs, 10, 4).orderBy("rank").collect()
    assert [r.content.split()[0] for r in got] == ["0", "6", "12", "18"] and got[-1].content.split()[-1] == "24"


def test_edge_upsert_keeps_confirmed_and_rises(spark):
    old = spark.createDataFrame([(1, "A", 2, 0.9, 0.5, "CONFIRMED"), (1, "B", 2, 0.3, 0.3, "REJECTED")], "subject int, relation string, object int, confidence double, quality double, status string")
    new = spark.createDataFrame([(1, "A", 2, 0.4, 1.7), (1, "B", 2, 0.6, 0.1), (3, "C", 4, 0.2, 0.2)], "subject int, relation string, object int, confidence double, quality double")
    got = {(r.subject, r.relation): (r.confidence, r.quality, r.status) for r in store.upsert_edges(old, new).collect()}
    assert got == {(1, "A"): (0.9, 1.0, "CONFIRMED"), (1, "B"): (0.6, 0.3, "AUTO"), (3, "C"): (0.2, 0.2, "AUTO")}


def test_paths_never_repeat_a_node(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1.0, 1.0, 0.08), (2, "b", "a", 1.0, 1.0, 0.08), (3, "b", "c", 1.0, 1.0, 0.08)], "edge_id int, subject string, object string, confidence double, quality double, strength double")
    seeds = spark.createDataFrame([("a",)], "node string")
    got = sorted([s.edge_id for s in r.steps] for r in graph.paths(edges, seeds, 3).collect())
    assert got == [[1], [1, 3], [2]]


def test_titles(spark):
    rows = spark.createDataFrame([("Could you explain **vector** search?",), ("",)], "t string").select(text.conversation_title(F.col("t")).alias("t")).collect()
    assert [r.t for r in rows] == ["vector search", "New conversation"]


def test_web_search_words_phrases_or_and_not(spark):
    rows = spark.createDataFrame([(1, "Red wide bolt"), (2, "red bolt, wide"), (3, "blue BOLT"), (4, None)], "i int, t string")
    found = lambda q: sorted(r.i for r in rows.filter(fulltext.matches(F.col("t"), q)).collect())
    assert found("red bolt") == [1, 2] and found('"red bolt"') == [2] and found("red or blue") == [1, 2, 3]
    assert found("bolt -red") == [3] and found("") == [] and found("or") == []


def test_full_page_admits_one_extra_and_extras_stand_reversed(spark):
    page = spark.createDataFrame([("a", 1), ("b", 2)], "id string, ord int")
    extra = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3), ("c", 4)], "id string, ord int")
    order = lambda most: [r.id for r in search.front_merge(page, extra, most, "id").orderBy("position").collect()]
    assert order(2) == ["c", "a", "b"] and order(9) == ["d", "c", "a", "b"]


def test_expansion_stops_at_target_or_when_nothing_is_new(spark):
    b = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2), (9, 9)], "event_id int, entity_id int")
    seeds = b.filter("event_id = 1").select("event_id")
    reach = lambda target: sorted(r[0] for r in graph.expand_until(seeds, b, "event_id", "entity_id", target, 5).collect())
    assert reach(0) == [] and reach(1) == [2] and reach(5) == [2, 3]


def test_relation_intents_and_merged_metadata(spark):
    rows = spark.createDataFrame([("需要什么证书",), ("hello",)], "q string").select(kinds.relation_intents(F.col("q")).alias("r")).collect()
    assert [r.r for r in rows] == [["REQUIRES", "HOLDS"], []]
    one = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3"}), (None, None)], "o map<string,string>, n map<string,string>")
    assert [r.m for r in one.select(store.merge_metadata(F.col("o"), F.col("n")).alias("m")).collect()] == [{"a": "1", "b": "3"}, {}]


def test_many_queries_are_one_scan(spark):
    r = random.Random(4)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.multi_topk(df, df.withColumnRenamed("vec_id", "q"), 3, "vec_id", "q", block=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and len(plan) < 5000
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(q, i, n) for q, a in rows for n, (i, _) in enumerate(sorted(rows, key=lambda x: -cosine(a, x[1]))[:3], 1)}
    assert {(x.q, x.vec_id, x["rank"]) for x in got.collect()} == want


def test_cover_rank_counts_shortest_stretches(spark):
    docs = spark.createDataFrame([(1, "a x b a b"), (2, "a a"), (3, "b x y a"), (4, None)], "i int, t string")
    got = {r.i: round(r["rank"], 6) for r in recall.cover_rank(docs, "i", "t", ["a", "b"]).collect()}
    assert got == {1: round(0.1 / 2 + 0.1 + 0.1, 6), 3: round(0.1 / 3, 6)}
    assert {r.i: round(r["rank"], 6) for r in recall.cover_rank(docs, "i", "t", ["a"]).collect()} == {1: 0.2, 2: 0.2, 3: 0.1}


def test_paths_go_on_from_either_end(spark):
    rows = [(1, "a", "b", "USES", True), (2, "c", "b", "USES", True), (3, "b", "d", "RELATED_TO", True), (4, "b", "e", "USES", False), (5, "x", "a", "RELATED_TO", False)]
    edges = spark.createDataFrame([(*r, 1.0, 1.0, 0.0) for r in rows], "edge_id int, subject string, object string, kind string, reasoning boolean, confidence double, quality double, strength double")
    got = {r.path for r in recall.paths_both_ways(edges, spark.createDataFrame([("a",)], "node string"), 3, 50).collect()}
    assert got == {"1", "1>2", "5", "5>1", "5>1>2"}


def test_relation_names_and_gate(spark):
    names = {" uses ": "USES", "A is a B": "IS_A", "满足要求": "REQUIRES", "nothing": "RELATED_TO", "part_of": "PART_OF", "belongs to x": "PART_OF", None: "RELATED_TO"}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ontology.relation_type(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == names
    rows = [("USES", 0.7, "e", None), ("USES", 0.7, "", None), ("USES", 0.7, "e", 0.8), ("RELATED_TO", 0.81, "e", 0.1), ("CAUSES", 0.9, "e", None), ("NOPE", 0.9, "e", None), ("USES", None, "e", None)]
    df = spark.createDataFrame(rows, "k string, c double, e string, m double")
    off = F.array(F.lit("CAUSES"))
    assert [r[0] for r in df.select(ontology.passes(F.col("k"), F.col("c"), F.col("e"), F.col("m"), off)).collect()] == [True] + [False] * 6


def test_search_dispatch_and_fallback(spark, tmp_path):
    with pytest.raises(ValueError):
        service.run_search(spark, "/root/testdata/sf0.001", "guess")
    a, b = spark.createDataFrame([], "i int"), spark.createDataFrame([(1,), (2,)], "i int")
    assert [r.i for r in recall.or_else(a, b).collect()] == [1, 2] and [r.i for r in recall.or_else(b.filter("i = 2"), b).collect()] == [2]


def test_files_and_connector_rows(spark, tmp_path):
    for name, body in (("a.md", "# A"), ("b.txt", "text"), ("c.pdf", "x"), ("empty.md", " ")):
        (tmp_path / name).write_text(body)
    got = {(r.title, r.content) for r in sources.text_files(spark, str(tmp_path)).collect()}
    assert got == {("a", "# A"), ("b", "text")}
    rows = spark.createDataFrame([("1", "u1", "T", 5), ("2", "", "x", 6), ("", "u", "x", 7), ("3", "u3", " ", 8)], "id string, url string, name string, _score int")
    page = sources.connector_rows(rows, "id", "url", "name", limit=500)
    assert page.columns == ["id", "url", "name", "title"] and [(r.id, r.title) for r in page.collect()] == [("1", "T"), ("3", "3")]
    assert [r.value for r in sources.as_json(page.select("id")).collect()] == ['{"id":"1"}', '{"id":"3"}']


def test_streams_of_activity_and_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 02:00:00", "a", 2.0), (2, "2024-01-01 02:00:00", "a", 2.0), (3, "2024-01-09 00:00:00", "b", 4.0)], "event_id long, t string, event_type string, value double")
    rows = rows.select("event_id", F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{tmp_path}/in")
    stream = streaming.without_repeats(streaming.read_events(spark, f"{tmp_path}/in", rows.schema), "event_id", "ts")
    q = stream.writeStream.format("memory").queryName("unique_logs").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.event_id for r in spark.table("unique_logs").collect()) == [1, 2, 3]
    q = streaming.activity(streaming.read_events(spark, f"{tmp_path}/in", rows.schema)).writeStream.format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(str(r.start), r.event_type, r.n, r.value) for r in spark.table("daily").collect()] == [("2024-01-01 00:00:00", "a", 3, 5.0)]


def test_names_are_cleaned_and_rated(spark):
    names = ["“Acme Group”", "下载文件", "Excel", "12.5", "一个很长的名字", "report.pdf", "评审系统", "Acme Group", "AI", "", "A1", "材料"]
    df = spark.createDataFrame([(1, names), (2, []), (3, None)], "id long, names array<string>")
    got = {r.id: r.e for r in df.select("id", extraction.clean_entities(F.col("names"), F.lit(True)).alias("e")).collect()}
    assert [(e.name, e.kind, e.score) for e in got[1]] == [("评审系统", "product", 24), ("Acme Group", "organization", 12), ("文件下载", "subject", 10)] and got[2] == [] and got[3] is None
    kept = df.filter("id = 1").select(extraction.clean_entities(F.col("names"), F.lit(True), F.array(F.lit("材料"))).alias("e")).first().e
    assert (kept[0].name, kept[0].score) == ("材料", 112)


def test_mentions_come_from_capitals_quotes_and_endings(spark):
    df = spark.createDataFrame([('The Red Widget met "old bolt" in 腾云平台 and The Red Widget',), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(extraction.mentions(F.col("t"))).collect()] == [["The Red Widget", "old bolt", "腾云平台"], [], None]


def test_texts_are_cut_at_sentences(spark):
    long, han = "a" * 200 + ". " + "b" * 100 + "! " + "c" * 90 + ".", "一" * 100 + "。" + "二" * 70 + "。" + "三" * 20 + "。"
    df = spark.createDataFrame([(" Hi there. More? ",), (long,), (han,), ("x" * 400,), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(extraction.first_sentence(F.col("t")), extraction.concise(F.col("t"), kinds.mostly_han(F.col("t")))).collect()]
    assert got == [
        ("Hi there.", "Hi there. More?"), ("a" * 120, "a" * 200 + ". " + "b" * 100 + "!"), (han[:120], han[:172]), ("x" * 120, "x" * 359 + "…"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([("four plain latin words",), ("一二三四五六七八",), ("",)], "t string")
    assert [tuple(r) for r in df.select(extraction.drifts(F.col("t"), F.lit(True)), extraction.drifts(F.col("t"), F.lit(False))).collect()] == [(True, False), (False, True), (False, False)]


def test_citations_take_whole_sections_of_searches_that_succeeded(spark):
    section = lambda k, content="x": {"chunkId": k, "sourceId": "s", "content": content}
    call = lambda n, *sections, tool="search", status="SUCCEEDED": (1, n, tool, status, f"q{n}", json.dumps({"sections": list(sections)}))
    rows = [
        call(1, section("a"), section("b", " ")), call(2, section("z"), status="FAILED"), call(3, section("y"), tool="other"), (1, 4, "search", "SUCCEEDED", "q", "no json"),
        (1, 5, "search", "SUCCEEDED", "q", None), call(6, section("b", " kept "), section("a"), section("c")), call(7, *(section(k) for k in "defg")),
    ]
    df = spark.createDataFrame(rows, "session long, n long, tool string, status string, query string, result string")
    got = citations.citations(df, "session", "n").orderBy("index").collect()
    assert [(r["index"], r.chunk_id, r.content, r.query) for r in got] == [(1, "a", "x", "q1"), (2, "b", "kept", "q6"), (3, "c", "x", "q6"), (4, "d", "x", "q7"), (5, "e", "x", "q7")]
    assert not citations.citations(df.limit(0), "session", "n").collect()


def test_long_sentences_are_cut_in_linear_time(spark):
    import time

    text = "word " * 400_000
    began = time.time()
    got = chunking.chunk(text, "heading_strict", 128, None, chunking.pieces)
    assert time.time() - began < 10 and len(got) == 3125 and all(len(chunking.pieces(x)) == 128 for _, x in got)
    assert "".join(x.replace(" ", "") for _, x in got) == "word" * 400_000


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.json"), reason="no vocabulary")
def test_chunks_by_a_vocabulary(spark):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/byte_bpe_50k.json"
    known, split = Tokenizer.from_file(path), chunking.bpe(path)
    for t in ("", "a", "日本語の文。 é ñ", "The quick brown fox.\n\nIt ran 12345 miles"):
        assert "".join(split(t)) == t and len(split(t)) == len(known.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(1, "# A\n" + "Ein längerer Satz ohne Ende " * 90), (2, None), (3, " ")], "doc_id long, text string")
    got = chunking.chunk_markdown(docs, "heading_strict", 64, tokenize=split).collect()
    assert len(got) > 5 and {r.doc_id for r in got} == {1} and all(r.n_tokens == len(known.encode(r.content, add_special_tokens=False).ids) <= 64 for r in got)


def test_alignment_joins_names_not_edges(spark):
    r = random.Random(7)
    names = ["", "Red", "red bolt", "bolt", "a red bolt x", "gear", "EAR", "x", "geared red", None]
    side = lambda first: [(first + k, r.choice("pq"), r.randint(1, 3), r.choice(names), r.random()) for k in range(120)]
    needs, has = side(0), side(60)  # some ids are on both sides
    schema = "edge_id long, source string, subject int, object string, confidence double"
    got = graph.align(spark.createDataFrame(needs, schema), spark.createDataFrame(has, schema))
    plain = lambda a, b: a.lower() in b.lower() or b.lower() in a.lower()
    want = sorted((a[0], b[0]) for a in needs for b in has if None not in (a[3], b[3]) and a[1] == b[1] and a[2] != b[2] and a[0] != b[0] and plain(a[3], b[3]))
    assert sorted((x.r_edge, x.m_edge) for x in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # no side of edges or pieces goes to the driver, whatever the tables' sizes


def test_new_edges_of_many_alike_equal_a_plain_form(spark):
    r = random.Random(11)
    names = ["", "Red", "red bolt", "bolt", "gear", None]
    side = lambda first: [(first + k, r.choice("pq"), r.randint(1, 4), r.choice(["proof", "lot"]), r.choice(names), r.choice(["PROVES", "HOLDS", None]), r.choice(["said", "", "it is the lot"]), r.random()) for k in range(150)]
    needs, has = side(0), side(5)  # most ids are on both sides, so that the first ids of both can be one
    schema = "edge_id long, source string, subject int, subject_name string, object string, kind string, evidence string, confidence double"
    known = [(1, "SATISFIES", 2), (3, "PROVES", 4)]
    a, b = spark.createDataFrame(needs, schema), spark.createDataFrame(has, schema)
    got = graph.aligned_edges(a, b, spark.createDataFrame(known, "subject int, kind string, object int"), "proof").collect()
    want = {}
    for x in needs:
        for y in has:
            if x[1] == y[1] and x[2] != y[2] and x[0] != y[0] and None not in (x[4], y[4]) and (x[4].lower() in y[4].lower() or y[4].lower() in x[4].lower()):
                key = x[1], y[2], "PROVES" if y[5] == "PROVES" or y[3] == "proof" else "SATISFIES", x[2]
                if key[1:] not in known and (key not in want or (x[0], y[0]) < want[key][:2]):
                    want[key] = x[0], y[0], " / ".join(filter(None, (y[6], x[6]))), max(0.5, 0.86 * min(x[7], y[7]))
    assert {(x.source, x.subject, x.kind, x.object): (x.r_edge, x.m_edge, x.evidence, x.confidence) for x in got} == want and len(got) == len(want)
    kept = graph.smallest(a, "r").groupBy("source", "r_object", "r_subject").count()
    assert kept.agg(F.max("count")).first()[0] == 2  # however many edges are alike, two meet the other side


def test_nearest_of_odd_vectors_equal_a_plain_form(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAST_ROWS", 16)  # several cells
    r = random.Random(3)
    odd = [None, [], [0.0] * 5, [1.0, None, 2.0, 0.5, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0, 1.0], [1e-170] * 5, [1e160] * 5, [1.0, 2.0], [3.0, 1.0, 1.0, None], [1.0] * 9]
    rows = [(k, [r.gauss(0, 1) for _ in range(5)]) for k in range(60)]
    rows = rows + [(k + 60, rows[k % 7][1]) for k in range(30)] + [(k + 90, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "i long, embedding array<double>")
    asked = df.filter("i % 3 = 0 or i > 85").select(F.col("i").alias("q"), "embedding")
    got = {(x.q, x["rank"]): (x.i, x.score) for x in search.multi_topk(df, asked, 4, "i", "q", block=13).collect()}
    pairs = df.crossJoin(asked.withColumnRenamed("embedding", "v")).withColumn("score", search.vector.cosine(F.col("embedding"), F.col("v")))
    pairs = pairs.withColumn("rank", F.row_number().over(search.Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "i"))).filter("rank <= 4")
    same = lambda a, b: a is b is None or (a != a and b != b) or abs(a - b) < 1e-9
    want = {(x.q, x["rank"]): (x.i, x.score) for x in pairs.collect()}
    assert got.keys() == want.keys()
    assert not [(k, got[k], w) for k, w in want.items() if got[k][0] != w[0] or not same(got[k][1], w[1])]


def test_nearest_of_multiples_tie_as_in_sql(spark):
    import duckdb

    rows = [(k, [round(c * x, 3) for x in (0.1, 0.7, -0.3, 0.9)]) for k, c in enumerate([1 + n / 8 for n in range(80)])]
    con = duckdb.connect()
    con.execute("CREATE TABLE e (i BIGINT, v FLOAT[])")
    con.executemany("INSERT INTO e VALUES (?, ?)", rows)
    want = con.execute("SELECT q.i, e.i, row_number() OVER (PARTITION BY q.i ORDER BY list_cosine_similarity(e.v::DOUBLE[], q.v::DOUBLE[]) DESC, e.i) AS n FROM e, e q QUALIFY n <= 20").fetchall()
    df = spark.createDataFrame(rows, "i long, embedding array<float>")
    got = search.multi_topk(df, df.withColumnRenamed("i", "q"), 20, "i", "q")
    assert {(x.q, x.i, x["rank"]) for x in got.collect()} == set(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row of the plan is a pair that isn't among the best of a cell
