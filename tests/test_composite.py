"""The composite search on small graphs, and its queue of paths against a plain one."""

import random

import pytest
from pyspark.sql import functions as F

from quarrymill.functions import fulltext
from quarrymill.operators import composite

EDGE = "edge_id long, event_id long, chunk_id long, subject long, object long, subject_name string, object_name string, kind string, label string, confidence double, quality double, strong boolean, reasoning boolean, evidence string, created long"
EVENT = "event_id long, text string, title_vector array<double>, content_vector array<double>"


def graph(spark, edges=(), entities=None, events=None, bridge=(), chunks=6):
    entities = entities if entities is not None else [(1, "project lead", "role", "", [0.0, 1.0]), (2, "manager certificate", "paper", "", [1.0, 0.0])]
    events = events if events is not None else [(k, f"event {k}", [1.0, k / 10], [1.0, (k - 3) / 10]) for k in range(1, chunks + 1)]
    return composite.Graph(
        spark.createDataFrame(entities, "entity_id long, name string, type string, description string, embedding array<double>"),
        spark.createDataFrame(events, EVENT),
        spark.createDataFrame(list(bridge), "event_id long, entity_id long, at int"),
        spark.createDataFrame(list(edges), EDGE),
        spark.createDataFrame([(10 * k, k, [1.0, k / 10]) for k in range(1, chunks + 1)], "chunk_id long, rank long, embedding array<double>"),
        spark.createDataFrame([(k, 10 * k) for k in range(1, chunks + 1)], "event_id long, chunk_id long"),
    )


def edge(k, event, chunk, s, o, kind="REQUIRES", confidence=0.9, quality=0.9, evidence="The project lead needs a manager certificate.", names=None):
    a, b = names or (f"n{s}", f"n{o}")
    return (k, event, chunk, s, o, a, b, kind, kind.lower(), confidence, quality, kind != "RELATED_TO", kind != "RELATED_TO", evidence, k)


def test_sections_of_found_events_keep_ids_and_order(spark):
    """Without entities the title vectors lead to events; a page of 50 shows all six, in the order of their contents."""
    found = composite.multi_search(graph(spark, entities=[]), "topk", [1.0, 0.0], "standard")
    rows = found.sections.orderBy("position").collect()
    assert [r.chunk_id for r in rows] == [30, 20, 40, 10, 50, 60]
    assert {r.why.kind for r in rows} == {"vector"} and not found.fallback
    assert found.counts["title_events"] == 6 and found.counts["entities"] == 0 and found.counts["sections"] == 6


def test_vectors_decide_rows(spark):
    g = graph(spark, entities=[])
    first = [r.chunk_id for r in composite.multi_search(g, "topk", [1.0, 0.0], "standard", options=composite.Options(rerank_top=2, sections=2)).sections.orderBy("position").collect()]
    other = [r.chunk_id for r in composite.multi_search(g, "topk", [1.0, 0.4], "standard", options=composite.Options(rerank_top=2, sections=2)).sections.orderBy("position").collect()]
    assert first != other


def test_titles_are_oversampled_then_cut_by_threshold(spark):
    events = [(k, "t", [1.0, float(k)], [1.0, 0.0]) for k in range(40)]
    near = composite.events_by_title(graph(spark, events=events), [1.0, 0.0], composite.Options(event_top=4))
    assert [r.event_id for r in near.orderBy("rank").collect()] == [0, 1, 2]  # cosines 1, 0.71, 0.45, 0.32


def test_why_names_entities_edges_paths_and_evidence(spark):
    e = edge(7, 1, 10, 1, 2)
    same = edge(8, 1, 10, 2, 1, quality=0.2)
    g = graph(spark, [e, same], bridge=[(1, 1, 1), (1, 2, 2)])
    found = composite.multi_search(g, "certificate of the project lead", [1.0, 0.0], "standard", ("Project Lead", "manager certificate"))
    why = {r.chunk_id: r.why for r in found.sections.collect()}[10]
    assert (why.kind, why.entities, why.edges, why.n_edges, why.fallback) == ("graph_path", [2, 1] if why.entities[0] == 2 else [1, 2], [7, 8], 2, False)
    assert why.paths[:2] == ["7", "8"] or "7" in why.paths
    assert why.evidence == ["The project lead needs a manager certificate."]
    assert {"entities": 2, "edges": 2, "paths": found.tables["paths"].count()}.items() <= found.counts.items()
    assert found.counts == {k: t.count() for k, t in found.tables.items()}


def test_edge_chunks_stand_in_front_with_a_floor(spark):
    g = graph(spark, [edge(7, None, 60, 1, 2, confidence=0.66, quality=0.1)], bridge=[(1, 1, 1)])
    rows = composite.multi_search(g, "project lead", [1.0, 0.0], "fast", options=composite.Options(rerank_top=2, sections=4)).sections.orderBy("position").collect()
    assert rows[0].chunk_id == 60 and rows[0].score == 0.75 and rows[0].why.kind == "graph_path" and len(rows) == 4


def test_no_seed_falls_back_to_chunks_and_unknown_modes_are_refused(spark):
    g = graph(spark, entities=[], events=[(1, "t", None, None)])
    found = composite.multi_search(g, "nothing", [1.0, 0.0], "fast", options=composite.Options(sections=3))
    assert found.fallback and [r.chunk_id for r in found.sections.orderBy("position").collect()] == [10, 20, 30]
    with pytest.raises(ValueError):
        composite.multi_search(g, "x", [1.0], "slow")


def test_entities_come_from_the_vector_only_where_text_finds_none(spark):
    g = graph(spark, bridge=[(1, 1, 1), (2, 2, 1)])
    by_vector = composite.multi_search(g, "zzz", [1.0, 0.0], "fast")
    by_text = composite.multi_search(g, "lead", [1.0, 0.0], "fast")
    assert [r.entity_id for r in by_vector.tables["entities"].collect()] == [2]
    assert [r.entity_id for r in by_text.tables["entities"].collect()] == [1]


def queue(edges, seeds, depth, limit, wide=30):
    order = lambda e: (-e[10], -e[9], -e[14], e[0])
    first = sorted((e for e in edges if e[3] in seeds or e[4] in seeds), key=order)[: max(8 * limit, 80)]
    waiting, out = [([e[3], e[4]], [e]) for e in first], []
    while waiting and len(out) < 3 * limit:
        nodes, steps = waiting.pop(0)
        out.append((nodes, steps))
        if len(steps) >= depth:
            continue
        tail = nodes[-1]
        for e in sorted((e for e in edges if tail in (e[3], e[4])), key=order)[:wide]:
            head = e[4] if e[3] == tail else e[3]
            if e not in steps and e[12] and e[7] != "RELATED_TO" and head not in nodes:
                waiting.append((nodes + [head], steps + [e]))

    def score(steps):
        n = len(steps)
        s = 0.45 * sum(e[9] for e in steps) / n + 0.45 * sum(e[10] for e in steps) / n + sum(0.08 if e[11] else -0.08 for e in steps) - 0.03 * (n - 1)
        return round(max(0, min(1, s)), 9)

    return [[e[0] for e in steps] for _, steps in sorted(out, key=lambda p: -score(p[1]))[:limit]]


@pytest.mark.parametrize("limit,wide", [(4, 30), (20, 3), (60, 2)])
def test_paths_equal_a_queue(spark, limit, wide):
    rnd = random.Random(limit)
    edges = [edge(k, k, k, rnd.randint(1, 12), rnd.randint(1, 12), rnd.choice(["REQUIRES", "RELATED_TO", "PROVES"]), round(rnd.random(), 3), round(rnd.random(), 3)) for k in range(70)]
    edges += [edge(100 + k, k, k, 3, 20 + k, "PROVES", 0.5, 0.5) for k in range(60)]  # a hub
    seeds = spark.createDataFrame([(1,), (2,), (2,)], "entity_id long")
    got = composite.budgeted_paths(spark.createDataFrame(edges, EDGE), seeds, 3, limit, wide)
    assert [[s.edge_id for s in r.steps] for r in got.orderBy("rank").collect()] == queue(edges, {1, 2}, 3, limit, wide)


def test_cover_density(spark):
    texts = [("red widget", 0.1), ("red big widget", 0.05), ("widget", 0.0), ("red widget and red widget", 0.1 + 0.05 + 0.1), ("", 0.0), (None, 0.0), ("red red widget", 0.1)]
    got = spark.createDataFrame(texts, "t string, want double").select("want", F.round(fulltext.cover_density(F.col("t"), "Red widget"), 6).alias("got")).collect()
    assert all(abs(r.want - r.got) < 1e-6 for r in got), got


def test_strategies_of_expansion(spark):
    """A chain of events 1-2-3-4-5 by shared entities: each strategy goes as far as it may, and hopllm on from the best contents only."""
    bridge = [(k, e, 1) for k in range(1, 6) for e in (k, k + 1)]
    g = graph(spark, bridge=bridge, events=[(k, "t", [1.0, 0.0], [1.0, float(k)]) for k in range(1, 6)])
    seeds, none = spark.createDataFrame([(1,)], "event_id long"), spark.createDataFrame([], "entity_id long")

    def run(**o):
        one, two = composite.expansions(g, seeds, none, [0.0, 1.0], composite.Options(**o))
        return sorted(r.event_id for r in one.collect()), None if two is None else sorted(r.event_id for r in two.collect())

    assert run(strategy="multi", hops=2) == ([2, 3], None)
    assert run(strategy="hop", later_events=2) == ([2], [3, 4]) and run(strategy="hop", later_events=9, retries=2) == ([2], [3, 4])
    assert run(strategy="hop") == ([2], []) and run(strategy="hop", later_events=1) == ([2], [3])
    assert run(strategy="hopllm", later_events=1, first_events=1) == ([2], [3])  # event 2 has the better content
    with pytest.raises(ValueError):
        run(strategy="other")
    found = composite.multi_search(g, "zzz", [0.0, 1.0], "fast", options=composite.Options(strategy="hop", later_events=5, similarity=0.0))
    assert found.counts["coarse_events"] == 5
