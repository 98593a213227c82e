"""The composite search: recall branches by text, name, vector, edge and path meet with their provenance in one ranked page of sections.

Lists that decide what follows (entities, title events, edges, paths, coarse rank, sections) have limits of their own, so each is a small table,
cut once and read by every later step; the sets between them (events of an entity, a hop) stay distributed. Each cut also
counts its rows by observe, so a trace costs no job of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import fulltext, relations, text, vector
from . import recall, search, shared

c = F.col
MOST_RESULTS, MOST_EDGES, SEED_EVENTS, SEED_ENTITIES, EVIDENCE, WHY_EDGES = 50, 20, 5, 8, 6, 200


@dataclass(frozen=True)
class Graph:
    """Tables of live rows. entities: entity_id, name, type, description, embedding. events: event_id, text, title_vector, content_vector.
    bridge: event_id, entity_id, at. edges: edge_id, event_id, chunk_id, subject, object, subject_name, object_name, kind, label, confidence, quality,
    strong, reasoning, evidence, created. chunks: chunk_id, rank, embedding. event_chunks: event_id, chunk_id."""

    entities: DataFrame
    events: DataFrame
    bridge: DataFrame
    edges: DataFrame
    chunks: DataFrame
    event_chunks: DataFrame


@dataclass(frozen=True)
class Options:
    entity_top: int = 20
    event_top: int = 20
    key_similarity: float = 0.9
    similarity: float = 0.4
    strategy: str = "multi"
    hops: int = 1
    events: int = 100
    first_events: int = 100
    later_events: int = 0
    retries: int = 3
    rerank_top: int = MOST_RESULTS
    sections: int = MOST_RESULTS
    kinds: tuple[str, ...] = ()
    confidence: float = 0.65
    paths: bool = True


@dataclass
class Found:
    """sections: chunk_id, position, score and why. The tables that led to them, by name; counts: their rows."""

    sections: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    watched: dict[str, Observation] = field(default_factory=dict)
    fallback: bool = False

    @property
    def counts(self) -> dict[str, int]:
        return {name: int(o.get["n"]) for name, o in self.watched.items()}


class Trail:
    """Cuts tables under a name and counts them on the way."""

    def __init__(self):
        self.tables: dict[str, DataFrame] = {}
        self.watched: dict[str, Observation] = {}

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        seen = self.watched[name] = Observation(name)
        self.tables[name] = shared.cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return self.tables[name]


def numbered(df: DataFrame, *order, most: int, name: str = "rank") -> DataFrame:
    """The first rows in an order, numbered from 1."""
    first = df.orderBy(*order).limit(most)
    return first.withColumn(name, F.row_number().over(Window.orderBy(*order)))  # so many rows at most


def entities_by_text(graph: Graph, query: str, most: int) -> DataFrame:
    """Live entities that match a text: by full text, trigrams, containment or a term; ranked by the greatest of these."""
    q, terms = query.lower().strip(), text.query_terms(query)
    name, more = F.lower("name"), F.lower(F.coalesce("description", F.lit("")))
    both = F.concat_ws(" ", "name", "description")
    near, near_more = text.similarity(name, F.lit(q)), text.similarity(more, F.lit(q))
    hit, whole = text.contains_any(name, terms) | text.contains_any(more, terms), fulltext.matches(both, query)
    score = F.greatest(fulltext.cover_density(both, query), near, near_more, F.when(F.lit(q).contains(name), 1.0), F.when(name == q, 1.2), F.when(hit, 0.8))
    found = graph.entities.filter(whole | (near >= 0.3) | (near_more >= 0.3) | F.lit(q).contains(name) | hit).withColumn("score", score)
    return numbered(live(graph, found), F.desc("score"), "name", "entity_id", most=most).select("entity_id", "name", "type", "score", "rank")


def live(graph: Graph, entities: DataFrame) -> DataFrame:
    """Entities of at least one live event."""
    at = graph.bridge.join(graph.events.select("event_id"), "event_id", "left_semi").select("entity_id")
    return entities.join(at, "entity_id", "left_semi")


def entities_by_vector(graph: Graph, query: list[float], most: int, threshold: float) -> DataFrame:
    scored = graph.entities.filter("embedding is not null").withColumn("score", vector.cosine(c("embedding"), F.array(*map(F.lit, query))))
    found = numbered(live(graph, scored.filter(c("score") >= threshold)), F.desc("score"), "entity_id", most=most)
    return found.select("entity_id", "name", "type", "score", "rank")


def entities_by_names(graph: Graph, names: list[str], vectors: list[list[float]], options: Options) -> DataFrame:
    """Those of a name first, exact ones before similar ones; then those near each name's vector, name by name; each where it comes first."""
    exact = recall.name_match(live(graph, graph.entities), names, "name", "entity_id", options.entity_top)
    exact = exact.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("near"), "entity_id")))
    every = exact.select("entity_id", "name", "type", "score", "rank", F.lit(0).alias("list"))
    for k, v in enumerate(vectors):
        every = every.unionByName(entities_by_vector(graph, v, options.entity_top, options.key_similarity).withColumn("list", F.lit(k + 1)))
    first = every.groupBy("entity_id").agg(F.min_by(F.struct("name", "type", "score", "list", "rank"), F.struct("list", "rank")).alias("x")).select("entity_id", "x.*")
    return first.withColumn("rank", F.row_number().over(Window.orderBy("list", "rank"))).drop("list")  # as many rows as lists have


def events_of(graph: Graph, entities: DataFrame) -> DataFrame:
    """Live events of entities."""
    hit = graph.bridge.join(entities.select("entity_id"), "entity_id", "left_semi").select("event_id").distinct()
    return hit.join(graph.events.select("event_id"), "event_id", "left_semi")


def events_by_title(graph: Graph, query: list[float], options: Options) -> DataFrame:
    """The nearest titles: three times as many as asked for are looked at, those under the threshold left out, the first kept."""
    scored = graph.events.filter("title_vector is not null").withColumn("score", vector.cosine(c("title_vector"), F.array(*map(F.lit, query)))).select("event_id", "score")
    near = scored.orderBy(F.desc("score"), "event_id").limit(3 * options.event_top).filter(c("score") >= options.similarity)
    return numbered(near, F.desc("score"), "event_id", most=options.event_top)


def best_first() -> tuple[Column, ...]:
    return F.desc("quality"), F.desc("confidence"), F.desc("created"), c("edge_id")


def usable(graph: Graph, options: Options) -> DataFrame:
    edges = graph.edges.filter(c("confidence") >= options.confidence)
    return edges.filter(c("kind").isin(*options.kinds)) if options.kinds else edges


def edges_by_text(graph: Graph, query: str, entities: DataFrame, events: DataFrame, options: Options) -> DataFrame:
    """Edges found by text, by an entity at either end, or by their event; ranked by the greatest of the reasons' scores, then by quality."""
    q = query.lower().strip()
    ids = F.broadcast(entities.select("entity_id"))  # entity_top rows a list at most
    at = [ids.select(c("entity_id").alias(side), F.lit(1.0).alias(f"by_{side}")) for side in ("subject", "object")]
    rows = usable(graph, options).join(at[0], "subject", "left").join(at[1], "object", "left")
    rows = rows.join(events.select("event_id", F.lit(0.8).alias("by_event")), "event_id", "left")
    words = F.concat_ws(" ", "subject_name", "label", "object_name", "evidence")
    near = [text.similarity(F.lower(n), F.lit(q)) for n in ("subject_name", "object_name", "label")]
    rows = rows.withColumns({"whole": fulltext.matches(words, query), "near": F.greatest(*near)})
    rows = rows.filter(c("whole") | (c("near") >= 0.3) | c("by_subject").isNotNull() | c("by_object").isNotNull() | c("by_event").isNotNull())
    score = F.greatest(fulltext.cover_density(words, query), "near", "by_subject", "by_object", "by_event")
    most = min(options.entity_top, MOST_EDGES)
    return numbered(rows.withColumn("score", score), F.desc("score"), *best_first(), most=most).select(*graph.edges.columns, "score", "rank")


def budgeted_paths(edges: DataFrame, seeds: DataFrame, depth: int, limit: int, wide: int = 30) -> DataFrame:
    """rank, nodes, steps and score of the best paths of up to `depth` edges from seeds (entity_id), as a queue finds them.

    First come the max(8 * limit, 80) best edges at a seed; a path then goes on over the `wide` best edges at its tail that serve reasoning and
    lead to a new node. The first 3 * limit paths in queue order are scored, the best `limit` returned. No hop holds more than 3 * limit
    paths: a path behind them would never leave the queue.
    """
    budget = 3 * limit
    step = F.struct("edge_id", "chunk_id", "confidence", "quality", F.when(c("strong"), 0.08).otherwise(-0.08).alias("strength"), "evidence", "subject_name", "label", "object_name")
    first = seeds.select("entity_id").distinct()
    ends = edges.join(first.select(c("entity_id").alias("subject")), "subject", "left_semi").select(edges.columns)
    ends = ends.unionByName(edges.join(first.select(c("entity_id").alias("object")), "object", "left_semi").select(edges.columns)).dropDuplicates(["edge_id"])
    now = numbered(ends, *best_first(), most=max(8 * limit, 80)).filter(c("rank") <= budget)
    now = now.select("rank", F.array("subject", "object").alias("nodes"), F.array(step).alias("steps"))
    out = now.withColumn("hop", F.lit(1))
    for hop in range(2, depth + 1):
        tails = F.broadcast(now.select(F.element_at("nodes", -1).alias("tail")).distinct())  # budget rows at most
        there = edges.join(tails, c("subject") == c("tail")).withColumn("head", c("object"))
        back = edges.filter("subject != object").join(tails, c("object") == c("tail")).withColumn("head", c("subject"))
        best = Window.partitionBy("tail").orderBy(*best_first())
        near = there.unionByName(back).withColumn("nth", F.row_number().over(best)).filter((c("nth") <= wide) & c("reasoning") & (c("kind") != "RELATED_TO"))
        near = near.select("tail", "head", "nth", step.alias("step"))
        longer = now.join(near, F.element_at("nodes", -1) == c("tail")).filter(~F.array_contains("nodes", c("head")) & ~F.array_contains("steps.edge_id", c("step.edge_id")))
        longer = longer.select(c("rank").alias("before"), "nth", F.array_append("nodes", c("head")).alias("nodes"), F.array_append("steps", c("step")).alias("steps"))
        now = numbered(longer, "before", "nth", most=budget).select("rank", "nodes", "steps")
        out = out.unionByName(now.withColumn("hop", F.lit(hop)))
    queue = out.orderBy("hop", "rank").limit(budget)
    scored = queue.withColumn("score", relations.path_score(c("steps.confidence"), c("steps.quality"), c("steps.strength")))
    order = (F.desc(F.round("score", 9)), c("hop"), c("rank"))
    return scored.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))).select(c("place").alias("rank"), "hop", "nodes", "steps", "score")


def expanded(graph: Graph, seeds: DataFrame, entities: DataFrame, hops: int) -> DataFrame:
    """Live events within so many hops of the seeds, over entities not met before; without the seeds."""
    seen, met, now, out = seeds, entities.select("entity_id"), seeds, seeds.limit(0)
    for hop in range(hops):
        new = graph.bridge.join(now, "event_id", "left_semi").select("entity_id").distinct().join(met, "entity_id", "left_anti")
        now = events_of(graph, new).join(seen, "event_id", "left_anti")
        if hop + 1 < hops:  # a later hop reads them again
            new, now = shared.cut(new, "hop-entities"), shared.cut(now, "hop-events")
        met, seen, out = met.unionByName(new), seen.unionByName(now), out.unionByName(now)
    return out


def until(graph: Graph, start: DataFrame, met: DataFrame, seen: DataFrame, target: int, retries: int) -> DataFrame:
    """Live events reached from start over entities not in met, hop by hop, until so many are found or so many hops done; whole hops, without those in seen."""
    out = start.limit(0).select("event_id")
    found = 0
    for _ in range(retries if target > 0 else 0):
        new = shared.cut(graph.bridge.join(start, "event_id", "left_semi").select("entity_id").distinct().join(met, "entity_id", "left_anti"), "new-entities")
        start = shared.cut(events_of(graph, new).join(seen, "event_id", "left_anti").join(out, "event_id", "left_anti"), "new-events")
        met, out = met.unionByName(new), out.unionByName(start)
        more = start.count()
        found += more
        if not more or found >= target:
            break
    return out


def expansions(graph: Graph, seeds: DataFrame, entities: DataFrame, query: list[float], o: Options) -> tuple[DataFrame, DataFrame | None]:
    """Events reached from the seeds by a strategy, and those of its second part.

    multi: all events within o.hops. hop: one hop, then on until o.later_events are found. hopllm: the second part starts anew from the o.first_events
    best contents among the seeds and the first hop.
    """
    if o.strategy == "multi":
        return expanded(graph, seeds, entities, o.hops), None
    if o.strategy not in ("hop", "hopllm"):
        raise ValueError(f"unknown strategy {o.strategy!r}")
    met = entities.select("entity_id")
    new = shared.cut(graph.bridge.join(seeds, "event_id", "left_semi").select("entity_id").distinct().join(met, "entity_id", "left_anti"), "first-entities")
    one = shared.cut(events_of(graph, new).join(seeds, "event_id", "left_anti"), "first-events")
    start = one
    if o.strategy == "hopllm":
        start = shared.cut(coarse(graph, seeds.unionByName(one), query, o.first_events).select("event_id"), "seeds-anew")
    return one, until(graph, start, met.unionByName(new), seeds.unionByName(one), o.later_events, o.retries)


def coarse(graph: Graph, events: DataFrame, query: list[float], most: int) -> DataFrame:
    rows = graph.events.filter("content_vector is not null").join(events, "event_id", "left_semi")
    return numbered(rows.withColumn("score", vector.cosine(c("content_vector"), F.array(*map(F.lit, query)))), F.desc("score"), "event_id", most=most).select("event_id", "text", "score", "rank")


def chunks_near(graph: Graph, query: list[float], most: int) -> DataFrame:
    scored = graph.chunks.filter("embedding is not null").withColumn("score", vector.cosine(c("embedding"), F.array(*map(F.lit, query))))
    return numbered(scored, F.desc("score"), "chunk_id", most=most).select("chunk_id", "score", "rank")


def event_sections(graph: Graph, selected: DataFrame, ranked: DataFrame, most: int) -> DataFrame:
    """Chunks of the selected events in their order, each chunk once; scored by the event's coarse rank."""
    rows = graph.event_chunks.join(F.broadcast(selected.select("event_id", "position")), "event_id").join(ranked.select("event_id", "score"), "event_id", "left")
    rows = rows.join(graph.chunks.select("chunk_id", c("rank").alias("within")), "chunk_id")
    first = rows.groupBy("chunk_id").agg(F.min(F.struct("position", "within", F.coalesce("score", F.lit(0.0)).alias("score"))).alias("x")).select("chunk_id", "x.*")
    return numbered(first, "position", "within", "chunk_id", most=most, name="ord").select("chunk_id", "score", "ord")


def edge_sections(graph: Graph, edges: DataFrame) -> DataFrame:
    """Chunks of edges (edge_id, chunk_id, confidence, quality, ord) in their order, each chunk once; scored by the better of quality and confidence."""
    rows = edges.join(graph.chunks.select("chunk_id", c("rank").alias("within")), "chunk_id").withColumn("score", F.greatest("quality", "confidence"))
    first = rows.groupBy("chunk_id").agg(F.min(F.struct("ord", "within", "score")).alias("x")).select("chunk_id", "x.*")
    return first.select("chunk_id", "score", F.row_number().over(Window.orderBy("ord", "within", "chunk_id")).alias("ord"))  # a chunk a recalled edge


def merged(sections: DataFrame, extra: DataFrame, spare: DataFrame, most: int, floor: float = 0.75) -> DataFrame:
    """A page: extra chunks that it lacks stand before it, the last of them first and scored at least `floor`, until it is full (a full page admits one);
    then spare chunks fill it up. chunk_id, score and position."""
    room = F.greatest(F.lit(1), F.lit(most) - F.count("*"))
    new = extra.join(sections.select("chunk_id"), "chunk_id", "left_anti").withColumn("nth", F.row_number().over(Window.orderBy("ord"))).crossJoin(sections.agg(room.alias("room"))).filter("nth <= room")  # a page of rows, and one
    front = new.select("chunk_id", F.greatest("score", F.lit(floor)).alias("score"), F.lit(0).alias("part"), (-c("nth")).alias("ord"))
    page = front.unionByName(sections.select("chunk_id", "score", F.lit(1).alias("part"), "ord"))
    more = spare.join(page.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "score", F.lit(2).alias("part"), c("rank").alias("ord"))
    every = page.unionByName(more)
    return numbered(every, "part", "ord", most=most, name="position").select("chunk_id", "score", "position")


def with_why(graph: Graph, page: DataFrame, entities: DataFrame, paths: DataFrame, fallback: bool) -> DataFrame:
    """chunk_id, position, score and why: kind, entities, edges, paths and evidence.

    Edges are the live ones that point at the section's chunk, best first; paths those over one of them; evidence their texts, each text once,
    EVIDENCE at most; a section names WHY_EDGES edges at most and counts all. Edges meet a page's few chunks in one join.
    """
    few = F.broadcast(page.select("chunk_id"))  # a page
    at = graph.edges.join(few, "chunk_id").select("chunk_id", F.struct((-c("quality")).alias("q"), (-c("confidence")).alias("r"), "edge_id", "evidence", "quality").alias("e"))
    kept = at.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("e"))).filter(c("nth") <= WHY_EDGES)
    total = at.groupBy("chunk_id").agg(F.count("*").alias("n_edges"))
    steps = paths.select("rank", "score", F.posexplode("steps").alias("nth", "s")).select("rank", "nth", "score", "s.*")
    over = at.select("chunk_id", c("e.edge_id").alias("edge_id")).join(F.broadcast(steps.select("edge_id", "rank").distinct()), "edge_id").select("chunk_id", "rank").distinct()
    over = over.join(paths.select("rank", F.array_join("steps.edge_id", ">").alias("path"), "steps"), "rank")
    by_path = over.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "steps"))).alias("p"))
    by_edge = kept.groupBy("chunk_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    named = entities.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id"))), lambda x: x["entity_id"]).alias("matched"))  # entity_top rows a list at most
    rows = page.join(by_edge, "chunk_id", "left").join(by_path, "chunk_id", "left").join(total, "chunk_id", "left").crossJoin(F.broadcast(named))
    said = F.concat(
        F.transform(F.coalesce("e", F.array().cast(by_edge.schema["e"].dataType)), lambda e: F.trim(e["evidence"])),
        F.flatten(F.transform(F.coalesce("p", F.array().cast(by_path.schema["p"].dataType)), lambda p: F.transform(p["steps"], lambda s: F.trim(s["evidence"])))),
    )
    evidence = F.slice(F.array_distinct(F.filter(said, lambda x: x != "")), 1, EVIDENCE)
    reason = recall.why(c("p").isNotNull(), c("e").isNotNull(), F.size("matched") > 0, F.lit(fallback))
    why = F.struct(
        reason.alias("kind"), c("matched").alias("entities"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce(F.transform("e", lambda e: e["edge_id"]), F.array().cast("array<bigint>")).alias("edges"),
        F.coalesce(F.transform("p", lambda p: p["path"]), F.array().cast("array<string>")).alias("paths"), evidence.alias("evidence"), (F.lit(fallback) | (reason == "fallback")).alias("fallback"),
    )
    return rows.select("chunk_id", "position", "score", why.alias("why"))


def multi_search(graph: Graph, query: str, query_vector: list[float], mode: str = "fast", names: tuple[str, ...] = (), name_vectors: tuple[list[float], ...] = (), aliases: tuple[str, ...] = (), options: Options | None = None) -> Found:
    """The page of sections for a query, and what led to it.

    fast: entities by text, or by the query's vector where the text finds none; candidates reranked by the query's words. standard: entities
    by names and by the names' vectors; candidates reranked by shared keywords. Without any seed event the page is that of the plain
    vector search. Events come from entities, title vectors, edges and paths, then a hop further; their contents are ranked by vector.
    """
    if mode not in ("fast", "standard"):
        raise ValueError(f"unknown mode {mode!r}")
    o, trail = options or Options(), Trail()
    page_size = max(1, min(o.sections, MOST_RESULTS))
    words = recall.expanded_query(query, list(aliases))
    if mode == "fast":
        by_text = shared.cut(entities_by_text(graph, words, o.entity_top), "by-text")
        entities = recall.or_else(by_text, entities_by_vector(graph, query_vector, o.entity_top, min(o.key_similarity, 0.72)))
    else:
        entities = entities_by_names(graph, list(names), list(name_vectors), o)
    entities = trail("entities", entities)
    titles = trail("title_events", events_by_title(graph, query_vector, o))
    entity_events = trail("entity_events", events_of(graph, entities))
    both = entity_events.unionByName(titles.select("event_id")).distinct()
    edges = trail("edges", edges_by_text(graph, words, entities, both, o))
    ends = entities.select("entity_id").unionByName(edges.select(c("subject").alias("entity_id"))).unionByName(edges.select(c("object").alias("entity_id")))
    paths = budgeted_paths(usable(graph, o), ends, max(1, min(o.hops or 2, 3)), min(o.entity_top, MOST_EDGES))
    paths = trail("paths", paths if o.paths else paths.limit(0))
    on_paths = graph.edges.join(F.broadcast(paths.select(F.explode("steps.edge_id").alias("edge_id")).distinct()), "edge_id", "left_semi").select("event_id")
    seeds = trail("seed_events", both.unionByName(edges.select("event_id")).unionByName(on_paths).filter("event_id is not null").distinct())
    spare = trail("near_chunks", chunks_near(graph, query_vector, 2 * page_size))
    if not trail.watched["seed_events"].get["n"]:
        page = spare.orderBy("rank").limit(page_size).select("chunk_id", c("rank").alias("position"), "score")
        page = page.withColumn("why", F.lit(None).cast(with_why(graph, page, entities, paths, True).schema["why"].dataType))
        return Found(page, trail.tables, trail.watched, True)
    first = graph.bridge.join(F.broadcast(titles.filter(c("rank") <= SEED_EVENTS).select("event_id", "rank")), "event_id")
    inferred = first.groupBy("entity_id").agg(F.min(F.struct("rank", "at")).alias("x"))
    inferred = numbered(inferred, "x.rank", "x.at", "entity_id", most=min(o.entity_top, SEED_ENTITIES)).join(graph.entities, "entity_id").select("entity_id", "name", "type", F.lit(1.0).alias("score"), "rank")
    entities = trail("entities_used", recall.or_else(entities, inferred))
    one, two = expansions(graph, seeds, entities, query_vector, o)
    reached = trail("expanded_events", one if two is None else one.unionByName(two))
    if two is None:
        ranked = coarse(graph, seeds.unionByName(reached).distinct(), query_vector, o.events)
    else:  # the second part has a rank of its own, behind the first's
        ranked = coarse(graph, seeds.unionByName(one).distinct(), query_vector, o.first_events)
        if o.later_events > 0:
            later = coarse(graph, two, query_vector, o.later_events)
            ranked = ranked.unionByName(later.withColumn("rank", c("rank") + o.first_events))
    ranked = trail("coarse_events", ranked)
    again = search.lexical_rerank if mode == "fast" else search.keyword_rerank
    selected = again(ranked, query, "text", "score", "event_id", max(1, min(o.rerank_top, MOST_RESULTS)))
    selected = trail("selected_events", selected.select("event_id", F.row_number().over(Window.orderBy(F.desc("rerank"), "event_id")).alias("position")))  # rerank_top rows
    listed = edges.select("edge_id", "chunk_id", "confidence", "quality", c("rank").alias("ord"))
    stepped = paths.select("rank", F.posexplode("steps").alias("nth", "s")).select("s.edge_id", "s.chunk_id", "s.confidence", "s.quality", (1000 * c("rank") + c("nth")).alias("ord"))
    at_edges = edge_sections(graph, listed.unionByName(stepped))
    page = trail("sections", merged(shared.cut(event_sections(graph, selected, ranked, page_size), "event-sections"), at_edges, spare, page_size))
    return Found(with_why(graph, page, entities, paths, False), trail.tables, trail.watched)
