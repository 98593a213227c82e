"""Documents into a snapshot store: chunks, events, entities, edges and counts of holders, replaced and deleted in one commit each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extraction, kinds, relation_text, text
from . import chunking, shared
from .snapshots import Store

c = F.col
ENTITIES = 12
#: Tables that hang on a document, and by what.
OF_DOCUMENT = ("documents", "chunks", "events", "edges")


def checked(rows: DataFrame) -> DataFrame:
    """rows (source_id, external_id, title, content) with document_id, and error where a row can't be taken: no source, no id or a blank content."""
    error = F.when(c("source_id").isNull(), "source is missing").when(F.trim(F.coalesce("external_id", F.lit(""))) == "", "external id is missing").when(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", "") == "", "content is empty")
    return rows.select(c("source_id").cast("long").alias("source_id"), F.trim(c("external_id").cast("string")).alias("external_id"), c("title").cast("string").alias("title"), c("content").cast("string").alias("content")).withColumn("error", error)


def extracted(chunks: DataFrame, rules=relation_text.RULES) -> DataFrame:
    """An event a chunk: chunk columns, event_id, first sentence as title, summary, keywords, named entities and relations between them."""
    names = F.transform(extraction.clean_entities(text.named_entities(c("content"), ENTITIES), kinds.mostly_han(c("content"))), lambda e: F.struct(e["name"].alias("name"), e["kind"].alias("type")))
    rows = chunks.withColumns({"event_id": F.xxhash64("chunk_id", F.lit("event")), "title": extraction.first_sentence(c("content")), "han": kinds.mostly_han(c("content")), "names": names})
    return rows.withColumns({"summary": extraction.concise(c("title"), c("han")), "keywords": text.keywords(c("content")), "relations": relation_text.extracted(c("content"), c("names"), rules)}).drop("han")


def staged(rows: DataFrame, commit_id: str, max_tokens: int | None, rules) -> dict[str, DataFrame]:
    """The rows of all tables for good documents, each computed once: ids depend on source, external id and commit, so a retry makes the same."""
    docs = shared.cut(rows.withColumn("document_id", F.xxhash64("source_id", "external_id", F.lit(commit_id))), "documents")
    made = chunking.chunk_markdown(docs.select(c("document_id").alias("doc_id"), c("content").alias("text")), "heading_strict", max_tokens).withColumnRenamed("doc_id", "document_id")
    made = made.join(docs.select("document_id", "source_id"), "document_id").withColumn("chunk_id", F.xxhash64("document_id", "rank"))
    chunks = shared.cut(made.select("chunk_id", "document_id", "source_id", "rank", "heading", "content", "n_tokens"), "chunks")
    events = shared.cut(extracted(chunks, rules), "events")
    entity = lambda name, type_: F.xxhash64("source_id", type_, F.lower(F.trim(name)))
    named = events.select("event_id", "document_id", "source_id", F.posexplode("names").alias("at", "e")).select("event_id", "document_id", "source_id", "at", "e.name", "e.type")
    named = named.withColumn("entity_id", entity(c("name"), c("type"))).dropDuplicates(["event_id", "entity_id"])
    drawn = events.select("event_id", "document_id", "source_id", "chunk_id", F.explode("relations").alias("r"), F.map_from_arrays("names.name", "names.type").alias("types"))
    ends = lambda side: entity(c(f"r.{side}"), F.element_at("types", c(f"r.{side}")))
    edges = drawn.select(
        F.xxhash64("event_id", "r.subject", "r.predicate", "r.object").alias("edge_id"), "document_id", "event_id", "source_id", "chunk_id", ends("subject").alias("subject"), ends("object").alias("object"), c("r.predicate").alias("kind"),
        c("r.evidence").alias("evidence"), c("r.confidence").alias("confidence"), c("r.quality").alias("quality"), F.lit("AUTO").alias("status"),
    )
    return {
        "documents": docs.select("document_id", "source_id", "external_id", "title", "content", F.lit(commit_id).alias("commit_id")),
        "chunks": chunks,
        "events": events.select("event_id", "document_id", "source_id", "chunk_id", "rank", "title", "summary", "content", "keywords"),
        "bridge": named.select("event_id", "entity_id", "document_id"),
        "entities": named.groupBy("entity_id").agg(F.min("source_id").alias("source_id"), F.min("type").alias("type"), F.min_by("name", F.struct("event_id", "at")).alias("name")),
        "edges": edges,
    }


def counted(commit, touched: DataFrame) -> DataFrame:
    """Of touched entities those that no event holds any more, by the sum of their signed counts."""
    return commit.rows("holders").join(touched, "entity_id", "left_semi").groupBy("entity_id").agg(F.sum("delta").alias("n")).filter("n <= 0").select("entity_id")


def take_out(commit, gone: DataFrame) -> None:
    """Delete documents (document_id) with all that hangs on them. Entities are counted by signed deltas, so only those that the documents' events
    held are looked at; entities without a holder go with their edges and counts, all others stay."""
    if "bridge" not in commit.tables:
        return
    gone = shared.cut(gone.select("document_id").distinct(), "gone")
    lost = shared.cut(commit.rows("bridge").join(gone, "document_id", "left_semi").groupBy("entity_id").agg((-F.count("*")).alias("delta")), "lost")
    commit.append("holders", lost)
    orphans = shared.cut(counted(commit, lost.select("entity_id")), "orphans")
    for name in (*OF_DOCUMENT, "bridge"):
        commit.delete(name, gone, ["document_id"])
    for name in ("entities", "holders"):
        commit.delete(name, orphans, ["entity_id"])
    for side in ("subject", "object"):
        commit.delete("edges", orphans.withColumnRenamed("entity_id", side), [side])


def put_in(commit, tables: dict[str, DataFrame]) -> None:
    for name in (*OF_DOCUMENT, "bridge"):
        commit.append(name, tables[name])
    new = tables["entities"]
    if "entities" in commit.tables:
        new = new.join(commit.rows("entities").select("entity_id"), "entity_id", "left_anti")
    commit.append("entities", new)
    commit.append("holders", tables["bridge"].groupBy("entity_id").agg(F.count("*").alias("delta")))


def ingest(store: Store, rows: DataFrame, commit_id: str, replace: bool = False, stop_on_error: bool = False, max_tokens: int | None = None, rules=relation_text.RULES) -> int:
    """Take documents in by one commit; its version. With replace, those of the same source and external id go in the same commit.

    Rows that can't be taken go to the quarantine table with their error, or stop the ingest before anything is committed. Of rows with one source
    and external id in a batch, the one with the greatest content counts. A commit id that is done is not done again.
    """
    if (before := store.done(commit_id)) is not None:
        return before
    all_rows = shared.cut(checked(rows), "checked")
    bad = all_rows.filter("error is not null")
    if stop_on_error and (first := bad.select("external_id", "error").first()):
        raise ValueError(f"document {first['external_id']!r}: {first['error']}")
    good = all_rows.filter("error is null").groupBy("source_id", "external_id").agg(F.max(F.struct("content", "title")).alias("x")).select("source_id", "external_id", "x.title", "x.content")
    tables = staged(good, commit_id, max_tokens, rules)
    commit = store.begin(commit_id)
    if replace and "documents" in commit.tables:
        again = tables["documents"].select("source_id", "external_id")
        take_out(commit, commit.rows("documents").join(again, ["source_id", "external_id"], "left_semi"))
    put_in(commit, tables)
    commit.append("quarantine", bad.select("source_id", "external_id", "title", "error").withColumn("commit_id", F.lit(commit_id)))
    return commit.publish()


def delete(store: Store, gone: DataFrame, commit_id: str) -> int:
    """Delete documents by document_id in one commit; the version."""
    if (before := store.done(commit_id)) is not None:
        return before
    commit = store.begin(commit_id)
    take_out(commit, gone)
    return commit.publish()


def rebuild(store: Store, source_id: int, commit_id: str, max_tokens: int | None = None, rules=relation_text.RULES) -> int:
    """All documents of a source taken in anew from their stored content, by one commit that replaces them."""
    rows = store.read("documents").filter(c("source_id") == source_id) if store.has("documents") else None
    return ingest(store, rows, commit_id, True, False, max_tokens, rules) if rows is not None else store.version()


def stream(rows: DataFrame, store: Store, name: str, replace: bool = True, stop_on_error: bool = False, **options):
    """A streaming write of documents: a commit a micro-batch, with the batch's number in its id, so that a replayed batch changes nothing."""
    return rows.writeStream.foreachBatch(lambda batch, number: ingest(store, batch, f"{name}-{number}", replace, stop_on_error, **options) and None)
