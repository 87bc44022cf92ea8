"""Whole runs over a catalogue: indexing, recommending, subjects, clouds, refreshes.

A catalogue is a dictionary of tables (see ``sources.tables.SCHEMAS``).  Each run
returns the next catalogue; what changed is stored in between, whole tables only by
``settle`` at the end of a run.  ``as_of`` takes the place of the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.lineage import cut
from shelfmark.operators import buckets, corpus, index, personal, popularity, similar, snapshots, subjects, tagcloud, worksets
from shelfmark.sources.tables import SCHEMAS

Catalogue = dict[str, DataFrame]
# Tables a run changes, and so writes anew.
STATE_TABLES = (
    "entries", "corpus", "recommendations", "buckets", "subjects", "entries_subjects", "tag_clouds", "feeds",
    "aggregation_feeds", *index.INDEX_TABLES,
)
# The aggregation whose members may be recommended, entries of a first run.
GLOBAL_AGGREGATION = 1
BOOTSTRAP_ENTRIES = 200
# Stamp of an entry that was never indexed: later than `snapshots.NEVER`, because an entry is due for recommendations
# when it was indexed after they were computed.
NEVER_INDEXED = "1971-01-02 00:00:00"


def empty_catalogue(spark: SparkSession) -> Catalogue:
    return {name: spark.createDataFrame([], SCHEMAS[name]) for name in STATE_TABLES}


def harvest(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after a harvest: the newest change of an id wins and keeps the stamps of the stored entry.

    A change without a harvest time is older than any with one; changes of one
    time are decided by their other columns, so the outcome does not depend on
    the order of the rows.  An entry seen for the first time has never been
    indexed or recommended and gets the stamps that say so, which makes it due.
    """
    columns = entries.columns
    named = F.struct(
        F.coalesce("harvested_at", F.lit("0001-01-01").cast("timestamp")).alias("_order"), *[F.col(c) for c in columns])
    latest = changes.groupBy("id").agg(F.max(named).alias("_row")).select([F.col(f"_row.{c}").alias(c) for c in columns])
    stamps = entries.select(
        "id", F.col("indexed_at").alias("_indexed"), F.col("relevance_calculated_at").alias("_calculated")
    )
    merged = (
        latest.join(stamps, "id", "left")
        .withColumn("indexed_at", F.coalesce("_indexed", "indexed_at", F.lit(NEVER_INDEXED).cast("timestamp")))
        .withColumn("relevance_calculated_at", F.coalesce(
            "_calculated", "relevance_calculated_at", F.lit(snapshots.NEVER).cast("timestamp")))
        # A change of unknown time is a change all the same and has to be processed.
        .withColumn("harvested_at", F.coalesce("harvested_at", F.col("indexed_at") + F.expr("interval 1 second")))
        .select(*columns)
    )
    return entries.join(latest.select("id"), "id", "left_anti").unionByName(merged).select(*columns)


def settle(state: Catalogue) -> Catalogue:
    """Store the state tables, so that the next run starts from tables and not from plans."""
    return {name: cut(table) if name in STATE_TABLES else table for name, table in state.items()}


def maintain_corpus(state: Catalogue, as_of, all: bool = False) -> Catalogue:
    """Deletions first, then new and changed documents, then documents without an entry.

    ``touched`` of the result are the documents that were written or removed.
    """
    state = dict(state)
    entries, recs, docs = state["entries"], state["recommendations"], state["corpus"]

    gone = cut(worksets.deleted_entries(entries))
    docs = corpus.remove_documents(docs, gone)
    entries = snapshots.flag_for_recompute(entries, recs, gone)
    state["recommendations"] = snapshots.delete_involving(recs, gone)
    entries = snapshots.delete_entries(entries)

    due = cut(entries.join(worksets.entries_to_index(entries, all), "id", "left_semi"))
    fresh = cut(corpus.build_corpus(due, state["feeds"]).select(*docs.columns))
    docs = corpus.remove_documents(docs, fresh).unionByName(fresh)
    known = due.join(state["feeds"].select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    done = corpus.corpus_validity(known).filter("stampable")
    state["entries"] = snapshots.stamp_processed(entries, done, "indexed_at", as_of)
    orphans = cut(corpus.index_orphans(docs, state["entries"]))
    state["corpus"] = corpus.remove_documents(docs, orphans)
    changed = fresh.select("id").unionByName(gone.select("id")).unionByName(orphans.select("id"))
    state["touched"] = state["touched"].unionByName(changed) if "touched" in state else changed
    return state


def kept_index(state: Catalogue) -> index.Index:
    return index.Index(*[state[name] for name in index.INDEX_TABLES])


def maintain_index(state: Catalogue) -> Catalogue:
    """The kept index after the changes of the corpus; only changed documents are split into terms."""
    state = dict(state)
    adjust = None
    if "stems" in state:  # (term, stem) and the words that stay as they are
        protected = state["protected_words"] if "protected_words" in state else state["stems"].select("term").limit(0)
        adjust = lambda terms: corpus.stem_vocabulary(terms, state["stems"], protected)
    touched = state.pop("touched") if "touched" in state else state["corpus"].select("id").limit(0)
    new = index.update_index(
        kept_index(state), state["corpus"], state["subjects"], state["entries_subjects"], touched, adjust)
    return {**state, **dict(zip(index.INDEX_TABLES, (new.terms, new.documents, new.vocabulary)))}


def recommend(state: Catalogue, as_of, all: bool = False, per_domain: int = similar.PER_DOMAIN) -> Catalogue:
    """Recompute the recommendations and buckets of the entries that are due."""
    state = maintain_index(state)
    entries, docs = state["entries"], state["corpus"]
    work = cut(worksets.entries_to_recommend(entries, all))
    aggs = corpus.feed_aggregations(state["feeds"], state["aggregation_feeds"])
    kept = kept_index(state)
    postings = index.postings(kept)
    queries = cut(similar.query_terms(postings.join(work, "id", "left_semi")))
    # Only postings of asked terms can score; what is stored follows the work of the run.
    asked = cut(postings.join(queries.select("lang", "term").distinct(), ["lang", "term"], "left_semi"))
    members = corpus.members_of(docs, aggs, GLOBAL_AGGREGATION)
    hits = similar.similar_entries(queries, asked, index.document_lengths(kept), members)
    fresh = cut(similar.select_recommendations(hits, entries, per_domain))

    stored = snapshots.upsert_recommendations(state["recommendations"], fresh)
    listed = cut(stored.join(fresh.select(*snapshots.PAIR), snapshots.PAIR, "left_semi").select(*stored.columns))
    lists = cut(buckets.bucket_json(buckets.bucketize(listed), entries, state["feeds"]))
    state["recommendations"] = snapshots.drop_stale_recommendations(stored, fresh)
    redone = fresh.select("entry_id").distinct()
    state["buckets"] = (
        state["buckets"].join(redone, "entry_id", "left_anti").unionByName(lists)
        .select("entry_id", *buckets.BUCKETS)
    )
    state["entries"] = snapshots.stamp_processed(entries, work, "relevance_calculated_at", as_of)
    return state


def add_subjects(state: Catalogue, work: DataFrame) -> Catalogue:
    """Replace the generated subjects of the given entries that are short of subjects."""
    state = dict(state)
    kept = cut(subjects.drop_autogenerated(state["entries_subjects"], work))
    gap = subjects.subject_gap(work, kept)
    existing = kept.join(state["subjects"].withColumnRenamed("id", "subject_id"), "subject_id").select(
        F.col("entry_id").alias("id"), "name"
    )
    added = cut(subjects.generate_subjects(corpus.tag_terms(corpus.corpus_fields(state["corpus"])), gap, existing))
    state["subjects"] = cut(snapshots.get_or_create_subjects(state["subjects"], added))
    rows = added.join(state["subjects"], "name").select(
        "entry_id", F.col("id").alias("subject_id"), F.lit(True).alias("autogenerated")
    )
    state["entries_subjects"] = cut(kept.unionByName(rows).select("entry_id", "subject_id", "autogenerated"))
    return state


def update_clouds(state: Catalogue, depth: int = 3) -> Catalogue:
    """Rebuild the clouds of every language up to ``depth``; other stored clouds stay."""
    state = dict(state)
    entries = state["entries"].withColumnRenamed("lang", "language_id")
    new = tagcloud.tag_clouds(entries, state["entries_subjects"], state["subjects"], depth)
    state["tag_clouds"] = cut(
        snapshots.replace_tag_clouds(state["tag_clouds"], cut(new.select(*state["tag_clouds"].columns)))
    )
    return state


def run_incremental(state: Catalogue, changes: DataFrame, as_of, keep: Callable[[Catalogue], Catalogue] = settle) -> Catalogue:
    """Harvest, index and recommend what changed.

    ``keep`` stores the result: all of it (``settle``), or what changed (``write_snapshot``).
    """
    state = {**state, "entries": harvest(state["entries"], cut(changes))}
    return keep(recommend(maintain_corpus(state, as_of), as_of))


def run_full(state: Catalogue, changes: DataFrame, as_of, depth: int = 3) -> Catalogue:
    """Harvest, index, recommend, generate subjects and rebuild the clouds, for all entries.

    Subjects are joined to the corpus when its terms are counted, so new ones need
    no second indexing.  Subjects are generated for the entries recommended in this run; asking for
    their stamps afterwards would find none, because recommending renews them.
    """
    state = {**state, "entries": cut(harvest(state["entries"], changes))}
    state = settle(maintain_corpus(state, as_of, all=True))
    work = cut(worksets.entries_to_recommend(state["entries"], all=True))
    state = settle(recommend(state, as_of, all=True))
    return update_clouds(add_subjects(state, work), depth)


def run_bootstrap(state: Catalogue, changes: DataFrame, as_of, n: int = BOOTSTRAP_ENTRIES) -> Catalogue:
    """A first run that works on ``n`` entries, with the top-level clouds only.

    All changes become entries; those beyond ``n`` keep the stamps of entries that
    were never processed and are due in the next run.
    """
    entries, changes = state["entries"], cut(changes)
    arrived = changes.select("id").distinct()
    ids = entries.select("id").join(arrived, "id", "left_anti").unionByName(arrived)
    chosen = cut(worksets.bootstrap_limit(ids, n))

    def harvested(how: str) -> DataFrame:
        return harvest(entries.join(chosen, "id", how), changes.join(chosen, "id", how))

    # Only the chosen entries are stored for the run; the texts of all others are written once, with the result.
    state = {**state, "entries": cut(harvested("left_semi"))}
    state = settle(maintain_corpus(state, as_of))
    work = cut(worksets.entries_to_recommend(state["entries"]))
    state = update_clouds(add_subjects(settle(recommend(state, as_of)), work), depth=1)
    return {**state, "entries": cut(state["entries"].unionByName(harvested("left_anti")))}


def refresh_personal(state: Catalogue, tables: Catalogue, as_of, weekly: bool = False) -> DataFrame:
    """Authorship attentions, then new recommendations for all users that need some."""
    entries = state["entries"]
    written = personal.authorship_attentions(entries, tables["identity_feeds"], tables["attentions"])
    columns = written.columns
    attentions = cut(tables["attentions"].select(*columns).unionByName(written))
    return personal.refresh_personal(
        tables["users"], tables["personal_recommendations"], attentions, tables["attention_types"],
        state["recommendations"], entries, as_of, weekly,
    )


def refresh_queries(queries: DataFrame, taggings: DataFrame, all_subjects: DataFrame) -> DataFrame:
    """Query suggestions after taking over the current popularity of the subjects."""
    return snapshots.upsert_queries(queries, popularity.subject_popularity(taggings, all_subjects))
