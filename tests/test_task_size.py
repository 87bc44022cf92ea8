"""Tasks that split texts hold a bounded amount of them."""

from pyspark.sql import functions as F

from shelfmark.operators import clustering, corpus
from shelfmark.plans import catalog


def test_terms_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    monkeypatch.setattr(corpus, "TASK_CHARACTERS", 1_000, raising=False)
    words = "alpha beta gamma delta " * 10
    fields = spark.range(100).select("id", F.lit("en").alias("lang"), F.lit("title").alias("field"), F.lit(words).alias("value"))
    got = corpus.weighted_terms(fields)
    assert got.groupBy("id").count().filter("count = 4").count() == 100
    assert got.agg(F.sum("tf")).first()[0] == 100 * 40 * 3
    per_task = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert per_task <= 20


def test_tokens_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(clustering, "TASK_TOKENS", 50, raising=False)
    tokens = spark.range(100).select("id", F.array(F.lit("one"), F.lit("two"), F.lit("one")).alias("tokens"))
    got = clustering.token_counts(tokens)
    assert sorted(map(tuple, got.filter("id = 7").collect())) == [(7, "one", 2), (7, "two", 1)]
    per_task = got.groupBy(F.spark_partition_id()).agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert per_task < 60


def test_vectors_of_blocks_equal_those_of_moved_counts(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BLOCK_CHARACTERS", 1_500, raising=False)
    words = ["new york", "harbour", "rain and snow", "x1", "light", "stone river", "q", "late"]
    text = lambda i: " ".join(words[(i * k + k // 3) % (len(words) - i % 3)] for k in range(i % 40)) or None
    docs = spark.createDataFrame([(i, f"Title {i} ", text(i)) for i in range(120)] + [(7, "Twice ", "rain again")],
                                 "id bigint, title string, description string")
    tokens = clustering.cut(clustering.document_tokens(docs))
    grams = clustering.cut(clustering.document_grams(tokens, clustering.collocations(tokens, 3, 5.0)))
    want = {(r.id, r.term): round(r.weight, 9) for r in clustering.tfidf_vectors(grams, 121, 4, 60).collect()}
    got = clustering.cut(clustering.block_vectors(docs, 121, min_support=3, min_llr=5.0, min_df=4, max_df_pct=60))
    assert {(r.id, r.term): round(r.weight, 9) for r in got.collect()} == want
    assert any(" " in term for _, term in want) and any(" " not in term for _, term in want)
    assert clustering.document_blocks(docs)[1] > 5


def test_weights_do_not_move_the_counts_of_documents(spark):
    plan = catalog.queries()["tfidf_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" not in plan and "hashpartitioning(term" not in plan


def test_texts_of_the_corpus_stay_where_they_are_read(spark, monkeypatch):
    docs = spark.range(60).select(
        "id", F.lit("en").alias("lang"), (F.col("id") % 4).alias("feed_id"), F.lit("link").alias("permalink"),
        F.lit(None).cast("string").alias("direct_link"), F.lit("title").alias("title"), F.lit("text").alias("description"),
        F.lit("course").alias("grain_size")).repartition(3)
    feeds = spark.createDataFrame([(0, "a"), (1, None), (2, "c")], "id bigint, short_title string")
    joined = lambda: corpus.build_corpus(docs, feeds)
    assert "hashpartitioning(feed_id" not in joined()._jdf.queryExecution().executedPlan().toString()
    few = sorted(joined().collect())
    monkeypatch.setattr(corpus, "BROADCAST_ROWS", 2)  # too many feeds to send
    assert sorted(joined().collect()) == few and len(few) == 45


def test_empty_texts_have_no_vectors(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "a", "of")], "id bigint, title string, description string")
    assert clustering.block_vectors(docs, 2, min_df=1).collect() == []
    assert clustering.block_vectors(docs.limit(0), 0).collect() == []
