"""Registered queries over the catalogue views, each with the SQL that checks it.

A query takes ``t``, a function from table name to DataFrame.  The checking SQL
is written from the definition of each operator, not from its Spark plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions import scoring, text
from shelfmark.functions.lineage import cut
from shelfmark.operators import (
    bipartite, buckets, clustering, collaborative, corpus, personal, popularity, similar, snapshots, subjects,
    tagcloud, worksets,
)
from shelfmark.plans import runs
from shelfmark.session import apply_settings
from shelfmark.plans.views import AS_OF, GLOBAL_AGGREGATION, VIEWS, oracle_text, view

Tables = Callable[[str], DataFrame]

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

NOW = f"timestamp '{AS_OF}'"


def query(sql: str | None = None, views: str = "", ctes: tuple[str, ...] = (), instead: dict[str, str] | None = None):
    """Register a query; ``ctes`` names the shared expressions of ``_CTES`` the SQL reads, ``instead`` replaces some."""

    def register(fn):
        name = fn.__name__
        _QUERIES[name] = fn
        if sql is not None:
            extra = {c: _CTES[c] for c in _CTES if c in _needed(ctes)} | (instead or {})
            wanted = set(views.split())
            for c in extra:
                wanted |= set(_CTE_VIEWS.get(c, "").split())
            _ORACLE[name] = oracle_text(sql, *sorted(wanted), extra=extra)
        return fn

    return register


def _needed(names) -> set[str]:
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo.extend(_CTE_DEPENDS.get(name, ()))
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(lambda name: view(spark, sf_dir, name))

        return run

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# --------------------------------------------------------------------------
# Shared expressions of the checking SQL

_LANGUAGES = ", ".join(f"'{c}'" for c in corpus.ANALYZER_LANGUAGES)
_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOP_WORDS)
_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_NORM_TITLE = r"coalesce(regexp_replace({0}, ',[^,]*\z', ''), '')"
_DOMAIN = "CASE WHEN strpos(substr({0}, 11), '/') > 0 THEN substr({0}, 1, strpos(substr({0}, 11), '/') + 9) ELSE {0} END"


def _decay(column: str) -> str:
    return f"(10 - 9 / (1 + exp(10 - date_diff('day', cast({column} AS date), date '{AS_OF[:10]}'))))"


_CTES = {
    "corpus": f"""
SELECT e.id, e.lang, e.feed_id, e.permalink, coalesce(e.direct_link, '') AS direct_link, e.title, e.description,
       coalesce(f.short_title, '') AS collection, e.grain_size
FROM entries e JOIN feeds f ON f.id = e.feed_id
WHERE e.lang IN ({_LANGUAGES}) AND e.title IS NOT NULL AND e.description IS NOT NULL
  AND e.permalink IS NOT NULL AND e.grain_size IS NOT NULL""",
    "fields": """
SELECT id, lang, 'title' AS field, title AS value FROM corpus
UNION ALL SELECT id, lang, 'description', description FROM corpus
UNION ALL SELECT c.id, c.lang, CASE WHEN es.autogenerated THEN 'generated_subject' ELSE 'subject' END, s.name
FROM corpus c JOIN entries_subjects es ON es.entry_id = c.id JOIN subjects s ON s.id = es.subject_id
UNION ALL SELECT c.id, c.lang, 'aggregation', cast(a.aggregation_id AS varchar)
FROM corpus c JOIN aggregation_feeds a ON a.feed_id = c.feed_id""",
    "terms": f"""
SELECT id, lang, term, cast(sum(w) AS bigint) AS tf
FROM (SELECT id, lang, CASE field WHEN 'title' THEN 3 WHEN 'description' THEN 1 ELSE 2 END AS w,
             unnest({_TOKENS.format('value')}) AS term
      FROM fields WHERE field IN ('title', 'description', 'subject')) x
GROUP BY id, lang, term""",
    "tag_terms": f"""
SELECT id, lang, term, cast(sum(w) AS bigint) AS tf
FROM (SELECT id, lang, CASE field WHEN 'title' THEN 3 ELSE 1 END AS w, unnest({_TOKENS.format('value')}) AS term
      FROM fields WHERE field IN ('title', 'description')) x
GROUP BY id, lang, term""",
    "postings": """
SELECT t.lang, t.id, t.term, t.tf, l.doc_length, v.df, ln(n.n_docs / (v.df + 1)) + 1 AS idf
FROM terms t
JOIN (SELECT id, cast(sum(tf) AS bigint) AS doc_length FROM terms GROUP BY id) l ON l.id = t.id
JOIN (SELECT lang, count(DISTINCT id) AS n_docs FROM terms GROUP BY lang) n ON n.lang = t.lang
JOIN (SELECT lang, term, count(*) AS df FROM terms GROUP BY lang, term) v ON v.lang = t.lang AND v.term = t.term
WHERE v.df >= 2 AND length(t.term) >= CASE WHEN t.lang IN ('zh', 'ja') THEN 1 ELSE 4 END""",
    "best_terms": """
SELECT lang, id, term, tf, df, idf, weight, weight / max(weight) OVER (PARTITION BY lang, id) AS boost
FROM (SELECT *, tf * idf AS weight,
             row_number() OVER (PARTITION BY lang, id ORDER BY round(tf * idf, 9) DESC, term) AS r FROM postings) x
WHERE r <= 25""",
    "hits": f"""
SELECT src, dst, position, score / greatest(1.0, max(score) OVER (PARTITION BY src)) AS relevance
FROM (SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS position
      FROM (SELECT q.id AS src, p.id AS dst,
                   count(*) / max(n.terms) * sum(q.boost * q.idf * q.idf * sqrt(p.tf)) / sqrt(max(p.doc_length)) / max(n.norm)
                   AS score
            FROM best_terms q
            JOIN (SELECT id, count(*) AS terms, sqrt(sum(boost * idf * boost * idf)) AS norm FROM best_terms GROUP BY id) n
              ON n.id = q.id
            JOIN postings p ON p.lang = q.lang AND p.term = q.term
            WHERE p.id IN (SELECT c.id FROM corpus c JOIN aggregation_feeds a ON a.feed_id = c.feed_id
                           WHERE a.aggregation_id = {GLOBAL_AGGREGATION})
            GROUP BY q.id, p.id) s) r
WHERE position <= 100""",
    "candidates": f"""
SELECT src, dst, relevance, starts_with(uri, {_DOMAIN.format('src_uri')}) AS same,
       list_filter([title_key, uri, direct], lambda x: x IS NOT NULL) AS keys,
       list_filter([src_uri, src_direct], lambda x: x IS NOT NULL) AS seeds, position,
       row_number() OVER (PARTITION BY src ORDER BY position) AS n
FROM (SELECT h.src, h.dst, h.position, h.relevance, d.permalink AS uri, nullif(d.direct_link, '') AS direct,
             {_NORM_TITLE.format('d.title')} AS title_key, s.permalink AS src_uri,
             nullif(s.direct_link, '') AS src_direct, {_NORM_TITLE.format('s.title')} AS src_key
      FROM hits h JOIN entries d ON d.id = h.dst JOIN entries s ON s.id = h.src
      WHERE h.src <> h.dst AND d.title IS NOT NULL AND d.permalink IS NOT NULL) c
WHERE NOT (round(relevance, 9) > 0.99 AND title_key = src_key)""",
    "bucketed": """
SELECT r.*, CASE WHEN clicks >= click_threshold THEN 'popular'
                 WHEN round(relevance, 9) > round(relevance_threshold, 9) THEN 'relevant' ELSE 'other' END AS bucket
FROM recommendations r JOIN (
  SELECT entry_id, avg(relevance) + stddev_pop(relevance) AS relevance_threshold,
         greatest(5, floor(round(avg(clicks) + stddev_pop(clicks), 9) + 0.5)) AS click_threshold
  FROM recommendations GROUP BY entry_id) t USING (entry_id)""",
    "cells": """
SELECT a.attentionable_id AS user_id, a.entry_id, max(a.weight * t.default_weight) AS value
FROM attentions a JOIN attention_types t ON t.id = a.attention_type_id
GROUP BY a.attentionable_id, a.entry_id HAVING max(a.weight * t.default_weight) > 0""",
    "likeness": """
SELECT d.i, d.l, d.dot / greatest(least(a.s, b.s), 1e-9) AS su
FROM (SELECT x.user_id AS i, y.user_id AS l, sum(x.value * y.value) AS dot
      FROM cells x JOIN cells y ON x.entry_id = y.entry_id GROUP BY x.user_id, y.user_id) d
JOIN (SELECT user_id, sum(value) AS s FROM cells GROUP BY user_id) a ON a.user_id = d.i
JOIN (SELECT user_id, sum(value) AS s FROM cells GROUP BY user_id) b ON b.user_id = d.l""",
    "cf": """
SELECT n.i AS user_id, n.entry_id, n.weighted / greatest(m.mass, 1e-9) AS score
FROM (SELECT k.i, c.entry_id, sum(k.su * c.value) AS weighted
      FROM likeness k JOIN cells c ON c.user_id = k.l GROUP BY k.i, c.entry_id) n
JOIN (SELECT i, sum(su) AS mass FROM likeness GROUP BY i) m ON m.i = n.i""",
    "scf": """
SELECT user_id, entry_id, max(score) AS score
FROM (SELECT user_id, entry_id, score FROM cf
      UNION ALL SELECT c.user_id, r.dest_entry_id, c.score * r.relevance
      FROM cf c JOIN recommendations r ON r.entry_id = c.entry_id AND r.dest_entry_id <> r.entry_id) x
GROUP BY user_id, entry_id HAVING max(score) > 0""",
    "edges": "SELECT user_id, movie_id, count(*) AS n FROM ratings WHERE rate >= 3 GROUP BY user_id, movie_id",
    "diffusion": """
SELECT i.user_id, o.movie_id AS entry_id, sum(1.0 / k.d / u.d) AS score
FROM edges i JOIN edges v ON v.movie_id = i.movie_id JOIN edges o ON o.user_id = v.user_id
JOIN (SELECT movie_id, sum(n) AS d FROM edges GROUP BY movie_id) k ON k.movie_id = i.movie_id
JOIN (SELECT user_id, sum(n) AS d FROM edges GROUP BY user_id) u ON u.user_id = v.user_id
GROUP BY i.user_id, o.movie_id""",
    "decayed": f"""
SELECT a.attentionable_id AS user_id, r.dest_entry_id,
       max(a.weight * t.default_weight * r.relevance * {_decay('a.created_at')} * {_decay('e.published_at')}) AS score
FROM attentions a JOIN attention_types t ON t.id = a.attention_type_id
JOIN recommendations r ON r.entry_id = a.entry_id JOIN entries e ON e.id = r.entry_id
WHERE a.attentionable_type = 'User'
GROUP BY a.attentionable_id, r.dest_entry_id""",
    "due_daily": f"""
SELECT id FROM (SELECT p.personal_recommendable_id AS id, max(date_diff('day', cast(p.created_at AS date), cast({NOW} AS date))) AS age
                FROM personal_recommendations p JOIN users u ON u.id = p.personal_recommendable_id
                WHERE p.visited_at IS NULL GROUP BY p.personal_recommendable_id) x
WHERE age > 1 AND id IN (SELECT id FROM users WHERE date_diff('day', cast(last_request_at AS date), cast({NOW} AS date)) < 7)
UNION
SELECT id FROM users u WHERE NOT EXISTS (SELECT 1 FROM personal_recommendations p WHERE p.personal_recommendable_id = u.id)
  AND id IN (SELECT attentionable_id FROM attentions GROUP BY attentionable_id HAVING count(*) > 5)""",
    "due_weekly": f"""
SELECT id FROM (SELECT p.personal_recommendable_id AS id, max(date_diff('day', cast(p.created_at AS date), cast({NOW} AS date))) AS age
                FROM personal_recommendations p JOIN users u ON u.id = p.personal_recommendable_id
                WHERE p.visited_at IS NULL GROUP BY p.personal_recommendable_id) x
WHERE age > 7 AND id IN (SELECT id FROM users WHERE date_diff('day', cast(last_request_at AS date), cast({NOW} AS date)) < 30)
UNION
SELECT id FROM users u WHERE NOT EXISTS (SELECT 1 FROM personal_recommendations p WHERE p.personal_recommendable_id = u.id)
  AND id IN (SELECT attentionable_id FROM attentions GROUP BY attentionable_id HAVING count(*) > 5)""",
    "grains": """
SELECT id, language_id, 'all' AS grain_size FROM item_entries
UNION ALL SELECT id, language_id, 'course' FROM item_entries WHERE grain_size = 'course'""",
    "cloud1": """
SELECT *, min(freq) OVER (PARTITION BY language_id, grain_size) AS cloud_min,
          max(freq) OVER (PARTITION BY language_id, grain_size) AS cloud_max, true AS shown
FROM (SELECT g.language_id, g.grain_size, '' AS filter, s.name AS tag, count(*) AS freq,
             row_number() OVER (PARTITION BY g.language_id, g.grain_size ORDER BY count(*) DESC, s.name) AS r
      FROM grains g JOIN entries_subjects es ON es.entry_id = g.id JOIN subjects s ON s.id = es.subject_id
      GROUP BY g.language_id, g.grain_size, s.id, s.name) x WHERE r <= 200""",
    "cloud2": """
SELECT *, min(freq) OVER (PARTITION BY language_id, grain_size, filter) AS cloud_min,
          max(freq) OVER (PARTITION BY language_id, grain_size, filter) AS cloud_max, NOT contains(filter, tag) AS shown
FROM (SELECT g.language_id, g.grain_size, s0.name AS filter, s.name AS tag, count(*) AS freq,
             row_number() OVER (PARTITION BY g.language_id, g.grain_size, s0.name ORDER BY count(*) DESC, s.name) AS r
      FROM grains g JOIN entries_subjects es0 ON es0.entry_id = g.id JOIN subjects s0 ON s0.id = es0.subject_id
      JOIN entries_subjects es ON es.entry_id = g.id JOIN subjects s ON s.id = es.subject_id
      WHERE EXISTS (SELECT 1 FROM cloud1 c WHERE c.language_id = g.language_id AND c.grain_size = g.grain_size AND c.tag = s0.name)
      GROUP BY g.language_id, g.grain_size, s0.name, s.id, s.name) x WHERE r <= 50""",
    "tag_pairs": """
SELECT DISTINCT language_id, grain_size, least(filter, tag) AS a, greatest(filter, tag) AS b FROM cloud2 WHERE shown""",
    "cloud3": """
SELECT *, min(freq) OVER (PARTITION BY language_id, grain_size, filter) AS cloud_min,
          max(freq) OVER (PARTITION BY language_id, grain_size, filter) AS cloud_max, NOT contains(filter, tag) AS shown
FROM (SELECT g.language_id, g.grain_size, concat(p.a, '/', p.b) AS filter, s.name AS tag, count(*) AS freq,
             row_number() OVER (PARTITION BY g.language_id, g.grain_size, p.a, p.b ORDER BY count(*) DESC, s.name) AS r
      FROM tag_pairs p JOIN grains g ON g.language_id = p.language_id AND g.grain_size = p.grain_size
      JOIN subjects s0 ON s0.name = p.a JOIN entries_subjects es0 ON es0.entry_id = g.id AND es0.subject_id = s0.id
      JOIN subjects s1 ON s1.name = p.b JOIN entries_subjects es1 ON es1.entry_id = g.id AND es1.subject_id = s1.id
      JOIN entries_subjects es ON es.entry_id = g.id JOIN subjects s ON s.id = es.subject_id
      GROUP BY g.language_id, g.grain_size, p.a, p.b, s.id, s.name) x WHERE r <= 50""",
    "popular_subjects": """
SELECT n.subject_id, s.name, cast(floor(n.n * 100.0 / max(n.n) OVER ()) AS int) AS frequency
FROM (SELECT subject_id, count(*) AS n FROM taggings GROUP BY subject_id) n JOIN subjects s ON s.id = n.subject_id""",
    "cleaned": f"""
SELECT id, list_filter({_TOKENS.format("concat(title, description)")},
       lambda t: length(t) >= 3 AND regexp_matches(t, '^[a-z]+$') AND t NOT IN ({_STOP})) AS tokens
FROM entries""",
    "words": "SELECT id, unnest(tokens) AS gram FROM cleaned",
    "neighbours": """
SELECT id, tokens[i] AS head, tokens[i + 1] AS tail
FROM (SELECT id, tokens, unnest(range(1, len(tokens))) AS i FROM cleaned) x""",
    "pair_counts": "SELECT head, tail, count(*) AS freq FROM neighbours GROUP BY head, tail",
    "pair_tables": """
SELECT p.head, p.tail, p.freq AS k11, h.n - p.freq AS k12, t.n - p.freq AS k21, s.n - h.n - t.n + p.freq AS k22, s.n AS n
FROM pair_counts p JOIN (SELECT head, sum(freq) AS n FROM pair_counts GROUP BY head) h ON h.head = p.head
JOIN (SELECT tail, sum(freq) AS n FROM pair_counts GROUP BY tail) t ON t.tail = p.tail
CROSS JOIN (SELECT sum(freq) AS n FROM pair_counts) s WHERE p.freq >= 2""",
    "grams": """
SELECT gram, count(*) AS freq, cast(NULL AS double) AS llr FROM words GROUP BY gram HAVING count(*) >= 2
UNION ALL
SELECT concat(head, ' ', tail), k11, llr FROM (
  SELECT *, 2 * (k11 * ln(k11 * n / ((k11 + k12) * (k11 + k21)))
    + CASE WHEN k12 > 0 THEN k12 * ln(k12 * n / ((k11 + k12) * (k12 + k22))) ELSE 0 END
    + CASE WHEN k21 > 0 THEN k21 * ln(k21 * n / ((k21 + k22) * (k11 + k21))) ELSE 0 END
    + CASE WHEN k22 > 0 THEN k22 * ln(k22 * n / ((k21 + k22) * (k12 + k22))) ELSE 0 END) AS llr
  FROM (SELECT head, tail, cast(k11 AS double) AS k11, cast(k12 AS double) AS k12, cast(k21 AS double) AS k21,
               cast(k22 AS double) AS k22, cast(n AS double) AS n FROM pair_tables) d) x
WHERE round(llr, 9) >= 50""",
    "doc_grams": """
SELECT x.id, x.gram AS term, count(*) AS tf
FROM (SELECT id, gram FROM words UNION ALL SELECT id, concat(head, ' ', tail) FROM neighbours) x
WHERE x.gram IN (SELECT gram FROM grams) GROUP BY x.id, x.gram""",
    "vecs": """
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
  SELECT g.id, g.term, sqrt(g.tf) * (ln(n.n / (v.df + 1)) + 1) AS w
  FROM doc_grams g JOIN (SELECT term, count(*) AS df FROM doc_grams GROUP BY term) v ON v.term = g.term
  CROSS JOIN (SELECT count(*) AS n FROM cleaned) n
  WHERE v.df >= 5 AND v.df * 100 <= n.n * 80) x""",
    "attended": """
SELECT DISTINCT a.attentionable_id AS user_id, a.entry_id AS id
FROM attentions a JOIN entries e ON e.id = a.entry_id WHERE a.attentionable_type = 'User'""",
}

_CTE_DEPENDS = {
    "fields": ("corpus",), "terms": ("fields",), "tag_terms": ("fields",), "postings": ("terms",),
    "best_terms": ("postings",), "hits": ("best_terms", "corpus"), "candidates": ("hits",),
    "likeness": ("cells",), "cf": ("likeness",), "scf": ("cf",), "diffusion": ("edges",),
    "cloud1": ("grains",), "cloud2": ("cloud1",), "tag_pairs": ("cloud2",), "cloud3": ("tag_pairs",),
    "words": ("cleaned",), "neighbours": ("cleaned",), "pair_counts": ("neighbours",),
    "pair_tables": ("pair_counts",), "grams": ("words", "pair_tables"), "doc_grams": ("grams", "neighbours"), "vecs": ("doc_grams", "cleaned"),
}
_CTE_VIEWS = {
    "corpus": "entries feeds", "fields": "entries_subjects subjects aggregation_feeds", "hits": "aggregation_feeds",
    "candidates": "entries", "bucketed": "recommendations", "cells": "attentions attention_types",
    "scf": "recommendations", "edges": "ratings", "decayed": "attentions attention_types recommendations entries",
    "due_daily": "personal_recommendations users attentions", "due_weekly": "personal_recommendations users attentions",
    "grains": "item_entries", "cloud1": "entries_subjects subjects", "cloud2": "entries_subjects subjects",
    "cloud3": "entries_subjects subjects", "popular_subjects": "taggings subjects", "cleaned": "entries", "attended": "attentions entries",
}


# --------------------------------------------------------------------------
# Pieces shared by several queries


def _fields(t: Tables) -> DataFrame:
    return corpus.corpus_fields(_corpus(t), t("subjects"), t("entries_subjects"), _feed_aggs(t))


def _corpus(t: Tables) -> DataFrame:
    return corpus.build_corpus(t("entries"), t("feeds"))


def _feed_aggs(t: Tables) -> DataFrame:
    return corpus.feed_aggregations(t("feeds"), t("aggregation_feeds"))


def _postings(t: Tables) -> DataFrame:
    return _index(t)[0]


def _index(t: Tables) -> tuple[DataFrame, DataFrame]:
    terms = cut(corpus.weighted_terms(_fields(t)))
    lengths = cut(similar.document_lengths(terms))
    return similar.index_postings(terms, lengths), lengths


def _hits(t: Tables) -> DataFrame:
    postings, lengths = _index(t)
    postings = cut(postings)  # the stored index, read several times
    members = corpus.members_of(_corpus(t), _feed_aggs(t), GLOBAL_AGGREGATION)
    return similar.similar_entries(similar.query_terms(postings), postings, lengths, members)


def _bucketed(t: Tables) -> DataFrame:
    return buckets.bucketize(t("recommendations"))


def _cells(t: Tables) -> DataFrame:
    return cut(collaborative.attention_matrix(t("attentions"), t("attention_types")))


def _cf(t: Tables) -> DataFrame:
    return collaborative.cf_scores(_cells(t))


def _scf(t: Tables) -> DataFrame:
    return collaborative.scf_scores(_cf(t), t("recommendations"))


def _diffusion(t: Tables) -> DataFrame:
    return bipartite.bipartite_scores(t("ratings"))


def _decayed(t: Tables) -> DataFrame:
    return personal.decayed_scores(t("attentions"), t("attention_types"), t("recommendations"), t("entries"), AS_OF)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Sums of powers of two and a decay at exactly ten days (5.5) end on a rounding
# limit; a small step off it makes both engines round the same way.
_STEP = 1e-9


def _items(t: Tables):
    return t("item_entries"), t("entries_subjects"), t("subjects")


def _tokens(t: Tables) -> DataFrame:
    return cut(clustering.document_tokens(t("entries")))


def _vectors(t: Tables) -> DataFrame:
    return clustering.block_vectors(t("entries"), t("entries").agg(F.count(F.lit(1))).scalar())


# --------------------------------------------------------------------------
# Work-sets


@query("SELECT id FROM entries WHERE harvested_at > indexed_at", "entries")
def entries_to_index(t):
    return worksets.entries_to_index(t("entries"))


@query("""SELECT id FROM entries WHERE permalink_good AND oai_identifier <> 'deleted'
AND indexed_at > relevance_calculated_at""", "entries")
def entries_to_recommend(t):
    return worksets.entries_to_recommend(t("entries"))


@query("SELECT id FROM entries WHERE permalink_good AND oai_identifier <> 'deleted'", "entries")
def entries_to_recommend_all(t):
    return worksets.entries_to_recommend(t("entries"), all=True)


@query("""SELECT id, lang, coalesce(oai_identifier = 'deleted', false) AS is_deleted FROM entries
WHERE oai_identifier = 'deleted' OR NOT permalink_good""", "entries")
def deleted_entries(t):
    return worksets.deleted_entries(t("entries"))


@query("""SELECT id, lang FROM entries WHERE permalink_good AND oai_identifier <> 'deleted'
AND indexed_at > relevance_calculated_at""", "entries")
def entries_to_tag(t):
    return worksets.entries_to_tag(t("entries"))


def _due(t, weekly):
    return worksets.users_needing_recs(
        t("users"), t("personal_recommendations"), t("attentions"), AS_OF, weekly=weekly
    )


@query("SELECT id, 20 AS quota FROM due_daily", ctes=("due_daily",))
def users_needing_recs_daily(t):
    return _due(t, False)


@query("SELECT id, 20 AS quota FROM due_weekly", ctes=("due_weekly",))
def users_needing_recs_weekly(t):
    return _due(t, True)


@query("""SELECT personal_recommendable_id AS id, 20 - count(*) AS recs_needed FROM personal_recommendations
WHERE visited_at IS NULL AND personal_recommendable_id IN
  (SELECT attentionable_id FROM attentions GROUP BY attentionable_id HAVING count(*) > 5)
GROUP BY personal_recommendable_id HAVING count(*) < 20""", "personal_recommendations attentions")
def recs_quota(t):
    return worksets.recs_quota(t("personal_recommendations"), t("attentions"), t("users"))


@query("SELECT id, lang, feed_id FROM entries ORDER BY id LIMIT 200", "entries")
def bootstrap_limit(t):
    return worksets.bootstrap_limit(t("entries")).select("id", "lang", "feed_id")


# --------------------------------------------------------------------------
# Table states


_NEW_PAIRS = """(SELECT n.*, row_number() OVER (ORDER BY md5(concat(n.entry_id, '|', n.dest_entry_id))) AS k
FROM fresh_recommendations n WHERE NOT EXISTS
  (SELECT 1 FROM recommendations o WHERE o.entry_id = n.entry_id AND o.dest_entry_id = n.dest_entry_id))"""


@query(f"""SELECT o.id, o.entry_id, o.dest_entry_id, cast(coalesce(n.rank, o.rank) AS int) AS rank,
       round(coalesce(n.relevance, o.relevance), 6) AS relevance, o.clicks, o.avg_time_at_dest
FROM recommendations o LEFT JOIN fresh_recommendations n ON n.entry_id = o.entry_id AND n.dest_entry_id = o.dest_entry_id
UNION ALL
SELECT (SELECT max(id) FROM recommendations) + k, entry_id, dest_entry_id, cast(rank AS int), relevance, 0, 60
FROM {_NEW_PAIRS} x""", "recommendations fresh_recommendations")
def upsert_recommendations(t):
    state = snapshots.upsert_recommendations(t("recommendations"), t("fresh_recommendations"))
    return _rounded(state, "relevance")


@query("""SELECT o.id, o.entry_id, o.dest_entry_id FROM recommendations o
WHERE NOT EXISTS (SELECT 1 FROM fresh_recommendations n WHERE n.entry_id = o.entry_id)
   OR EXISTS (SELECT 1 FROM fresh_recommendations n WHERE n.entry_id = o.entry_id AND n.dest_entry_id = o.dest_entry_id)
""", "recommendations fresh_recommendations")
def drop_stale_recommendations(t):
    return snapshots.drop_stale_recommendations(t("recommendations"), t("fresh_recommendations")).select(
        "id", "entry_id", "dest_entry_id"
    )


_GONE = "(SELECT id FROM entries WHERE oai_identifier = 'deleted' OR NOT permalink_good)"


@query(f"""SELECT id, entry_id, dest_entry_id FROM recommendations
WHERE entry_id NOT IN {_GONE} AND dest_entry_id NOT IN {_GONE}""", "recommendations entries")
def delete_involving(t):
    kept = snapshots.delete_involving(t("recommendations"), worksets.deleted_entries(t("entries")))
    return kept.select("id", "entry_id", "dest_entry_id")


@query("SELECT id, permalink_good FROM entries WHERE oai_identifier IS NULL OR oai_identifier <> 'deleted'", "entries")
def delete_entries(t):
    return snapshots.delete_entries(t("entries")).select("id", "permalink_good")


@query(f"""SELECT id, CASE WHEN harvested_at > indexed_at THEN {NOW} ELSE indexed_at END AS indexed_at FROM entries""",
       "entries")
def stamp_processed(t):
    entries = t("entries")
    stamped = snapshots.stamp_processed(entries, worksets.entries_to_index(entries), "indexed_at", AS_OF)
    return stamped.select("id", "indexed_at")


@query(f"""SELECT id, CASE WHEN id IN (SELECT entry_id FROM recommendations WHERE dest_entry_id IN {_GONE})
THEN timestamp '1971-01-01 00:00:00' ELSE relevance_calculated_at END AS relevance_calculated_at FROM entries""",
       "entries recommendations")
def flag_for_recompute(t):
    entries = t("entries")
    flagged = snapshots.flag_for_recompute(entries, t("recommendations"), worksets.deleted_entries(entries))
    return flagged.select("id", "relevance_calculated_at")


@query(f"SELECT DISTINCT entry_id AS id FROM recommendations WHERE dest_entry_id IN {_GONE}", "recommendations entries")
def entries_pointing_at(t):
    return snapshots.entries_pointing_at(t("recommendations"), worksets.deleted_entries(t("entries")))


@query(f"""SELECT p.personal_recommendable_id AS user_id, p.destination_id AS entry_id,
       round(coalesce(s.score, p.relevance), 6) AS relevance, p.created_at
FROM personal_recommendations p LEFT JOIN wanted s ON s.user_id = p.personal_recommendable_id AND s.entry_id = p.destination_id
UNION ALL
SELECT user_id, entry_id, round(score, 6), {NOW} FROM wanted s WHERE NOT EXISTS
  (SELECT 1 FROM personal_recommendations p WHERE p.personal_recommendable_id = s.user_id AND p.destination_id = s.entry_id)
""".replace("wanted s", """(SELECT c.* FROM scf c WHERE score > 0 AND NOT EXISTS
  (SELECT 1 FROM attentions a WHERE a.attentionable_id = c.user_id AND a.entry_id = c.entry_id)) s"""),
       "personal_recommendations attentions", ctes=("scf",))
def upsert_personal(t):
    state = snapshots.upsert_personal(
        t("personal_recommendations"), _scf(t), collaborative.attended_pairs(t("attentions")), AS_OF
    )
    return state.select(
        F.col("personal_recommendable_id").alias("user_id"), F.col("destination_id").alias("entry_id"),
        F.round("relevance", 6).alias("relevance"), "created_at",
    )


@query("""SELECT personal_recommendable_id AS user_id, destination_id AS entry_id FROM personal_recommendations
WHERE visited_at IS NOT NULL OR personal_recommendable_id NOT IN (SELECT id FROM due_daily)""",
       "personal_recommendations", ctes=("due_daily",))
def delete_unvisited(t):
    kept = snapshots.delete_unvisited(t("personal_recommendations"), _due(t, False))
    return kept.select(
        F.col("personal_recommendable_id").alias("user_id"), F.col("destination_id").alias("entry_id")
    )


@query("""SELECT id, name FROM subjects UNION ALL
SELECT (SELECT max(id) FROM subjects) + row_number() OVER (ORDER BY md5(name)), name
FROM (SELECT DISTINCT split_part(title, ' ', 1) AS name FROM entries) n
WHERE name NOT IN (SELECT name FROM subjects)""", "subjects entries")
def get_or_create_subjects(t):
    names = t("entries").select(F.split_part("title", F.lit(" "), F.lit(1)).alias("name"))
    return snapshots.get_or_create_subjects(t("subjects"), names)


@query("""SELECT q.id, q.name, CASE WHEN q.frequency < 100 THEN coalesce(p.frequency, q.frequency) ELSE q.frequency END AS frequency
FROM queries_seed q LEFT JOIN popular_subjects p ON p.name = q.name
UNION ALL
SELECT (SELECT max(id) FROM queries_seed) + row_number() OVER (ORDER BY md5(name)), name, frequency
FROM popular_subjects WHERE name NOT IN (SELECT name FROM queries_seed)""", "queries_seed", ctes=("popular_subjects",))
def upsert_queries(t):
    return snapshots.upsert_queries(
        t("queries_seed"), popularity.subject_popularity(t("taggings"), t("subjects"))
    )


@query("""SELECT language_id, grain_size, filter, tag, freq FROM cloud1 WHERE grain_size = 'course'
UNION ALL SELECT language_id, grain_size, filter, tag, freq + 1 FROM cloud1 WHERE grain_size = 'all'""", ctes=("cloud1",))
def replace_tag_clouds(t):
    clouds = tagcloud.tag_cloud_level1(*_items(t)).select("language_id", "grain_size", "filter", "tag", "freq")
    rebuilt = clouds.filter(F.col("grain_size") == "all").withColumn("freq", F.col("freq") + 1)
    return snapshots.replace_tag_clouds(clouds, rebuilt)


# --------------------------------------------------------------------------
# Corpus


@query("""SELECT f.id AS feed_id, a.aggregation_id FROM feeds f LEFT JOIN aggregation_feeds a ON a.feed_id = f.id""",
       "feeds aggregation_feeds")
def feed_aggregations(t):
    return _feed_aggs(t)


@query("""SELECT id, lang, feed_id, permalink, direct_link, title, md5(description) AS description_md5, collection,
grain_size FROM corpus""", ctes=("corpus",))
def build_corpus(t):
    return _corpus(t).select(
        "id", "lang", "feed_id", "permalink", "direct_link", "title",
        F.md5("description").alias("description_md5"), "collection", "grain_size",
    )


@query("SELECT id, lang, field, md5(value) AS value_md5 FROM fields", ctes=("fields",))
def corpus_fields(t):
    return _fields(t).select("id", "lang", "field", F.md5("value").alias("value_md5"))


@query(f"""SELECT id, coalesce(lang IN ({_LANGUAGES}), false) AND title IS NOT NULL AND description IS NOT NULL
  AND permalink IS NOT NULL AND grain_size IS NOT NULL AS indexable,
  NOT coalesce(lang IN ({_LANGUAGES}), false) OR (title IS NOT NULL AND description IS NOT NULL
  AND permalink IS NOT NULL AND grain_size IS NOT NULL) AS stampable FROM entries""", "entries")
def corpus_validity(t):
    return corpus.corpus_validity(t("entries"))


@query("SELECT id, lang, term, tf FROM terms", ctes=("terms",))
def weighted_terms(t):
    return corpus.weighted_terms(_fields(t))


@query("SELECT id, lang, term, tf FROM tag_terms", ctes=("tag_terms",))
def tag_terms(t):
    return corpus.tag_terms(_fields(t))


@query("""SELECT id, lang, coalesce(s.stem, t.term) AS term, cast(sum(tf) AS bigint) AS tf
FROM terms t LEFT JOIN (SELECT * FROM stem_map WHERE term <> 'tion') s ON s.term = t.term
GROUP BY id, lang, coalesce(s.stem, t.term)""", "stem_map", ctes=("terms",))
def stemmed_terms(t):
    stems = t("stem_map")
    protected = stems.filter(F.col("term") == "tion").select("term")
    return corpus.stem_vocabulary(corpus.weighted_terms(_fields(t)), stems, protected)


@query("SELECT c.id, c.lang FROM corpus c WHERE c.id IN (SELECT id FROM entries WHERE oai_identifier = 'deleted')",
       "entries", ctes=("corpus",))
def index_orphans(t):
    return corpus.index_orphans(_corpus(t), snapshots.delete_entries(t("entries")))


@query(f"SELECT id, lang, title FROM corpus WHERE id NOT IN {_GONE}", "entries", ctes=("corpus",))
def corpus_after_delete(t):
    return corpus.remove_documents(_corpus(t), worksets.deleted_entries(t("entries"))).select("id", "lang", "title")


# --------------------------------------------------------------------------
# Scalar expressions


@query("""SELECT id, token, count(*) AS n FROM (SELECT id, unnest(tokens) AS token FROM cleaned) x
GROUP BY id, token""", ctes=("cleaned",))
def clean_tokens(t):
    return clustering.token_counts(_tokens(t))


@query(f"SELECT id, {_NORM_TITLE.format('title')} AS normalized_title FROM entries", "entries")
def normalized_title(t):
    return t("entries").select("id", text.normalized_title(F.col("title")).alias("normalized_title"))


@query(f"SELECT page_id, {_DOMAIN.format('url')} AS domain FROM pages")
def domain_of(t):
    return t("pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


@query("""SELECT id, i - 1 AS position, pieces[i] AS piece FROM (
  SELECT id, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (
    SELECT id, list_filter(list_transform(regexp_split_to_array(lower(title), '--|[:;,)(/".]'), lambda p: trim(p)),
                           lambda p: length(p) > 0) AS pieces FROM entries) a) b""", "entries")
def split_subjects(t):
    return t("entries").select(
        "id", F.posexplode(text.split_subjects(F.col("title"))).alias("position", "piece")
    ).select("id", F.col("position").cast("bigint").alias("position"), "piece")


@query(f"""SELECT id, round({_decay('published_at')}, 6) AS published_decay,
round({_decay('harvested_at')}, 6) AS harvested_decay FROM entries""", "entries")
def decay_curve(t):
    return t("entries").select(
        "id", F.round(scoring.decay(F.col("published_at"), AS_OF), 6).alias("published_decay"),
        F.round(scoring.decay(F.col("harvested_at"), AS_OF), 6).alias("harvested_decay"),
    )


# --------------------------------------------------------------------------
# Similar entries


@query("SELECT lang, id, term, tf, df, round(weight, 6) AS weight, round(boost, 6) AS boost FROM best_terms",
       ctes=("best_terms",))
def query_terms(t):
    best = similar.query_terms(_postings(t)).select("lang", "id", "term", "tf", "df", "weight", "boost")
    return _rounded(best, "weight", "boost")


@query("SELECT src, dst, position, round(relevance, 6) AS relevance FROM hits WHERE src <> dst", ctes=("hits",))
def similar_entries(t):
    return _rounded(_hits(t), "relevance")


_WALK_SQL = """walk AS (
  SELECT src, cast(0 AS bigint) AS n, any_value(seeds) AS seen, 0 AS same, 0 AS other, cast(NULL AS bigint) AS dst,
         cast(NULL AS double) AS relevance, cast(0 AS bigint) AS rank
  FROM numbered GROUP BY src
  UNION ALL
  SELECT src, n, CASE WHEN take THEN list_concat(seen, keys) ELSE seen END,
         same + CASE WHEN take AND is_same THEN 1 ELSE 0 END, other + CASE WHEN take AND NOT is_same THEN 1 ELSE 0 END,
         CASE WHEN take THEN dst END, relevance, rank + CASE WHEN take THEN 1 ELSE 0 END
  FROM (SELECT w.src, c.n, w.seen, w.same, w.other, w.rank, c.keys, c.same AS is_same, c.dst, c.relevance,
               NOT list_has_any(w.seen, c.keys) AND CASE WHEN c.same THEN w.same < 20 ELSE w.other < 20 END AS take
        FROM walk w JOIN numbered c ON c.src = w.src AND c.n = w.n + 1) s)"""


@query(f"""WITH RECURSIVE numbered AS MATERIALIZED (SELECT * FROM candidates),
{_WALK_SQL}
SELECT src AS entry_id, dst AS dest_entry_id, cast(rank AS int) AS rank, round(relevance, 6) AS relevance
FROM walk WHERE dst IS NOT NULL""", ctes=("candidates",))
def select_recommendations(t):
    return _rounded(similar.select_recommendations(_hits(t), t("entries")), "relevance")


@query("""SELECT src, dst, same, class_rank FROM (
  SELECT src, dst, same, row_number() OVER (PARTITION BY src, same ORDER BY position) AS class_rank FROM candidates) x
WHERE class_rank <= 20""", ctes=("candidates",))
def domain_capped(t):
    return similar.domain_capped(_hits(t), t("entries"))


# --------------------------------------------------------------------------
# Buckets


@query("""SELECT entry_id, round(avg(relevance) + stddev_pop(relevance), 6) AS relevance_threshold
FROM recommendations GROUP BY entry_id""", "recommendations")
def relevance_threshold(t):
    return _rounded(buckets.relevance_threshold(t("recommendations")), "relevance_threshold")


@query("""SELECT entry_id, cast(greatest(5, floor(round(avg(clicks) + stddev_pop(clicks), 9) + 0.5)) AS int) AS click_threshold
FROM recommendations GROUP BY entry_id""", "recommendations")
def click_threshold(t):
    return buckets.click_threshold(t("recommendations"))


@query("SELECT id, entry_id, dest_entry_id, rank, bucket FROM bucketed", ctes=("bucketed",))
def bucketize(t):
    return _bucketed(t).select("id", "entry_id", "dest_entry_id", "rank", "bucket")


@query("""SELECT entry_id, bucket, dest_entry_id, row_number() OVER (PARTITION BY entry_id, bucket
ORDER BY CASE WHEN bucket = 'popular' THEN avg_time_at_dest ELSE 0 END, rank, dest_entry_id) AS position
FROM bucketed""", ctes=("bucketed",))
def bucket_order(t):
    return buckets.order_buckets(_bucketed(t)).select("entry_id", "bucket", "dest_entry_id", "position")


@query("""SELECT entry_id, count(*) FILTER (bucket = 'popular') AS n_popular,
count(*) FILTER (bucket = 'relevant') AS n_relevant, count(*) FILTER (bucket = 'other') AS n_other
FROM bucketed GROUP BY entry_id""", ctes=("bucketed",))
def bucket_counts(t):
    return buckets.bucket_counts(_bucketed(t))


def _json_list(bucket):
    return f"""coalesce(to_json(list(struct_pack(id := b.id, uri := e.permalink, direct_link := coalesce(e.direct_link, ''),
  title := e.title, collection := coalesce(f.short_title, ''), clicks := b.clicks,
  avg_time_on_target := b.avg_time_at_dest, relevance := b.relevance)
  ORDER BY CASE WHEN b.bucket = 'popular' THEN b.avg_time_at_dest ELSE 0 END, b.rank, b.dest_entry_id)
  FILTER (b.bucket = '{bucket}')), '[]') AS {bucket}"""


@query(f"""SELECT b.entry_id, {', '.join(_json_list(b) for b in buckets.BUCKETS)}
FROM bucketed b JOIN entries e ON e.id = b.dest_entry_id JOIN feeds f ON f.id = e.feed_id GROUP BY b.entry_id""",
       "entries feeds", ctes=("bucketed",))
def bucket_json(t):
    return buckets.bucket_json(_bucketed(t), t("entries"), t("feeds"))


@query("""SELECT entry_id, bucket, dest_entry_id, row_number() OVER (PARTITION BY entry_id, bucket
ORDER BY CASE WHEN bucket = 'popular' THEN avg_time_at_dest ELSE 0 END, rank, dest_entry_id) AS position
FROM (SELECT r.*, CASE WHEN clicks >= click_threshold THEN 'popular'
        WHEN round(relevance, 9) > round(relevance_threshold, 9) THEN 'relevant' ELSE 'other' END AS bucket
      FROM recommendations r JOIN (
        SELECT r.entry_id, avg(relevance) + stddev_pop(relevance) AS relevance_threshold,
               greatest(5, floor(round(avg(clicks) + stddev_pop(clicks), 9) + 0.5)) AS click_threshold
        FROM recommendations r JOIN live l ON l.id = r.dest_entry_id GROUP BY r.entry_id) t ON t.entry_id = r.entry_id
      JOIN live l ON l.id = r.dest_entry_id) b""".replace("live l", """(SELECT e.id FROM entries e JOIN feeds f ON f.id = e.feed_id
        WHERE e.oai_identifier IS NULL OR e.oai_identifier <> 'deleted') l"""), "recommendations entries feeds")
def rebuild_cache(t):
    cache = buckets.rebuild_cache(t("recommendations"), snapshots.delete_entries(t("entries")), t("feeds"))
    return cache.select("entry_id", "bucket", "dest_entry_id", "position")


# --------------------------------------------------------------------------
# Personal recommendations


@query("""SELECT a.attentionable_id AS user_id, r.dest_entry_id, round(max(a.weight * t.default_weight * r.relevance), 6) AS score,
min(a.attentionable_type) AS attentionable_type
FROM attentions a JOIN attention_types t ON t.id = a.attention_type_id JOIN recommendations r ON r.entry_id = a.entry_id
GROUP BY a.attentionable_id, r.dest_entry_id""", "attentions attention_types recommendations")
def semantic_scores(t):
    return _rounded(
        personal.semantic_scores(t("attentions"), t("attention_types"), t("recommendations")), "score"
    )


@query("SELECT user_id, entry_id, round(value, 6) AS value FROM cells", ctes=("cells",))
def attention_matrix(t):
    return _rounded(_cells(t), "value")


@query("SELECT user_id, movie_id AS entry_id, round(max(rate / 5.0), 6) AS value FROM ratings GROUP BY user_id, movie_id",
       "ratings")
def ratings_matrix(t):
    return _rounded(collaborative.ratings_matrix(t("ratings")), "value")


@query("SELECT i AS user_id, l AS other_id, round(su, 6) AS similarity FROM likeness", ctes=("likeness",))
def user_similarity(t):
    return _rounded(collaborative.user_similarity(_cells(t)), "similarity")


@query("SELECT user_id, entry_id, round(score, 6) AS score FROM cf", ctes=("cf",))
def cf_scores(t):
    return _rounded(_cf(t), "score")


_UNATTENDED = """score > 0 AND NOT EXISTS (SELECT 1 FROM attentions a
WHERE a.attentionable_id = c.user_id AND a.entry_id = c.entry_id)"""


@query(f"SELECT user_id, entry_id, round(score, 6) AS score FROM cf c WHERE {_UNATTENDED}", "attentions", ctes=("cf",))
def cf_recommendations(t):
    return _rounded(
        collaborative.recommend(_cf(t), collaborative.attended_pairs(t("attentions"))), "score"
    )


@query("SELECT user_id, entry_id, round(score, 6) AS score FROM scf", ctes=("scf",))
def scf_scores(t):
    return _rounded(_scf(t), "score")


@query(f"SELECT user_id, entry_id, round(score, 6) AS score FROM scf c WHERE {_UNATTENDED}", "attentions", ctes=("scf",))
def scf_recommendations(t):
    return _rounded(
        collaborative.recommend(_scf(t), collaborative.attended_pairs(t("attentions"))), "score"
    )


@query(f"SELECT user_id, entry_id, round(score + {_STEP}, 6) AS score FROM diffusion", ctes=("diffusion",))
def bipartite_scores(t):
    return _rounded(_diffusion(t).withColumn("score", F.col("score") + _STEP), "score")


@query(f"""SELECT user_id, count(*) AS n_reached, round(sum(score) + {_STEP}, 6) AS mass, round(max(score) + {_STEP}, 6) AS best
FROM diffusion GROUP BY user_id""", ctes=("diffusion",))
def bipartite_all_users(t):
    """Diffusion summed up per user."""
    totals = bipartite.bipartite_totals(t("ratings")).withColumns({c: F.col(c) + _STEP for c in ("mass", "best")})
    return _rounded(totals, "mass", "best")


@query(f"""SELECT user_id, entry_id, round(score + {_STEP}, 6) AS score FROM diffusion d
WHERE round(score, 9) > (SELECT round(2 * sum(score) / ((SELECT count(DISTINCT user_id) FROM ratings) * (SELECT count(*) FROM part)), 9) FROM diffusion)
  AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = d.user_id AND r.movie_id = d.entry_id)""",
       "ratings", ctes=("diffusion",))
def bipartite_recommendations(t):
    users = t("ratings").select("user_id").distinct().count()
    chosen = bipartite.bipartite_recommendations(t("ratings"), users, t("part").count())
    return _rounded(chosen.withColumn("score", F.col("score") + _STEP), "score")


@query(f"SELECT user_id, dest_entry_id, round(score + {_STEP}, 4) AS score FROM decayed", ctes=("decayed",))
def decayed_scores(t):
    return _rounded(_decayed(t).withColumn("score", F.col("score") + _STEP), "score", digits=4)


@query(f"""SELECT user_id, dest_entry_id, round(score + {_STEP}, 4) AS score, position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, dest_entry_id) AS position
  FROM decayed d WHERE NOT EXISTS (SELECT 1 FROM personal_recommendations p
    WHERE p.personal_recommendable_id = d.user_id AND p.destination_id = d.dest_entry_id)) x
WHERE position <= 20""", "personal_recommendations", ctes=("decayed",))
def decayed_recommendations(t):
    best = personal.decayed_recommendations(_decayed(t), t("personal_recommendations"))
    return _rounded(best.withColumn("score", F.col("score") + _STEP), "score", digits=4)


@query(f"""WITH kept AS (SELECT * FROM personal_recommendations
  WHERE visited_at IS NOT NULL OR personal_recommendable_id NOT IN (SELECT id FROM due_daily))
SELECT personal_recommendable_id AS user_id, destination_id AS entry_id, round(relevance + {_STEP}, 4) AS relevance, created_at FROM kept
UNION ALL
SELECT user_id, dest_entry_id, round(score + {_STEP}, 4), {NOW} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, dest_entry_id) AS position
  FROM decayed d WHERE user_id IN (SELECT id FROM due_daily) AND NOT EXISTS (SELECT 1 FROM kept p
    WHERE p.personal_recommendable_id = d.user_id AND p.destination_id = d.dest_entry_id)) x
WHERE position <= 20""", "personal_recommendations", ctes=("decayed", "due_daily"))
def refresh_personal(t):
    state = personal.refresh_personal(
        t("users"), t("personal_recommendations"), t("attentions"), t("attention_types"), t("recommendations"),
        t("entries"), AS_OF,
    )
    return state.select(
        F.col("personal_recommendable_id").alias("user_id"), F.col("destination_id").alias("entry_id"),
        F.round(F.col("relevance") + _STEP, 4).alias("relevance"), "created_at",
    )


@query("""SELECT i.ownable_id AS attentionable_id, 'User' AS attentionable_type, e.id AS entry_id, 1 AS attention_type_id,
5.0E0 AS weight, e.published_at AS created_at
FROM entries e JOIN identity_feeds i ON i.feed_id = e.feed_id WHERE NOT EXISTS
  (SELECT 1 FROM attentions a WHERE a.entry_id = e.id AND a.attentionable_id = i.ownable_id)""",
       "entries identity_feeds attentions")
def authorship_attentions(t):
    return personal.authorship_attentions(t("entries"), t("identity_feeds"), t("attentions"))


@query("""SELECT a.attentionable_id AS user_id, e.id AS entry_id, e.title, md5(e.description) AS description_md5
FROM entries e JOIN attentions a ON a.entry_id = e.id WHERE a.attentionable_type = 'User'""", "entries attentions")
def attention_docs(t):
    return personal.attention_docs(t("entries"), t("attentions")).select(
        "user_id", "entry_id", "title", F.md5("description").alias("description_md5")
    )


# --------------------------------------------------------------------------
# Subjects, clouds, popularity


_WORK = "(SELECT id FROM entries WHERE permalink_good AND oai_identifier <> 'deleted' AND indexed_at > relevance_calculated_at)"


@query(f"""SELECT entry_id, subject_id, autogenerated FROM entries_subjects
WHERE NOT autogenerated OR entry_id NOT IN {_WORK}""", "entries_subjects entries")
def drop_autogenerated(t):
    return subjects.drop_autogenerated(t("entries_subjects"), worksets.entries_to_tag(t("entries")))


def _gap(t):
    work = worksets.entries_to_tag(t("entries"))
    return subjects.subject_gap(work, subjects.drop_autogenerated(t("entries_subjects"), work))


_GAP = f"""(SELECT e.id, count(es.entry_id) AS have FROM entries e
  LEFT JOIN entries_subjects es ON es.entry_id = e.id AND NOT es.autogenerated
  WHERE e.id IN {_WORK} GROUP BY e.id HAVING count(es.entry_id) < 5)"""


@query(f"SELECT id, have FROM {_GAP} g", "entries_subjects entries")
def subject_gap(t):
    return _gap(t)


@query("""SELECT id, term, tf, row_number() OVER (PARTITION BY id ORDER BY tf DESC, term) AS position
FROM tag_terms WHERE tf > 2""", ctes=("tag_terms",))
def top_tag_terms(t):
    return subjects.top_tag_terms(corpus.tag_terms(_fields(t)))


@query(f"""SELECT id AS entry_id, name FROM (
  SELECT t.id, t.term AS name, g.have, row_number() OVER (PARTITION BY t.id ORDER BY t.tf DESC, t.term) AS n
  FROM tag_terms t JOIN {_GAP} g ON g.id = t.id
  WHERE t.tf > 2 AND NOT EXISTS (SELECT 1 FROM entries_subjects es JOIN subjects s ON s.id = es.subject_id
    WHERE es.entry_id = t.id AND NOT es.autogenerated AND s.name = t.term)) x
WHERE have + n <= 5""", "entries_subjects subjects entries", ctes=("tag_terms",))
def generate_subjects(t):
    existing = t("entries_subjects").filter("NOT autogenerated").join(
        t("subjects").withColumnRenamed("id", "subject_id"), "subject_id"
    ).select(F.col("entry_id").alias("id"), "name")
    return subjects.generate_subjects(corpus.tag_terms(_fields(t)), _gap(t), existing)


def _cloud_sql(level):
    return f"""SELECT {level} AS level, language_id, grain_size, filter, tag, freq, cloud_min, cloud_max, shown
FROM cloud{level}"""


def _levels(t):
    level1 = cut(tagcloud.tag_cloud_level1(*_items(t)))
    level2 = tagcloud.tag_cloud_level2(level1, *_items(t))
    return level1, level2


@query(_cloud_sql(1), ctes=("cloud1",))
def tag_cloud_l1(t):
    return tagcloud.tag_cloud_level1(*_items(t))


@query(_cloud_sql(2), ctes=("cloud2",))
def tag_cloud_l2(t):
    return _levels(t)[1]


@query(_cloud_sql(3), ctes=("cloud3",))
def tag_cloud_l3(t):
    return tagcloud.tag_cloud_level3(_levels(t)[1], *_items(t))


@query(f"{_cloud_sql(2)} WHERE grain_size = 'course'", ctes=("cloud2",))
def get_clouds(t):
    level1, level2 = _levels(t)
    return tagcloud.get_clouds(level1.unionByName(level2), 2, "course")


@query("""SELECT 2 AS level, language_id, grain_size, filter,
concat_ws(',', min(cloud_min), max(cloud_max), string_agg(concat(tag, ',', freq), ',' ORDER BY tag) FILTER (shown)) AS tag_list
FROM cloud2 GROUP BY language_id, grain_size, filter""", ctes=("cloud2",))
def cloud_string(t):
    return tagcloud.cloud_string(_levels(t)[1])


@query("SELECT subject_id, name, frequency FROM popular_subjects", ctes=("popular_subjects",))
def subject_popularity(t):
    return popularity.subject_popularity(t("taggings"), t("subjects"))


# --------------------------------------------------------------------------
# Clustering


@query("SELECT gram, freq, round(llr, 6) AS llr FROM grams", ctes=("grams",))
def collocations(t):
    return _rounded(clustering.collocations(_tokens(t)), "llr")


@query("""SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM (
  SELECT g.id, g.term, sqrt(g.tf) * (ln(n.n / (v.df + 1)) + 1) AS w
  FROM doc_grams g JOIN (SELECT term, count(*) AS df FROM doc_grams GROUP BY term) v ON v.term = g.term
  CROSS JOIN (SELECT count(*) AS n FROM cleaned) n
  WHERE v.df >= 5 AND v.df * 100 <= n.n * 80) x""", ctes=("doc_grams",))
def tfidf_weights(t):
    return _rounded(_vectors(t), "weight")


@query("""SELECT count(*) AS n_pairs, round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance,
round(avg(d), 6) AS avg_distance FROM (
  SELECT x.vec_id, sum(abs(x.v - c.v)) AS d
  FROM (SELECT vec_id, label, cast(unnest(embedding) AS double) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) x
  JOIN (SELECT label, i, avg(v) AS v FROM (SELECT label, cast(unnest(embedding) AS double) AS v,
          generate_subscripts(embedding, 1) AS i FROM embeddings) y GROUP BY label, i) c
    ON c.label = x.label AND c.i = x.i
  GROUP BY x.vec_id) z""")
def manhattan_stats(t):
    points = t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = (
        points.select("label", F.posexplode("v").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c"))
        .select("label", F.transform("c", lambda p: p["x"]).alias("c"))
    )
    pairs = points.join(means, "label").select(clustering.manhattan(F.col("v"), F.col("c")).alias("distance"))
    return _rounded(clustering.distance_stats(pairs), "min_distance", "max_distance", "avg_distance")


def _attended(t):
    return collaborative.attended_pairs(t("attentions")).join(
        t("entries").select(F.col("id").alias("entry_id")), "entry_id", "left_semi").withColumnRenamed("entry_id", "id")


# With the fixed thresholds a canopy holds all points of its user; with these it holds some.
WIDE = (28.0, 26.0)
# Rounds the checking SQL walks; a user with more founders than that would make it differ.
_WALK = 32


def _canopy_sql(t1: float, t2: float) -> str:
    """Founders by unrolled rounds of the walk, then the canopies and their means."""
    rounds = "".join(f"""
walk{k} AS MATERIALIZED (SELECT user_id, min(id) AS c FROM open{k - 1} GROUP BY user_id),
open{k} AS MATERIALIZED (SELECT o.user_id, o.id FROM open{k - 1} o JOIN walk{k} f ON f.user_id = o.user_id
  JOIN far d ON d.user_id = o.user_id AND d.a = f.c AND d.b = o.id WHERE d.d >= {t2} AND o.id <> f.c),""" for k in range(1, _WALK + 1))
    founders = " UNION ALL ".join(f"SELECT user_id, c FROM walk{k}" for k in range(1, _WALK + 1))
    return f"""own AS MATERIALIZED (SELECT u.user_id, v.id, v.term, v.weight FROM attended u JOIN vecs v ON v.id = u.id),
lengths AS MATERIALIZED (SELECT user_id, id, sum(abs(weight)) AS l1, sum(weight * weight) AS l2 FROM own GROUP BY user_id, id),
far AS MATERIALIZED (SELECT a.user_id, a.id AS a, b.id AS b, round(a.l1 + b.l1 - coalesce(s.common, 0), 9) AS d
  FROM lengths a JOIN lengths b ON b.user_id = a.user_id
  LEFT JOIN (SELECT x.user_id, x.id AS a, y.id AS b, sum(abs(x.weight) + abs(y.weight) - abs(x.weight - y.weight)) AS common
             FROM own x JOIN own y ON y.user_id = x.user_id AND y.term = x.term GROUP BY x.user_id, x.id, y.id) s
    ON s.user_id = a.user_id AND s.a = a.id AND s.b = b.id),
open0 AS MATERIALIZED (SELECT user_id, id FROM lengths),{rounds}
inside AS MATERIALIZED (SELECT f.user_id, f.c, d.b AS id FROM ({founders}) f JOIN far d ON d.user_id = f.user_id AND d.a = f.c WHERE d.d < {t1}),
centre0 AS MATERIALIZED (SELECT i.user_id, i.c, o.term, sum(o.weight) / n.n AS w
  FROM inside i JOIN own o ON o.user_id = i.user_id AND o.id = i.id
  JOIN (SELECT user_id, c, count(*) AS n FROM inside GROUP BY user_id, c) n ON n.user_id = i.user_id AND n.c = i.c
  GROUP BY i.user_id, i.c, o.term, n.n)"""


def _nearest_sql(centre: str, only: str) -> str:
    return f"""(SELECT l.user_id, l.id, coalesce(b.c, f.c) AS c, coalesce(b.d, 1.0) AS d
  FROM lengths l JOIN (SELECT user_id, min(c) AS c FROM {centre} GROUP BY user_id) f ON f.user_id = l.user_id
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY d, c) AS r FROM (
      SELECT x.user_id, x.id, x.c, round(1.0 - x.dot / (p.l2 + q.l2 - x.dot), 9) AS d
      FROM (SELECT o.user_id, o.id, k.c, sum(o.weight * k.w) AS dot FROM own o JOIN {centre} k ON k.user_id = o.user_id AND k.term = o.term
            GROUP BY o.user_id, o.id, k.c) x
      JOIN lengths p ON p.user_id = x.user_id AND p.id = x.id
      JOIN (SELECT user_id, c, sum(w * w) AS l2 FROM {centre} GROUP BY user_id, c) q ON q.user_id = x.user_id AND q.c = x.c) z) b
    ON b.user_id = l.user_id AND b.id = l.id AND b.r = 1
  WHERE {only})"""


def _kmeans_sql() -> str:
    """Ten unrolled rounds in which finished users keep their centres, then the last assignment."""
    rounds = "".join(f"""
near{k} AS MATERIALIZED {_nearest_sql(f"centre{k - 1}", f"l.user_id IN (SELECT user_id FROM busy{k - 1})")},
mean{k} AS MATERIALIZED (SELECT n.user_id, n.c, o.term, sum(o.weight) / m.n AS w FROM near{k} n
  JOIN own o ON o.user_id = n.user_id AND o.id = n.id
  JOIN (SELECT user_id, c, count(*) AS n FROM near{k} GROUP BY user_id, c) m ON m.user_id = n.user_id AND m.c = n.c
  GROUP BY n.user_id, n.c, o.term, m.n),
centre{k} AS MATERIALIZED (SELECT * FROM mean{k} UNION ALL
  SELECT * FROM centre{k - 1} z WHERE NOT EXISTS (SELECT 1 FROM near{k} n WHERE n.user_id = z.user_id AND n.c = z.c)),
busy{k} AS MATERIALIZED (SELECT a.user_id FROM (SELECT user_id, c, sum(w * w) AS l2 FROM centre{k} GROUP BY user_id, c) a
  JOIN (SELECT user_id, c, sum(w * w) AS l2 FROM centre{k - 1} GROUP BY user_id, c) b ON b.user_id = a.user_id AND b.c = a.c
  LEFT JOIN (SELECT x.user_id, x.c, sum(x.w * y.w) AS dot FROM centre{k} x JOIN centre{k - 1} y
             ON y.user_id = x.user_id AND y.c = x.c AND y.term = x.term GROUP BY x.user_id, x.c) s ON s.user_id = a.user_id AND s.c = a.c
  WHERE a.user_id IN (SELECT user_id FROM busy{k - 1})
  GROUP BY a.user_id HAVING round(max(1.0 - coalesce(s.dot, 0) / (a.l2 + b.l2 - coalesce(s.dot, 0))), 9) > 0.01),""" for k in range(1, 11))
    return f"""busy0 AS MATERIALIZED (SELECT DISTINCT user_id FROM centre0),{rounds}
placed AS MATERIALIZED (SELECT a.user_id, a.id, n.c AS cluster, n.d AS distance
  FROM attended a LEFT JOIN {_nearest_sql("centre10", "true")} n ON n.user_id = a.user_id AND n.id = a.id)"""


_CLUSTER_CTES = {"views": "entries attentions", "ctes": ("vecs", "attended")}
_CENTRES = """SELECT user_id, c AS c_id, count(*) AS n_terms, round(sum(w), 6) AS mass, round(sum(w * w), 6) AS square
FROM centre0 GROUP BY user_id, c"""
_PLACES = "SELECT user_id, id, cluster, round(distance, 6) AS distance FROM placed"


def _clusters(t, *thresholds):
    return clustering.cluster_documents(cut(_attended(t)), cut(_vectors(t)), *thresholds)


def _centre_sums(t, *thresholds):
    """Size and sums of every centre; the centres themselves have a row per term."""
    attended, vectors = cut(_attended(t)), cut(_vectors(t))
    points, pairs = clustering.attended_points(attended, vectors), clustering.document_pairs(attended, vectors)
    members = cut(clustering.document_canopies(points, pairs, *thresholds))
    alike = clustering.alike_canopies(members, points)
    once = cut(members.join(alike.filter("c_id = same").select("user_id", "c_id"), ["user_id", "c_id"], "left_semi"))
    sums = clustering.document_centers(once, vectors).groupBy("user_id", "c_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("weight").alias("mass"), F.sum(F.pow("weight", F.lit(2))).alias("square"))
    sums = alike.join(sums.withColumnRenamed("c_id", "same"), ["user_id", "same"]).drop("same")
    return _rounded(sums, "mass", "square")


@query(f"WITH {_canopy_sql(clustering.T1, clustering.T2)} {_CENTRES}", **_CLUSTER_CTES)
def canopy_centers(t):
    return _centre_sums(t)


@query(f"WITH {_canopy_sql(*WIDE)} {_CENTRES}", **_CLUSTER_CTES)
def canopy_centers_wide(t):
    return _centre_sums(t, *WIDE)


@query(f"WITH {_canopy_sql(clustering.T1, clustering.T2)}, {_kmeans_sql()} {_PLACES}", **_CLUSTER_CTES)
def kmeans_clusters(t):
    return _rounded(_clusters(t), "distance")


@query(f"WITH {_canopy_sql(*WIDE)}, {_kmeans_sql()} "
       "SELECT p.user_id, p.cluster, p.id, e.title FROM placed p JOIN entries e ON e.id = p.id", **_CLUSTER_CTES)
def cluster_listing(t):
    return clustering.cluster_listing(_clusters(t, *WIDE), t("entries"))


# --------------------------------------------------------------------------
# Whole runs over the catalogue, with an empty corpus and index to start from

#: Some entries arrive again with another title.
_CHANGED_AT = "2024-01-30 12:00:00"
_SEEN = f"""
SELECT id, feed_id, lang, permalink, direct_link, CASE WHEN id % 25 = 3 THEN concat('Changed ', title) ELSE title END AS title,
       description, grain_size, permalink_good, oai_identifier,
       CASE WHEN id % 25 = 3 THEN timestamp '{_CHANGED_AT}' ELSE harvested_at END AS harvested_at, indexed_at,
       CASE WHEN id % 25 = 3 THEN coalesce(relevance_calculated_at, timestamp '{snapshots.NEVER}')
            ELSE relevance_calculated_at END AS relevance_calculated_at, published_at
FROM ({VIEWS["entries"]}) stored"""
_BOOTSTRAP = 300


def _after_run(seen: str, all: bool) -> dict:
    """SQL of the recommendations after a run: those of the entries due anew, and old ones that nothing deleted touches."""
    gone = f"SELECT id FROM ({seen}) s WHERE oai_identifier = 'deleted' OR NOT permalink_good"
    entries = f"SELECT * FROM ({seen}) s WHERE oai_identifier IS DISTINCT FROM 'deleted'"
    complete = "title IS NOT NULL AND description IS NOT NULL AND permalink IS NOT NULL AND grain_size IS NOT NULL"
    stamped = f"""harvested_at > indexed_at AND feed_id IN (SELECT id FROM feeds)
          AND (NOT coalesce(lang IN ({_LANGUAGES}), false) OR ({complete}))"""
    due = "SELECT id FROM entries WHERE permalink_good AND oai_identifier <> 'deleted'"
    if not all:
        due = f"""{due} AND CASE WHEN {stamped} THEN {NOW} ELSE indexed_at END
          > CASE WHEN id IN (SELECT entry_id FROM recommendations WHERE dest_entry_id IN (SELECT id FROM gone))
                 THEN timestamp '{snapshots.NEVER}' ELSE relevance_calculated_at END"""
    instead = {"entries": entries}
    if not all:  # only what was harvested since has come into the empty corpus
        instead["corpus"] = _CTES["corpus"].replace("FROM entries e", "FROM (SELECT * FROM entries WHERE harvested_at > indexed_at) e")
    sql = f"""WITH RECURSIVE gone AS ({gone}), due AS ({due}),
numbered AS MATERIALIZED (SELECT * FROM candidates WHERE src IN (SELECT id FROM due)),
{_WALK_SQL},
fresh AS (SELECT src AS entry_id, dst AS dest_entry_id, rank, relevance FROM walk WHERE dst IS NOT NULL),
kept AS (
  SELECT * FROM recommendations WHERE entry_id NOT IN (SELECT id FROM gone) AND dest_entry_id NOT IN (SELECT id FROM gone))
SELECT f.entry_id, f.dest_entry_id, cast(f.rank AS int) AS rank, round(f.relevance, 6) AS relevance, coalesce(o.clicks, 0) AS clicks
FROM fresh f LEFT JOIN kept o ON o.entry_id = f.entry_id AND o.dest_entry_id = f.dest_entry_id
UNION ALL
SELECT entry_id, dest_entry_id, rank, round(relevance, 6), clicks FROM kept WHERE entry_id NOT IN (SELECT entry_id FROM fresh)"""
    return {"sql": sql, "views": "recommendations entries", "ctes": ("candidates",), "instead": instead}


def _catalogue(t: Tables, stored: bool = True) -> runs.Catalogue:
    """The catalogue before a run; one that reads its entries only a few times takes them as they are given."""
    entries = t("entries")
    given = {name: t(name) for name in ("recommendations", "subjects", "entries_subjects", "feeds", "aggregation_feeds")}
    return {**runs.empty_catalogue(entries.sparkSession), **given, "entries": cut(entries) if stored else entries}


def _changes(state: runs.Catalogue) -> DataFrame:
    return state["entries"].filter("id % 25 = 3").withColumns({
        "title": F.concat(F.lit("Changed "), "title"), "harvested_at": F.lit(_CHANGED_AT).cast("timestamp")})


def _recommended(state: runs.Catalogue) -> DataFrame:
    return _rounded(state["recommendations"].select("entry_id", "dest_entry_id", "rank", "relevance", "clicks"), "relevance")


@query(**_after_run(_SEEN, all=False))
def run_incremental(t):
    state = _catalogue(t)
    return _recommended(runs.run_incremental(state, _changes(state), AS_OF))


@query(**_after_run(_SEEN, all=True))
def run_full(t):
    state = _catalogue(t)
    return _recommended(runs.run_full(state, _changes(state), AS_OF))


@query(**_after_run(f"SELECT * FROM ({_SEEN}) x ORDER BY id LIMIT {_BOOTSTRAP}", all=False))
def run_bootstrap(t):
    state = _catalogue(t, stored=False)
    return _recommended(runs.run_bootstrap(state, _changes(state), AS_OF, n=_BOOTSTRAP))
