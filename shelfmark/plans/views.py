"""The catalogue tables used by the registered queries, derived from the given parquet tables.

Each view is one SQL text that means the same in Spark SQL and in the checking
engine (``EACH`` apart).  Every view reads at least one given table, so its size follows the
data; the two literal dimensions (kinds of attention, stems) are only ever
joined to such views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

AS_OF = "2024-01-31 00:00:00"
GLOBAL_AGGREGATION = 1

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# EACH(a,b,...) gives one row per value; it is the one construct the engines spell differently.
_EACH = re.compile(r"EACH\(([^)]*)\)")

VIEWS = {
    "feeds": """
SELECT DISTINCT cast(substr(source,4) AS bigint) AS id,
       CASE WHEN cast(substr(source,4) AS bigint) % 7 = 0 THEN NULL ELSE source END AS short_title
FROM documents""",
    "aggregation_feeds": """
SELECT cast(1 AS bigint) AS aggregation_id, id AS feed_id FROM feeds WHERE id % 10 <> 9
UNION ALL
SELECT cast(2 AS bigint), id FROM feeds WHERE id % 2 = 0 AND id % 10 <> 9""",
    "entries": """
SELECT doc_id AS id, cast(substr(source,4) AS bigint) AS feed_id, lang,
       concat('http://', source, '.example.org/d/', cast(doc_id AS string)) AS permalink,
       CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE concat('http://cdn.example.org/', cast(doc_id AS string)) END AS direct_link,
       split_part(text, chr(10), 1) AS title, text AS description,
       CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'course' ELSE 'resource' END AS grain_size,
       doc_id % 17 <> 0 AS permalink_good,
       CASE WHEN doc_id % 23 = 0 THEN 'deleted' WHEN doc_id % 19 = 0 THEN NULL
            ELSE concat('oai:', cast(doc_id AS string)) END AS oai_identifier,
       timestamp '2024-01-01 00:00:00' + interval '1' day * cast(doc_id % 30 AS int) AS harvested_at,
       timestamp '2024-01-01 00:00:00' + interval '1' day * cast(doc_id % 20 AS int) AS indexed_at,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE timestamp '2024-01-01 00:00:00' + interval '1' day * cast(doc_id % 25 AS int) END AS relevance_calculated_at,
       timestamp '2024-01-01 00:00:00' + interval '1' day * cast(doc_id % 28 AS int) AS published_at
FROM documents""",
    "item_entries": """
SELECT p_partkey AS id, CASE WHEN p_size <= 25 THEN 'course' ELSE 'resource' END AS grain_size,
       cast(p_partkey % 2 AS int) AS language_id, p_name AS title
FROM part""",
    # A part has one name of each kind, so (part, kind) numbers the names without a sort.
    "subjects": """
SELECT cast(min(k) AS bigint) AS id, name FROM (
  SELECT p_partkey*4 AS k, split_part(p_name,' ',1) AS name FROM part
  UNION ALL SELECT p_partkey*4 + 1, split_part(p_name,' ',2) FROM part
  UNION ALL SELECT p_partkey*4 + 2, lower(p_type) FROM part
  UNION ALL SELECT p_partkey*4 + 3, p_brand FROM part) n
GROUP BY name""",
    "entries_subjects": """
SELECT t.entry_id, s.id AS subject_id, t.autogenerated FROM (
  SELECT p_partkey AS entry_id, split_part(p_name,' ',1) AS name, false AS autogenerated FROM part
  UNION ALL SELECT p_partkey, split_part(p_name,' ',2), false FROM part
  UNION ALL SELECT p_partkey, lower(p_type), false FROM part
  UNION ALL SELECT p_partkey, p_brand, true FROM part WHERE p_size > 10) t
JOIN subjects s ON s.name = t.name""",
    "taggings": "SELECT subject_id FROM entries_subjects",
    "attention_types": """
SELECT * FROM (VALUES (1,'signup',2.0E0),(2,'purchase',5.0E0),(3,'view',1.0E0),(4,'click',3.0E0),(5,'error',0.0E0))
       v(id,name,default_weight)""",
    "attentions": """
SELECT e.event_id AS id, e.user_id AS attentionable_id, 'User' AS attentionable_type,
       cast(regexp_extract(e.props,'[0-9]+',0) AS bigint) AS entry_id, a.id AS attention_type_id,
       e.value AS weight, cast(e.ts AS timestamp) AS created_at
FROM events e JOIN attention_types a ON a.name = e.event_type""",
    "users": "SELECT user_id AS id, cast(max(ts) AS timestamp) AS last_request_at FROM events GROUP BY user_id",
    # Six destinations per entry; the numbers of clicks and the times vary so that
    # every bucket is filled.  Follows the documents, not a fixed range.
    "steps": "SELECT doc_id AS i, EACH(1,2,3,4,5,6) AS r FROM documents",
    "recommendations": """
SELECT i*10 + r AS id, i AS entry_id, dest AS dest_entry_id, cast(r AS int) AS rank,
       (700 - 100*r + (i*37 + r*11) % 90) / 1000.0E0 AS relevance, cast((i*r) % 17 AS int) AS clicks,
       cast(30 + (i + r*r) % 90 AS bigint) AS avg_time_at_dest
FROM (SELECT i, r, (i*7 + r*13) % (SELECT count(*) FROM documents) AS dest FROM steps) s
WHERE dest <> i""",
    "personal_recommendations": """
SELECT id AS personal_recommendable_id, 'User' AS personal_recommendable_type, (id*3) % 100 AS destination_id,
       'Entry' AS destination_type, 0.5E0 AS relevance,
       timestamp '2024-01-01 00:00:00' + interval '1' day * cast(id % 30 AS int) AS created_at,
       CASE WHEN id % 3 = 0 THEN timestamp '2024-01-30 00:00:00' END AS visited_at
FROM users WHERE id % 5 <> 0""",
    "identity_feeds": "SELECT id AS feed_id, id AS ownable_id FROM feeds",
    "queries_seed": """
SELECT id, name, cast(CASE WHEN id % 6 = 0 THEN 100 ELSE id % 50 END AS int) AS frequency
FROM subjects WHERE id % 2 = 0""",
    "ratings": """
SELECT o_custkey AS user_id, l_partkey AS movie_id, cast(ceil(l_quantity/10) AS int) AS rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "stem_map": "SELECT * FROM (VALUES ('erst','er'),('tion','ti'),('ereau','er'),('ou','o')) v(term,stem)",
    # A second state: every other entry was recomputed, its last destinations were
    # lost and, where there was room, one new destination was found.
    "fresh_recommendations": """
SELECT entry_id, dest_entry_id, rank + 1 AS rank, relevance / 2 AS relevance
FROM recommendations WHERE entry_id % 2 = 0 AND rank <= 4
UNION ALL
SELECT f.i, f.dest, 1, 0.75E0
FROM (SELECT doc_id AS i, (doc_id*7 + 101) % (SELECT count(*) FROM documents) AS dest
      FROM documents WHERE doc_id % 2 = 0) f
WHERE f.dest <> f.i
  AND NOT EXISTS (SELECT 1 FROM recommendations o WHERE o.entry_id = f.i AND o.dest_entry_id = f.dest)""",
}


def _dependencies(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", text))
    return [name for name in VIEWS if name in words]


def _closure(names: list[str]) -> list[str]:
    """Named views with everything they read, in definition order."""
    needed: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo.extend(d for d in _dependencies(VIEWS[name]) if d != name)
    return [name for name in VIEWS if name in needed]


def oracle_text(body: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the common table expressions it needs, for the checking engine."""
    parts = {name: VIEWS[name] for name in _closure(list(views))}
    parts.update(extra or {})
    if not parts:
        return body
    shared = ",\n".join(f"{name} AS ({text})" for name, text in parts.items())
    shared = _EACH.sub(r"unnest([\1])", shared)
    # A body with expressions of its own continues the list.
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(opening):
            return f"{opening}{shared},\n{body[len(opening):]}"
    return f"WITH {shared}\n{body}"


_schemas: dict[str, StructType] = {}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per session."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One catalogue table as a DataFrame, without leaving anything registered in the session."""
    if name in BASE_TABLES:
        return base_table(spark, sf_dir, name)
    names = _closure([name])
    words = set(re.findall(r"\b[a-z_]+\b", " ".join(VIEWS[n] for n in names)))
    tables = {t: base_table(spark, sf_dir, t) for t in BASE_TABLES if t in words}
    parts = [f"{t} AS (SELECT * FROM {{{t}}})" for t in tables]
    parts += [f"{n} AS ({VIEWS[n]})" for n in names]
    text = "WITH " + ",\n".join(parts) + f"\nSELECT * FROM {name}"
    return spark.sql(_EACH.sub(r"explode(array(\1))", text), **tables)
