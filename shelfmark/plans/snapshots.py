"""Stored states: tables in hash-bucketed parts, a pointer per snapshot, only changed parts written.

``<snapshot>/<table>/_part=<part>`` holds the rows of a part, ``<snapshot>/pointer``
says for every part of every table which folder has it.  A snapshot based on an
earlier one writes the parts whose rows differ and points to the folders of the
others.  The pointer is written last: without it the snapshot does not exist, and
writing it again gives the same state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.functions.lineage import remove_folder
from shelfmark.plans.runs import STATE_TABLES, Catalogue
from shelfmark.sources.tables import SCHEMAS

#: Parts of a table (of a language in the corpus); a part is written by one task, so large states need more.
BUCKETS = 16
# What the rows of a table are dealt by; tables that are read by language are dealt within it.
PART_KEYS = {
    "entries": "id", "corpus": "id", "recommendations": "entry_id", "buckets": "entry_id", "subjects": "id",
    "entries_subjects": "entry_id", "tag_clouds": "filter", "feeds": "id", "aggregation_feeds": "feed_id",
    "index_terms": "id", "index_documents": "id", "index_vocabulary": "term",
}
BY_LANGUAGE = ("corpus", "index_terms", "index_vocabulary")

_POINTER = "table string, part string, folder string, rows bigint, digest string, buckets int"


def _tagged(table: DataFrame, name: str, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64(PART_KEYS[name]), F.lit(buckets)).cast("string")
    if name in BY_LANGUAGE:
        bucket = F.concat_ws("-", F.coalesce("lang", F.lit("")), bucket)
    return table.withColumn("_part", bucket)


def _digests(name: str, tagged: DataFrame) -> DataFrame:
    """Rows and an order-free digest of every part."""
    columns = [c for c in tagged.columns if c != "_part"]
    return tagged.groupBy(F.col("_part").alias("part")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("string").alias("digest"),
    ).withColumn("table", F.lit(name))


def read_pointer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_POINTER).parquet(f"{path}/pointer")


def write_snapshot(state: Catalogue, path: str, base: str | None = None, buckets: int = BUCKETS) -> int:
    """Write the state tables as the snapshot ``path``; returns how many parts were written.

    ``base`` is the snapshot before.  Pointer and digests have a row per part,
    tables x languages x buckets of them, and go through the driver.
    """
    spark = state[STATE_TABLES[0]].sparkSession
    old = {(r["table"], r["part"]): r for r in read_pointer(spark, base).collect()} if base else {}
    buckets = next((r["buckets"] for r in old.values()), buckets)
    tagged = {name: _tagged(state[name].select(*_columns(name)), name, buckets) for name in STATE_TABLES}
    found = reduce(DataFrame.unionByName, [_digests(name, t) for name, t in tagged.items()]).collect()
    pointer, changed = [], {name: [] for name in STATE_TABLES}
    for row in found:
        before = old.get((row["table"], row["part"]))
        if before is not None and (before["rows"], before["digest"]) == (row["rows"], row["digest"]):
            folder = before["folder"]
        else:
            folder = f"{path}/{row['table']}/_part={row['part']}"
            changed[row["table"]].append(row["part"])
        pointer.append((row["table"], row["part"], folder, row["rows"], row["digest"], buckets))
    for name, parts in changed.items():
        if parts:
            (tagged[name].filter(F.col("_part").isin(parts)).repartition(len(parts), "_part")
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_part").parquet(f"{path}/{name}"))
    spark.createDataFrame(pointer, _POINTER).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(f"{path}/pointer")
    return sum(map(len, changed.values()))


def _columns(name: str) -> list[str]:
    return [column.split()[0] for column in SCHEMAS[name].split(", ")]


def read_snapshot(spark: SparkSession, path: str) -> Catalogue:
    folders: dict[str, list[str]] = {name: [] for name in STATE_TABLES}
    for row in read_pointer(spark, path).collect():
        folders[row["table"]].append(row["folder"])
    return {
        name: spark.read.schema(SCHEMAS[name]).parquet(*sorted(paths)) if paths else spark.createDataFrame([], SCHEMAS[name])
        for name, paths in folders.items()
    }


def remove_unused(spark: SparkSession, root: str, keep: list[str]) -> list[str]:
    """Delete what no snapshot of ``keep`` points to, of all snapshots below ``root``; returns the deleted folders."""
    used = {r["folder"] for path in keep for r in read_pointer(spark, path).select("folder").collect()}
    used = {folder.rstrip("/") for folder in used}
    removed = []
    for snapshot in _folders(spark, root):
        if snapshot in keep:
            dead = [part for table in _folders(spark, snapshot) if not table.endswith("/pointer")
                    for part in _folders(spark, table) if part not in used]
        else:
            parts = [part for table in _folders(spark, snapshot) for part in _folders(spark, table)]
            needed = [part for part in parts if part in used]
            dead = [part for part in parts if part not in used] + [f"{snapshot}/pointer"] if needed else [snapshot]
        for folder in dead:
            remove_folder(spark, folder)
        removed += dead
    return removed


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders in a folder, spelled as its path is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return [f"{path.rstrip('/')}/{s.getPath().getName()}" for s in system.listStatus(folder) if s.isDirectory()]
