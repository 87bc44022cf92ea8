"""Registered queries of this folder with the SQL that checks them.

Each applies its operator with production parameters to the whole table it is
meant for.  Where SQL cannot express an operator there is no text here and
``tests/llm`` compares the operator with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import (
    backoff, exact, extract, merkle, mixing, permutation, simhash, token_files, toolcalls, toxicity, vector_codes, warc,
    word_bpe,
)
from shelfmark.llm.rows import ship_package
from shelfmark.session import apply_settings

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            ship_package(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        _QUERIES[fn.__name__] = run
        if sql is not None:
            _ORACLE[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


@query()
def op1_extract(t) -> DataFrame:
    return extract.extract(t("pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query("""
WITH docs AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents),
places AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM docs),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS h FROM places),
counts AS (
  SELECT doc_id, pos, h,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS n1,
         count(h) OVER (PARTITION BY h, w) - count(h) OVER (PARTITION BY doc_id, h, w) AS n2,
         count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM pairs),
scores AS (
  SELECT doc_id,
         CASE WHEN n1 > 0 THEN n1 / greatest(1, n) ELSE 1 / (n + 1) END AS single,
         CASE WHEN h IS NOT NULL AND n2 > 0 THEN n2 / lag(n1) OVER (PARTITION BY doc_id ORDER BY pos) END AS double, h
  FROM counts),
sums AS (
  SELECT doc_id, count(*) AS n_words, sum(ln(CASE WHEN h IS NULL THEN single ELSE coalesce(double, 0.4 * single) END)) AS s
  FROM scores GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::bigint AS n_words, round(s, 4) AS log_score, round(exp(-s / n_words), 4) AS perplexity
FROM docs LEFT JOIN sums USING (doc_id)
""")
def op2_backoff(t) -> DataFrame:
    return backoff.score(t("documents")).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("perplexity", 4).alias("perplexity"))


@query()
def op3_permutation_index(t) -> DataFrame:
    return permutation.nearest_neighbours(t("embeddings"), F.col("vec_id") % 50 == 0)


#: Target weights: domains, languages within a domain, single sources.
DOMAIN = "concat('domain', cast(try_cast(substr(source, 4) AS bigint) % 3 AS string))"
TARGETS = [
    ("domain0", None, None, 5), ("domain1", None, None, 3), ("domain2", None, None, 2),
    *[(f"domain{d}", lang, None, weight) for d in range(3) for lang, weight in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))],
    ("domain0", "en", "src0", 3), ("domain0", "en", "src3", 2), ("domain1", "en", "src7", 4), ("domain2", "de", "src2", 2),
]
BUDGET_PERCENT = 80


def target_weights(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {_target_values()} AS t(domain, lang, source, weight)")


def _target_values() -> str:
    text = lambda x: "cast(NULL AS string)" if x is None else f"'{x}'"
    return ", ".join(f"({text(d)}, {text(lang)}, {text(s)}, {w})" for d, lang, s, w in TARGETS)


def _deal_sql(name: str, parent: str, above: list[str], own: list[str]) -> str:
    """Water filling of one level, written as the recurrence over saturated children."""
    keys = ", ".join(["root", *above])
    on = ", ".join(["root", *above])
    return f"""
{name}_nodes AS (
  SELECT root, {", ".join(own)}, sum(cap) AS cap, max({own[-1]}_w) AS w FROM leaf GROUP BY ALL),
{name}_marked AS (
  SELECT n.*, p.budget AS b,
         cap::double <= (p.budget - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::double
           / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * w AS is_full
  FROM {name}_nodes n JOIN {parent} p USING ({on})
  WINDOW f AS (PARTITION BY {keys.replace("root", "n.root")} ORDER BY cap::double / w, {own[-1]})),
{name} AS (
  SELECT root, {", ".join(own)},
         CASE WHEN is_full THEN cap ELSE greatest(0, floor(
           (b - coalesce(sum(cap) FILTER (is_full) OVER g, 0))::double / sum(w) FILTER (NOT is_full) OVER g * w)) END::bigint AS budget
  FROM {name}_marked WINDOW g AS (PARTITION BY {keys}))"""


@query(f"""
WITH docs AS (
  SELECT doc_id, coalesce({DOMAIN}, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) + 1 AS tokens
  FROM documents),
targets AS (SELECT * FROM (VALUES {_target_values()}) AS t(domain, lang, source, weight)),
leaf AS (
  SELECT 0 AS root, d.domain, d.lang, d.source, sum(tokens)::bigint AS supply, 3 * sum(tokens)::bigint AS cap,
         coalesce(any_value(a.weight), 1)::bigint AS domain_w, coalesce(any_value(b.weight), 1)::bigint AS lang_w,
         coalesce(any_value(c.weight), 1)::bigint AS source_w
  FROM docs d
  LEFT JOIN targets a ON a.domain = d.domain AND a.lang IS NULL
  LEFT JOIN targets b ON b.domain = d.domain AND b.lang = d.lang AND b.source IS NULL
  LEFT JOIN targets c ON c.domain = d.domain AND c.lang = d.lang AND c.source = d.source
  GROUP BY ALL),
top AS (SELECT 0 AS root, floor(sum(supply) * {BUDGET_PERCENT}.0::double / 100)::bigint AS budget FROM leaf),
{_deal_sql("domains", "top", [], ["domain"])},
{_deal_sql("langs", "domains", ["domain"], ["domain", "lang"])},
{_deal_sql("sources", "langs", ["domain", "lang"], ["domain", "lang", "source"])},
share AS (
  SELECT domain, lang, source, s.budget // l.supply AS passes, s.budget % l.supply AS rest
  FROM sources s JOIN leaf l USING (domain, lang, source) WHERE s.budget > 0),
ranked AS (
  SELECT d.*, passes, rest, sum(tokens) OVER (
           PARTITION BY domain, lang, source
           ORDER BY md5(concat('7:', cast(passes + 1 AS varchar), ':', cast(doc_id AS varchar))), tokens
           ROWS UNBOUNDED PRECEDING) AS total
  FROM docs d JOIN share USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens::bigint AS n_tokens, (passes + (total <= rest)::bigint)::bigint AS copies
FROM ranked WHERE passes + (total <= rest)::bigint > 0
""".replace("cast(NULL AS string)", "cast(NULL AS varchar)"))
def op4_mixing(t) -> DataFrame:
    docs = t("documents")
    return mixing.mix(
        docs.select("doc_id", "lang", "source", "text"), target_weights(docs.sparkSession), F.expr(DOMAIN), BUDGET_PERCENT,
    ).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


#: The tools that assistant turns of `conversations` are read as calls of.
TOOLS = [("search", "query", "string", "true"), ("search", "limit", "integer", "false"), ("lookup", "key", "string", "true"),
         ("lookup", "strict", "boolean", "false"), ("note", "text", "string", "true")]


def tool_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls, the turn after each as its result; some arguments break their schema on purpose."""
    turns = conversations.select("conv_id", "turn", "role", "text", toolcalls.json_text(F.coalesce("text", F.lit(""))).alias("quoted"))
    call = lambda turn: F.expr(f"concat('c', conv_id, '-', {turn})")
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", call("turn").alias("call_id"),
        F.expr("CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'note' END").alias("name"),
        F.expr("""CASE WHEN turn % 3 = 0 THEN concat('{ "query": ', quoted, ', "limit": ', if(conv_id % 7 = 0, '"many"', cast(turn AS string)), ' }')
                       WHEN turn % 3 = 1 AND conv_id % 11 = 0 THEN '{"strict": true}'
                       WHEN turn % 3 = 1 THEN concat('{"strict": true, "key": ', quoted, '}')
                       WHEN conv_id % 13 = 0 THEN concat('{"text": ', quoted)
                       ELSE concat('{"text": ', quoted, '}') END""").alias("arguments"),
        F.when(F.expr("turn % 8 > 2"), F.array(call("turn - turn % 8 + 1"))).alias("needs"))
    results = turns.filter("role = 'user' AND turn > 0").select(
        "conv_id", "turn", call("turn - 1").alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("""
WITH calls AS (
  SELECT *, concat('c', conv_id, '-', turn) AS call_id, to_json(coalesce(text, ''))::varchar AS quoted,
         CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'note' END AS name,
         CASE WHEN turn % 8 > 2 THEN turn - turn % 8 + 1 END AS need
  FROM conversations WHERE role = 'assistant'),
results AS (SELECT conv_id, turn, text, turn - 1 AS call_turn FROM conversations WHERE role = 'user' AND turn > 0),
checked AS (
  SELECT c.*, r.text AS result, r.turn AS result_turn,
         CASE WHEN name = 'search' AND c.conv_id % 7 = 0 THEN 'type of limit'
              WHEN name = 'lookup' AND c.conv_id % 11 = 0 THEN 'missing key' ELSE '' END AS problems,
         CASE WHEN name = 'search' THEN concat('{"limit":', CASE WHEN c.conv_id % 7 = 0 THEN '"many"' ELSE c.turn::varchar END, ',"query":', quoted, '}')
              WHEN name = 'lookup' AND c.conv_id % 11 = 0 THEN '{"strict":true}'
              WHEN name = 'lookup' THEN concat('{"key":', quoted, ',"strict":true}')
              WHEN c.conv_id % 13 = 0 THEN NULL
              ELSE concat('{"text":', quoted, '}') END AS canonical,
         need IS NOT NULL AND h.turn IS NULL AS lacks, h.turn IS NOT NULL AS waits
  FROM calls c
  LEFT JOIN (SELECT conv_id, turn FROM calls) h ON h.conv_id = c.conv_id AND h.turn = c.need
  LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_turn = c.turn)
SELECT conv_id, turn, call_id, name, waits::int AS level,
       CASE WHEN canonical IS NULL THEN 'not_an_object' WHEN problems <> '' THEN 'bad_arguments' WHEN lacks THEN 'missing_need'
            WHEN result_turn IS NULL THEN 'no_result' ELSE 'ok' END AS status, problems,
       concat('{"arguments":', coalesce(canonical, 'null'), ',"id":"', call_id, '","name":"', name, '","result":',
              CASE WHEN result_turn IS NULL THEN 'null' ELSE to_json(coalesce(result, ''))::varchar END, '}') AS json
FROM checked
UNION ALL
SELECT conv_id, turn, concat('c', conv_id, '-', call_turn), NULL, NULL, 'orphan_result', '',
       concat('{"arguments":null,"id":"', concat('c', conv_id, '-', call_turn), '","name":null,"result":', to_json(coalesce(text, ''))::varchar, '}')
FROM results r WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.turn = r.call_turn)
""")
def op5_toolcalls(t) -> DataFrame:
    conversations = t("conversations")
    tools = ", ".join(f"('{n}', '{p}', '{k}', {r})" for n, p, k, r in TOOLS)
    schemas = conversations.sparkSession.sql(f"SELECT * FROM VALUES {tools} AS t(name, parameter, type, required)")
    return toolcalls.link(*tool_calls(conversations), schemas)


@query()
def op6_word_bpe(t) -> DataFrame:
    import public_tokenizers

    return word_bpe.encode(t("documents"), public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op7_toxicity(t) -> DataFrame:
    return toxicity.score(t("documents"), toxicity.fit(t("documents"), t("labels")))


@query()
def op8_simhash(t) -> DataFrame:
    return simhash.near_duplicates(t("documents"))


@query("""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content
  FROM documents),
winners AS (
  SELECT content, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY content)
SELECT r.doc_id, w.keep_id, cast(w.group_size AS bigint) AS group_size, r.doc_id = w.keep_id AS kept,
       sha256(r.content) AS text_sha256
FROM rows r JOIN winners w USING (content)
""")
def op9_exact_dedup(t) -> DataFrame:
    return exact.duplicate_groups(t("documents")).drop("n_chars")


@query("""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (
  SELECT *, array_to_string([
      substr('0000000100100011010001010110011110001001101010111100110111101111',
             4 * (strpos('0123456789abcdef', substr(sha1(html), k::int, 1))::int - 1) + 1, 4)
      FOR k IN range(1, 41)], '') AS b
  FROM rows)
SELECT page_id, cast(octet_length(encode(html)) AS bigint) AS payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ('0b' || substr(b, 5 * i::int + 1, 5))::int + 1, 1) FOR i IN range(32)], '')
         AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM bits
""")
def op10_warc(t) -> DataFrame:
    return warc.round_trip(t("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The id that ends a document in the token files.
END_ID = 2


@query()
def op11_token_files(t) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(t("documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID).select(
        "doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that the SQL spells out: 16**5 documents of a source, 16**3 sources.
_SQL_LEVELS = {"leaf": 5, "top": 3}


def _leaf_sql(text: str) -> str:
    fields = [f"{f}::varchar" for f in _LEAF_FIELDS[:-1]] + [text]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen({f})::varchar, ':', {f}) END" for f in fields) + "))"


def _levels_sql(name: str, levels: int) -> str:
    """Level by level: nodes with what stands before and after them in their run, then the nodes of the next level."""
    out = []
    for k in range(levels):
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""
{name}_s{k} AS (
  SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lo,
         CASE WHEN n > 1 THEN coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS hi
  FROM {name}_{k}),
{name}_{k + 1} AS (
  SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n,
         CASE WHEN n > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
  FROM {name}_{k} GROUP BY tree, pos // 16, n),""")
    return "".join(out)


def _fold_sql(name: str, levels: int, keys: str, kept: str) -> str:
    """From the leaf up: the copied digest and the siblings of every level."""
    out = []
    for k in range(levels):
        out.append(f"""
{name}_f{k + 1} AS (
  SELECT {kept}, concat(f.proof, s.lo, s.hi) AS proof, CASE WHEN s.n > 1 THEN sha256(concat(s.lo, f.digest, s.hi)) ELSE f.digest END AS digest
  FROM {name}_f{k} f JOIN {name}_s{k} s ON s.tree = f.{keys} AND s.pos = f.pos // {16 ** k}),""")
    return "".join(out)


@query(f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n)) AS t),
sums AS (
  SELECT doc_id AS id, xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), bits),
leaves AS (
  SELECT d.doc_id, coalesce('s' || source, 'n') AS tree, {_leaf_sql("text")} AS leaf,
         CASE WHEN crc % 5 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents d LEFT JOIN sums ON sums.id = d.doc_id),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
leaf_0 AS (SELECT tree, pos, n, leaf AS digest FROM placed),
{_levels_sql("leaf", _SQL_LEVELS["leaf"])}
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM leaf_{_SQL_LEVELS["leaf"]}),
top_0 AS (SELECT 'all' AS tree, pos, n, digest FROM subroots),
{_levels_sql("top", _SQL_LEVELS["top"])}
root AS (SELECT digest AS root FROM top_{_SQL_LEVELS["top"]}),
leaf_f0 AS (SELECT doc_id, leaf, tree, pos, '' AS proof, coalesce(changed, leaf) AS digest FROM placed),
{_fold_sql("leaf", _SQL_LEVELS["leaf"], "tree", "f.doc_id, f.leaf, f.tree, f.pos")}
top_f0 AS (
  SELECT f.doc_id, f.leaf, 'all' AS tree, r.pos, r.digest AS subroot, f.proof, f.digest
  FROM leaf_f{_SQL_LEVELS["leaf"]} f JOIN subroots r USING (tree)),
{_fold_sql("top", _SQL_LEVELS["top"], "tree", "f.doc_id, f.leaf, f.tree, f.pos, f.subroot")}
done AS (SELECT * FROM top_f{_SQL_LEVELS["top"]}, root)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified FROM done
""")
def op12_merkle(t) -> DataFrame:
    digest = lambda text: merkle.row_digest([*map(F.col, _LEAF_FIELDS[:-1]), text])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, digest(F.translate("text", _UPPER, _LOWER)))
    return merkle.build(t("documents"), digest(F.col("text")), changed).proofs().select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def _rounds_sql() -> str:
    out = []
    for k in range(1, vector_codes.ROUNDS + 1):
        out.append(f"""
sums{k} AS (
  SELECT p, best.e AS e, i, floor(sum(x[i + 1]) / count(*)) AS c
  FROM a{k - 1} JOIN parts USING (vec_id, p), (SELECT unnest(range(w)) AS i FROM dimension) GROUP BY ALL),
c{k} AS (
  SELECT old.p, old.e, coalesce(new.c, old.c) AS c
  FROM c{k - 1} old LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM sums{k} GROUP BY ALL) new USING (p, e)),
{_assign_sql(k)}""")
    return "".join(out)


def _assign_sql(k: int) -> str:
    """Squared distance by inner products: whole numbers, so exact in double precision."""
    return f"""
a{k} AS (
  SELECT vec_id, p, min(struct_pack(
           d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS best
  FROM parts JOIN c{k} USING (p) GROUP BY ALL),"""


@query(f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::double * {vector_codes.SCALE})) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dimension AS (SELECT max(len(v)) // {vector_codes.PARTS} AS w FROM kept),
parts AS (SELECT vec_id, p, v[p * w + 1:p * w + w] AS x FROM kept, dimension, range({vector_codes.PARTS}) t(p)),
c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {vector_codes.ENTRIES})),
{_assign_sql(0)}
{_rounds_sql()}
numbers AS (SELECT p, e, unnest(c)::bigint AS x, generate_subscripts(c, 1) AS i FROM c{vector_codes.ROUNDS}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::bigint AS error
  FROM a{vector_codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error,
       (SELECT sha256(string_agg(x::varchar, ',' ORDER BY p, e, i)) FROM numbers) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
""")
def op13_vector_codes(t) -> DataFrame:
    coded, books = vector_codes.compress(t("embeddings"))
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))
