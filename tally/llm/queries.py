"""Registered queries of this package, one per operator, over whole tables.

``QUERIES`` maps a name to ``(spark, sf_dir) -> DataFrame``, ``SQL`` holds the
SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroids,
    chat,
    decontaminate,
    html_extract,
    lang_id,
    line_dedup,
    merkle,
    simhash,
    token_store,
    toxicity,
    url_filter,
    winnow,
)
from .common import table

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
WINDOW = 10  # words of a benchmark window
SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
BPE_RANKS, BPE_JSON = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"
MERKLE_ARITY, TAMPERED_EVERY = 2, 7
CENTROIDS, ROUNDS, DIMENSIONS, SCALE, CENTROID_SEED = 8, 10, 64, 1024.0, 3


def _remainder(of: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


def held_out() -> Column:
    return F.coalesce(_remainder(5) == 0, F.lit(False))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                     WINDOW, keep=["doc_id"])
    hit = F.aggregate(F.zip_with("hit_start", "hit_end", lambda a, b: b - a), F.lit(0).cast("long"),
                      lambda acc, n: acc + n)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_start") > 0).alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"), words=SHINGLE_WORDS, max_bits=MAX_BITS, seed=SEED)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "kept_text")


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", winnow.as_string(F.col("fp")).alias("fingerprint"),
        winnow.as_string(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_windows(given.unionByName(probe)))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_JSON))
    return token_store.digest(store)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BPE_RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep=["doc_id"])
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids"), bpe.load_ranks(path)), 256).alias("decoded_sha256"))


def op11_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, F.coalesce(_remainder(3) != 1, F.lit(False)))
    found = lang_id.identify(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"),
                        F.col("lang_best").alias("lang_pred"), F.col("lang_score").alias("score"),
                        "lang_margin", (F.col("lang_pred") == F.col("lang_best")).alias("accepted"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaves = docs.select("lang", "doc_id", merkle.leaf(given).alias("h"),
                         F.when(_remainder(TAMPERED_EVERY) == 0, merkle.leaf(changed)).alias("seen"))
    found = merkle.manifest(leaves, "lang", ["doc_id"], MERKLE_ARITY)
    folded = merkle.folded(F.coalesce("seen", "h"), F.col("path"))
    return found.select("doc_id", F.col("h").alias("leaf"), "subroot", "root",
                        merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).select(
                            "*", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, found = centroids.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, DIMENSIONS, SCALE,
                                      CENTROID_SEED)
    return centroids.with_inertia(labels, found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_simhash, op4_html_extract, op5_url_filter,
                            op6_line_dedup, op7_winnow, op8_chat, op9_token_store, op10_bpe, op11_lang_id,
                            op12_merkle, op13_centroids)}

_UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), %s), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % _UPPER_LOWER

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k,
              array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(i)),
occ AS (SELECT doc_id, i, k, item_id FROM dg JOIN bw USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM occ, unnest(range(0, k)) AS u(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


def _sql_rule(host: str, path: str) -> tuple[str, str]:
    """The rule and the verdict of (host, path), as CASE expressions."""
    whens, kinds = "", ""
    for kind, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "allow")):
        name, _, below = text.partition("/")
        fits = f"({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '/{below}')"
        whens += f" WHEN {fits} THEN '{text}'"
        kinds += f" WHEN {fits} THEN '{kind}'"
    return f"(CASE{whens} END)", f"(CASE{kinds} END)"


def _sql_host(url: str) -> str:
    rest = f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"
    return f"coalesce(translate(regexp_extract({rest}, '^([^/?#]*)', 1), {_UPPER_LOWER}), '')"


def _sql_after(url: str, until: str) -> str:
    rest = f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"
    return f"coalesce(regexp_extract({rest}, '^[^/?#]*([^{until}]*)', 1), '')"


def _sql_node(url: str) -> str:
    tail = _sql_after(url, "#")
    return (f"(CASE WHEN strpos({url}, '://') > 0 THEN {_sql_host(url)} || "
            f"(CASE WHEN starts_with({tail}, '/') THEN {tail} ELSE '/' || {tail} END) END)")


def _sql_attribute(name: str) -> str:
    pattern = r"(?is)\b%s\s*=\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\s>\"'']+))" % name
    parts = " || ".join(f"coalesce(regexp_extract(tag, '{pattern}', {i}), '')" for i in (1, 2, 3))
    return f"trim(replace({parts}, '&amp;', '&'))"


_RULE, _KIND = _sql_rule("host", "path")
_, _NODE_KIND = _sql_rule("split_part(node, '/', 1)",
                          "regexp_extract(substr(node, length(split_part(node, '/', 1)) + 1), '^([^?#]*)', 1)")

SQL["op5_url_filter"] = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {_sql_host("url")} AS host, {_sql_after("url", "?#")} AS path, {_sql_node("url")} AS node, html
  FROM pages),
tags AS (
  SELECT url, host, path, node, unnest(regexp_extract_all(regexp_replace(coalesce(html, ''),
         '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM p WHERE node IS NOT NULL),
refs AS (
  SELECT url, host, path, node, CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_sql_attribute("rel")}), '(^|\s)canonical($|\s)')
      THEN {_sql_attribute("href")}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower({_sql_attribute("http-equiv")}) = 'refresh'
      THEN trim(regexp_extract({_sql_attribute("content")}, '(?is)url\s*=\s*[''"]?([^''"]*)', 1)) END AS ref
  FROM tags),
targets AS (
  SELECT node AS src, CASE
    WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
    WHEN starts_with(ref, '//') THEN 'x:' || ref
    WHEN ref = '' OR starts_with(ref, '#') OR regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(ref, '/') THEN 'x://' || host || ref
    WHEN starts_with(ref, '?') THEN 'x://' || host || path || ref
    ELSE 'x://' || host || (CASE WHEN regexp_replace(path, '[^/]*$', '') = '' THEN '/'
                                 ELSE regexp_replace(path, '[^/]*$', '') END) || ref END AS target
  FROM refs WHERE ref IS NOT NULL),
half AS (SELECT src, {_sql_node("target")} AS dst FROM targets WHERE target IS NOT NULL),
edges AS (SELECT src, dst FROM half WHERE dst IS NOT NULL AND src <> dst
          UNION SELECT dst, src FROM half WHERE dst IS NOT NULL AND src <> dst),
reach AS (SELECT src AS node, src AS other FROM edges UNION SELECT reach.node, edges.dst FROM reach JOIN edges ON reach.other = edges.src),
ruled AS (SELECT node, {_NODE_KIND} AS own FROM (SELECT DISTINCT src AS node FROM edges)),
alias AS (
  SELECT reach.node FROM reach JOIN ruled ON reach.other = ruled.node GROUP BY reach.node
  HAVING bool_or(coalesce(own = 'block', false)) AND NOT bool_or(coalesce(own = 'allow', false)))
SELECT page_id, host, path, {_RULE} AS rule,
       coalesce({_KIND}, CASE WHEN alias.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN alias ON p.node = alias.node
"""


def _sql_leaf(n_chars: str) -> str:
    def part(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: list_transform(range(0, 8), lambda b: ((ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) >> b) & 1)::BIGINT))),
  lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"""


def _sql_tree(name: str, rows: str, group: str) -> str:
    """CTE ``name`` (group, lvl, i, n, h): all levels of the trees over ``rows`` (group, i, n, h)."""
    a = MERKLE_ARITY
    return f"""{name} AS (
  SELECT {group}, 0 AS lvl, i, n, h FROM {rows}
  UNION ALL
  SELECT {group}, lvl + 1, i // {a}, max((n + {a - 1}) // {a}), sha256(string_agg(h, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY {group}, lvl, i // {a})"""


def _sql_climb(name: str, rows: str, tree: str, group: str) -> str:
    """CTE ``name``: the rows (no, lvl, i, proof, f) one level up at a time, siblings left and right."""
    a = MERKLE_ARITY
    return f"""{name} AS (
  SELECT no, {group}, 0 AS lvl, i, proof, f FROM {rows}
  UNION ALL
  SELECT no, {group}, lvl + 1, i // {a}, proof || l || r, sha256(l || f || r) FROM (
    SELECT c.no, c.{group}, c.lvl, c.i, c.proof, c.f,
           coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < c.i), '') AS l,
           coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > c.i), '') AS r
    FROM {name} c JOIN {tree} t ON t.{group} IS NOT DISTINCT FROM c.{group} AND t.lvl = c.lvl AND t.i // {a} = c.i // {a}
    WHERE t.n > 1 GROUP BY ALL))"""


SQL["op12_merkle"] = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS h,
         CASE WHEN {_CRC32} % {TAMPERED_EVERY} = 0 THEN {_sql_leaf("(n_chars + 1)")} END AS seen FROM documents),
rows_ AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, h) AS no,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n, '' AS proof, coalesce(seen, h) AS f FROM leaves),
{_sql_tree("tree", "rows_", "lang")},
groups_ AS MATERIALIZED (
  SELECT 0 AS every, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM tree WHERE n = 1),
{_sql_tree("top", "groups_", "every")},
{_sql_climb("climb", "rows_", "tree", "lang")},
reached AS MATERIALIZED (
  SELECT c.no, g.every, g.i, c.proof, c.f, g.h AS subroot FROM climb c
  JOIN (SELECT no, max(lvl) AS lvl FROM climb GROUP BY no) m ON c.no = m.no AND c.lvl = m.lvl
  JOIN groups_ g ON g.lang IS NOT DISTINCT FROM c.lang),
{_sql_climb("upper", "reached", "top", "every")}
SELECT w.doc_id, w.h AS leaf, r.subroot, t.h AS root, sha256(u.proof) AS proof_sha256, u.f AS folded_root, u.f = t.h AS verified
FROM upper u JOIN (SELECT no, max(lvl) AS lvl FROM upper GROUP BY no) m ON u.no = m.no AND u.lvl = m.lvl
JOIN rows_ w ON w.no = u.no JOIN reached r ON r.no = u.no JOIN top t ON t.n = 1
"""


def _sql_centroids() -> str:
    square = "list_sum(list_transform(range(1, %d), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))" % (DIMENSIONS + 1)

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT no, any_value(vec_id) AS vec_id, any_value(vq) AS q, min(c) AS cluster, min(d) AS distance FROM (
    SELECT v.no, v.vec_id, v.q AS vq, c.c, CAST({square} AS BIGINT) AS d FROM kept v, c{r} c
    QUALIFY row_number() OVER (PARTITION BY v.no ORDER BY d, c.c) = 1) GROUP BY no)"""

    def moved(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM (
      SELECT cluster, i, sum(q[i]) AS s, CAST(count(*) AS HUGEINT) AS n FROM a{r}, range(1, {DIMENSIONS + 1}) AS t(i)
      GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.c)"""

    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {DIMENSIONS}
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{CENTROID_SEED}:' || vec_id) NULLS LAST, q) - 1 AS c, q FROM kept
  QUALIFY c < {CENTROIDS}),
{steps},
{assigned(ROUNDS)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
       CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.cluster
"""


SQL["op13_centroids"] = _sql_centroids()
