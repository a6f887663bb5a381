"""The registered corpus queries, each over whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import centroids, decontaminate, exact_dedup, fingerprints, html_text, language, language_model, line_dedup, mixing, near_duplicates, prefix_trie, quality, toxicity
from tidemark.llm.tables import crc_mod, stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _held_out(divisor: int, remainder: int) -> F.Column:
    return F.coalesce(crc_mod("doc_id", divisor) == remainder, F.lit(False))


@query
def op1_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


ORACLES["op1_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
g AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT u AS node, u AS seen FROM g UNION SELECT r.node, g.v FROM r JOIN g ON r.seen = g.u),
c AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, coalesce(c.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.node = w.doc_id
"""


@query
def op2_toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents.where(~_held_out(4, 2)), labels.where(~_held_out(4, 2)))
    scored = toxicity.score_documents(documents, model)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_line_dedup(spark, sf_dir):
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLES["op3_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last IS NOT NULL AND last <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (last IS NULL OR last = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""


@query
def op4_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = language.train(documents.where(~_held_out(5, 0)))
    return language.identify(documents, model).select("doc_id", _held_out(5, 0).alias("held_out"), "lang_pred", "score")


@query
def op5_fingerprints(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op6_source_mix(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels.where(~_held_out(4, 2)))
    scored = quality.score_documents(documents, model)
    return scored.select("doc_id", _held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_decontamination(spark, sf_dir):
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


ORACLES["op9_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)
"""


@query
def op10_language_model(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    texts = documents.where(~_held_out(10, 0))
    counts = stage(language_model.token_counts(texts), "token-counts")
    model = language_model.train(texts, counts)
    scored = language_model.score_documents(documents, model, counts)
    return scored.select("doc_id", _held_out(10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op11_prefix_trie"] = r"""
WITH r AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY rn) AS turns FROM r GROUP BY conv_id),
h AS (
  SELECT *, xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295::BIGINT) % 4 AS h
  FROM o),
c AS (
  SELECT a.conv_id, list_concat(CASE WHEN a.h = 0 OR b.turns IS NULL THEN [] ELSE b.turns[1:a.h] END, a.turns[a.h + 1:]) AS t
  FROM h a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, t[1:d] AS k, d, len(t) AS n, t[d].text AS last FROM (SELECT conv_id, t, unnest(generate_series(0, len(t))) AS d FROM c)),
g AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS deepest,
         (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(last), ''), '[^ 	-
]+')) AS cost,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY k, d),
u AS (SELECT g.d, g.conv_id, g.cost, g.deepest, g.k, unnest(generate_series(0, g.d)) AS up FROM g),
s AS (SELECT k[1:up] AS k, sum(cost) AS saved, count(*) FILTER (deepest = d) AS leaves FROM u GROUP BY 1),
ch AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM g WHERE d > 0 GROUP BY 1)
SELECT g.conv_id, g.d::BIGINT AS depth, q.conv_id AS parent_conv_id, g.n_convs, coalesce(ch.n, 0) AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN s ON s.k = g.k LEFT JOIN ch ON ch.k = g.k LEFT JOIN g q ON g.d > 0 AND q.k = g.k[1:g.d - 1]
"""


@query
def op12_exact_dedup(spark, sf_dir):
    kept = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op13_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def _centroid_sql(rounds: int = 10) -> str:
    """Every round as a pair of common table expressions: nearest centroids, then their floored means."""
    near = """a{i} AS MATERIALIZED (
  SELECT row, vec_id, v, cluster, distance FROM (
    SELECT k.row, k.vec_id, k.v, c.cluster, list_sum(list_transform(list_zip(k.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS distance,
           row_number() OVER (PARTITION BY k.row ORDER BY list_sum(list_transform(list_zip(k.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c.cluster) AS r
    FROM k CROSS JOIN c{i} c) WHERE r = 1)"""
    mean = """c{j} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS v FROM (
      SELECT cluster, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""
    steps = [near.format(i=0)] + [part for i in range(rounds) for part in (mean.format(i=i, j=i + 1), near.format(i=i + 1))]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster, v FROM k
  QUALIFY cluster < 8),
{", ".join(steps)}
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)
"""


ORACLES["op13_centroids"] = _centroid_sql()
