"""Registered queries of the operators, each over its whole table, and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perennial.llm import (
    centroids,
    cotrain,
    decontam,
    langid,
    mixing,
    ngram_join,
    order_minhash,
    pii,
    spelling,
    token_count,
    tool_calls,
    toxicity,
    wavelet,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` with its SQL equivalent, where SQL has one."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = """WITH sized AS (SELECT doc_id, text, source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(1 + place % 3 AS BIGINT) AS weight, 3 * source_size AS bound FROM sources),
levels AS (SELECT *, sum(source_size) OVER () AS whole,
  CAST((sum(source_size) OVER () - coalesce(sum(bound) OVER (ORDER BY bound / weight, place
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS DOUBLE)
  / sum(weight) OVER (ORDER BY bound / weight, place
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
shares AS (SELECT *, bound <= level AS reached,
  sum(CASE WHEN bound <= level THEN bound ELSE 0 END) OVER () AS filled,
  sum(CASE WHEN bound <= level THEN 0 ELSE weight END) OVER () AS open_weight FROM levels),
targets AS (SELECT source, source_size, CASE WHEN reached THEN CAST(bound AS DOUBLE)
  ELSE CAST((whole - filled) * weight AS DOUBLE) / open_weight END AS target FROM shares),
rated AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  least(3.0, coalesce(t.target / nullif(t.source_size, 0), 0)) AS rate,
  CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13)
    AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate)
  + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM rated"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark, sf_dir):
    plan = mixing.mixture_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_pii")
def op3_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_digest(docs).drop("text")


_WORDS_SQL = (
    "regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
LEAKS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id,
  coalesce({_WORDS_SQL.format(text='text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL.format(text='text')} AS w FROM benchmark
  WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n,
  list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM (
  SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT p.r, p.i, p.n, x.item FROM places p JOIN win x ON p.n = x.n AND p.win = x.win),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (
  SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names
  FROM hits GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


@query("op4_decontamination", LEAKS_SQL)
def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark")
    return decontam.digest(decontam.with_contamination(docs, benchmark)).drop("text", "longest_match")


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.with_token_counts(docs, vocabulary).drop("text")


NEAR_SQL = """WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS s FROM (
  SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s
  AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM edge UNION
  SELECT r.a, e.b FROM r JOIN edge e ON r.b = e.a) SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, reach.least) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id"""


@query("op9_ngram_jaccard_join", NEAR_SQL)
def op9_ngram_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngram_join.ngram_jaccard_join(docs, n=3, similarity=(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def held_out(key, parts: int, part: int):
    return F.crc32(key.cast("string")) % parts == part


@query("op6_language_id")
def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = held_out(F.col("doc_id"), 5, 0)
    model = langid.fit(docs.where(~apart), F.col("doc_id"))
    found = langid.with_language(docs.withColumn("held_out", apart), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op7_order_minhash")
def op7_order_minhash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return order_minhash.compare_with_next(docs)


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    apart = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    learned = ~held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, labels.where(learned))
    scored = toxicity.with_toxicity(docs.withColumn("held_out", apart), model)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


#: Tools of the chat query: what a question may look like.
TOOLS = {
    "ask": '{"type":"object","required":["question","turn"],"additionalProperties":false,"properties":'
    '{"question":{"type":"string","minLength":1,"maxLength":400},"turn":{"type":"integer","maximum":5}}}',
    "start": '{"type":"object","required":["question","turn"],"properties":'
    '{"question":{"type":"string","minLength":1},"turn":{"enum":[0,1]}}}',
}
CALLS_SQL = """WITH RECURSIVE calls AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn, text,
  CASE WHEN turn < 2 THEN 'start' ELSE 'ask' END AS name,
  CASE WHEN turn IN (0, 2) AND conv_id % 5 = 0 THEN CASE turn WHEN 0 THEN 2 END
    WHEN turn IN (0, 2) AND conv_id % 7 = 0 THEN 2 - turn WHEN turn >= 2 THEN turn - 2 END AS earlier
  FROM conversations WHERE role = 'user'),
edges AS (SELECT c.conv_id, c.turn, c.earlier FROM calls c JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.earlier),
turned AS (SELECT DISTINCT conv_id FROM edges WHERE earlier >= turn),
lev(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0 FROM (SELECT * FROM calls SEMI JOIN turned USING (conv_id)) ANTI JOIN edges USING (conv_id, turn)
  UNION ALL SELECT e.conv_id, e.turn, l.level + 1 FROM lev l JOIN edges e ON e.conv_id = l.conv_id AND e.earlier = l.turn),
results AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text AS content
  FROM conversations WHERE role = 'assistant'),
linked AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
  c.name, CASE WHEN t.conv_id IS NULL THEN c.turn ELSE l.level END AS position,
  CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN t.conv_id IS NOT NULL AND l.level IS NULL THEN 'cycle'
  WHEN c.earlier IS NOT NULL AND p.call_id IS NULL THEN 'missing_dependency'
  WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status, c.text, r.content, c.turn
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
  LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.earlier LEFT JOIN turned t ON t.conv_id = c.conv_id
  LEFT JOIN lev l ON l.conv_id = c.conv_id AND l.turn = c.turn)
SELECT conv_id, call_id, name, position, status, CASE WHEN name IS NULL THEN '' ELSE concat_ws('; ',
    CASE WHEN name = 'ask' AND length(text) > 400 THEN '$.question: too long' END,
    CASE WHEN length(text) < 1 THEN '$.question: too short' END,
    CASE WHEN name = 'ask' AND turn > 5 THEN '$.turn: above maximum' END) END AS errors,
  '{"arguments":' || CASE WHEN name IS NULL THEN 'null' ELSE '{"question":' || to_json(text) || ',"turn":'
  || turn || '}' END || ',"call_id":' || to_json(call_id) || ',"content":'
  || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"conv_id":' || conv_id || ',"name":'
  || coalesce(CAST(to_json(name) AS VARCHAR), 'null') || '}' AS record FROM linked"""


@query("op1_tool_calls", CALLS_SQL)
def op1_tool_calls(spark, sf_dir):
    """Every user turn calls a tool and depends on the user turn before; the next turn answers it.

    In every fifth conversation the first call waits for the second, in every seventh both for each other.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def name(turn):
        return F.concat_ws(":", F.col("conv_id"), turn)

    turn, first = F.col("turn"), F.col("turn").isin(0, 2)
    earlier = (
        F.when(first & (F.col("conv_id") % 5 == 0), F.when(turn == 0, 2))
        .when(first & (F.col("conv_id") % 7 == 0), 2 - turn)
        .when(turn >= 2, turn - 2)
    )
    calls = turns.where("role = 'user'").select(
        "conv_id",
        name(F.col("turn")).alias("call_id"),
        F.col("turn").alias("place"),
        F.when(F.col("turn") < 2, "start").otherwise("ask").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("question"))).alias("arguments"),
        F.when(earlier.isNotNull(), F.array(name(earlier)))
        .otherwise(F.array().cast("array<string>"))
        .alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id",
        name(F.col("turn") - 1).alias("call_id"),
        F.col("turn").alias("place"),
        F.col("text").alias("content"),
    )
    schemas = spark.createDataFrame(sorted(TOOLS.items()), "name string, schema string")
    linked = tool_calls.link_calls(calls, results, schemas)
    errors = F.array_join("errors", "; ").alias("errors")
    return linked.select("conv_id", "call_id", "name", "position", "status", errors, "record")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@query("op10_quality_cotraining")
def op10_quality_cotraining(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = cotrain.fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    scored = cotrain.with_quality(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        F.col("quality.content").alias("content_score"),
        F.col("quality.metadata").alias("metadata_score"),
        F.col("quality.score").alias("score"),
        (F.col("quality.score") >= 0.5).cast("int").alias("predicted"),
    )


SPELLING_SQL = """WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]+')) AS run
  FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(doc || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END))),
    lambda x, y: xor(t[CAST(xor(x, y) % 256 + 1 AS BIGINT)], x // 256)), 4294967295) AS h FROM counted, tab),
kept AS (SELECT n, CASE WHEN h % 199 > 0 THEN run ELSE substr(run, 1, h % length(run))
  || substr(run, h % length(run) + 2) END AS word FROM summed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gap AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT x.word, y.word AS near FROM gap x JOIN gap y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT g.word, w.word FROM gap g JOIN w ON w.word = g.a || g.b
  UNION SELECT w.word, g.word FROM gap g JOIN w ON w.word = g.a || g.b),
best AS (SELECT word, count(*) AS n_near, min(ROW(-n, near)) AS b FROM pairs JOIN
  (SELECT word AS near, n FROM w) USING (near) GROUP BY word),
form AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, -b[1] AS form_n, b[2] AS form
  FROM w LEFT JOIN best USING (word)),
formed AS (SELECT word, n, n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
  CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM form),
walk AS (WITH RECURSIVE r(word, last, up) AS (SELECT word, word, form FROM formed UNION ALL
  SELECT r.word, f.word, f.form FROM r JOIN formed f ON f.word = r.up) SELECT word, last AS root FROM r WHERE up IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN walk USING (word)"""


@query("op12_spelling_variants", SPELLING_SQL)
def op12_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_wavelet_shards")
def op13_wavelet_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = wavelet.write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return wavelet.stored_documents(store)


def _rounds_sql(rounds: int) -> str:
    """``c0`` to ``cN`` are the centroids after each round, ``aN`` the assignment to ``cN``."""
    parts = []
    for r in range(rounds + 1):
        parts.append(
            f"""f{r} AS (SELECT p.r, c.cluster, list_sum(list_transform(range(1, 65),
              lambda i: (p.point[i] - c.point[i]) * (p.point[i] - c.point[i])))::BIGINT AS distance
              FROM points p, c{r} c),
            a{r} AS (SELECT r, -b[2] AS cluster, -b[1] AS distance FROM (
              SELECT r, max(ROW(-distance, -cluster)) AS b FROM f{r} GROUP BY r))"""
        )
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT cluster, list(mean ORDER BY i) AS point FROM (
                  SELECT cluster, i, (s - ((s % n) + n) % n) // n AS mean FROM (
                    SELECT a.cluster, i, sum(p.point[i])::BIGINT AS s, count(*) AS n
                    FROM a{r} a JOIN points p USING (r), range(1, 65) AS x(i) GROUP BY a.cluster, i)) GROUP BY cluster),
                c{r + 1} AS (SELECT c.cluster, coalesce(m.point, c.point) AS point
                  FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""
            )
    return ", ".join(parts)


CENTROIDS_SQL = f"""WITH points AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS point FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, point FROM points
  ORDER BY cluster LIMIT 40), {_rounds_sql(5)},
sums AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a5 GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, distance, cluster_inertia,
  (SELECT sum(distance)::BIGINT FROM a5) AS inertia,
  sha256(array_to_string(c.point, ',')) AS centroid_sha256
FROM a5 a JOIN points USING (r) JOIN sums ON sums.cluster = a.cluster JOIN c5 c ON c.cluster = a.cluster"""


@query("op11_centroid_clusters", CENTROIDS_SQL)
def op11_centroid_clusters(spark, sf_dir):
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))
