"""The training-data queries over the given tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import consensus_html, dart_minhash, fm_index, hilbert_clusters, line_crf, line_dedup, mixing, phrase_mining, pivot_search, pu_toxicity, rank_profiles, secret_lexer, warc_bundles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MIX_SQL = r"""
WITH units AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, count(*) AS copies
  FROM documents GROUP BY ALL),
sized AS (
  SELECT source, sum(size * copies)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM units GROUP BY source),
weighed AS (SELECT *, ((rank - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM sized),
filled AS (
  SELECT *, sum(most) OVER w AS most_to, sum(weight) OVER w AS weight_to, (SELECT sum(source_size)::DOUBLE FROM sized) AS all_size, (SELECT sum(weight) FROM weighed) AS all_weight
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (all_size - (most_to - most)) / (all_weight - (weight_to - weight)) AS level FROM filled),
cut AS (SELECT level FROM levels WHERE most > weight * level ORDER BY most / weight, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN (SELECT count(*) FROM cut) = 0 THEN most ELSE least(most, weight * (SELECT level FROM cut)) END AS target FROM levels),
placed AS (
  SELECT u.*, t.source_size, t.target,
    sum(size * copies) OVER (PARTITION BY u.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size * copies AS start
  FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * coalesce(len(list_filter([0, 1, 2], lambda k: row < floor((target - (start + k * source_size)::DOUBLE) / nullif(size, 0) + 0.5))), 0))::BIGINT AS taken
FROM placed, unnest(range(copies)) AS r(row)
"""


@_query("op1_curriculum_mix", _MIX_SQL)
def curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).drop("first_position")


@_query("op2_dart_minhash")
def dart_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.classes(_table(spark, sf_dir, "documents"))


_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p GROUP BY digest),
hexed AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, digest, first, page_id IS NOT DISTINCT FROM first AS is_first FROM p JOIN f USING (digest))
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (('0x' || substr(digest, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - (5 * i) % 4)::INT) % 32 + 1, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN is_first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT is_first THEN first END AS refers_to
FROM hexed
"""


@_query("op3_warc_bundles", _WARC_SQL)
def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc_bundles.archive(_table(spark, sf_dir, "pages"))
    records = warc_bundles.read_bundles(folder, index)
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op4_assignment_secrets")
def assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_lexer.find_secrets(_table(spark, sf_dir, "documents"))


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LEAK_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
phrase AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
lengths AS (SELECT DISTINCT n FROM phrase),
grams AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS r(i)),
found AS (SELECT k, i, g.n, item FROM grams g JOIN phrase q ON g.p = q.p AND g.n = q.n),
hit AS (SELECT k, count(DISTINCT j) AS n_hit FROM found, unnest(range(i, i + n)) AS r(j) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS ids FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
"""


@_query("op5_fm_decontamination", _LEAK_SQL)
def fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@_query("op6_line_crf_quality")
def line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = line_crf.scores(docs, line_crf.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


@_query("op7_consensus_html")
def consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_html.extract(_table(spark, sf_dir, "pages"))


@_query("op8_pu_toxicity")
def pu_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = pu_toxicity.scores(docs, pu_toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", line_crf.in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= pu_toxicity.THRESHOLD).cast("int").alias("predicted"))


_TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@_query("op9_pivot_top_k", _TOP_SQL)
def pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query("op10_rank_order_language")
def rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = rank_profiles.identify(docs, rank_profiles.train(docs))
    held_out = line_crf.in_fold(F.col("doc_id"), rank_profiles.FOLDS, rank_profiles.HELD_OUT)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_LINES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT k, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}') AS key FROM d, unnest(range(1, len(l) + 1)) AS r(i)),
shared AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT k) >= 10),
told AS (SELECT k, count(*) AS n_dropped FROM lines JOIN shared USING (key) GROUP BY k),
kept AS (SELECT k, string_agg(line, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN shared USING (key) GROUP BY k)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN told USING (k) LEFT JOIN kept USING (k)
"""


@_query("op11_line_dedup", _LINES_SQL)
def shared_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_shared_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def _cluster_sql(rounds: int = 3) -> str:
    steps = ""
    near = "SELECT * FROM (SELECT k, c, d, row_number() OVER (PARTITION BY k ORDER BY d, c) AS place FROM (SELECT k, c, list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - w.v[i]) * (v.v[i] - w.v[i])))::BIGINT AS d FROM v, c{0} AS w)) WHERE place = 1"
    for k in range(rounds):
        steps += f"""a{k} AS ({near.format(k)}),
s{k} AS (SELECT c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN v USING (k), unnest(range(1, 65)) AS r(i) GROUP BY c, i),
m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{k} AS o LEFT JOIN m{k} AS m USING (c)),
"""
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 16),
{steps}last AS ({near.format(rounds)})
SELECT vec_id, last.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w.v, ',')) AS centroid_sha256
FROM last JOIN v USING (k) JOIN c{rounds} AS w ON w.c = last.c
"""


@_query("op12_hilbert_clusters", _cluster_sql())
def hilbert_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hilbert_clusters.clusters(_table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


_PHRASE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[.,;:!?
-
]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM pieces),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, 5)) AS s(k), unnest(range(1, len(w) - k + 2)) AS r(i) GROUP BY ALL),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
held AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS holder FROM c, unnest(range(2, 4)) AS s(m), unnest(range(1, 4)) AS r(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE NOT coalesce(100::HUGEINT * holder >= 80::HUGEINT * a, false)),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM kept, unnest(range(1, 4)) AS r(j) WHERE j < k),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, x.f AS l, y.f AS r, ((2000000::HUGEINT * cut.a) // (x.f + y.f))::BIGINT AS score, row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY (2000000::HUGEINT * cut.a) // (x.f + y.f), j) AS place
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored WHERE place = 1) JOIN n USING (lang) WHERE rank <= 2000
"""


@_query("op13_phrase_mining", _PHRASE_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(_table(spark, sf_dir, "documents"))
