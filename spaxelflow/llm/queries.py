"""The registered queries opN_<name>, and their SQL where DuckDB can express it.

Each query applies its operator, with production parameters, to its whole table; the digest columns are derived
here from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, clustering, decontamination, fingerprints, hard_negatives, html_text, language_id, ngram_join, packing, quality, secrets, substring_dedup


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out() -> Column:
    """crc32 of doc_id as text, modulo 4, is 2; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_read(spark, sf_dir, "conversations"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = _read(spark, sf_dir, "labels").where(~held_out())
    model = quality.train(docs.where(~F.col("held_out")), labels)
    scored = quality.score(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"), ["page_id", "url"])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_groups(_read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"), ["doc_id"]).drop("clean_text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op7_phrase_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_read(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), ["doc_id"]).drop("kept_text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(_read(spark, sf_dir, "documents"), ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    digests = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids")
    decoded = byte_bpe.decode(digests, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(_read(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"), number % 100 == 0, 64, label=label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VECTORS = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _cluster_sql(k: int, rounds: int) -> str:
    """Rounds of assignment and floored means, one after another."""
    parts = [f"e AS MATERIALIZED ({_VECTORS})", "l AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e)"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM e QUALIFY c < {k})")
    near = "SELECT vec_id, c, list_sum(list_transform(list_zip(e.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM e, c{r} AS m QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) = 1"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            sums = f"SELECT c, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN l USING (vec_id) GROUP BY c, d"
            moved = f"SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS v FROM ({sums}) GROUP BY c"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} AS o LEFT JOIN ({moved}) AS m ON m.c = o.c)")
    last = f"a{rounds}"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INT) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, (SELECT sha256(array_to_string(v, ',')) FROM c{rounds} AS m WHERE m.c = {last}.c) AS centroid_sha256 FROM {last}"


_SQL = {
    "op12_centroid_clustering": _cluster_sql(40, 5),
    "op13_hard_negatives": f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM ({_VECTORS}) WHERE label IS NOT NULL),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5""",
    "op1_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
r AS (SELECT conv_id, count(*) AS n, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS s FROM o GROUP BY conv_id),
d AS (SELECT min(conv_id) AS conv_id, n, s, count(*) AS n_copies FROM r GROUP BY n, s),
m AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE e.n > d.n AND starts_with(e.s, d.s)))
SELECT m.conv_id, CAST(floor((pos - 1) / 256) AS BIGINT) AS part, m.n AS n_turns, m.n_copies,
       string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM m JOIN o ON o.conv_id = m.conv_id GROUP BY ALL""",
    "op4_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) AS c ON c.node = d.doc_id""",
    "op6_decontamination": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS v, array_to_string(v, ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dg.doc_id, dg.i, dg.n, win.item FROM dg JOIN win ON win.g = dg.g AND win.n = dg.n),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
lists AS MATERIALIZED (SELECT doc_id, t, list(p) AS ps FROM (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw) GROUP BY doc_id, t),
counts AS (SELECT t, sum(len(ps)) AS c FROM lists GROUP BY t),
ranked AS (SELECT item, g, n, t, row_number() OVER (PARTITION BY item, g ORDER BY coalesce(c, 0), o) AS r FROM (SELECT item, g, n, unnest(v) AS t, generate_subscripts(v, 1) AS o FROM win) LEFT JOIN counts USING (t) QUALIFY r <= {decontamination.RAREST}),
rarest AS (SELECT DISTINCT item, n, ts FROM (SELECT item, g, n, list(t ORDER BY r) AS ts FROM ranked GROUP BY item, g, n)),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT a.doc_id, item FROM rarest JOIN lists AS a ON a.t = ts[1]
 LEFT JOIN lists AS b ON b.doc_id = a.doc_id AND b.t = ts[2] LEFT JOIN lists AS c ON c.doc_id = a.doc_id AND c.t = ts[3]
 WHERE len(list_filter(a.ps, lambda p: (len(ts) < 2 OR len(list_filter(b.ps, lambda q: abs(q - p) < n + {decontamination.SLOP})) > 0) AND (len(ts) < 3 OR len(list_filter(c.ps, lambda q: abs(q - p) < n + {decontamination.SLOP})) > 0))) > 0)
 GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id LEFT JOIN near ON near.doc_id = dw.doc_id""",
    "op8_substring_dedup": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS least FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM g JOIN f ON f.g = g.g WHERE f.least < g.doc_id),
k AS (SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.k) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) AS u LEFT JOIN c ON c.doc_id = u.doc_id AND c.k = u.k WHERE c.k IS NULL GROUP BY u.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, len(w.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
