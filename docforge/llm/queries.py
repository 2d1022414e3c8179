"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm import bpe, centroids, codes, embed, exact, langid, ngramjoin, packing, pieces, pii, substring, suffix, toxicity
from docforge.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs, langid.train(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "lang_pred", "score", "n_bytes")


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_private(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.byte_digests(table(spark, sf_dir, "documents"))


def op5_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.vector_links(table(spark, sf_dir, "embeddings"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.word_digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language, op2_private, op3_packing, op4_suffix, op5_exact, op6_embeddings, op7_substring, op8_toxicity, op9_pieces, op10_jaccard, op11_bpe, op12_codes, op13_centroids)}


def _codes_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds, one pair of steps a round; op12 must give the same."""
    steps = [
        """v AS MATERIALIZED (
          SELECT vec_id, label, len(embedding) // 4 AS w, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS MATERIALIZED (SELECT vec_id, p, list_slice(x, p * w + 1, p * w + w) AS x FROM v, range(4) AS r(p)),
        c0 AS MATERIALIZED (SELECT p, e, x FROM q JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v ORDER BY vec_id LIMIT 256) USING (vec_id))"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
          SELECT vec_id, p, any_value(q.x) AS x, min((list_inner_product(q.x, q.x) - 2 * list_inner_product(q.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + e) AS m
          FROM q JOIN c{r} c USING (p) GROUP BY vec_id, p)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
          SELECT p, e, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (
            SELECT p, e, list((s - ((s % n) + n) % n) / n ORDER BY i) AS x FROM (
              SELECT p, m % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL)
            GROUP BY p, e) n USING (p, e))""")
    steps.pop()
    return f"""
        WITH {",".join(steps)},
        done AS (
          SELECT vec_id, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
        labels_ AS (SELECT label, sum(error)::BIGINT AS label_error FROM done JOIN v USING (vec_id) GROUP BY label),
        books AS (SELECT sha256(string_agg(x[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM c{rounds}))
        SELECT vec_id, code, error, label_error, codebooks_sha256
        FROM done JOIN v USING (vec_id) JOIN labels_ l ON v.label IS NOT DISTINCT FROM l.label, books"""


def _centroids_sql(rounds: int = 3) -> str:
    """The same rounds as joins and sums."""
    steps = [
        """v AS MATERIALIZED (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
          WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v ORDER BY c LIMIT 16)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
          SELECT vec_id, any_value(v.x) AS x, min(list_sum(list_transform(list_zip(v.x, k.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 16 + c) AS m
          FROM v, c{r} k GROUP BY vec_id)""")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
          SELECT c, coalesce(n.x, k.x) AS x FROM c{r} k LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) / n ORDER BY i) AS x FROM (
              SELECT m % 16 AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT m, x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY ALL)
            GROUP BY c) n USING (c))""")
    steps.pop()
    return f"""
        WITH {",".join(steps)}
        SELECT vec_id, (m % 16)::INTEGER AS cluster, m // 16 AS distance, (sum(m // 16) OVER (PARTITION BY m % 16))::BIGINT AS cluster_inertia, (sum(m // 16) OVER ())::BIGINT AS inertia,
               (SELECT sha256(array_to_string(list_transform(x, lambda y: y::BIGINT), ',')) FROM c{rounds} k WHERE k.c = m % 16) AS centroid_sha256
        FROM a{rounds}"""


#: DuckDB over the same tables, where SQL can say it in reasonable time.
ORACLES = {
    "op5_exact": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        g AS (
          SELECT text_sha256, count(*) AS group_size,
                 first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id
          FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op4_suffix": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        s AS (
          SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 200)) AS k
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
        again AS (
          SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM s)
          WHERE nth > 1),
        runs AS (
          SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
            SELECT doc_id, p, sum(CASE WHEN p - was <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
            FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM again))
          GROUP BY doc_id, run),
        cut AS (
          SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS rest,
                 string_agg(substring(h, 2 * up + 1, 2 * (a - up)), '' ORDER BY a) AS front
          FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS up FROM runs) JOIN d USING (doc_id)
          GROUP BY doc_id)
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(from_hex(coalesce(front, '') || substring(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op7_substring": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, p, md5_number(array_to_string(list_slice(w, p + 1, p + 35), ' ')) AS k
          FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS p FROM d)),
        again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS times FROM s) WHERE times > 1),
        runs AS (
          SELECT doc_id, min(p) AS a, max(p) + 35 AS b FROM (
            SELECT doc_id, p, sum(CASE WHEN p - was <= 35 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run
            FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM again))
          GROUP BY doc_id, run),
        ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, len(w), len(w) FROM d),
        kept AS (
          SELECT doc_id, string_agg(array_to_string(list_slice(w, up + 1, a), ' '), ' ' ORDER BY a) AS t
          FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS up FROM ends) JOIN d USING (doc_id)
          WHERE a > up GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed FROM runs GROUP BY 1) USING (doc_id)""",
    "op10_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        sets AS (
          SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, p + 1, p + 4), ' ')) AS k
          FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 3, least(len(w), 1)))) AS p FROM w)),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
        shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sets x JOIN sets y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (
          SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * both_ >= 85 * (x.n + y.n - both_)),
        reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
        SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op12_codes": _codes_sql(),
    "op13_centroids": _centroids_sql(),
}
