"""The registered queries of the operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

import importlib.util
import os
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .decontaminate import contaminated
from .embedding_dedup import near_duplicates
from .hard_negatives import hard_negatives
from .jaccard_join import jaccard_groups
from .language_id import identify
from .lexical_search import ranked_search
from .licenses import scan
from .packing import pack_documents
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .token_output import read_tokens, write_tokens
from .toxicity import toxicity
from .topk_search import top_k


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, without importing more than its package needs."""
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.join(os.path.dirname(spec.origin), name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), length=400, words=51)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, manifest = write_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path, manifest, with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90, scale=256)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_output, op3_decontamination, op4_topk_search, op5_language_id, op6_toxicity, op7_best_fit_packing, op8_license_scan, op9_jaccard_join, op10_token_counts, op11_embedding_dedup, op12_hard_negatives, op13_ranked_search)}

_LOW = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = f"list_filter(string_split_regex({_LOW}, '[ \\x09-\\x0D]+'), lambda x: x <> '')"

_TERMS = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_TEMPLATES = _values((t, text) for t, text in enumerate([phrase for _, phrase in licenses.BASE] + [m.text for m in licenses.MORE]))
_BASE = _values(licenses.BASE)
_KEYS = _values((m.label, len(m.keys), key) for m in licenses.MORE for key in m.keys)

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT row_number() OVER () AS q, item_id, {_WORDS} AS w FROM benchmark),
 bs AS (SELECT DISTINCT q, item_id, least(len(w), 5) AS n, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM b WHERE len(w) > 0)),
 ds AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)),
 z AS (SELECT q, count(*) AS n_shingles FROM bs GROUP BY q)
 SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment FROM ds JOIN bs USING (n, s) JOIN z USING (q) GROUP BY r, doc_id, q, item_id HAVING 100 * count(*) >= 80 * any_value(n_shingles)""",
    "op4_topk_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op8_license_scan": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
 whole AS (SELECT r, ' ' || array_to_string(w, ' ') || ' ' AS body FROM d WHERE len(w) > 0),
 base(label, phrase) AS (VALUES {_BASE}), keys(label, n, phrase) AS (VALUES {_KEYS}), tpl(t, body) AS (VALUES {_TEMPLATES}),
 tw AS (SELECT t, unnest(string_split(body, ' ')) AS x, generate_subscripts(string_split(body, ' '), 1) AS k FROM tpl),
 dw AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) > 0),
 df AS (SELECT v.x, coalesce(n, 0) AS n FROM (SELECT DISTINCT x FROM tw) v LEFT JOIN (SELECT x, count(DISTINCT r) AS n FROM dw GROUP BY x) c USING (x)),
 rare AS (SELECT x, n, ln(((SELECT count(*) FROM d) + 1) / (n + 1)) + 1e-9 AS idf FROM df WHERE n <= 0.05 * (SELECT count(*) FROM d)),
 top AS (SELECT t, sum(idf) AS z FROM (SELECT t, idf FROM (SELECT DISTINCT t, x FROM tw) JOIN rare USING (x) QUALIFY row_number() OVER (PARTITION BY t ORDER BY idf DESC) <= 8) GROUP BY t),
 own AS (SELECT r, x, idf FROM (SELECT DISTINCT r, x FROM dw) JOIN rare USING (x) QUALIFY row_number() OVER (PARTITION BY r ORDER BY n, x) <= 8),
 part AS (SELECT r, max(share) AS share FROM (SELECT r, sum(idf) / any_value(z) AS share FROM own JOIN dw USING (r, x) JOIN tw USING (x) JOIN top USING (t) GROUP BY r, t, i - k) GROUP BY r),
 first AS (SELECT DISTINCT string_split(phrase, ' ')[1] AS x, phrase, label FROM base),
 places AS (SELECT dw.r, label, dw.i - 1 AS s FROM dw JOIN first USING (x) JOIN d USING (r) WHERE array_to_string(d.w[dw.i : dw.i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
 b AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
 found AS (SELECT r, label FROM places UNION SELECT r, label FROM whole JOIN keys ON contains(body, ' ' || phrase || ' ') GROUP BY r, label HAVING count(*) = any_value(keys.n)),
 l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY r)
 SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
 round(CASE WHEN l.labels IS NOT NULL THEN 1.0::DOUBLE ELSE least(coalesce(part.share, 0.0::DOUBLE), 0.99::DOUBLE) END, 6) AS score FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN part USING (r)""",
    "op9_jaccard_join": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT r, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
 z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
 l AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r JOIN z x ON x.r = a.r JOIN z y ON y.r = b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
 reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
 SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id FROM d LEFT JOIN z USING (r) LEFT JOIN reach ON reach.a = d.r LEFT JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id""",
    "op11_embedding_dedup": """WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 u AS (SELECT r, vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS z FROM d WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 l AS (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r WHERE list_inner_product(a.v, b.v) / (a.z * b.z) >= 0.93),
 reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
 SELECT d.vec_id, coalesce(any_value(n.n), 0) AS n_links, least(d.vec_id, min(o.vec_id)) AS component_id, d.vec_id = least(d.vec_id, min(o.vec_id)) AS kept FROM d LEFT JOIN n ON n.a = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN d o ON o.r = reach.b GROUP BY d.r, d.vec_id""",
    "op12_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
 p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
 SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents), b AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark),
 s AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0), z AS (SELECT count(*) AS docs, sum(n) AS terms FROM s), norm AS (SELECT r, doc_id, 50 + (50 * n * docs) // terms AS m FROM s, z),
 p AS (SELECT r, x, count(*) AS tf FROM (SELECT r, unnest(t) AS x FROM d) GROUP BY r, x), v AS (SELECT x, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, z GROUP BY x),
 a AS (SELECT DISTINCT q, item_id, unnest(t) AS x FROM b),
 sums AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM a JOIN v USING (x) JOIN p USING (x) JOIN norm USING (r) GROUP BY q, item_id, r, doc_id)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sums WHERE score > 0 QUALIFY rank <= 50""",
}
