"""The registered queries of this subpackage: one ``opN_<name>`` an operator, over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, conversations, decontaminate, html_text, langid, licenses, mixing, pii, repeats, shingle_join, token_counts, topk
from .arrow import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.defaults())


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages in one table; the model is fitted on labelled documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = langid.document_rows(docs).withColumn("page_id", none)
    languages, known = langid.fit(docs)
    return langid.identify(rows.unionByName(langid.page_rows(pages).withColumn("doc_id", none)), languages, known)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.lengths(table(spark, sf_dir, "documents"), *bpe.defaults())
    return token_counts.by_limit(token_counts.histogram(counted))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's directory is its source and language."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {
    "op2_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, greatest(len(x) // 2 - 199, 0))) AS i FROM d)),
many AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), hit AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN many USING (h)),
run AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM hit) GROUP BY r, run),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS p FROM run),
k AS (SELECT d.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || any_value(substr(x, 2 * e + 1)) AS kept FROM gap JOIN d USING (r) JOIN (SELECT r, max(b) AS e FROM run GROUP BY r) USING (r) GROUP BY d.r)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op3_top_k": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_shingle_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * c.c >= 80 * (x.n + y.n - c.c)),
r(d, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.d), k AS (SELECT d, min(c) AS component_id FROM r GROUP BY d),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY all_s) AS class_id FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS all_s FROM sh GROUP BY doc_id))
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, coalesce(class.class_id, w.doc_id) AS class_id FROM w JOIN k ON w.doc_id = k.d LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN class ON w.doc_id = class.doc_id""",
    "op6_decontaminate": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, k, array_to_string(w[j + 1:j + k], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS j FROM b WHERE len(w) > 0)),
o AS (SELECT doc_id, k, j, array_to_string(w[j + 1:j + k], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS j FROM d, (SELECT DISTINCT k FROM i))),
m AS (SELECT o.doc_id, o.j, o.k, i.item_id FROM o JOIN i ON o.k = i.k AND o.s = i.s), h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(g.t, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op11_collocations": f"""WITH p AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(coalesce({LOWER}, ''), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM p GROUP BY lang), g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, w[i:i + k - 1] AS w, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.w, c.k, c.cut, c.f AS a, l.f AS l, r.f AS r, t.n, (1000 * c.f * t.n) // (l.f * r.f) AS score FROM c JOIN t ON c.lang = t.lang JOIN f l ON l.lang = c.lang AND l.w = c.w[1:cut] JOIN f r ON r.lang = c.lang AND r.w = c.w[cut + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
sub AS (SELECT DISTINCT x.lang, x.w[i:i + j - 1] AS w, max(x.f) OVER (PARTITION BY x.lang, x.w[i:i + j - 1]) AS f FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM f, range(2, 5) r(j) WHERE j < k) x),
z AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM b LEFT JOIN sub ON b.lang = sub.lang AND b.w = sub.w WHERE sub.f IS NULL OR sub.f < b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    """The rest can't be said in SQL; their tests hold them against brute force."""
    return dict(ORACLE_SQL)
