"""The operators on their whole tables, as named queries, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procura.llm import bpe, chat, collocations, embedding_dedup, langid, lexical, minhash, mixing, packing, quality, secrets, topk, urls
from procura.llm.common import fold, table


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"), fold("doc_id", 5) != 0)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held.alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold("doc_id", 3) != 1)
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return langid.identify(docs.withColumn("held_out", held), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_balanced(docs).select("doc_id", "_mix.*")


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    found = chat.format_chats(rows, F.coalesce(fold("_key", 5) != 0, F.lit(False)))
    return found.withColumn("held_out", F.coalesce(fold("conv_id", 5) == 0, F.lit(False)))


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    found = urls.judge(table(spark, folder, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", secrets.scan(F.col("text")).alias("d")).select("doc_id", "d.*")


def tokenizer() -> str:
    """The default vocabulary file, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sent = bpe.vocabulary(spark, path or tokenizer())
    return docs.select("doc_id", bpe.digests(F.col("text"), sent).alias("d")).select("doc_id", "d.*")


def op10_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_packing(spark: SparkSession, folder: str, path: str | None = None) -> DataFrame:
    sent = bpe.vocabulary(spark, path or word_tokenizer())
    return packing.pack_documents(table(spark, folder, "documents"), sent)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op5_langid": op5_langid,
    "op2_mixing": op2_mixing,
    "op3_minhash": op3_minhash,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op6_chat": op6_chat,
    "op7_urls": op7_urls,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_topk": op10_topk,
    "op11_ranked_search": op11_ranked_search,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.c) = len(q.c)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s
)
SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), g AS (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), l AS (
  SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * both_have >= 75 * (len(x.s) + len(y.s) - both_have)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)
"""

_COSINE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine
  FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.fine AND b.fine AND list_cosine_similarity(a.e, b.e) >= 0.95
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY 1) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS words FROM d WHERE len(t) > 0
), q AS (
  SELECT item_id, term, count(*) AS q
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY 1, 2
), f AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY 1), s
), m AS (
  SELECT k, doc_id, 25 + ((75 * len(t) * docs) // words) AS m FROM d, s WHERE len(t) > 0
), p AS (
  SELECT item_id, k, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY 1, 2
), r AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn
  FROM p JOIN m USING (k) WHERE score > 0
)
SELECT item_id, CAST(rn AS INTEGER) AS rank, doc_id, score FROM r WHERE rn <= 10
"""

_PHRASES = f"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r,
    CAST((2000000 * CAST(a AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY (2000000 * CAST(a AS HUGEINT)) // (x.f + y.f), j) AS place
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y
), longer AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a
  FROM (SELECT lang, w, m, a, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2
), kept AS (
  SELECT s.lang, s.phrase, s.a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE place = 1 AND (o.a IS NULL OR 100 * o.a < 80 * s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN t USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op3_minhash": _NEAR,
    "op4_embedding_dedup": _COSINE,
    "op10_topk": _TOPK,
    "op11_ranked_search": _RANKED,
    "op13_collocations": _PHRASES,
}
