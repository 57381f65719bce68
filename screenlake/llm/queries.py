"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import byte_bpe, byte_repeats, chat_tree, collocations, containment, language_id, secret_scan, sharding, simhash, source_divergence, url_filter, vector_links, word_repeats
from screenlake.llm.registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES"]

CONTAINMENT_SQL = """
WITH w AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
t AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM w),
s AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(2, len(words) - 3)), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle FROM t WHERE len(words) > 0),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM s AS d JOIN s AS i ON d.shingle = i.shingle JOIN n ON n.item_id = i.id
WHERE d.side = 'd' AND i.side = 'i'
GROUP BY d.id, i.id, n_item
HAVING count(*) >= greatest(1, ceil(0.8 * n_item - 1e-9))
"""
COLLOCATION_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS s(k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 10),
x AS (SELECT lang, k, phrase, a, array_to_string(ws[1:1], ' ') AS first, array_to_string(ws[2:], ' ') AS rest, 1 AS cut FROM a
      UNION ALL SELECT lang, k, phrase, a, array_to_string(ws[1:2], ' '), ws[3], 2 FROM a WHERE k = 3),
y AS (SELECT x.lang, x.phrase, a, l.f AS l, r.f AS r, cut, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM x JOIN c AS l ON l.lang = x.lang AND l.phrase = first JOIN c AS r ON r.lang = x.lang AND r.phrase = rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a FROM a WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM a WHERE k = 3) GROUP BY lang, phrase),
q AS (SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank FROM z LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN t USING (lang) WHERE rank <= 2000
"""
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
e AS (SELECT k.lang, s.source, k.term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY k.lang, s.source) AS total FROM k JOIN s USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p FROM e JOIN v USING (lang)),
l AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS q FROM l JOIN v USING (lang)),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM r))
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10
"""
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query("op1_chat_prefix_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_tree.read_back(*chat_tree.prefix_tree(turns, path, pattern), path, pattern)


@query("op2_simhash_near_duplicates")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_prefix_doubling_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_jump_hash_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    asked = docs.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "text")
    return language_id.predict(asked, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_fixed_block_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = word_repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op7_minhash_containment", CONTAINMENT_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_collision_counting")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_byte_level_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return byte_bpe.decode(coded, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_link_graph_url_filter")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op11_assignment_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op12_phrase_collocations", COLLOCATION_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_source_divergence", DIVERGENCE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))
