"""The corpus pipeline: documents in, token ids of a clean corpus out.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it got, but for
the last one, which returns token ids.  A stage works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenlake.llm import byte_bpe, containment, graph, language_id, simhash, word_repeats
from screenlake.llm.arrow import prepare
from screenlake.llm.registry import table
from screenlake.session import cut_lineage

#: A document stays if its language has at least this probability.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays unclear, go."""
    prepare(spark)
    judged = language_id.identify(docs)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts one row stays: the smallest id, nulls last, then the least row hash.

    Rows are told apart by a hash of all their columns, so different texts of one id are judged
    each for itself, and equal rows count once."""
    row = F.md5(F.to_json(F.struct(*docs.columns))).alias("__row")
    marked = cut_lineage(simhash.fingerprints(docs.select("doc_id", row, "text")))
    if not marked.groupBy("__row").count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row"))
    # by fingerprint first: no join meets the copies of a text
    firsts = marked.groupBy(F.col("fingerprint").alias("fp")).agg(first.alias("first"))
    roots = graph.components(simhash.links(firsts.select("fp"))).withColumnRenamed("node", "fp")
    kept = firsts.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return docs.withColumn("__row", row).join(kept.select("first.__row"), "__row", "left_semi").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; so do documents with no word left."""
    cut = word_repeats.remove_repeats(docs, joined=False).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.when(changed, F.length("kept")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text that they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern).drop("text")
    return byte_bpe.decode(coded, path).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_text")


STAGES = [
    ("language ID", keep_known_language),
    ("SimHash near-dedup", keep_one_of_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode_bytes),
]
#: Fingerprints, trained models and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        # the next stage reads its input several times
        docs = docs if name == STAGES[-1][0] else cut_lineage(docs)
    return docs
