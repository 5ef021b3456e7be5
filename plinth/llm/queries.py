"""The queries of this subpackage: thin digests of what its operators return over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, counts, decontaminate, lines, packing, pages, quality, repair, shards, simhash, winnow


THRESHOLD = 0.7
ARRIVALS = 6


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.table(spark, sf_dir, "pages"))


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.dedup(docs, count_col="lines_removed")
    return kept.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.with_next(common.table(spark, sf_dir, "documents"))
    n = F.length("text")
    cut = (n / 4).cast("int")  # floor, as lengths are not negative
    rows = rows.withColumn("edited", F.concat(F.left("text", n - cut), F.left("head", cut)))
    rows = rows.withColumn("edited_chosen", winnow.edited_fingerprint(F.col("chosen"), F.col("edited").cast("binary"), F.octet_length(F.left("text", n - cut))))
    rows = rows.withColumn("hashes", winnow.hashes(F.col("chosen")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.text_of(F.col("chosen")).alias("fingerprint"),
        winnow.text_of(F.col("edited_chosen")).alias("edited_fingerprint"),
        winnow.likeness(F.col("hashes"), winnow.hashes(F.col("edited_chosen"))).alias("near_edited"),
        winnow.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(common.table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "ids")
    repair.write_store(common.table(spark, sf_dir, "documents"), path)
    return repair.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.ShardStore(spark, common.new_path(spark, "shards"))
    docs = common.table(spark, sf_dir, "documents")
    # the whole table comes in parts by hash of the id, and is compacted as it grows; all files are this query's own
    parts = docs.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int"))
    for _ in store.append_all(parts, "arrival"):
        store.compact()
        store.vacuum(keep=1)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(common.table(spark, sf_dir, "documents"))


def op9_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_page_differencing,
        op2_factorisation_machine,
        op3_line_minhash,
        op4_winnowing,
        op5_vector_packing,
        op6_repair_ids,
        op7_shard_compaction,
        op8_trie_token_counts,
        op9_simhash_classes,
        op10_decontamination,
    )
}
#: DuckDB SQL, for what SQL can express: the store must give back every row as it came.
ORACLES: dict[str, str] = {
    "op7_shard_compaction": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
}
