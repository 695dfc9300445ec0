"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import balltree, chat, decontaminate, language, licences, lines, mixing, oracles, phrases, ppm, prefixes, simhash, substrings, token_records
from trackloom.llm.common import crc_mod, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return out.withColumn("mask", spans)


def op2_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_licence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_partial_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    return ppm.score(docs, ppm.train(docs.where("not held_out")))


def op5_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    model = language.fit(docs.where("not held_out"))
    found = language.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_files(table(spark, sf_dir, "documents"), tokenizer_path()).drop("path")


#: Production targets of the mix, chosen without regard to a corpus' own shares.
MIX_TARGETS: mixing.Targets = {
    "source": {f"src{i}": 0.048 for i in range(20)} | {"other": 0.04},
    "lang": {"en": 0.50, "de": 0.18, "fr": 0.17, "es": 0.15},
    "topic": {"short": 0.15, "long": 0.80, "table": 0.05},
}
MIX_ROUNDS, MIX_SEED = 20, "mix"


def with_topic(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"topic": mixing.form_of(F.col("text")), "tokens": mixing.tokens_of(F.col("text"))})


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_topic(table(spark, sf_dir, "documents")).select("doc_id", "source", "lang", "topic", "tokens")
    out = mixing.mix(docs, MIX_TARGETS, MIX_SEED, MIX_ROUNDS)
    return out.select("doc_id", *[F.col(f"g_{m}").alias(f"{m}_group") for m in mixing.MARGINS], "tokens", "probability", "kept")


def op11_prefix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"), prefixes.shared_heads(F.col("conv"))).drop("n_ends", "position", "end")


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_phrase_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(phrases.counts_of(table(spark, sf_dir, "documents"))).drop("cut")


QUERIES = {
    "op1_chat_rotation": op1_chat_rotation,
    "op2_suffix_arrays": op2_suffix_arrays,
    "op3_licence_index": op3_licence_index,
    "op4_partial_matching": op4_partial_matching,
    "op5_language_codes": op5_language_codes,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_ball_tree": op7_ball_tree,
    "op8_token_records": op8_token_records,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_prefix_intervals": op11_prefix_intervals,
    "op12_line_runs": op12_line_runs,
    "op13_phrase_sketches": op13_phrase_sketches,
}
ORACLE_SQL = {
    "op1_chat_rotation": oracles.CHAT,
    "op2_suffix_arrays": oracles.SUBSTRINGS,
    "op3_licence_index": oracles.licence_scan(licences.BASE + licences.TEMPLATES),
    "op6_spaced_seeds": oracles.spaced_seeds(decontaminate.SPAN, decontaminate.LEAST),
    "op7_ball_tree": oracles.TOP_K,
    "op9_mixing": oracles.mixing(MIX_TARGETS, MIX_ROUNDS, MIX_SEED),
    "op11_prefix_intervals": oracles.PREFIXES,
    "op12_line_runs": oracles.line_dedup(lines.MIN_CHARS, lines.MIN_DOCS),
    "op13_phrase_sketches": oracles.collocations(phrases.LENGTH, phrases.MIN_COUNT, phrases.TOP, phrases.SHARE),
}
