"""The queries of the operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprint, langid, negatives, ngrams, packing, paragraphs, quality, sharding, simhash, spelling, urlfilter
from .base import crc32_of_id, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of_id() % 4 == 2
    model = langid.learned(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return chat.preferences(chat.swapped_answers(turns))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc32_of_id() % 5 == 0
    model = quality.learned(docs, read(spark, sf_dir, "labels"), ~held_out)
    return quality.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(read(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_passages(read(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.relabelled(read(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_url_filter, op2_decontamination, op3_language_id, op4_sharding, op5_simhash,
        op6_chat_preferences, op7_packing, op8_quality, op9_fingerprint, op10_substring_dedup,
        op11_spelling_variants, op12_hard_negatives, op13_lm_scores,
    )
    return {f.__name__: f for f in own}


_OP1_SQL = r"""
with parsed as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(host_part, path_part, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select p.page_id, p.host, p.path,
       arg_max(r.host_part || r.path_part, length(r.host_part || r.path_part)) as rule,
       coalesce(arg_max(r.verdict, length(r.host_part || r.path_part)), 'allow') as verdict
from parsed p left join rules r
  on (p.host = r.host_part or ends_with(p.host, '.' || r.host_part)) and starts_with(p.path, r.path_part)
group by p.page_id, p.host, p.path
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1_SQL, "op6_chat_preferences": chat.ORACLE_SQL, "op11_spelling_variants": spelling.ORACLE_SQL, "op12_hard_negatives": negatives.ORACLE_SQL}
