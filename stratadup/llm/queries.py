"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratadup.llm import bpe_counts, curve_search, kneser_ney, line_crf, merge_dropout, ngram_join, packing, robust_rules, robust_sql, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.search(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda key: key % 20 == 0, 20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_rules.report(_table(spark, sf_dir, "documents")).drop("distance")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_curve_search": op1_curve_search, "op2_sharding": op2_sharding, "op3_line_crf": op3_line_crf, "op4_merge_dropout": op4_merge_dropout, "op5_robust_rules": op5_robust_rules, "op6_token_counts": op6_token_counts, "op7_packing": op7_packing, "op8_ngram_join": op8_ngram_join, "op9_substring_dedup": op9_substring_dedup, "op10_kneser_ney": op10_kneser_ney}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINKS = f"""
with recursive w as (select distinct doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} as words from documents where doc_id is not null),
spots as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0),
grams as (select distinct doc_id, array_to_string(words[i : i + 4], ' ') as gram from spots),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
links as (
    select a.doc_id as a, b.doc_id as b from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id
    join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
    group by a.doc_id, b.doc_id, x.n, y.n having 180 * count(*) >= 80 * (x.n + y.n)),
edges as (select a, b from links union all select b, a from links),
reach(node, root) as (select doc_id, doc_id from w union select e.b, r.root from reach r join edges e on e.a = r.node)
select r.node as doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.root) as component_id from reach r left join sizes s on s.doc_id = r.node group by r.node
"""

_REMOVALS = f"""
with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w where len(words) >= 50),
windows as (select doc_id, i, array_to_string(words[i : i + 49], ' ') as win from places),
firsts as (select win, min(doc_id) as first from windows group by win),
gone as (select distinct v.doc_id, unnest(range(v.i, v.i + 50)) as k from windows v join firsts f on f.win = v.win where v.doc_id > f.first),
flat as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as k from w),
marked as (select f.*, g.k is not null as cut from flat f left join gone g on g.doc_id = f.doc_id and g.k = f.k),
sums as (select doc_id, count_if(cut) as n_removed, string_agg(word, ' ' order by k) filter (where not cut) as kept from marked group by doc_id)
select w.doc_id, cast(len(w.words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join sums using (doc_id)
"""

ORACLES: dict[str, str] = {"op5_robust_rules": robust_sql.statement(), "op8_ngram_join": _LINKS, "op9_substring_dedup": _REMOVALS}
