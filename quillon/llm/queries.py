"""The thin queries of this subpackage: each applies its operator, with production
parameters, to a whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import cross_polytope, language_id, mixing, ngram_lm, packing, quality, secrets, simhash, suffix_dedup, toxicity
from quillon.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    found = language_id.predict(docs, language_id.profiles(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.PATTERNS))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"))


#: Wanted shares of expected tokens, by quality and toxicity of the labels.
TARGETS = {"clean-high": 0.8, "clean-low": 0.15, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from the table of labels; null labels have no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when((F.col("toxic") == 0) & (F.col("quality") == 1), "clean-high").when((F.col("toxic") == 0) & (F.col("quality") == 0), "clean-low")
    return labels.select("doc_id", domain.alias("domain"))


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.mixture(docs, label_domains(table(spark, sf_dir, "labels")), TARGETS)
    row = mix.rates().withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    names = [F.col(f"p_{k}").alias("p_" + d.replace("-", "_")) for k, d in enumerate(mix.domains)]
    return row.select("doc_id", "n_tokens", *names, "rate")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op10_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), modulus=7, held=2)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mcd_outliers, op2_simhash_components, op3_cross_polytope_neighbours, op4_rank_order_language, op5_randomness_battery, op6_soft_membership_mixing, op7_suffix_array_dedup, op8_subsequence_kernel, op9_best_fit_packing, op10_backoff_automaton)}


#: Every 50-byte string by brute force; texts as hexadecimal digits, two for each byte.
OP7_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from d where length(h) >= 100),
w as (select doc_id, i, md5_number(substr(h, cast(2 * i + 1 as int), 100)) as k from p),
l as (select k, min(doc_id) as first from w group by k having min(doc_id) < max(doc_id)),
g as (select doc_id, i from w join l using (k) where doc_id > first),
m as (select doc_id, i, sum(case when i <= prior + 50 then 0 else 1 end) over (partition by doc_id order by i) as run from (select doc_id, i, coalesce(lag(i) over (partition by doc_id order by i), -100) as prior from g)),
r as (select doc_id, min(i) as a, max(i) + 50 as z from m group by doc_id, run),
c as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as kept_from from r),
k as (select doc_id, string_agg(substr(h, cast(2 * kept_from + 1 as int), cast(2 * (a - kept_from) as int)), '' order by a) as head, max(z) as tail, sum(z - a) as n_removed, count(*) as n_spans from c join d using (doc_id) group by doc_id)
select d.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
 sha256(unhex(case when k.doc_id is null then h else head || substr(h, cast(2 * tail + 1 as int)) end)) as kept_sha256
from d left join k using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_array_dedup": OP7_SQL}
