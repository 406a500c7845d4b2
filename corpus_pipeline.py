"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's input.  All
stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, mixing, near_copies, packing, secrets, simhash, toxicity
from quillon.llm.queries import label_domains

#: Wanted shares of tokens after toxic documents are gone; nothing that is kept is lost, so
#: rates lie between one and three.
TARGETS = {"clean-high": 0.9, "clean-low": 0.1}
LOW, HIGH = 1.0, 3.0


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column beside the two that stages read, so that no name clashes."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the string-kernel classifier rejects.  The classifier is
    trained on the labelled documents of the input; every row, repeated or with null id or
    text, is judged by its own text.  Null and empty texts stay; an empty table stays empty;
    extra columns of any name are kept."""
    common.prepare(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))

    def extend(batch, p, worst):
        return batch.filter(p < 0.5)

    ready = _rows(docs).select("text", "row")
    return ready.mapInArrow(toxicity.score_batches(model, 0, extend), ready.schema).select("row.*")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates: the least by id, then by hash of its
    text; rows without an id come last.  Groups are SimHash components of five-word shingles
    (fingerprints within ``simhash.RADIUS`` bits), joined where texts of two groups have a
    similarity of 0.8 or more by exact count (:mod:`quillon.llm.near_copies`).  Each row is
    judged by its own text.  Texts without a word (null, empty) are no duplicates of each
    other; of those with the same id and text one row is kept.  An empty table stays empty;
    extra columns of any name are kept."""
    common.prepare(spark)
    plain = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    groups = simhash.simhash_components(plain.where(F.rlike("text", F.lit(common.WORD_PATTERN))), id_col="text_hash", shingle=5)
    classes = groups.select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("class"))
    rows = common.materialise(near_copies.near_copies(plain, shingle=5, classes=classes), "near-components")
    unnamed = F.col("doc_id").isNull()
    least = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(unnamed.alias("last"), "doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash")
    wordless = rows.where("component is null").select("doc_id", "text_hash").distinct()
    keys = least.unionByName(wordless.where(~unnamed)).select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"))
    keyed = _rows(docs).select("row", "doc_id", F.xxhash64("text").alias("own"))
    kept = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("own") == F.col("key_hash")), "left_semi").dropDuplicates(["doc_id", "own"])
    blank = keyed.where(unnamed).join(wordless.where(unnamed).select(F.col("text_hash").alias("own")), "own", "left_semi")
    return kept.select("row.*").unionByName(blank.select("row.*"))


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret in a text by a mark; ``n_chars`` follows the text.  Every row
    stays: null and empty texts as they are, repeated rows each by itself.  An empty table
    stays empty; extra columns of any name are kept."""
    common.prepare(spark)
    found = secrets.scan(_rows(docs).select("row", "text"), keep=("row", "text"))
    clean = secrets.redact(F.col("text"), F.col("spans"))
    out = []
    for c in docs.columns:
        own = F.col("row")[c]
        if c == "text":
            own = F.when(F.size("spans") > 0, clean).otherwise(own)
        elif c == "n_chars":
            own = F.when(F.size("spans") > 0, F.length(clean).cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return found.select(*out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the expected tokens of each domain come nearest to the
    targets; each row, of null or empty text too, occurs at least once, repeated rows each
    for itself.  An empty table stays empty; extra columns of any name are kept."""
    common.prepare(spark)
    mix = mixing.mixture(docs.select("doc_id", "text"), label_domains(common.table(spark, sf_dir, "labels")), TARGETS, low=LOW, high=HIGH)
    rates = mix.rates().select(F.col("doc_id").alias("rate_id"), F.col("text_hash").alias("rate_hash"), "rate")
    keyed = _rows(docs).select("row", "doc_id", F.xxhash64("text").alias("own"))
    rated = keyed.join(rates, keyed["doc_id"].eqNullSafe(rates["rate_id"]) & (keyed["own"] == rates["rate_hash"]), "left")
    times = mixing.copies(F.coalesce("rate", F.lit(1.0)), "doc_id", "own")
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("copy")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens.  Null texts are empty and
    have one token; repeated rows are packed each; an empty table gives no piece; extra
    columns are not read."""
    common.prepare(spark)
    return packing.best_fit_packing(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("secrets", secrets_out),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage but the secret patterns can be stated in SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
