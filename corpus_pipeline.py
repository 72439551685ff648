"""A training corpus from raw documents, in five stages.

Each stage is ``f(spark, docs, sf_dir) -> DataFrame`` and works on all rows its
predecessor kept; its result is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.

1. language_id: documents that the byte network cannot place go: those without
   a letter, and those whose windows are unsure themselves (a mean of each
   window's highest probability below MIN_SCORE). A text in several languages
   stays; if no network could be trained, every text with a letter does.
2. near_dedup: of every group of documents linked by SimHash fingerprints, the
   one with the smallest doc_id stays (of repeated rows, one).
3. secret_scan: strings that the forest confirms as secrets are replaced by
   REDACTED, in one pass over the text; every document stays.
4. mixing: documents are taken as often as their source's target asks for, and
   put in training order.
5. bpe: token counts and digests of ids and decoded text.

Null texts are rejected by stage 1; an empty table gives an empty result;
columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from buoyline.llm import bpe, common, langid, mixing, secret_scan, simhash
from buoyline.llm.queries import vocabulary
from buoyline.session import scratch_path

MIN_SCORE = 0.5
REDACTED = "[secret]"
WHOLE = 16  # shorter secrets are values behind a key word only


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    net = langid.fit(docs)
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    placed = langid.predict(docs, net, key=common.carried(docs), sure=True)
    return placed.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("sure") >= MIN_SCORE)).select("key.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = docs.select(common.carried(docs).alias("row"), common.identity().alias("id"), F.col("text").alias("text"))
    groups = simhash.components(rows.select("id", "text"), size=3, distance=3, key="id")
    kept = groups.select(F.col("component_id").alias("id")).distinct()
    # Of the kept ids there may be as many as documents, however few Spark expects: never broadcast.
    return rows.select("row", "id").join(kept.hint("merge"), "id", "left_semi").dropDuplicates(["id"]).select("row.*")


def redacted(text: Column, found: Column) -> Column:
    """The text with every secret replaced, in one pass however many there are.

    Longest first: a secret that is part of another must not leave the rest of
    it standing. A value of fewer than WHOLE characters, which only its key word
    and sign made a secret, is replaced where it stands alone: the same letters
    inside a longer word stay.
    """
    quoted = lambda s: F.concat(F.lit(r"\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    alone = lambda s: F.concat(F.lit("(?<![A-Za-z0-9])"), quoted(s), F.lit("(?![A-Za-z0-9])"))
    longest = F.sort_array(F.transform(found, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False)
    each = F.transform(longest, lambda x: F.when(x["n"] < WHOLE, alone(x["s"])).otherwise(quoted(x["s"])))
    return F.regexp_replace(text, F.array_join(each, "|"), F.lit(REDACTED))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    model = secret_scan.made_model(spark)
    rows = docs.select(common.carried(docs).alias("row"), common.identity().alias("id"), F.col("text").alias("text"))
    found = secret_scan.scan(rows, model, key="id").where("n_secrets > 0").select("id", "secrets")
    clean = redacted(F.col("row.text"), F.col("secrets"))
    joined = rows.select("row", "id").join(found, "id", "left")
    fresh = {"text": clean}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length(clean).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[
        F.when(F.col("secrets").isNull(), F.col("row")[c]).otherwise(fresh[c]).alias(c) if c in fresh else F.col("row")[c].alias(c)
        for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    rows = docs.select(common.carried(docs).alias("row"), "doc_id", "source", "text")
    return mixing.training_order(mixing.mix(rows, epochs=3), ["row", "doc_id"]).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return bpe.digests(docs, vocabulary())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secrets), ("mixing", mix), ("bpe", encode)]

ORACLE_SQL = None  # the classifier, XXH64 fingerprints, the forest and BPE have no SQL form; tests use brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is a table in the shared folder that the next stage reads."""
    docs = common.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
