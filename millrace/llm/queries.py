"""The queries of this subpackage, each over its whole tables with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.labels import mended_family, mended_label, mended_language
from millrace.llm.blending import blend
from millrace.llm.canonical import Ledger
from millrace.llm.capping import cap_per_contributor
from millrace.llm.leakage import leaked
from millrace.llm.mixture import Sample, proportional_sample
from millrace.llm.pairs import defective_pairs
from millrace.llm.residue import residue
from millrace.llm.tokens import token_budget, tokenizer_of
from millrace.session import spread
from millrace.sources.tables import table

FAMILIES = ["musique_2hop", "musique_3hop", "musique_4hop", "unanswerable", "no_tool"]


# Problem 1
def _sample(spark: SparkSession, d: str) -> Sample:
    t = table(spark, d, "task", "task_id", "task_type", "difficulty", "tier", "loaded_at")
    pool = t.groupBy("task_id").agg(F.max_by(F.struct("task_type", "difficulty", "tier"), F.struct("loaded_at", "task_type", "difficulty", "tier")).alias("x")).select("task_id", "x.*")
    family = mended_family(F.col("task_type"))
    pool = pool.withColumn("task_type", F.when(family.isin(FAMILIES), family))
    return proportional_sample(pool, table(spark, d, "mix_targets"), "task_id", ["task_type", "difficulty", "tier"], seed=7)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report.filter("unmet").select("mix_name", "cell_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report.select("mix_name", "cell_id", "sample_rows", "available", "quota", "taken", "drawn", F.round("reached_share", 6).alias("reached_share"), "unmet", "below")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).rows


# Problem 2
def _ledger(spark: SparkSession, d: str) -> Ledger:
    t = table(spark, d, "task", "task_id", "prompt", "loaded_at")
    # Two batches, as two loads would bring them: what was delivered up to the middle of the period, and the rest.
    middle = t.agg(F.timestamp_seconds((F.unix_micros(F.min("loaded_at")) + F.unix_micros(F.max("loaded_at"))) / 2e6)).scalar()
    late = F.coalesce(F.col("loaded_at") > middle, F.lit(True))
    ledger = Ledger(spark)
    ledger.update(spread(t.filter(~late)), "task_id", "prompt")
    return ledger.update(spread(t.filter(late)), "task_id", "prompt")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).duplicates().select(F.col("kept_id").alias("kept_task_id"), F.col("id").alias("task_id"))


def p2_copies(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).groups().select(F.col("kept_id").alias("task_id"), "copies")


# Problem 3
def _ranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ids = table(spark, d, "trajectory", "task_id").filter("task_id is not null").distinct()
    card = table(spark, d, "scorecard", "task_id", "success", "final_f1", "loaded_at").groupBy("task_id").agg(F.max_by(F.struct("success", "final_f1"), F.struct("loaded_at", "success", "final_f1")).alias("c"))
    rows = ids.join(card, "task_id", "left").select(
        "task_id", F.substring_index("task_id", "#", 1).alias("base_task"), F.coalesce(F.col("c.success"), F.lit(False)).cast("int").alias("success"),
        F.when((F.col("c.final_f1") >= 0) & (F.col("c.final_f1") <= 1), F.col("c.final_f1")).alias("f1"),
    )
    return ids, rows


def _kept(rows: DataFrame) -> DataFrame:
    return cap_per_contributor(rows, "task_id", "base_task", ["success", "f1"], cap=8)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ids, rows = _ranked(spark, d)
    return ids.join(_kept(rows).select("task_id"), "task_id", "left_anti")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return _kept(_ranked(spark, d)[1])


def p3_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The same cap by a weighted draw: a better trajectory is likelier to stay, none is sure to; no task holds over a hundredth."""
    rows = _ranked(spark, d)[1]
    return cap_per_contributor(rows, "task_id", "base_task", ["success", "f1"], cap=8, max_share=0.01, temperature=0.25, seed=7)


# Problem 4
def _defects(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trajectory", "task_id", "prompt", "final_answer", "stop_reason", "loaded_at")
    return defective_pairs(t, "task_id", "prompt", "final_answer", "stop_reason", order_col="loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("task_id", F.col("defects")[0].alias("defect"))


def p4_all_defects(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("task_id", F.explode("defects").alias("defect"))


# Problem 5
def p5_token_budget(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "sft_record", "record_id", "source", "lang", "messages", "meta", "loaded_at")
    t = spread(t.select("record_id", "source", "lang", F.col("meta.task_type").alias("task_type"), "loaded_at", F.col("messages.content").alias("content")))
    by = {"source": mended_label(F.col("source")), "lang": mended_language(F.col("lang")), "task_type": mended_label(F.col("task_type"))}
    return token_budget(t, "content", tokenizer_of(spark, d), by, "record_id", "loaded_at")


# Problem 6
def _held_out(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judge_row", "id", "question", "answer", "context")
    whole = j.select(F.col("id").alias("item_id"), F.col("question").alias("text"), F.lit(True).alias("whole"), "answer")
    return whole.unionAll(j.select("id", F.explode("context.paragraph_text"), F.lit(False), "answer"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents", "doc_id", "text"), _held_out(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("has_answer").alias("has_answer"))


# Problem 7
def _blend(spark: SparkSession, d: str):
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    sized = spread(docs).select("doc_id", mended_label(F.col("source")).alias("source"), tokenizer_of(spark, d).column(F.col("text")).alias("size"))
    return blend(sized, table(spark, d, "source_weights"), "doc_id", "source", "size", seed=7)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _blend(spark, d).report.filter("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _blend(spark, d).report


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _blend(spark, d).rows


# Problem 8
def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents", "doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).filter("label is not null").select("doc_id")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d)


def p8_by(spark: SparkSession, d: str) -> DataFrame:
    """How many documents got which label, by a rule on their own text or from their component."""
    return _residue(spark, d).filter("label is not null").groupBy("label", "by").agg(F.count("*").alias("documents"), F.countDistinct("component").alias("classes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}
