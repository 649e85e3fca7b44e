"""Folds fixed by hashing, their rotations, and seeded samples by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.hashing import hash_fold

SEED = 20260723


def assign(questions: DataFrame, group: str = "source_group_id", seed: int = SEED, folds: int = 5) -> DataFrame:
    """question_id, group, fold and hash: questions of one group share the fold that the SHA-256 of seed and group gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(group, F.lit(""))), 256)
    return questions.select("question_id", group, hash_fold(digest, folds).alias("fold"), digest.alias("assignment_hash"))


def rotations(assigned: DataFrame, folds: int = 5) -> DataFrame:
    """question_id, outer_test_fold, part: in rotation i fold i is tested, the next one calibrates, the others train."""
    rows = assigned.select("question_id", "fold", F.explode(F.array(*[F.lit(i) for i in range(folds)])).alias("outer_test_fold"))
    part = F.when(F.col("fold") == F.col("outer_test_fold"), "test").when(F.col("fold") == (F.col("outer_test_fold") + 1) % folds, "calibration").otherwise("train")
    return rows.select("question_id", "outer_test_fold", part.alias("part"))


def partition_summary(rotated: DataFrame, groups: DataFrame, group: str = "source_group_id") -> DataFrame:
    """Questions and groups of each part of each rotation."""
    return rotated.join(groups.select("question_id", group), "question_id").groupBy("outer_test_fold", "part").agg(F.count(F.lit(1)).alias("questions"), F.count_distinct(group).alias("groups"))


def partition_issues(frozen: DataFrame) -> DataFrame:
    """(batch_id, outer_test_fold, code) of frozen partitions: empty parts, ids in two parts, a calibration fold out of turn."""
    t, c, r = "train_question_ids", "calibration_question_ids", "test_question_ids"
    codes = F.array_compact(F.array(
        F.when((F.size(t) < 1) | (F.size(c) < 1) | (F.size(r) < 1), F.lit("E_PART_EMPTY")),
        F.when(F.arrays_overlap(t, c) | F.arrays_overlap(t, r) | F.arrays_overlap(c, r), F.lit("E_PARTS_OVERLAP")),
        F.when(F.col("calibration_fold") != (F.col("outer_test_fold") + 1) % 5, F.lit("E_ROTATION")),
        F.when((F.size(F.array_distinct(t)) < F.size(t)) | (F.size(F.array_distinct(c)) < F.size(c)) | (F.size(F.array_distinct(r)) < F.size(r)), F.lit("E_ID_REPEATED")),
    ))
    return frozen.select("batch_id", "outer_test_fold", F.explode(codes).alias("code")).distinct()


def stratified_sample(questions: DataFrame, quota: int, seed: int = SEED) -> DataFrame:
    """domain, category, question_id, place: of each stratum the `quota` questions with the smallest SHA-256 of seed, stratum and id.

    The group limit before the exchange leaves each task's smallest hashes only.
    """
    hashed = questions.where("domain is not null and category is not null").withColumn("_h", F.sha2(F.concat_ws("\u0000", F.lit(str(seed)), "domain", "category", "question_id"), 256))
    place = F.row_number().over(Window.partitionBy("domain", "category").orderBy("_h", "question_id"))
    return hashed.withColumn("place", place).where(F.col("place") <= quota).select("domain", "category", "question_id", "place")
