"""The standard chain of the published analysis, as lazy DataFrames.

events -> adapter views -> enrich (J-06) -> cohort (F-02) -> volume code (X-05)
-> sessions (W-01..W-05) -> long table with positions and arm (Q-01, Q-02)
-> cohorts of the analysis notebook (F-04, F-05, F-06).

Parameters shared by every registered query live in ``Params``: the gap is 30
minutes, sequences are 12 long and valid only if all 12 questions equal the
control, sessions are numbered per character.

The derived answer log, the sessionized cohort and the long table are written
once per application and input to the shared folder and read back pruned, so
plans stay short, a lost executor costs nothing, and queries share the work.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqlab.functions.scalar import volume_code
from seqlab.functions.timecols import parse_timestamp
from seqlab.operators.enrich import cohort_filter, enrich_answers
from seqlab.operators.sections import SECTION_KEYS, section_rows, split_by_section
from seqlab.operators.sessions import assign_sessions
from seqlab.sources import adapter
from seqlab.sources.tables import read_table


@dataclass(frozen=True)
class Params:
    gap_minutes: float = 30
    flavour: str = "per_character"
    n: int = 12
    baseline_arm: int = 1


P = Params()


def events(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "events", StructType.fromDDL(adapter.EVENTS))


def answer_log(spark: SparkSession, root: str) -> DataFrame:
    """The derived answer log, written once: the published pipeline's main input."""
    return _once(spark, ("answer_log", root), lambda: adapter.answer_log(events(spark, root)))


def exp_log(spark: SparkSession, root: str) -> DataFrame:
    return adapter.exp_log(answer_log(spark, root))


def question_structure(spark: SparkSession, root: str) -> DataFrame:
    return adapter.question_structure(answer_log(spark, root))


def enriched(spark: SparkSession, root: str) -> DataFrame:
    ev = events(spark, root)
    return enrich_answers(answer_log(spark, root), adapter.user_info(ev), exp_log(spark, root),
                          question_structure(spark, root), adapter.gc_course(ev))


_MEMO: dict = {}


def clean(spark: SparkSession) -> None:
    """Forget the written tables and remove the folder of this application's intermediate tables
    (``seqlab-<application id>`` in ``spark.checkpoint.dir``), once no result made from them is read any more."""
    from seqlab.session import checkpoint_dir
    reset()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_dir(spark).rstrip('/')}/seqlab-{spark.sparkContext.applicationId}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def reset(inputs: bool = True) -> None:
    """Forget the written tables, so that they are made anew (e.g. after the input files
    changed); ``inputs=False`` keeps the derived answer log."""
    for key in [k for k in _MEMO if inputs or k[1] != "answer_log"]:
        del _MEMO[key]


def _once(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Write a shared table once per application and input, under ``spark.checkpoint.dir``, and read it back."""
    from seqlab.session import checkpoint_dir
    app = spark.sparkContext.applicationId
    path = _MEMO.get((app, *key))
    if path is None:
        df = build()
        path = f"{checkpoint_dir(spark).rstrip('/')}/seqlab-{app}/{key[0]}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _MEMO[(app, *key)] = path
        _SCHEMAS[path] = df.schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_SCHEMAS: dict = {}


def cohort(spark: SparkSession, root: str, p: Params = P) -> DataFrame:
    """Enriched answers of the cohort, with ``created_at`` and ``manual_book_vol``; written, as the
    sessionizer reads it in several branches."""
    return _once(spark, ("cohort", root), lambda: cohort_filter(enriched(spark, root)).withColumns({
        "created_at": parse_timestamp(F.col("created_at_utc8")), "manual_book_vol": volume_code("book_volume_name")}))


def in_sessions(spark: SparkSession, root: str, p: Params = P) -> DataFrame:
    return _once(spark, ("in_sessions", root, p), lambda: assign_sessions(
        cohort(spark, root, p), gap_seconds=p.gap_minutes * 60, flavour=p.flavour))


def long_table(spark: SparkSession, root: str, p: Params = P) -> DataFrame:
    """One row per answer: section keys, pos, q_len, experiment_mode and the answer fields."""
    return _once(spark, ("long", root, p), lambda: split_by_section(in_sessions(spark, root, p)))


def materialize_long_table(spark: SparkSession, root: str, p: Params = P, path: str | None = None) -> DataFrame:
    """Write the long table partitioned by arm to a folder of the caller's choice (default:
    under ``spark.checkpoint.dir``), for analyses in other applications."""
    from seqlab.session import checkpoint_dir
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/seqlab_long_table"
    long_table(spark, root, p).write.mode("overwrite").partitionBy("experiment_mode").parquet(path)
    return spark.read.parquet(path)


def sections(spark: SparkSession, root: str, p: Params = P) -> DataFrame:
    return section_rows(long_table(spark, root, p))


# Cohorts of the analysis notebook, on the long table ---------------------------------

def first_sessions(long: DataFrame) -> DataFrame:
    """``rawdata``: sections of session number 1, any length (F-05)."""
    return long.filter(F.col("session_id") == 1)


def long_data(long: DataFrame, n: int = 12) -> DataFrame:
    """Session number 1 and at least n answers in the section (F-04)."""
    return first_sessions(long).filter(F.col("q_len") >= n)


def experiment_data(long: DataFrame, n: int = 12) -> DataFrame:
    """``long_data`` inside an arm (F-06: arm <> -1)."""
    return long_data(long, n).filter(F.col("experiment_mode") != -1)


__all__ = ["Params", "P", "events", "answer_log", "exp_log", "enriched", "cohort", "in_sessions",
           "long_table", "sections", "first_sessions", "long_data", "experiment_data", "SECTION_KEYS"]
