"""Rounds of completion: what failed is asked again with its error and a larger budget, case by case."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Completion tokens of the first, second and third attempt.
BUDGETS = (1536, 3072, 6144)
#: (prompt, completion tokens) -> answer; raises if there is none.
Completer = Callable[[str, int], str]
#: answer -> what is wrong with it, or None.
Check = Callable[[str], str | None]


def corrected(prompt: Column, error: Column) -> Column:
    """The prompt, and after a failure what was wrong with the last answer."""
    return F.when(error.isNull(), prompt).otherwise(F.concat(prompt, F.lit("\n\nThe last answer was refused: "), error, F.lit("\nGive the whole answer again without this fault.")))


def ask(requests: DataFrame, case: str, completer: Completer, check: Check, budget: int) -> DataFrame:
    """``case, answer, error`` of each ``case, prompt``: a failure stays with its case, whatever it is."""
    schema = f"`{case}` {requests.schema[case].dataType.simpleString()}, answer string, error string"

    def one(prompt: str | None) -> tuple[str | None, str | None]:
        try:
            answer = completer(prompt or "", budget)
            wrong = check(answer)
        except Exception as e:  # the model and its answers are outside this program
            return None, f"{type(e).__name__}: {e}"
        return (answer, None) if wrong is None else (None, wrong)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            told = [one(p) for p in f["prompt"]]
            yield pd.DataFrame({case: f[case], "answer": [a for a, _ in told], "error": [e for _, e in told]})

    return requests.select(case, "prompt").mapInPandas(run, schema)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def complete(requests: DataFrame, case: str, completer: Completer, check: Check, path: str, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """``case, answer, error, attempt`` of every request: the first answer that passes ``check``, else the last error.

    Each round asks the cases that no earlier round answered, with the error of the round before in the prompt and
    the next of ``budgets``, and is written below ``path`` before the next begins.  A run that was cut off goes on
    with the rounds that are there; no case is asked twice in a round, unless a lost task is run again.
    Requests are told apart by ``case``; of several with one, the smallest prompt counts.  A null prompt is empty.
    """
    spark = requests.sparkSession
    first = requests.groupBy(case).agg(F.min("prompt").alias("prompt")).withColumn("error", F.lit(None).cast("string"))
    pending, done = first, None
    for attempt, budget in enumerate(budgets, 1):
        at = f"{path}/attempt-{attempt}"
        if not _exists(spark, f"{at}/_SUCCESS"):
            told = ask(pending.select(case, corrected(F.col("prompt"), F.col("error")).alias("prompt")), case, completer, check, budget)
            told.withColumn("attempt", F.lit(attempt)).write.mode("overwrite").parquet(at)
        told = spark.read.parquet(at)
        last = attempt == len(budgets)
        kept = told if last else told.filter("error is null")
        done = kept if done is None else done.unionByName(kept)
        failed = told.filter("error is not null").select(case, "error")
        if last or not failed.limit(1).count():
            break
        pending = first.drop("error").join(failed, case)
    return done


def per_case(rows: DataFrame, case: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` on the rows of each case; a case that fails gives one row of nulls with its ``error`` and stops no other.

    ``schema`` names the columns of ``work``'s result besides the case.  A case's rows, one patient's, come together.
    """
    names = [c.split()[0] for c in schema.split(",")]

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        try:
            out, error = work(f)[names], None
        except Exception as e:  # local to the case by contract
            out, error = pd.DataFrame({n: [None] for n in names}), f"{type(e).__name__}: {e}"
        return out.assign(**{case: key[0], "error": error})[[case, *names, "error"]]

    return rows.groupBy(case).applyInPandas(run, f"`{case}` {rows.schema[case].dataType.simpleString()}, {schema}, error string")
