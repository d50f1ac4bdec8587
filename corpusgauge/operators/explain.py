"""File explanations, and the one Python step: completing prompts in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.functions.languages import explain_language
from corpusgauge.functions.templates import fill
from corpusgauge.functions.text import split_lines, universal_newlines
from corpusgauge.operators.files import by_size, rejection_message
from corpusgauge.operators.quality import MAX_FILE_SIZE_KB
from corpusgauge.operators.replies import key_elements_of, purpose_of
from corpusgauge.session import stored

Complete = Callable[[str], str]


def complete_batch(
    prompts: DataFrame, make_client: Callable[[], Complete], tasks: int | None = None
) -> DataFrame:
    """Replace ``prompt`` by ``response`` and ``error``.

    ``make_client`` runs once per task and returns the function that answers one
    prompt.  A failing call becomes an error value; the job goes on.  Write the
    result to a table before using it: a lost executor must not repeat paid calls.
    ``tasks`` spreads the prompts evenly, since the calls outweigh the shuffle by far.
    """
    if tasks:
        prompts = prompts.repartition(tasks)
    kept = [field for field in prompts.schema.fields if field.name != "prompt"]
    schema = T.StructType(
        [*kept, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = make_client()
        for batch in batches:
            responses: list[str | None] = []
            errors: list[str | None] = []
            for prompt in batch["prompt"]:
                try:
                    responses.append(complete(prompt))
                    errors.append(None)
                except Exception as failure:  # noqa: BLE001 - any failure is a value here
                    responses.append(None)
                    errors.append(str(failure))
            yield batch.drop(columns="prompt").assign(response=responses, error=errors)

    return prompts.mapInPandas(answer, schema)


def complete_logged(
    prompts: DataFrame, make_client: Callable[[], Complete], log: str, slices: int = 16
) -> DataFrame:
    """``complete_batch`` with a log of replies, so that a job begun anew asks only what is open.

    ``log`` is a folder that driver and executors share.  Its rows ``prompt_key, response,
    error`` are known by the SHA-256 of the prompt, so equal prompts are asked once.  The
    open prompts are asked in ``slices`` jobs, by hash, each of which adds its replies to
    the log when it is done: a killed run loses one slice at most.  Failed calls are in
    the log, too, and are asked again by the next run.
    """
    spark = prompts.sparkSession
    schema = "prompt_key STRING, response STRING, error STRING"
    spark.createDataFrame([], schema).write.mode("append").parquet(log)
    keyed = stored(prompts.withColumn("prompt_key", F.sha2(F.col("prompt").cast("binary"), 256)), "prompts")
    for part in range(slices):
        here = F.pmod(F.xxhash64("prompt_key"), F.lit(slices)) == part
        done = spark.read.schema(schema).parquet(log).filter(here & F.col("error").isNull()).select("prompt_key")
        due = keyed.filter(here).select("prompt_key", "prompt").join(done, "prompt_key", "left_anti")
        complete_batch(due.dropDuplicates(["prompt_key"]), make_client).write.mode("append").parquet(log)
    # an answer before a failure; a prompt asked in several runs has a row of each
    rank = F.struct(F.col("error").isNull().alias("ok"), "response", "error")
    best = spark.read.schema(schema).parquet(log).groupBy("prompt_key").agg(F.max(rank).alias("best"))
    named = keyed.drop("prompt").join(best, "prompt_key", "left")
    return named.select(*[c for c in prompts.columns if c != "prompt"], "best.response", "best.error")


def explained_files(files: DataFrame, max_kb: int = MAX_FILE_SIZE_KB) -> DataFrame:
    """Language, line count and text of the files small enough to explain."""
    accepted, _ = by_size(files, max_kb)
    text = universal_newlines(F.col("content"))
    return accepted.select(
        "repo_id", "path", explain_language(F.col("path")).alias("language"), text.alias("text")
    ).withColumn("lines", split_lines(F.col("text")).cast("bigint"))


def rejected_files(files: DataFrame, max_kb: int = MAX_FILE_SIZE_KB) -> DataFrame:
    """Files too large to explain, with the reason."""
    _, rejected = by_size(files, max_kb)
    return rejected.select(
        "repo_id", "path", rejection_message(F.col("size_bytes"), max_kb).alias("reason")
    )


def file_prompts(explained: DataFrame) -> DataFrame:
    prompt = fill(
        "file",
        {
            "file_path": F.col("path"),
            "language": F.col("language"),
            "lines": F.col("lines"),
            "content": F.col("text"),
        },
    )
    return explained.select("repo_id", "path", "language", "lines", prompt.alias("prompt"))


def explanations(answered: DataFrame) -> DataFrame:
    """``answered`` holds ``repo_id, path, language, lines, response`` per file."""
    response = F.col("response")
    return answered.filter(response.isNotNull()).select(
        "repo_id",
        "path",
        "language",
        "lines",
        purpose_of(response).alias("purpose"),
        key_elements_of(response).alias("key_elements"),
        response.alias("explanation"),
    )
