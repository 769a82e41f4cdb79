"""Answers of a remote model as a pluggable column function: prompts, a table of responses, retries, rows out of answers."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestrata.operators.text import salvaged
from lodestrata.session import small_list


def prompt_key(system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))), 256)


def answer_from_table(prompts: DataFrame, responses: DataFrame, system: str = "system", user: str = "user") -> DataFrame:
    """``prompts`` with the answer of each from ``responses(prompt_key, answer)``; unanswered prompts keep a null."""
    p = prompts.withColumn("prompt_key", prompt_key(F.col(system), F.col(user)))
    return p.join(responses.select("prompt_key", "answer").dropDuplicates(["prompt_key"]), "prompt_key", "left")


def answer_by_call(prompts: DataFrame, model: Callable[[str, str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``prompts`` with ``answer`` and ``error``: the model is called for each row, again after a growing wait where it fails.

    A failing row keeps its message and never stops the batch.
    """
    schema = StructType([*prompts.schema.fields]).add("answer", "string").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, errors = [], []
            for s, u in zip(b["system"], b["user"]):
                answer, error = None, None
                for k in range(tries):
                    try:
                        answer, error = model(s, u), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(wait * 2**k)
                answers.append(answer)
                errors.append(error)
            yield b.assign(answer=answers, error=errors)

    return prompts.mapInPandas(run, schema)


def answer_rows(answers: DataFrame, items: str, schema: str, keep: list[str]) -> DataFrame:
    """The list named ``items`` of each answer as rows of ``schema``; fences, prose and cut ends are seen to, unknown keys dropped."""
    parsed = answers.withColumn("_j", F.from_json(salvaged(F.col("answer")), f"`{items}` array<struct<{schema}>>"))
    return parsed.select(*keep, F.explode(F.col(f"_j.{items}")).alias("_r")).select(*keep, "_r.*")


def row_schema(struct: StructType) -> str:
    """JSON schema of a row for a prompt."""
    kinds = {"double": "number", "integer": "integer", "long": "integer", "string": "string", "boolean": "boolean"}
    return json.dumps({"type": "object", "properties": {f.name: {"type": [kinds.get(f.dataType.typeName(), "string"), "null"]} for f in struct.fields}})


def dense_scores(pairs: DataFrame, options: DataFrame, record: str, option: str, logp: str) -> DataFrame:
    """Sparse (record, option, logp) as every option of every record, absent ones ln(1e-20). At most 100,000 options."""
    listed = small_list(options.select(option).distinct(), 100_000, "options").agg(F.array_sort(F.collect_list(option)).alias("_all"))
    maps = pairs.groupBy(record).agg(F.map_from_entries(F.collect_list(F.struct(option, logp))).alias("_m"))
    dense = maps.join(F.broadcast(listed)).select(record, F.explode("_all").alias(option), "_m")
    return dense.select(record, option, F.coalesce(F.try_element_at("_m", F.col(option)), F.log(F.lit(1e-20))).alias(logp))
