"""Batch explanations by a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnspark.session import bound_batches

# Fixed value: what stands for an explanation that could not be had.
FAILED = "Error generating explanation."

# Characters of the prompts that a model gets at once; a single prompt may be longer.
PROMPTS = 2 << 20

INSTRUCTIONS = (
    "Explain the vulnerability below to a reader without security training.\n"
    "Use three plain sentences and no list: what the weakness is, how an attacker "
    "makes use of it, and which harm may follow.\n"
)


def prompt(cve_id: Column, attack_type: Column, description: Column) -> Column:
    return F.concat(
        F.lit(f"{INSTRUCTIONS}\nCVE ID: "), cve_id,
        F.lit("\nAttack Type: "), attack_type,
        F.lit("\nDescription: "), description,
        F.lit("\n\nExplanation:"),
    )


def explain(
    df: DataFrame,
    prompt_text: Column,
    predict: Callable[[list[str]], list[str]],
    output: str = "ai_explanation",
) -> DataFrame:
    """Add the model's answer per row.

    ``predict`` maps a batch of prompts, some 2 MB of text, to as many answers and runs in the tasks;
    rate limits belong inside it. If a batch fails its prompts are tried one by
    one, so a bad row costs only its own answer.
    """
    staged = df.withColumn(output, prompt_text)
    schema = T.StructType(
        [f for f in staged.schema.fields if f.name != output] + [T.StructField(output, T.StringType())]
    )

    def answers(prompts: list[str]) -> list[str]:
        try:
            out = [a.strip() for a in predict(prompts)]
        except Exception:
            out = []
        if len(out) == len(prompts):
            return out
        if len(prompts) == 1:
            return [FAILED]
        return [answers([p])[0] for p in prompts]

    at = staged.columns.index(output)
    kept = [i for i in range(len(staged.columns)) if i != at]
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, prompts, size = 0, [], 0
            for i, text in enumerate(batch.column(at)):
                prompts.append(text.as_py())
                size += len(prompts[-1] or "")
                if size > PROMPTS or i + 1 == batch.num_rows:
                    columns = [batch.column(k).slice(first, len(prompts)) for k in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(answers(prompts), pa.string())], schema.fieldNames())
                    first, prompts, size = i + 1, [], 0

    return staged.mapInArrow(run, schema)


def preview_text(c: Column, length: int = 80) -> Column:
    return F.substring(c, 1, length)


EXPLANATION_COLUMNS = (
    "cve_id", "title", "vendor", "attack_type", "severity", "score", "description", "ai_explanation",
)


def explanation_rows(explained: DataFrame) -> DataFrame:
    return explained.select(*EXPLANATION_COLUMNS)
