"""Batch explanations."""

from pyspark.sql import functions as F

from vulnspark import schemas
from vulnspark.operators import enrich
from vulnspark.plans import explanations


def test_failures_cost_one_row(spark):
    def model(prompts):
        if any("bad" in x for x in prompts):
            raise RuntimeError("refused")
        return [f" {x} " for x in prompts]

    texts = [f"t{i}" for i in range(40)] + ["bad"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = {r.t: r.ai_explanation for r in enrich.explain(df, F.col("t"), model).collect()}
    assert found == {t: t for t in texts} | {"bad": enrich.FAILED}


def test_wrong_number_of_answers(spark):
    texts = [f"t{i}" for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = enrich.explain(df, F.col("t"), lambda prompts: prompts[:1]).collect()
    assert {r.t: r.ai_explanation for r in found} == {t: t for t in texts}
    found = enrich.explain(df, F.col("t"), lambda prompts: []).collect()
    assert [r.ai_explanation for r in found] == [enrich.FAILED] * 40


def test_explanations(spark):
    rows = [
        (2, "C2", None, "", "Xss", ("7.5", "HIGH"), " text two "),
        (1, "C1", "T", "V", "Sql", (None, None), "one"),
        (3, "C3", "T", "V", "Sql", None, "  "),
        (4, "C4", "T", "V", "Sql", None, "four"),
    ]
    df = spark.createDataFrame(rows, "_row int, cve_id string, title string, vendor string, attack_type string, "
                               "cvss_features struct<score:string,severity_level:string>, d string")
    df = df.withColumn("description_features", F.struct(F.col("d").alias("text"))).drop("d")
    found = explanations(df, lambda prompts: [x.split("\n")[-3] for x in prompts], ["_row"], 2)
    assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schemas.EXPLANATIONS]
    assert [tuple(r) for r in found.orderBy("cve_id").collect()] == [
        ("C1", "T", "V", "Sql", "Unknown", "N/A", "one", "Description: one"),
        ("C2", "Unknown", "", "Xss", "HIGH", "7.5", "text two", "Description: text two"),
    ]


def test_preview(value):
    assert value(enrich.preview_text(F.col("t")), t="x" * 100) == "x" * 80


def test_a_model_gets_some_text_at_once(spark):
    texts = [str(i % 10) * 200_000 for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = enrich.explain(df, F.col("t"), lambda prompts: [f"{len(prompts)} {p[0]}" for p in prompts]).select("i", "ai_explanation").collect()
    assert [int(r.ai_explanation.split()[1]) for r in sorted(found)] == [i % 10 for i in range(40)]
    assert max(int(r.ai_explanation.split()[0]) for r in found) <= 2 + enrich.PROMPTS // 200_000
