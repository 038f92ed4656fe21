import pyarrow as pa
from pyspark.sql import functions as F

from martwright.operators import profile
from martwright.plans import onboard


def test_cleaned_rows_are_computed_once(spark, encounters):
    result = onboard.onboard(spark, encounters, "Demo once", load=False)
    assert "regexp_replace" not in result.clean._jdf.queryExecution().executedPlan().toString()
    assert result.clean.count() == 19 and {r["_source"] for r in result.clean.collect()} == {"Demo once"}


def test_value_facts_count_values_in_one_pass(spark):
    read, n = spark.sparkContext.accumulator(0), 300

    def counting(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)

    rows = spark.range(n).select("id", F.concat(F.repeat(F.lit("x"), 80), F.col("id") % 7).alias("text"))
    facts = {r["column"]: r for r in profile.value_facts(rows.mapInArrow(counting, rows.schema)).collect()}
    assert read.value == 2 * n  # once to count, once for the whole of the long texts that are shown
    assert facts["text"]["unique_count"] == 7 and [s["value"] for s in facts["id"]["samples"]] == ["0", "1", "2"] and len(facts["text"]["top"]) == 5


def test_value_facts_without_top_values(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",)], "t string")
    full, less = profile.value_facts(rows).first(), profile.value_facts(rows, top=0).first()
    assert full.asDict() | {"top": []} == less.asDict()
    assert profile.value_facts(rows, top=0, samples=0).first()["unique_count"] == 2
