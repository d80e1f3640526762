"""Column reports: can a column be trusted?"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sanilake.functions.labels import lookup
from sanilake.functions.rules import DATE_PATTERNS, date



def check_columns(df: DataFrame, fields: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row for each column: rule, how much is empty, what has no label, which dates are wrong.

    fields: by column, label, type, format and codes of its dictionary entry.
    Two jobs for all columns: one unpivots values and counts them by column
    and value, the other sums those counts.  A value is empty if null or ''.
    The example is the smallest filled value, as rows have no order.
    """
    spark = df.sparkSession
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("place"), F.col(f"`{c}`").cast("string").alias("value")) for n, c in enumerate(df.columns)))).alias("x")
    values = df.select(cells).select("x.*").groupBy("place", "value").agg(F.count("*").alias("rows"))
    filled = F.col("value").isNotNull() & (F.col("value") != "")
    named, valid = F.lit(None).cast("string"), F.lit(None).cast("date")
    described = []
    for n, c in enumerate(df.columns):
        field = fields.get(c.lower(), {})
        codes, pattern = field.get("codes") or {}, field.get("format") if field.get("type") == "date" else None
        pattern = pattern if pattern in DATE_PATTERNS and not codes else None
        described.append((n, c, field.get("label"), c.lower() in fields, len(codes), pattern))
        if codes:
            named = F.when(F.col("place") == n, lookup(codes, "value")).otherwise(named)
        if pattern:
            valid = F.when(F.col("place") == n, date("value", pattern)[0]).otherwise(valid)
    about = spark.createDataFrame(described, "place int, column string, label string, known boolean, n_codes int, pattern string")
    said = F.when(F.col("n_codes") > 0, F.format_string("code map (%d codes)", "n_codes")).when(F.col("pattern").isNotNull(), F.concat(F.lit("date "), "pattern"))
    about = about.select("place", "column", "label", F.when(F.col("known"), said).otherwise("not in dictionary").alias("rule"), (F.col("n_codes") > 0).alias("coded"), F.col("pattern").isNotNull().alias("dated"))
    seen = values.join(F.broadcast(about.select("place", "coded", "dated")), "place").withColumns({"named": named, "valid": valid})
    unlabelled = filled & F.col("coded") & F.col("named").isNull()
    order = F.struct((-F.col("rows")).alias("less"), F.col("value"))
    report = seen.groupBy("place").agg(
        F.sum("rows").alias("_all"),
        F.sum(F.when(filled, F.col("rows")).otherwise(0)).alias("_filled"),
        F.count_if(filled).alias("distinct"),
        F.min(F.when(filled, F.col("value"))).alias("example_code"),
        F.min(F.when(filled, F.struct("value", "named"))).alias("_example"),
        F.array_sort(F.collect_list(F.when(unlabelled, order))).alias("_codes"),
        F.sum(F.when(unlabelled, F.col("rows")).otherwise(0)).alias("unlabelled_rows"),
        F.sum(F.when(filled & F.col("dated") & F.col("valid").isNull(), F.col("rows")).otherwise(0)).alias("_wrong"),
        F.min("valid").alias("date_min"),
        F.max("valid").alias("date_max"),
    )
    pct = lambda part, whole: F.round(100.0 * part / F.nullif(whole, F.lit(0)), 1)
    joined = about.join(report, "place", "left")
    return joined.select(
        "column",
        "label",
        "rule",
        pct(F.col("_all") - F.col("_filled"), F.col("_all")).alias("pct_empty"),
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        "example_code",
        F.col("_example.named").alias("example_label"),
        F.coalesce(F.transform("_codes", lambda x: x["value"]), F.array().cast("array<string>")).alias("unlabelled_codes"),
        F.coalesce("unlabelled_rows", F.lit(0)).alias("unlabelled_rows"),
        F.when(F.col("dated"), pct(F.col("_wrong"), F.col("_filled"))).alias("pct_invalid_dates"),
        "date_min",
        "date_max",
    )
