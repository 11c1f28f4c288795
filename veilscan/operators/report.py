"""Report columns: findings table, detail blocks, risk headline, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..sources import dims
from .findings import risk_code, with_display


def findings_table(findings: DataFrame, location_chars: int | None = None) -> DataFrame:
    """Pattern, level, icon + strategy, severity, location (cut if asked), GDPR mark."""
    f = with_display(findings)
    return f.withColumn("strategy_label", F.concat(F.col("strategy_icon"), F.lit(" "), F.col("high_level_strategy"))) \
        .withColumn("location_short", F.substring("location", 1, location_chars) if location_chars else F.col("location")) \
        .withColumn("gdpr_mark", F.when(F.col("gdpr_risk"), F.lit("⚠️")).otherwise(F.lit("—")))


def finding_details(findings: DataFrame, number: str = "finding_no", total: str = "finding_total") -> DataFrame:
    """Detail block per finding; the legal line only when a reference exists."""
    f = with_display(findings)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Pattern:    "), F.col("pattern")),
        F.concat(F.lit("Level:      "), F.col("level")),
        F.concat(F.lit("Strategy:   "), F.col("strategy_icon"), F.lit(" "), F.col("high_level_strategy")),
        F.concat(F.lit("Severity:   "), F.col("severity")),
        F.concat(F.lit("Location:   "), F.col("location")),
        F.concat(F.lit("Evidence:   "), F.col("evidence")),
        F.when(F.coalesce(F.col("legal_reference"), F.lit("")) != "",
               F.concat(F.lit("Legal ref:  "), F.col("legal_reference"))),
        F.concat(F.lit("Fix:        "), F.col("recommendation")))
    title = F.format_string("Finding %d of %d", F.col(number), F.col(total))
    return f.withColumn("detail", text).withColumn("title", title)


def risk_headline(reports: DataFrame) -> DataFrame:
    icon = F.when(F.col("overall_risk") == "CLEAN", F.lit("✅")).otherwise(F.lit("⚠️"))
    text = F.concat(icon, F.lit(" Overall risk: "), F.col("overall_risk"), F.lit("\n\n"),
                    F.coalesce(F.col("overall_summary"), F.lit("")),
                    F.when(F.col("gdpr_concerns"), F.lit("\n\n⚖️  GDPR concerns detected")).otherwise(F.lit("")))
    color = F.coalesce(F.element_at(dims.literal_map(dims.RISK_COLORS), F.col("overall_risk")),
                       F.lit(dims.DEFAULT_COLOR))
    return reports.withColumn("headline", text).withColumn("border_color", color)


def risk_gate(reports: DataFrame) -> DataFrame:
    """Exit code of the whole batch: the worst site decides (HIGH 2, MEDIUM/LOW 1, else 0)."""
    return reports.agg(F.coalesce(F.max(risk_code("overall_risk")), F.lit(0)).alias("exit_code"))


def findings_title(n) -> Column:
    n = col(n)
    return F.format_string("Findings (%d pattern%s detected)", n, F.when(n != 1, "s").otherwise(""))
