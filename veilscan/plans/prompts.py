"""Analyst prompt per site: a table for any external scorer.

The template lists the taxonomy and legal map from the dimension tables and
asks for the report JSON contract; ``{evidence_summary}`` and
``{screenshot_count}`` are filled per site with column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import dims


def template() -> str:
    lines = ["Classify deceptive design in the evidence below with the ontology of",
             dims.ONTOLOGY_REFERENCE, ""]
    for strategy in dims.STRATEGIES:
        lines.append(f"## {strategy}")
        for level in ("meso", "low"):
            for name, definition in dims.TAXONOMY[strategy][level]:
                lines.append(f"- [{level}] {name}: {definition}")
    lines.append("")
    lines.append("## Legal context")
    for law, pats in dims.LEGAL:
        lines.append(f"- {law}: {', '.join(pats)}")
    lines += ["", "## Evidence", "{evidence_summary}", "", "Screenshots available: {screenshot_count}", "",
              "Answer with one JSON object: dark_patterns_found (list of pattern, level, high_level_strategy,",
              "severity, evidence, location, gdpr_risk, legal_reference, recommendation), overall_risk,",
              "overall_summary, gdpr_concerns, pattern_count, language_detected, ontology_reference.",
              "Use the most specific level; one finding per instance."]
    return "\n".join(lines)


def analyst_prompts(summaries: DataFrame, summary_col: str = "evidence_summary",
                    shots_col: str = "screenshot_count") -> DataFrame:
    t = F.lit(template())
    filled = F.replace(F.replace(t, F.lit("{evidence_summary}"), F.col(summary_col)),
                       F.lit("{screenshot_count}"), F.col(shots_col).cast("string"))
    return summaries.withColumn("prompt", filled)
