"""Completeness check of generated report documents (a table of JSON texts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: (group, section, item name, plural, minimum items, ((field, minimum length, ending), ...))
SECTIONS = (
    ("driving_factors", "positive_factors", "Positive factor", "positive factors", 3,
     (("factor", 10, " description"), ("impact", 10, " description"), ("evidence", 10, " description"))),
    ("driving_factors", "negative_factors", "Negative factor", "negative factors", 2,
     (("factor", 10, " description"), ("impact", 10, " description"), ("evidence", 10, " description"))),
    ("operational_recommendations", "immediate_actions", "Immediate action", "immediate actions", 3,
     (("action", 20, " description (too short or empty)"), ("rationale", 20, ""), ("expected_impact", 10, ""))),
    ("operational_recommendations", "strategic_initiatives", "Strategic initiative", "strategic initiatives", 2,
     (("initiative", 20, " description (too short or empty)"), ("rationale", 20, ""), ("expected_impact", 10, ""))),
    ("operational_recommendations", "risk_mitigation", "Risk mitigation", "risk mitigations", 2,
     (("risk", 20, " description (too short or empty)"), ("mitigation", 20, " description (too short or empty)"))),
    ("operational_recommendations", "optimization_opportunities", "Optimization opportunity",
     "optimization opportunities", 2,
     (("opportunity", 20, " description (too short or empty)"), ("description", 20, ""))),
    ("executive_summary", "key_insights", "Key insight", "key insights", 3, ()),
)


def _schema() -> str:
    groups: dict[str, list[str]] = {}
    for group, section, _, _, _, fields in SECTIONS:
        item = "struct<" + ",".join(f"{f}:string" for f, _, _ in fields) + ">" if fields else "string"
        groups.setdefault(group, []).append(f"{section}:array<{item}>")
    return ", ".join(f"{g} struct<{','.join(s)}>" for g, s in groups.items())


REPORT_SCHEMA = _schema()

_WARNING = "array<struct<section:string,item_no:int,field:string,message:string>>"


def _warning(when: Column, section: str, item_no: Column, field: str | None, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(section).alias("section"), item_no.cast("int").alias("item_no"),
                                 F.lit(field).cast("string").alias("field"), message.alias("message")))


def _section_warnings(items: Column, section: str, name: str, plural: str, least: int, fields) -> Column:
    n = F.size(items)
    few = F.array_compact(F.array(_warning(
        n < least, section, F.lit(0), None,
        F.format_string(f"Insufficient {plural}: %d (minimum {least} required)", n))))
    if not fields:
        return few.cast(_WARNING)

    def of_item(item: Column, i: Column) -> Column:
        return F.array_compact(F.array(*[
            _warning(F.coalesce(F.length(item[f]), F.lit(0)) < size, section, i + 1, f,
                     F.format_string(f"{name} %d has incomplete '{f}'{ending}", i + 1))
            for f, size, ending in fields]))

    return F.concat(few.cast(_WARNING), F.flatten(F.transform(items, of_item)).cast(_WARNING))


def report_warnings(reports: DataFrame, ident: str = "report_id", text: str = "report") -> DataFrame:
    """One row per shortcoming of each report, in reading order. A text that is no JSON object
    counts as an empty report."""
    parsed = reports.select(ident, F.from_json(F.col(text), REPORT_SCHEMA).alias("r"))
    found = []
    for group, section, name, plural, least, fields in SECTIONS:
        item = "struct<" + ",".join(f"{f}:string" for f, _, _ in fields) + ">" if fields else "string"
        items = F.coalesce(F.col(f"r.{group}.{section}"), F.array().cast(f"array<{item}>"))
        found.append(_section_warnings(items, section, name, plural, least, fields))
    return (parsed.select(ident, F.posexplode(F.concat(*found)).alias("warning_no", "w"))
            .select(ident, "warning_no", "w.*"))
