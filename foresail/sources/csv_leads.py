"""Lead CSV files: comment-tolerant reader, column check, date coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foresail.schema import DATE_COLUMNS, LEAD, LEAD_COLUMNS, REQUIRED_COLUMNS
from foresail.sources.csv_records import named_cells, placed_lines

# fixed values: cell texts that mean "no value" in CSV files
NO_VALUE = ("", "#N/A", "#NA", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# date spellings that are understood, the first that fits counts; slashes put the month first
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "M/d/yyyy")


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def coerce_dates(df: DataFrame, columns: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Parse date text in any of DATE_FORMATS; blank or impossible dates become null. Absent columns are skipped."""
    def parsed(c: str):
        text = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        # the usual spelling needs no formatter, and fits no other one
        plain = text.rlike(r"^[1-9]\d{3}-\d\d-\d\d$")
        return F.when(plain, text.try_cast("date")).otherwise(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS)).cast("date"))
    return df.withColumns({c: parsed(c) for c in columns if c in df.columns})


def typed_leads(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns -> lead schema. Optional columns a file lacks are added as null; ``keep``
    names columns that ride along."""
    dated = coerce_dates(raw)
    out = []
    for f in LEAD.fields:
        if f.name not in dated.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.IntegerType)):
            number = F.col(f.name).try_cast("double")
            if isinstance(f.dataType, T.IntegerType):  # a fraction or a number out of range is no value
                number = F.when(number == F.rint(number), number).try_cast(f.dataType)
            out.append(number.cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name))
    return dated.select(*out, *keep)


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor comments, indented or not."""
    return lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))


def leads_of_lines(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Leads of CSV lines with their places (``csv_records.placed_lines``), each file by its own header.

    Blank and comment lines are dropped first, inside a quoted cell too. Cells that mean "no value"
    become null; records without any value are dropped."""
    cells = named_cells(data_lines(lines), LEAD_COLUMNS, REQUIRED_COLUMNS, keep)
    known = cells.select(*[F.when(~F.trim(c).isin(*NO_VALUE), F.col(c)).alias(c) for c in LEAD_COLUMNS], *keep)
    # exploded, so that the rows to drop are told from the values there are, not by parsing every cell again
    typed = typed_leads(known, keep).select(F.explode(F.array(F.struct(*LEAD_COLUMNS))).alias("_lead"), *keep)
    return typed.select("_lead.*", *keep).dropna("all", subset=LEAD_COLUMNS)


def read_leads_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Leads from one or many CSV files, each parsed by its own header; quoted cells may span lines."""
    try:
        return leads_of_lines(placed_lines(spark.read.text(path)))
    except ValueError as fault:
        raise ValueError(f"{fault} ({path})") from None


def write_leads_csv(leads: DataFrame, path: str) -> None:
    leads.write.option("header", True).option("escape", '"').option("dateFormat", "yyyy-MM-dd").csv(path)
