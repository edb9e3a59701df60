"""Rules over document metadata: ``metadata(doc_id, meta MAP<STRING,STRING>)``.

A null map means there was no metadata to read and raises nothing; an empty map is a stripped one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X
from inkwitness.functions.dates import parse_pdf_date
from inkwitness.operators.signals import describe, evidence_map, in_layout, signal

def _meta() -> Column:
    return F.col("meta")


def _entry(key: str) -> Column:
    return F.try_element_at(_meta(), F.lit(key))


def _trimmed(key: str) -> Column:
    return X.strip(F.coalesce(_entry(key), F.lit("")))


def _seconds() -> Column:
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return (at("_mod") - at("_cre")).cast("long")


def _shown(c: Column) -> Column:
    return F.coalesce(X.quoted(c), F.lit("None"))


def builder_tool() -> Column:
    """First known builder named by creator or producer."""
    combined = F.lower(F.concat(_trimmed("creator"), F.lit(" "), _trimmed("producer")))
    tools = F.array(*[F.lit(t) for t in V.BUILDER_TOOLS])
    return F.get(F.filter(tools, lambda t: F.contains(combined, t)), F.lit(0))


def _candidate(keep: Column, columns: list[Column]) -> Column:
    return F.when(keep, F.struct(*columns))


def _rules() -> dict[str, Column]:
    one, creator, producer = F.lit(1), _trimmed("creator"), _trimmed("producer")
    minutes = F.col("_seconds") / 60.0
    dates = F.concat(F.lit("CreationDate="), _shown(_entry("creationDate")), F.lit(" ModDate="), _shown(_entry("modDate")))
    shown_tool = X.quoted(F.when(creator != "", creator).otherwise(producer))
    tool = F.col("_tool")
    return {
        "builder": _candidate(tool.isNotNull(), signal(
            "metadata_generic_builder_tool", F.lit("medium"), one, F.lit("WEAK"), "high",
            describe("metadata_generic_builder_tool", tool=shown_tool, matched=tool),
            F.concat(F.lit("Creator="), X.quoted(creator), F.lit(" Producer="), X.quoted(producer)),
            evidence_map(creator=creator, producer=producer, matched_tool=tool))),
        "rapid": _candidate((F.col("_seconds") > 0) & (F.col("_seconds") < V.RAPID_EDIT_MINUTES * 60), signal(
            "metadata_rapid_edit_window", F.lit("medium"), one, F.lit("WEAK"), "medium",
            describe("metadata_rapid_edit_window", minutes=X.fixed0(minutes)), dates,
            evidence_map(creation_date=_entry("creationDate"), mod_date=_entry("modDate"), gap_minutes=F.bround(minutes, 1)))),
        "reversed": _candidate(F.col("_seconds") < 0, signal(
            "metadata_mod_before_creation", F.lit("low"), one, F.lit("WEAK"), "medium", None, dates,
            evidence_map(creation_date=_entry("creationDate"), mod_date=_entry("modDate")))),
        "stripped": _candidate(
            _meta().isNotNull() & (creator == "") & (producer == "") & (F.coalesce(_entry("creationDate"), F.lit("")) == ""),
            signal("metadata_stripped", F.lit("low"), one, F.lit("WEAK"), "low")),
    }


def _detect(metadata: DataFrame, *names: str) -> DataFrame:
    rules = _rules()
    prepared = (
        metadata.filter(_meta().isNotNull())
        .withColumn("_tool", builder_tool())
        .withColumn("_cre", parse_pdf_date(_entry("creationDate")))
        .withColumn("_mod", parse_pdf_date(_entry("modDate")))
        .withColumn("_seconds", _seconds())
    )
    return in_layout(prepared.select("doc_id", F.inline(F.array_compact(F.array(*[rules[n] for n in names])))))


def detect_metadata(metadata: DataFrame) -> DataFrame:
    """All metadata rules in one pass."""
    return _detect(metadata, "builder", "rapid", "reversed", "stripped")


def detect_metadata_tool(metadata: DataFrame) -> DataFrame:
    return _detect(metadata, "builder")


def detect_metadata_rapid_edit(metadata: DataFrame) -> DataFrame:
    return _detect(metadata, "rapid")


def detect_metadata_reversed(metadata: DataFrame) -> DataFrame:
    return _detect(metadata, "reversed")


def detect_metadata_stripped(metadata: DataFrame) -> DataFrame:
    return _detect(metadata, "stripped")
