"""Read side: history, leaderboards, detail, inspection and report rows over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions.text import fill
from inkwitness.operators.cleaning import _bands, boxes_meet
from inkwitness.operators.narrative import narrate
from inkwitness.operators.scoring import label_entry, trust_label, trust_score
from inkwitness.operators.signals import severity_rank

COUNTS = ["total_signals", "high_count", "medium_count", "low_count"]


# --- history -----------------------------------------------------------------------------

def owned_scans(scans: DataFrame, documents: DataFrame, owner: int | None = None, label: str | None = None) -> DataFrame:
    """Scans with their document; filters apply before the join."""
    docs = documents.select("doc_id", "owner_id", "filename")
    if owner is not None:
        docs = docs.filter(F.col("owner_id") == owner)
    if label is not None:
        scans = scans.filter(F.col("trust_label") == label)
    return scans.join(docs, "doc_id")


def scan_history(scans: DataFrame, documents: DataFrame, owner: int | None = None, label: str | None = None,
                 limit: int = V.HISTORY_PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """Newest first, one page.  Ties are settled by scan number, newest first."""
    if not 1 <= limit <= V.HISTORY_PAGE_MAX or offset < 0:
        raise ValueError("limit must be 1..100 and offset not negative")
    page = owned_scans(scans, documents, owner, label).orderBy(F.desc("scanned_at"), F.desc("scan_id")).offset(offset).limit(limit)
    return page.fillna(0, subset=[c for c in COUNTS if c in page.columns])


def history_total(scans: DataFrame, documents: DataFrame, owner: int | None = None, label: str | None = None) -> DataFrame:
    return owned_scans(scans, documents, owner, label).agg(F.count("*").alias("total"))


def _mean_of_tenths(score: str) -> Column:
    """Mean of scores that have one decimal place, from whole tenths, so the order of adding is immaterial."""
    tenths = F.sum(F.bround(F.col(score) * 10, 0).cast("long"))
    return F.try_divide(tenths.cast("double"), F.count(score) * F.lit(10.0))


def history_summary(scans: DataFrame, documents: DataFrame) -> DataFrame:
    """Per owner, all labels: count, count per label, mean score."""
    label = F.col("trust_label")
    known = [F.count_if(label == name).alias(name.lower().replace(" ", "_")) for name in V.LABELS]
    return owned_scans(scans, documents).groupBy("owner_id").agg(
        F.count("*").alias("total_scans"), *known,
        F.count_if(label.isNotNull() & ~label.isin(*V.LABELS)).alias("other_labels"),
        F.coalesce(F.bround(_mean_of_tenths("trust_score"), 1), F.lit(0.0)).alias("average_trust_score"),
    )


def history_window(total: Column, offset: Column, size: int = V.HISTORY_WINDOW) -> list[Column]:
    return [
        F.when(total == 0, 0).otherwise(offset + 1).alias("start_idx"),
        F.least(offset + size, total).alias("end_idx"),
        (offset > 0).alias("has_prev"),
        (offset + size < total).alias("has_next"),
    ]


# --- leaderboards ------------------------------------------------------------------------

def leaderboard(rows: DataFrame) -> DataFrame:
    """``rank`` in each batch: best trust, then best match, then the order of submission; a missing score counts as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).desc()
    return rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("batch_id").orderBy(zero("trust_score"), zero("true_match_score"), "batch_pos")))


def leaderboard_by(rows: DataFrame, key: str, ascending: bool = False) -> DataFrame:
    value = F.coalesce(F.col(key), F.lit(0.0))
    return rows.withColumn("rank", F.row_number().over(
        Window.partitionBy("batch_id").orderBy(value.asc() if ascending else value.desc(), "batch_pos")))


# --- one scan ----------------------------------------------------------------------------

def number_signals(signals: DataFrame) -> DataFrame:
    """Numbers the signals of a document in reading order."""
    box = [F.coalesce(F.col(f"bbox.{c}"), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")]
    order = Window.partitionBy("doc_id").orderBy(
        "page", severity_rank(F.col("severity")), "signal_type", *box, "description", "span_no")
    return signals.withColumn("signal_no", F.row_number().over(order))


def scan_detail(scans: DataFrame, signals: DataFrame, spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Scan rows with their signals, spans and paragraph scores nested."""
    nest = lambda df, name, *cols: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    sig = nest(number_signals(signals), "signals", "signal_no", "signal_type", "severity", "page", "bbox", "description",
               "evidence_text", "risk_points", "evidence_strength", "confidence", "remediation")
    spn = nest(spans, "spans", "span_no", "page", "block_no", "text", "font_name", "font_size", "bbox")
    par = nest(paragraphs, "paragraphs", "paragraph_index", "page", "text_snippet", "ai_score", "confidence")
    out = scans.join(sig, "doc_id", "left").join(spn, "doc_id", "left").join(par, "doc_id", "left")
    return out.withColumn("span_count", F.coalesce(F.size("spans"), F.lit(0)))


def flagged_pairs(spans: DataFrame, signals: DataFrame) -> DataFrame:
    """``(doc_id, page, span_no, signal_no, ...)`` for boxes that meet on the same page."""
    keys = ["doc_id", "page"]
    placed = spans.filter(F.col("bbox").isNotNull()).select(*keys, "span_no", "bbox").withColumn("band", F.explode(_bands(F.col("bbox"))))
    hits = (
        signals.filter(F.col("bbox").isNotNull())
        .select(*keys, F.col("bbox").alias("hit"), "signal_no", "signal_type", "severity")
        .withColumn("band", F.explode(_bands(F.col("hit"))))
    )
    met = placed.join(hits, keys + ["band"]).filter(boxes_meet(F.col("bbox"), F.col("hit")))
    # boxes that share several bands are kept once, in the first band both touch
    first = F.greatest(F.element_at(_bands(F.col("bbox")), 1), F.element_at(_bands(F.col("hit")), 1))
    return met.filter(F.col("band") == first).select(*keys, "span_no", "signal_no", "signal_type", "severity")


def inspect_spans(spans: DataFrame, signals: DataFrame) -> DataFrame:
    """Every span with the signals that meet it; ``is_flagged`` tells the two kinds apart."""
    met = flagged_pairs(spans, signals).groupBy("doc_id", "span_no").agg(
        F.array_sort(F.collect_list(F.struct("signal_no", "signal_type", "severity"))).alias("matching_signals"))
    return spans.join(met, ["doc_id", "span_no"], "left").withColumn("is_flagged", F.col("matching_signals").isNotNull())


def inspect_counts(inspected: DataFrame) -> DataFrame:
    return inspected.groupBy("doc_id").agg(
        F.count("*").alias("total_spans"), F.count_if("is_flagged").alias("flagged_span_count"),
        F.count_if(~F.col("is_flagged")).alias("clean_span_count"))


def clean_sample(inspected: DataFrame, limit: int | None = None) -> DataFrame:
    """The clean spans of each document, or the first ``limit`` of them (a report's sample)."""
    if limit is None:
        return inspected.filter(~F.col("is_flagged"))
    order = Window.partitionBy("doc_id").orderBy("span_no")
    return inspected.filter(~F.col("is_flagged")).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def inspect_by_page(inspected: DataFrame, limit: int | None = None) -> DataFrame:
    """Per page: the clean spans (of a document the first ``limit``), then the flagged ones, each with the types that flagged it."""
    shown = clean_sample(inspected, limit).unionByName(inspected.filter("is_flagged"))
    types = F.coalesce(F.transform("matching_signals", lambda m: m["signal_type"]), F.array().cast("array<string>"))
    entry = F.struct("is_flagged", "span_no", "text", types.alias("signal_types"))
    return shown.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(entry)).alias("spans"))


def public_view(scans: DataFrame, documents: DataFrame, token: str | None = None) -> DataFrame:
    """Redacted result behind a share token: an allow-list of columns, no evidence, no positions."""
    shared = scans.filter(F.col("share_token").isNotNull() if token is None else F.col("share_token") == token)
    none = F.array().cast("array<string>")
    told = narrate(
        shared.select("doc_id", "share_token", "scanned_at", "trust_score", "trust_label", "forensic_risk_score",
                      "ai_content_score", "true_match_score", *COUNTS)
        .withColumn("high_types", none).withColumn("medium_types", none).withColumn("font_substituted", F.lit(False)))
    return told.join(documents.select("doc_id", "filename"), "doc_id").select(
        "share_token", "filename", "scanned_at", "trust_score", "trust_label", "forensic_risk_score", "ai_content_score",
        "true_match_score", "summary", "key_factors", "recommendation",
        F.lit(V.NARRATIVE["public_disclaimer"]).alias("limitations_disclaimer"))


def signals_by_severity(signals: DataFrame) -> DataFrame:
    """Signals of a document grouped by severity, most severe group first."""
    group = F.upper(F.coalesce("severity", F.lit("low")))
    return (
        number_signals(signals).withColumn("severity_group", group)
        .groupBy("doc_id", "severity_group")
        .agg(F.array_sort(F.collect_list(F.struct("signal_no", "signal_type"))).alias("s"))
        .select("doc_id", "severity_group", severity_rank(F.lower("severity_group")).alias("group_rank"),
                F.col("s.signal_type").alias("signal_types"))
    )


# --- report rows -------------------------------------------------------------------------

def _first_words(text: Column, n: int) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, 1, n), " ")


def report_signal_rows(signals: DataFrame) -> DataFrame:
    return signals.select(
        "doc_id", F.upper("severity").alias("sev"), F.translate("signal_type", "_", " ").alias("signal_name"), "page",
        F.substring("description", 1, 130).alias("description"), _first_words(F.col("evidence_text"), 22).alias("evidence"))


def report_top_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Three highest paragraphs scoring 40 or more; equals keep their order."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("ai_score"), "paragraph_index")
    return (
        paragraphs.filter(F.col("ai_score") >= 40).withColumn("place", F.row_number().over(order)).filter("place <= 3")
        .select("doc_id", "place", F.concat(F.format_string("%.1f", "ai_score"), F.lit("%")).alias("score"),
                F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "),
                         _first_words(F.replace("text_snippet", F.lit("\n"), F.lit(" ")), 20), F.lit("...")).alias("snippet"),
                F.substring(F.array_join("contributing_factors", ", "), 1, 65).alias("factors"))
    )


def report_hidden_words(signals: DataFrame) -> DataFrame:
    return signals.filter(F.col("signal_type") == "hidden_text").select(
        "doc_id", F.substring("evidence_text", 1, 90).alias("hidden_text"), "page", F.upper("severity").alias("sev"),
        F.translate("signal_type", "_", " ").alias("signal_name"))


def report_input(scans: DataFrame, documents: DataFrame) -> DataFrame:
    """Scan header for a report; a missing trust score is recomputed from the counts."""
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in COUNTS[1:]]
    legacy = trust_score(F.col("ai_content_score"), F.col("true_match_score"), *counts, None)
    score = F.coalesce("trust_score", legacy)
    label = F.when(F.col("trust_score").isNotNull(), F.col("trust_label")).otherwise(trust_label(legacy, counts[0]))
    return (
        scans.join(documents.select("doc_id", "filename", "sha256", "page_count"), "doc_id")
        .withColumn("report_score", score).withColumn("report_label", label)
        .withColumn("report_emoji", label_entry(F.col("report_label"), V.LABEL_EMOJI))
    )


def report_signals(signals: DataFrame) -> DataFrame:
    """Box only where all four coordinates are there."""
    box = F.col("bbox")
    whole = box["x0"].isNotNull() & box["y0"].isNotNull() & box["x1"].isNotNull() & box["y1"].isNotNull()
    return signals.withColumn("bbox", F.when(whole, box))


def overlay_rectangles(signals: DataFrame, documents: DataFrame) -> DataFrame:
    """Rectangles to draw over a page: position, colour by severity, caption."""
    sev = F.col("severity")
    channel = lambda i: F.when(sev == "high", V.OVERLAY_RGB["high"][i]).when(sev == "medium", V.OVERLAY_RGB["medium"][i]).when(
        sev == "low", V.OVERLAY_RGB["low"][i]).otherwise(V.OVERLAY_DEFAULT_RGB[i])
    return (
        report_signals(signals).filter(F.col("bbox").isNotNull())
        .join(documents.select("doc_id", "page_count"), "doc_id")
        .filter((F.col("page") >= 1) & (F.col("page") <= F.col("page_count")))
        .select("doc_id", "page", "bbox.*", *[channel(i).alias(n) for i, n in enumerate(("red", "green", "blue"))],
                F.translate("signal_type", "_", " ").alias("caption"), F.col("bbox.x0").alias("caption_x"),
                F.greatest(F.col("bbox.y0") - 2, F.lit(0.0)).alias("caption_y"))
    )


def fraud_summary_text(total: Column, high: Column) -> Column:
    plural = F.when(total > 1, "s").otherwise("")
    return F.when(total == 0, V.SUMMARY_NONE).otherwise(fill(V.SUMMARY_SOME, total=total, plural=plural, high=high))


# --- organisations -----------------------------------------------------------------------

def effective_thresholds(owners: DataFrame, settings: DataFrame) -> DataFrame:
    """Per owner the organisation's thresholds, or the defaults.  The optimiser picks the join by size."""
    return owners.join(settings, "organization", "left").select(
        *owners.columns,
        F.coalesce("near_white_threshold", F.lit(V.NEAR_WHITE_THRESHOLD)).alias("near_white_threshold"),
        F.coalesce("hidden_font_size_pt", F.lit(V.HIDDEN_FONT_SIZE_PT)).alias("hidden_size_threshold"),
    )


def document_thresholds(documents: DataFrame, owners: DataFrame) -> DataFrame:
    """``documents(doc_id, owner_id)`` with the limits of ``effective_thresholds``; an unknown owner has the defaults."""
    limits = owners.select("owner_id", "near_white_threshold", "hidden_size_threshold")
    return documents.select("doc_id", "owner_id").join(limits, "owner_id", "left").select(
        "doc_id",
        F.coalesce("near_white_threshold", F.lit(V.NEAR_WHITE_THRESHOLD)).alias("near_white_threshold"),
        F.coalesce("hidden_size_threshold", F.lit(V.HIDDEN_FONT_SIZE_PT)).alias("hidden_size_threshold"),
    )


def with_thresholds(spans: DataFrame, limits: DataFrame) -> DataFrame:
    """Spans with the limits of their document on every row, where the span rules look for them.

    Documents that keep to the defaults are left out of the join, so that usually its small side holds few documents.
    """
    near, tiny = F.lit(V.NEAR_WHITE_THRESHOLD), F.lit(V.HIDDEN_FONT_SIZE_PT)
    own = limits.filter((F.col("near_white_threshold") != near) | (F.col("hidden_size_threshold") != tiny))
    return spans.join(own, "doc_id", "left").withColumns({
        "near_white_threshold": F.coalesce("near_white_threshold", near), "hidden_size_threshold": F.coalesce("hidden_size_threshold", tiny)})


def share_allowed(scans: DataFrame, documents: DataFrame, owners: DataFrame, settings: DataFrame) -> DataFrame:
    """Scans their owner may share: the organisation has switched sharing on."""
    open_orgs = settings.filter(F.coalesce("candidate_transparency_enabled", F.lit(False))).select("organization")
    return (
        scans.select("scan_id", "doc_id").join(documents.select("doc_id", "owner_id"), "doc_id")
        .join(owners.join(open_orgs, "organization", "left_semi").select("owner_id"), "owner_id", "left_semi")
    )
