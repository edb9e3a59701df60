"""Rules that look at one span at a time.

One pass over the span table evaluates only short tests: each span yields an array of (rule,
matched text) hits, exploded once.  Positions, texts and points of a signal are worked out on the
few rows that were hit, and only those rows are ever joined or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from inkwitness import fixed_values as V
from inkwitness.functions import text as X
from inkwitness.functions.colour import rgb_distance
from inkwitness.operators.pages import subset_font_anomaly
from inkwitness.operators.signals import describe, evidence_map, signal
from inkwitness.functions.text import fill
from inkwitness.schemas import SIGNAL_COLUMNS



def _class_of(chars) -> str:
    """Character class of ``chars``, neighbours as one range, which is looked up faster."""
    codes = sorted(map(ord, chars))
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in zip(starts, ends)) + "]"


ZERO_WIDTH_CLASS = _class_of(V.ZERO_WIDTH)
LOOKALIKE_CLASS = _class_of(V.LOOKALIKES)
_OTHER_SCRIPT = "[" + "".join(X._ranges(s) for s in V.SCRIPT_RANGES if s != "Latin") + "]"
PROMPT_CLASSES = [f"(?i){p}" for p, _, _ in V.INJECTION_PATTERNS]
# every match of a pattern holds one of its pieces; a look for them costs far less than the pattern
PROMPT_PIECES = [("ignore",), ("disregard",), ("candidate",), ("candidate",), ("evaluator", "assistant", "model", "system"),
                 ("manager", "recruiter", "hr"), ("candidate",), ("not",), ("system",), ("forget",)]



def _text() -> Column:
    return F.col("text")


def _beyond_ascii() -> Column:
    """Holds a character outside ASCII: cheap, and a condition for zero-width characters and other scripts."""
    return F.octet_length(_text()) > F.length(_text())


def _page() -> Column:
    return F.col("page")


def _bbox() -> Column:
    return F.col("bbox")


def _span_no() -> Column:
    return F.col("span_no")


def _rule() -> Column:
    return F.col("rule")


def _matched() -> Column:
    return F.col("matched")


def _size() -> Column:
    return F.coalesce(F.col("font_size"), F.lit(12.0))


def _w() -> Column:
    return F.col("_w")


def _h() -> Column:
    return F.col("_h")



def _code_point(char: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(char)), 4, "0"))


def _box_text() -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *[F.bround(_bbox()[c], 1).cast("string") for c in ("x0", "y0", "x1", "y1")]), F.lit("]"))



@dataclass
class Rule:
    """A test on a span, what it matched, and the signal columns for rows it hit."""

    number: int
    test: Column
    columns: list[Column]
    matched: Column | None = None


PROMPT_BASE = 10


def zero_width() -> Rule:
    found = F.regexp_extract_all(_text(), F.lit(ZERO_WIDTH_CLASS), F.lit(0))
    kinds = F.array_distinct(found)
    names = F.create_map(*[F.lit(x) for pair in V.ZERO_WIDTH.items() for x in pair])
    start = lambda ch: F.greatest(F.instr(_text(), ch) - 20, F.lit(1))
    detail = lambda ch: F.struct(
        X.quoted(ch).alias("character"),
        _code_point(ch).alias("codepoint"),
        F.element_at(names, ch).alias("name"),
        X.quoted(F.substr(_text(), start(ch), F.instr(_text(), ch) + 21 - start(ch))).alias("context"),
    )
    description = describe(
        "zero_width_chars", count=F.size(found), page=_page(),
        names=F.array_join(F.transform(kinds, lambda ch: F.element_at(names, ch)), ", "),
    )
    evidence = evidence_map(
        occurrence_count=F.size(found), unique_codepoints=F.size(kinds), characters=F.to_json(F.transform(kinds, detail))
    )
    return Rule(0, _beyond_ascii() & _text().rlike(ZERO_WIDTH_CLASS), signal(
        "zero_width_chars", F.lit("high"), _page(), F.lit("DEFINITIVE"), "high", description, X.snippet(_text()), evidence, _bbox(), _span_no()))


def homoglyph_word() -> Column:
    """First word mixing scripts and holding a look-alike letter; null if there is none."""
    mixed = F.filter(
        F.regexp_extract_all(_text(), F.lit(X.ANY_WORD), F.lit(0)),
        lambda w: (F.length(w) >= 2) & w.rlike(LOOKALIKE_CLASS) & (F.size(X.scripts_of(w)) >= 2),
    )
    return F.when(_beyond_ascii() & _text().rlike(_OTHER_SCRIPT), F.get(mixed, F.lit(0)))


def homoglyph() -> Rule:
    word = _matched()
    suspects = F.regexp_extract_all(word, F.lit(LOOKALIKE_CLASS), F.lit(0))
    shown_scripts = F.concat(F.lit("['"), F.array_join(X.scripts_of(word), "', '"), F.lit("']"))
    shown = F.array_join(F.transform(suspects, lambda c: F.concat(X.quoted(c), F.lit("("), _code_point(c), F.lit(")"))), ", ")
    detail = lambda c: F.struct(
        X.quoted(c).alias("character"), _code_point(c).alias("codepoint"), X.char_script(c).alias("detected_script"),
        F.lit("Latin").alias("expected_script"), (F.instr(word, c) - 1).alias("position_in_word"),
    )
    evidence = evidence_map(word=word, scripts_found=shown_scripts, suspect_chars=F.to_json(F.transform(suspects, detail)))
    return Rule(1, F.col("homoglyph_word").isNotNull(), signal(
        "homoglyph_substitution", F.lit("high"), _page(), F.lit("STRONG"), "high",
        describe("homoglyph_substitution", word=X.quoted(word), page=_page(), scripts=shown_scripts, chars=shown),
        X.snippet(_text()), evidence, _bbox(), _span_no()), F.col("homoglyph_word"))


def hidden_text(threshold: Column) -> Rule:
    color = F.col("font_color")
    distance = rgb_distance(color, V.BACKGROUND_RGB)
    near = distance < V.INVISIBLE_DISTANCE
    background = "(" + ", ".join(str(v) for v in V.BACKGROUND_RGB) + ")"
    shown = F.concat(F.lit("("), F.concat_ws(", ", color["r"], color["g"], color["b"]), F.lit(")"))
    evidence = evidence_map(
        text_color_rgb=shown, background_color_rgb=F.lit(background), rgb_distance=F.bround(distance, 2),
        threshold=threshold, font_size=F.col("font_size"),
    )
    return Rule(2, color.isNotNull() & (distance < threshold) & ~X.is_blank(_text()), signal(
        "hidden_text", F.when(near, "high").otherwise("medium"), _page(), F.when(near, "DEFINITIVE").otherwise("STRONG"), "high",
        describe("hidden_text", color=shown, distance=X.fixed1(distance), background=F.lit(background), threshold=threshold),
        X.snippet(X.strip(_text())), evidence, _bbox(), _span_no()))


def tiny_font(threshold: Column) -> Rule:
    none = _size() <= 0
    return Rule(3, (_size() <= threshold) & ~X.is_blank(_text()), signal(
        "zero_or_tiny_font", F.when(none, "high").otherwise("medium"), _page(), F.when(none, "DEFINITIVE").otherwise("STRONG"), "high",
        describe("zero_or_tiny_font", size=_size(), threshold=threshold), X.snippet(X.strip(_text())),
        evidence_map(font_size=_size(), hidden_size_threshold=threshold), _bbox(), _span_no(),
        fill(V.REMEDIATIONS["zero_or_tiny_font"], size=_size())))


def _sides() -> list[tuple[str, Column, Column]]:
    """(side, outside on that side, distance outside)."""
    box, w, h = _bbox(), _w(), _h()
    return [("left", box["x1"] < 0, -box["x1"]), ("right", box["x0"] > w, box["x0"] - w),
            ("top", box["y1"] < 0, -box["y1"]), ("bottom", box["y0"] > h, box["y0"] - h)]


def offpage(threshold: Column, narrowest: Column, lowest: Column) -> Rule:
    """Spans outside the smallest page of the corpus: a necessary condition that needs no join.

    The exact test against the page's own size follows on the hits (``_place_on_page``).
    """
    outside = (_bbox()["x1"] < 0) | (_bbox()["y1"] < 0) | (_bbox()["x0"] > narrowest) | (_bbox()["y0"] > lowest)
    directions = F.concat_ws(", ", *[F.when(test, F.lit(name)) for name, test, _ in _sides()])
    distance = F.greatest(*[F.when(test, gap).otherwise(0.0) for _, test, gap in _sides()])
    return Rule(4, _bbox().isNotNull() & outside & (_size() > threshold) & ~X.is_blank(_text()), signal(
        "offpage_text", F.lit("high"), _page(), F.lit("DEFINITIVE"), "high",
        describe("offpage_text", bbox=_box_text(), width=X.fixed0(_w()), height=X.fixed0(_h()), directions=directions, distance=X.fixed1(distance)),
        X.snippet(X.strip(_text())),
        evidence_map(page_width=_w(), page_height=_h(), off_directions=directions, distance_outside_pt=F.bround(distance, 2)), _bbox(), _span_no()))


def font_substitution() -> Rule:
    font, head = F.col("font_name"), F.substring(_text(), 1, 200)
    return Rule(5, subset_font_anomaly().isNotNull(), signal(
        "font_substitution", F.lit("high"), _page(), F.lit("MODERATE"), "medium", describe("font_substitution", font=font), head,
        evidence_map(font_name=font, suspected_hidden_text=head), _bbox(), _span_no()))


#: The same for a second piece, where the first is also common in plain text.
SECOND_PIECES = {0: ("instruction",), 4: ("ai",), 5: ("you", "act", "pretend"), 7: ("this",), 8: (":",), 9: ("know", "learned", "told")}


def prompt_injection() -> list[Rule]:
    """One test per pattern; severity and reason are looked up by the pattern's number."""
    entry = lambda i: F.get(F.array(*[F.lit(p[i]) for p in V.INJECTION_PATTERNS]), _rule() - PROMPT_BASE)
    severity, reason = entry(1), entry(2)
    columns = signal(
        "prompt_injection", severity, _page(), F.when(severity == "high", "STRONG").otherwise("MODERATE"), "medium",
        describe("prompt_injection", page=_page(), reason=reason, matched=X.quoted(_matched())), X.snippet(_text()),
        evidence_map(matched_text=_matched(), pattern_reason=reason, full_span=X.snippet(_text(), 300)), _bbox(), _span_no())
    holds = lambda pieces: reduce(or_, [F.contains(F.col("_low"), F.lit(piece)) for piece in pieces])
    maybe = lambda i: holds(PROMPT_PIECES[i]) & holds(SECOND_PIECES.get(i, ("",)))
    return [Rule(PROMPT_BASE + i, maybe(i) & _text().rlike(p), columns, F.regexp_extract(_text(), p, 0)) for i, p in enumerate(PROMPT_CLASSES)]


def hits_of(spans: DataFrame, rules: list[Rule]) -> DataFrame:
    """Span rows, once per rule that hit them, with ``rule`` and ``matched``.

    Each test is a column of its own, so that it is generated code of its own; inside the list of all
    of them it would be interpreted. The outer form of the generator keeps a filter on the list, which
    would evaluate all tests twice, from being put below it.
    """
    tests = [F.when(r.test, F.struct(F.lit(r.number).alias("rule"), (F.lit(None) if r.matched is None else r.matched).cast("string").alias("matched")))
             .alias(f"_hit{r.number}") for r in rules]
    columns = [c for c in ("doc_id", "page", "span_no", "text", "bbox", "font_name", "font_size", "font_color",
                           "near_white_threshold", "hidden_size_threshold") if c in spans.columns]
    if any(r.number == 1 for r in rules):
        spans = spans.withColumn("homoglyph_word", homoglyph_word())
    if any(r.number >= PROMPT_BASE for r in rules):
        spans = spans.withColumn("_low", F.lower(_text()))
    tested = spans.select(*columns, *tests)
    return tested.select(*columns, F.inline_outer(F.array_compact(F.array(*(f"_hit{r.number}" for r in rules))))).filter(_rule().isNotNull())


def as_signals(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hit rows -> the shared signal layout."""
    prompts = [r for r in rules if r.number >= PROMPT_BASE]
    kinds = [(_rule() == r.number, r.columns) for r in rules if r.number < PROMPT_BASE]
    if prompts:
        kinds.append((_rule() >= PROMPT_BASE, prompts[0].columns))
    out = []
    for i, field in enumerate(f for f in SIGNAL_COLUMNS if f != "doc_id"):
        value = kinds[0][1][i]
        if len(kinds) > 1:
            value = F.when(kinds[0][0], value)
            for test, columns in kinds[1:]:
                value = value.when(test, columns[i])
        out.append(value.alias(field))
    return hits.select("doc_id", *out)


def _place_on_page(hits: DataFrame, page_dims: DataFrame) -> DataFrame:
    """Exact off-page test: hits of that rule stay only if they lie outside their own page."""
    dims = page_dims.select("doc_id", "page", F.col("width").alias("_w"), F.col("height").alias("_h"))
    outside = _w().isNotNull() & (reduce(or_, [test for _, test, _ in _sides()]))
    return hits.join(dims, ["doc_id", "page"], "left").filter((_rule() != 4) | outside)


def _first_per_pattern(hits: DataFrame) -> DataFrame:
    """A prompt pattern counts once per page, at the earliest span; other rules keep every span.

    A plain aggregate: it combines before the shuffle, so a page that repeats one instruction a
    million times sends one row per task.
    """
    keys = ["doc_id", "page", "rule", "slot"]
    rest = [c for c in hits.columns if c not in keys]
    return (
        hits.withColumn("slot", F.when(_rule() >= PROMPT_BASE, F.lit(-1)).otherwise(_span_no()))
        .groupBy(keys).agg(F.min_by(F.struct(*rest), _span_no()).alias("s")).select("doc_id", "page", "rule", "s.*")
    )


def _limits(spans: DataFrame) -> tuple[Column, Column]:
    """Thresholds carried on the rows (per organisation) or the defaults."""
    white = F.col("near_white_threshold") if "near_white_threshold" in spans.columns else F.lit(V.NEAR_WHITE_THRESHOLD)
    tiny = F.col("hidden_size_threshold") if "hidden_size_threshold" in spans.columns else F.lit(V.HIDDEN_FONT_SIZE_PT)
    return white, tiny


def _offpage_rule(spans: DataFrame, page_dims: DataFrame) -> Rule:
    smallest = page_dims.agg(F.struct(F.min("width").alias("w"), F.min("height").alias("h"))).scalar()
    return offpage(_limits(spans)[1], smallest["w"], smallest["h"])


def row_local_rules(spans: DataFrame) -> list[Rule]:
    """Rules that need nothing but the span (usable on a stream as well)."""
    white, tiny = _limits(spans)
    return [zero_width(), homoglyph(), hidden_text(white), tiny_font(tiny), font_substitution()]


def detect_row_local(spans: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = rules or row_local_rules(spans)
    return as_signals(hits_of(spans, rules), rules)


def detect_zero_width(spans: DataFrame) -> DataFrame:
    return detect_row_local(spans, [zero_width()])


def detect_homoglyphs(spans: DataFrame) -> DataFrame:
    return detect_row_local(spans, [homoglyph()])


def detect_hidden_text(spans: DataFrame) -> DataFrame:
    return detect_row_local(spans, [hidden_text(_limits(spans)[0])])


def detect_tiny_font(spans: DataFrame) -> DataFrame:
    return detect_row_local(spans, [tiny_font(_limits(spans)[1])])


def detect_font_substitution(spans: DataFrame) -> DataFrame:
    return detect_row_local(spans, [font_substitution()])


def detect_offpage(spans: DataFrame, page_dims: DataFrame) -> DataFrame:
    rules = [_offpage_rule(spans, page_dims)]
    return as_signals(_place_on_page(hits_of(spans, rules), page_dims), rules)


def detect_prompt_injection(spans: DataFrame) -> DataFrame:
    rules = prompt_injection()
    return as_signals(_first_per_pattern(hits_of(spans, rules)), rules)


def detect_span_signals(spans: DataFrame, page_dims: DataFrame) -> DataFrame:
    """All span rules in one scan of the span table."""
    rules = row_local_rules(spans) + [_offpage_rule(spans, page_dims)] + prompt_injection()
    return as_signals(_first_per_pattern(_place_on_page(hits_of(spans, rules), page_dims)), rules)
