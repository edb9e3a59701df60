"""Personal data by weak supervision, with DataFrame operations only.

Four base patterns (email, ip, card, phone) mark what is personal beyond doubt. Further spans are candidates: addresses
spelt out, account numbers, groups of digits, titled or given names, street addresses. Six labellers vote on every
candidate, for, against or not at all: its shape, its check digits, gazetteers, cue words before it, the characters around
it, and other personal data in the document. Expectation-maximisation over the vote patterns, of which there are at most
3^6, estimates how reliable each labeller is; the posteriors are soft labels from which a naive Bayes classifier of shape
and surrounding words is trained, one sum per feature bucket. A candidate is a span where the classifier says so. Base
matches take part in the estimate, so that there are clear cases to learn from, and stay whatever it says.

A text is searched where it lies. Only matches, the lengths of the gaps and a few characters around candidates are
written, and positions are running sums of these lengths. All patterns take time linear in the text: runs are entered at
their start and never given back. Sums of posteriors are sums of whole millionths, so that results do not depend on
the order of rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

BASE = ("email", "ip", "card", "phone")
ADDED = ("address", "handle", "iban", "number", "person")

# What the base patterns match is given; run starts and possessive quantifiers only save time.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split()
GIVEN = ("Anna Anne Antonio Carlos Charles Christine David Elena Elizabeth Francisco Hans James Jean Jennifer John José Juan Julia "
         "Karl Klaus Laura Linda Luis Manuel Maria María Marie Mary Michael Michel Paul Peter Philippe Pierre Richard Robert "
         "Sarah Sophie Stefan Susan Thomas Ursula William Wolfgang").split()
STREETS = "Street St Avenue Ave Road Rd Lane Drive Boulevard Square".split()
SUFFIXES = "com org net edu gov info io de fr es uk eu".split()
CUES = ("account birth bill call card cell contact correo credit email fax iban kontakt mail mobile mobil name paid patient phone "
        "reach ssn tarjeta tel telefon telefono teléfono téléphone telephone whatsapp").split()
AGAINST = "build chapter copyright edition equation figure isbn issn issue line order page part patent revision section serial table version vol volume year".split()

_TEXTUAL_AT = r"\x20?(?:\(at\)|\[at\]|\{at\})\x20?"
_TEXTUAL_DOT = r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?"
_NAME = r"\p{Lu}\p{Ll}{1,30}"
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SHAPES = {
    "email": PATTERNS["email"],
    "handle": rf"(?<![{_LOCAL}])[{_LOCAL}]++{_TEXTUAL_AT}[A-Za-z0-9-]++(?:{_TEXTUAL_DOT}[A-Za-z0-9-]++)++",
    "phone": PATTERNS["phone"],
    "ip": PATTERNS["ip"],
    "iban": rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?{_END}",
    "address": rf"{_EDGE}[0-9]{{1,5}}\x20{_NAME}\x20(?:{'|'.join(STREETS)}){_END}|{_EDGE}{_NAME}(?:straße|strasse|weg|platz)\x20[0-9]{{1,4}}{_END}",
    "number": rf"(?<![\p{{L}}\p{{N}}_.])(?:[0-9]{{13,19}}|[0-9]{{4}}(?:[\x20-][0-9]{{4}}){{2}}[\x20-][0-9]{{1,7}}|\(?[0-9]{{2,5}}\)?(?:[\x20./-][0-9]{{2,5}}){{1,4}}|[0-9]{{7,12}}){_END}",
    "person": rf"{_EDGE}(?:(?:{'|'.join(TITLES)})\.?\x20{_NAME}(?:\x20{_NAME})?|(?:{'|'.join(GIVEN)})\x20{_NAME}){_END}",
}
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
#: Code points kept on each side of a candidate.
AROUND = 40
#: Buckets that the features are hashed to, and rounds of the estimate.
BUCKETS, ROUNDS = 1024, 50
LABELLERS = ("shape", "check", "gazetteer", "cue", "setting", "company")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(steps: Column) -> Column:
    """Running sums of an array of numbers, by blocks of about the root of its size."""
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, b: a + b)

    def summed(s: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(s))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(s) - 1) / width).cast("int")), lambda j: F.slice(s, j * width + 1, width))
        return _bound(blocks, lambda b: _bound(F.transform(b, total), lambda t: F.flatten(F.transform(b, lambda part, j: _bound(
            total(F.slice(t, F.lit(1), j)), lambda before: F.transform(part, lambda _, i: before + total(F.slice(part, F.lit(1), i + 1))))))))

    return F.when(F.size(steps) > 0, _bound(steps, summed)).otherwise(F.array().cast("array<bigint>"))


def _searched(docs: DataFrame) -> DataFrame:
    """Matches of each base kind and of the candidates, with the lengths of the gaps and what stands around candidates."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), *(F.regexp_extract_all(text, F.lit(p), 0).alias(f"m_{k}") for k, p in (PATTERNS | {"any": ANY}).items()))
    gaps = [F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(F.array().cast("array<string>")).alias(f"g_{k}") for k, p in (PATTERNS | {"any": ANY}).items()]
    cut = found.select("doc_id", *(f"m_{k}" for k in (*BASE, "any")), *gaps)
    lengths = [F.transform(f"g_{k}", F.length).alias(f"g_{k}") for k in (*BASE, "any")]
    sides = [F.transform("g_any", lambda g: F.right(g, F.lit(AROUND))).alias("before"), F.transform("g_any", lambda g: F.left(g, F.lit(AROUND))).alias("after")]
    return cut.select("doc_id", *(f"m_{k}" for k in (*BASE, "any")), *lengths, *sides)


def _starts(kind: str) -> Column:
    """Start of each match: gaps up to it and matches before it."""
    matches, gaps = F.col(f"m_{kind}"), F.col(f"g_{kind}")
    before = F.concat(F.array(F.lit(0)), F.transform(F.slice(matches, F.lit(1), F.greatest(F.size(matches) - 1, F.lit(0))), F.length))
    steps = F.when(F.size(matches) > 0, F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), before, lambda g, m: g + m)).otherwise(F.array().cast("array<int>"))
    return _running(steps)


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.length(digits).between(14, 19), digits)), F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _span(kind: Column, rank: Column, start: Column, match: Column) -> Column:
    return F.struct(start.alias("start"), rank.alias("rank"), (start + F.length(match)).alias("end"), kind.alias("kind"))


def _base_spans(kind: str) -> Column:
    spans = F.zip_with(f"m_{kind}", f"s_{kind}", lambda m, s: F.struct(_span(F.lit(kind), F.lit(BASE.index(kind)), s, m).alias("span"), m.alias("match")))
    return F.transform(F.filter(spans, lambda x: _valid(kind, x["match"])), lambda x: x["span"])


def _kind(match: Column) -> Column:
    """Kind of a candidate by the first shape that it has as a whole; look-around has been tested by the search."""
    bare = lambda p: p.replace(_EDGE, "").replace(_END, "").replace(rf"(?:(?<![{_LOCAL}])|\G)", "").replace(rf"(?<![{_LOCAL}])", "")
    out = F.lit("number")
    for kind in reversed([k for k in SHAPES if k != "number"]):
        out = F.when(match.rlike(f"^(?:{bare(SHAPES[kind])})$"), kind).otherwise(out)
    return F.when(match.rlike("^[0-9][0-9 -]+$") & _valid("card", match), "card").otherwise(out)


def _vote(*cases: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, vote in reversed(cases):
        out = F.when(condition, vote).otherwise(out)
    return out


def _votes(c: Column, company: Column) -> dict[str, Column]:
    """The labellers' votes on a candidate ``c`` (kind, match, before, after): 1 for, -1 against, 0 none."""
    kind, match, before, after = c["kind"], c["match"], F.lower(c["before"]), c["after"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    word = lambda words: rf"(?:^|[^\p{{L}}])(?:{'|'.join(words)})[\p{{P}}\s]{{0,4}}(?:\p{{L}}{{1,12}}[\p{{P}}\s]{{1,3}}){{0,2}}$"
    dated = match.rlike(r"^(?:[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}|[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}[/-](?:19|20)[0-9]{2})$")
    return {
        "shape": _vote((kind.isin("email", "ip", "phone", "card", "handle"), 1), (kind == "number", _vote(
            (dated, -1), (match.rlike(r"^[0-9]{13,19}$|^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]"), 1), (match.rlike("^[0-9]+$"), 0),
            (F.length(digits).between(9, 15), 1), (F.length(digits) < 7, -1))), ),
        "check": _vote((match.rlike(r"([0-9])\1{6}") | F.instr(F.lit("012345678901234567890"), digits).between(1, 20) & (F.length(digits) > 0), -1),
                       (kind.isin("ip"), _vote((_valid("ip", match), 1)) * 2 - 1), (kind.isin("card"), 1),
                       ((kind == "number") & F.coalesce(F.call_function("luhn_check", F.when(F.length(digits).between(13, 19), digits)), F.lit(False)), 1)),
        "gazetteer": _vote((kind.isin("email", "handle"), _vote((F.lower(match).rlike(rf"[.)\]}} ](?:{'|'.join(SUFFIXES)})$"), 1))),
                           (kind == "person", _vote((match.rlike(rf"(?:{'|'.join(GIVEN)})(?!\p{{L}})"), 1))), (kind == "address", 1),
                           (kind.isin("card", "number") & (F.length(digits) >= 13), _vote((digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), 1)))),
        "cue": _vote((before.rlike(word(AGAINST)), -1), (before.rlike(word(CUES)), 1)),
        "setting": _vote((before.rlike("[\"'=#$€£/\\\\_%&]$") | after.rlike("^(?:[\"'=%€$£/\\\\_&]|\\.[0-9])"), -1), (before.rlike(r"(?:^|[\s:,;(])$") & after.rlike(r"^(?:$|[\s.,;:)!?])"), 1)),
        "company": _vote((company, 1)),
    }


def _features(c: Column) -> list[Column]:
    """Buckets of a candidate's features: its shape and the words around it, none of the votes."""
    match, kind = c["match"], c["kind"]
    outline = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, r"\p{Lu}", "A"), r"\p{Ll}+", "a"), "[0-9]", "9")
    values = {
        "kind": kind, "size": F.length(match).cast("string"), "outline": outline, "digits": F.length(F.regexp_replace(match, "[^0-9]", "")).cast("string"),
        "left": F.right(c["before"], F.lit(1)), "right": F.left(c["after"], F.lit(1)),
        "word": F.lower(F.regexp_extract(c["before"], r"([\p{L}]{1,20})[^\p{L}]*$", 1)), "next": F.lower(F.regexp_extract(c["after"], r"^[^\p{L}]*([\p{L}]{1,20})", 1)),
    }
    return [F.pmod(F.xxhash64(F.lit(name), kind, value), F.lit(BUCKETS)).cast("int") for name, value in values.items()]


def estimate(patterns: dict[tuple[int, ...], int]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern, from how often it occurs: expectation-maximisation with one reliability per labeller and vote."""
    posterior = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p in sorted(patterns)}
    for _ in range(ROUNDS):
        mass = [0.0, 0.0]
        told = [[{v: 1.0 for v in (-1, 0, 1)} for _ in LABELLERS] for _ in (0, 1)]
        for p, n in sorted(patterns.items()):
            for truth in (0, 1):
                share = n * (posterior[p] if truth else 1 - posterior[p])
                mass[truth] += share
                for i, vote in enumerate(p):
                    told[truth][i][vote] += share
        for p in posterior:
            odds = math.log((mass[1] + 1) / (mass[0] + 1))
            odds += sum(math.log(told[1][i][v] / (mass[1] + 3)) - math.log(told[0][i][v] / (mass[0] + 3)) for i, v in enumerate(p))
            posterior[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return posterior


def _weights(spans: DataFrame, posterior: dict[tuple[int, ...], float]) -> tuple[float, list[float]]:
    """Log-odds of the classes and of each feature bucket, from sums of posteriors in whole millionths."""
    if not posterior:
        return 0.0, [0.0] * BUCKETS
    soft = F.create_map(*(F.lit(x) for p, q in posterior.items() for x in (",".join(map(str, p)), round(q * 1_000_000))))
    counted = spans.withColumn("good", soft[F.col("pattern")].cast("long")).select("good", F.explode("features").alias("bucket"))
    rows = counted.groupBy("bucket").agg(F.sum("good").alias("good"), F.count("*").alias("n")).collect()
    good, bad = [1_000_000] * BUCKETS, [1_000_000] * BUCKETS
    for row in rows:
        good[row.bucket] += row.good
        bad[row.bucket] += 1_000_000 * row.n - row.good
    # every span has the same number of features, so the sums over all buckets stand for the classes
    prior = math.log(sum(good) / sum(bad))
    return prior, [math.log(g / sum(good)) - math.log(b / sum(bad)) for g, b in zip(good, bad)]


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, ``base`` and ``added``, arrays of spans
    (start, rank, end, kind) in code points, end exclusive, in the order of start and rank.

    A null text is empty. Repeated rows and ids stand for themselves. An empty table gives no rows. The classifier is
    fitted to the candidates of the table itself; without any candidate nothing is added.
    """
    found = materialise(_searched(docs), "matches")
    placed = found.select("*", *(_starts(k).alias(f"s_{k}") for k in (*BASE, "any")))
    base = F.array_sort(F.concat(*(_base_spans(k) for k in BASE)))
    several = F.size(F.col("m_email")) + F.size(F.col("m_ip")) + F.size(F.col("m_phone")) > F.when(F.size("m_any") > 1, 0).otherwise(1)
    raw = F.zip_with(F.arrays_zip("m_any", "s_any"), F.arrays_zip("before", F.slice("after", F.lit(2), F.greatest(F.size("after") - 1, F.lit(0))).alias("after")),
                     lambda m, around: F.struct(m["m_any"].alias("match"), m["s_any"].alias("start"), around["before"].alias("before"), F.coalesce(around["after"], F.lit("")).alias("after")))
    candidates = F.transform(F.filter(raw, lambda x: x["match"].isNotNull()), lambda x: x.withField("kind", _kind(x["match"])))
    judged = placed.select("doc_id", base.alias("base"), candidates.alias("candidates"), several.alias("several"))
    described = F.transform("candidates", lambda c: F.struct(
        _span(c["kind"], F.lit(len(BASE)), c["start"], c["match"]).alias("span"),
        F.concat_ws(",", *(v.cast("string") for v in _votes(c, F.col("several")).values())).alias("pattern"),
        F.array(*_features(c)).alias("features")))
    ready = materialise(judged.select("doc_id", "base", described.alias("candidates")), "candidates")
    spans = ready.select(F.inline("candidates"))
    patterns = {tuple(map(int, r.pattern.split(","))): r.n for r in spans.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    prior, weights = _weights(spans, estimate(patterns))
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    odds = lambda c: F.aggregate(c["features"], F.lit(prior), lambda a, b: a + F.get(table, b))
    chosen = F.filter("candidates", lambda c: ~c["span"]["kind"].isin(*BASE) & (odds(c) >= 0.0))
    ranked = F.transform(chosen, lambda c: c["span"].withField("rank", F.array_position(F.array(*(F.lit(k) for k in ADDED)), c["span"]["kind"]).cast("int") + len(BASE) - 1))
    return ready.select("doc_id", "base", F.array_sort(ranked).alias("added"))


def spelt(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
