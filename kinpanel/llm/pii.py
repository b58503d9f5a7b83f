"""Personal data: overlapping candidates of many generators, scored by boosted trees, cut by calibrated thresholds.

Generators are patterns of high recall for four kinds (email, ip, card, phone). Those of the base are fixed; a base span is
a match that passes its kind's check, and stays whatever the model says. The others propose spans inside, beside and across
base matches: numbers run together, written without a plus, with other separators, or addresses spelled out.

Labels come from the base: a candidate inside a base span of its kind is personal; one that fails its kind's check, or lies
inside a base span of another kind only, is not; the rest is unlabelled. Half of the rows (by hash) train gradient boosted
trees on counts of feature patterns, the other half calibrates: a kind's threshold is the least score from which on all
thresholds keep ``PRECISION``. Candidates at or above it are added; overlapping ones of a kind become one span, and those
that overlap a base span of their kind are left out, as it is redacted anyway.

All of it is DataFrame functions and Spark's tree ensembles, without Python workers. Patterns are written so that matching
takes linear time without recursion: possessive where nothing follows, bounded elsewhere. Places of matches come from
texts split at marked matches. Only matches with a little context leave the scan, keyed by row; candidates of one row are
ordered by windows over that row.

Defined cases: a null or empty text has no spans. A null doc_id is kept; every input row gives one row, equal rows equal
ones. Without labelled rows of both classes there is no model and nothing is added. The control characters 1 and 2 count
as other control characters. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinpanel.session import checkpointed

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_AT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20at\x20|\x20@\x20)"
_DOT = r"(?:\.(?=[A-Za-z])|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20dot\x20)"
#: (kind, base, pattern); the first four are the base. A local part starts where no other could reach further left.
GENERATORS: list[tuple[int, bool, str]] = [
    (EMAIL, True, rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    (IP, True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (CARD, True, r"[0-9](?:[\x20-]?[0-9])++"),
    (PHONE, True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    (EMAIL, False, rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}{_AT}{_LABEL}{{1,63}}(?:{_DOT}{_LABEL}{{1,63}}){{1,6}}"),
    (IP, False, rf"(?<![0-9]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])"),
    (IP, False, rf"(?<![0-9.]){_OCTET}(?:\x20?[\[({{]\x20?\.\x20?[\])}}]\x20?{_OCTET}){{3}}(?![0-9])"),
    (IP, False, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    (CARD, False, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    (CARD, False, r"(?<![0-9])[0-9]{4}([\x20._-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?![0-9])"),
    (CARD, False, r"(?<![0-9])3[0-9]{3}[\x20._-]?[0-9]{6}[\x20._-]?[0-9]{5}(?![0-9])"),
    (PHONE, False, r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}(?![0-9])"),
    (PHONE, False, r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]{2,4}(?:[\x20.-]?[0-9]{2,4}){1,3}?(?![0-9])"),
    (PHONE, False, r"(?<![0-9])(?:\([0-9]{2,5}\)[\x20./-]?|[0-9]{3}[\x20./-])[0-9]{3}[\x20./-]?[0-9]{4}(?![0-9])"),
    (PHONE, False, r"(?<![0-9])00[1-9][0-9]{0,2}(?:[\x20./-]?[0-9]{2,4}){2,4}(?![0-9])"),
]
#: characters on either side of a match that features look at
CONTEXT = 24
#: share of labelled candidates at or above a threshold that must be personal
PRECISION = 0.95
#: boosted trees
TREES, DEPTH = 20, 4
#: words before a span that tell its kind, in the order of KINDS
CUES = [r"(?i)mail|contact|write", r"(?i)\bip\b|host|server|addr", r"(?i)card|visa|credit|pay", r"(?i)phone|tel|call|fax|mobil|dial"]


def _found(text: Column, pattern: str) -> Column:
    """Pieces of the text, each a match (but for the first) with what follows up to the next: match, rest, after, tail."""
    def piece(p: Column) -> Column:
        match = F.substring_index(p, "\x02", 1)
        rest = F.when(F.instr(p, "\x02") > 0, F.substring(p, F.length(match) + 2, F.length(p))).otherwise(p)
        return F.struct(F.when(F.instr(p, "\x02") > 0, match).otherwise(F.lit("")).alias("match"), F.length(rest).alias("rest"),
                        F.substring(rest, F.lit(1), F.lit(CONTEXT)).alias("after"), F.right(rest, F.lit(CONTEXT)).alias("tail"))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("\x01$0\x02"))
    return F.when(text.rlike(pattern), F.transform(F.split(marked, "\x01", -1), piece))


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and their matches: row, generator, start, end (code points), match, before, after."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", "\x03\x03")
    each = F.array(*[F.struct(F.lit(i).alias("generator"), _found(F.col("__text"), p).alias("pieces"))
                     for i, (_, _, p) in enumerate(GENERATORS)])
    some = F.col("__text").rlike(r"[0-9]|@|[\[({<\x20](?:at|AT)[\])}>\x20]")
    rows = docs.select("doc_id", text.alias("__text")).select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(
        some, F.filter(each, lambda g: g["pieces"].isNotNull())).alias("found"))
    rows = checkpointed(rows)
    pieces = rows.select("row", F.explode("found").alias("g")).select(
        "row", F.col("g.generator").alias("generator"), F.posexplode("g.pieces").alias("at", "p"))
    pieces = pieces.select("row", "generator", "at", F.col("p.match").alias("match"), F.col("p.rest").alias("rest"),
                           F.col("p.after").alias("after"), F.col("p.tail").alias("tail")).repartition("row")
    order = Window.partitionBy("row", "generator").orderBy("at")
    start = F.sum(F.length("match") + F.col("rest")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumns({"start": start, "before": F.lag("tail").over(order)}).filter("at > 0")
    return rows.select("row", "doc_id"), placed.select(
        "row", "generator", "start", (F.col("start") + F.length("match")).alias("end"), "match", "before", "after")


def _luhn(digits: Column) -> Column:
    """Does a string of at most 19 digits pass the check sum? Longer ones do not."""
    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, at, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - at) % 2 == 1, twice).otherwise(digit)
    checked = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0
    return F.when(F.length(digits).between(1, 19), checked).otherwise(F.lit(False))


def _octets(match: Column) -> Column:
    """Are there four numbers of at most 255?"""
    parts = F.split(F.regexp_replace(match, F.lit(r"[^0-9.]"), F.lit("")), r"\.")
    small = F.forall(parts, lambda p: F.regexp_replace(p, F.lit("^0+(?=[0-9])"), F.lit("")).rlike(f"^{_OCTET}$"))
    return (F.size(parts) == 4) & small


def _side(char: Column) -> Column:
    """Class of the character beside a span: none or space, mark, letter, digit, quote or bracket."""
    return (F.when(F.coalesce(char, F.lit("")).rlike(r"^\s?$"), 0).when(char.rlike(r"\p{L}|_"), 2).when(char.rlike("[0-9]"), 3)
            .when(char.rlike(r"[\"'()\[\]{}<>=]"), 4).otherwise(1))


FEATURES = ["kind", "size", "digits", "groups", "marks", "plus", "bracket", "luhn", "octets", "first", "left", "right", "cue", "number_near",
            "last_label"]


def candidates(found: DataFrame) -> DataFrame:
    """Adds the kind, whether the span is one of the base, whether it passes its kind's check, and the features."""
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in GENERATORS]), F.col("generator") + 1)
    of_base = F.element_at(F.array(*[F.lit(b) for _, b, _ in GENERATORS]), F.col("generator") + 1)
    match = F.col("match")
    found = found.withColumns({"kind": kind, "number": F.regexp_replace(match, F.lit("[^0-9]"), F.lit("")), "before": F.coalesce("before", F.lit(""))})
    found = found.withColumns({
        "size": F.least(F.length(match), F.lit(48)), "digits": F.least(F.length("number"), F.lit(24)),
        "groups": F.least(F.regexp_count(match, F.lit("[0-9]++")), F.lit(8)),
        "marks": F.least(F.regexp_count(match, F.lit(r"[^0-9A-Za-z]")), F.lit(12)),
        "plus": match.startswith("+").cast("int"), "bracket": match.rlike(r"[()\[\]{}<>]").cast("int"),
        "luhn": F.when(F.col("kind") == CARD, _luhn(F.col("number"))).otherwise(F.lit(False)).cast("int"),
        "octets": F.when(F.col("kind") == IP, _octets(match)).otherwise(F.lit(False)).cast("int"),
        "first": F.coalesce(F.substring("number", 1, 1).try_cast("int"), F.lit(-1)),
        "left": _side(F.right("before", F.lit(1))), "right": _side(F.substring("after", 1, 1)),
        "number_near": F.least(F.regexp_count(F.concat("before", F.lit(" "), "after"), F.lit("[0-9]")), F.lit(10)),
        "last_label": F.when(F.col("kind") == EMAIL, F.least(F.length(F.regexp_extract(match, r"([A-Za-z]*)$", 1)), F.lit(12))).otherwise(F.lit(-1))})
    cue = F.lit(False)
    for k, words in enumerate(CUES):
        cue = cue | ((F.col("kind") == k) & F.col("before").rlike(words))
    passes = (F.when(F.col("kind") == EMAIL, F.lit(True)).when(F.col("kind") == IP, (F.col("octets") == 1) | match.contains(":"))
              .when(F.col("kind") == CARD, F.col("digits").between(13, 19) & (F.col("luhn") == 1)).otherwise(F.col("digits").between(9, 15)))
    return found.withColumns({"cue": cue.cast("int"), "passes": passes}).withColumn("base", of_base & F.col("passes")).drop(
        "number", "before", "after", "match")


def labelled(spans: DataFrame) -> DataFrame:
    """Adds ``label``: 1 inside a base span of the kind, 0 if the check fails or inside one of another kind, else null."""
    ends = F.max(F.when(F.col("base"), F.col("end")))
    own = ends.over(Window.partitionBy("row", "kind").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    any_kind = ends.over(Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    label = F.when(F.coalesce(own >= F.col("end"), F.lit(False)), 1).when(
        ~F.col("passes") | F.coalesce(any_kind >= F.col("end"), F.lit(False)), 0)
    return spans.withColumn("label", label)


@dataclass
class Detector:
    """Trees over FEATURES and the least score of each kind that is added (none: nothing is)."""
    trees: GBTClassificationModel | None
    least: dict[int, float]


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def _scored(df: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    scored = trees.transform(_assembled(df))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(spans: DataFrame, precision: float = PRECISION, trees: int = TREES, depth: int = DEPTH) -> Detector:
    """Boosted trees on the feature patterns of half of the rows; thresholds from the other half.

    Patterns have bounded numbers as features, so their table does not grow with the rows beyond their combinations.
    """
    half = (F.xxhash64("row") % 2 == 0).cast("int")
    patterns = checkpointed(spans.filter("label IS NOT NULL").groupBy(half.alias("half"), "label", *FEATURES).agg(
        F.count("*").cast("double").alias("weight")))
    seen = {(r["half"], r["label"]) for r in patterns.select("half", "label").distinct().collect()}
    if not {(0, 0), (0, 1)} <= seen:
        return Detector(None, {})
    fit = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, weightCol="weight", featuresCol="features", labelCol="label")
    model = fit.fit(_assembled(patterns.filter("half = 0")))
    # counts per kind and score: as many rows as there are different scores
    kept = _scored(patterns.filter("half = 1"), model).groupBy("kind", "score").agg(
        F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("hits"))
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("share", F.sum("hits").over(above) / F.sum("n").over(above))
    kept = kept.withColumn("holds", F.min("share").over(above) >= precision).filter("holds").groupBy("kind").agg(F.min("score").alias("least"))
    return Detector(model, {r["kind"]: r["least"] for r in kept.collect()})


def added(spans: DataFrame, detector: Detector) -> DataFrame:
    """row, kind, start, end of the spans that the method adds to the base."""
    chosen = spans.filter("NOT base AND (label IS NULL OR label = 1)")
    if detector.trees is None or not detector.least:
        return spans.filter(F.lit(False)).select("row", "kind", "start", "end")
    least = F.create_map(*[F.lit(x) for pair in detector.least.items() for x in pair])
    chosen = _scored(chosen, detector.trees).filter(F.col("score") >= F.coalesce(F.try_element_at(least, F.col("kind")), F.lit(2.0)))
    both = chosen.select("row", "kind", "start", "end", F.lit(0).alias("is_base")).unionByName(
        spans.filter("base").select("row", "kind", "start", "end", F.lit(1).alias("is_base")))
    order = Window.partitionBy("row", "kind").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    both = both.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = both.groupBy("row", "kind", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("is_base").alias("is_base"))
    return merged.filter("is_base = 0").select("row", "kind", "start", "end")


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, **options: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all of them), n_added.

    ``docs`` has doc_id and text. Spans are kind:start:end in code points, end exclusive, by kind, then start.
    """
    rows, found = matches(docs)
    spans = checkpointed(labelled(candidates(found)))
    extra = added(spans, train(spans, **options))
    base = spans.filter("base").select("row", "kind", "start", "end")
    marked = base.withColumn("more", F.lit(False)).unionByName(extra.withColumn("more", F.lit(True)))
    span = F.struct("kind", "start", "end")
    per_row = marked.groupBy("row").agg(
        *[F.sum((~F.col("more") & (F.col("kind") == k)).cast("long")).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.collect_list(F.when(~F.col("more"), span)).alias("base"), F.collect_list(span).alias("spans"),
        F.sum(F.col("more").cast("long")).alias("n_added"))
    none = F.lit([]).cast("array<struct<kind:int,start:bigint,end:bigint>>")
    out = rows.join(per_row, "row", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in KINDS],
                      F.sha2(_told(F.coalesce("base", none)).cast("binary"), 256).alias("base_sha256"),
                      _told(F.coalesce("spans", none)).alias("spans"), F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))
