"""Personal data: base patterns, wide candidate generators and boosted trees that choose among candidates.

The base patterns (email, ip, card, phone) stand as they are. Generators with higher recall propose
spans that may overlap: loosely written addresses and all groups of digits. Boosted trees see a
candidate's format and the words before it. They learn from all candidates, counted by what the trees see of them: those that the
base patterns confirm or that count once they are written plainly (at-signs and dots spelled out, spaces,
brackets; a missing plus only after a word for phones), against the others. A threshold by kind is set on a fifth of the candidates, held out, so that
``PRECISION`` of what passes is right, also among those the base has not found; these are added to it if they pass.

Only DataFrame functions (and Spark's own boosted trees) are used. Places of matches come from the
lengths of the text's pieces between them, in code points.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.storage import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
TREES, DEPTH = 20, 4
# Characters before a candidate that its features see, and of a cell of the text.
_CONTEXT = 24
_CELL = 256

# The base patterns, with loops that do not back up where they cannot gain from it, and
# that begin only at the start of a run of their characters or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without any of these has no span of any kind.
_MAY = r"[0-9@]|[(\[]at[)\]]"
# Generators: addresses with at-signs and dots spelled out or spaced, groups of digits with separators.
GENERATORS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?: ?@ ?| ?[(\[]at[)\]] ?)[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)*+",
    "number": r"[+(]?[0-9]++(?:[ ().-]{1,2}[0-9]++)*+",
}
_WORDS = {"email": "mail|contact|reach", "ip": r"\bip\b|address|host|server", "card": "card|visa|master|amex|credit|pay", "phone": r"\b(?:(?:tele|cell)?phone|call|tel|mobile|cell|fax)\b"}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0)) * (1 + i % 2))
    return F.aggregate(F.transform(values, lambda v: v - F.when(v > 9, 9).otherwise(0)), F.lit(0), lambda a, v: a + v) % 10 == 0


def _small(part: Column) -> Column:
    """Whether a string of digits is at most 255."""
    plain = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))


def valid(kind: str, match: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(digits(match))
    if kind == "ip":
        return F.forall(F.split(match, r"\."), _small)
    if kind == "card":
        return n.between(16, 19) & luhn(digits(match))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def matches(texts: DataFrame, pattern: str) -> DataFrame:
    """doc, start, end, match, before of every match of ``pattern`` in ``texts`` (doc, text)."""
    # Pieces and matches take turns, so their lengths give the places; the piece after the last is left out.
    zipped = F.zip_with(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
        F.split("text", pattern, -1),
        lambda m, p: F.struct(m.alias("match"), F.length(p).alias("gap"), F.right(p, F.lit(_CONTEXT)).alias("before")),
    )
    rows = texts.select("doc", F.posexplode(F.filter(zipped, lambda z: z["match"].isNotNull())).alias("number", "z")).select("doc", "number", "z.*")
    so_far = Window.partitionBy("doc").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far).cast("bigint"))
    return placed.select("doc", (F.col("end") - F.length("match")).cast("bigint").alias("start"), "end", "match", "before")


def base_spans(texts: DataFrame) -> DataFrame:
    """doc, kind, start, end of the base patterns' matches that count."""
    may = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    parts = [
        matches(texts.filter(may.get(k, F.lit(True))), BASE[k]).filter(valid(k, F.col("match"))).select("doc", F.lit(k).alias("kind"), "start", "end")
        for k in KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


def plain_address(match: Column) -> Column:
    """An address with its at-sign and dots as characters, without the spaces around them."""
    at = F.regexp_replace(match, r" ?[(\[]at[)\]] ?| ?@ ?", "@")
    return F.regexp_replace(at, r" ?[(\[]dot[)\]] ?", ".")


def _named(kind: str) -> Column:
    """Whether a word for the kind stands before a candidate."""
    return F.rlike(F.lower("before"), F.lit(_WORDS[kind]))


def sound() -> Column:
    """Whether a candidate (kind, match, before), written plainly, is a match of the base that counts."""
    number = digits(F.col("match"))
    address = F.rlike(plain_address(F.col("match")), F.lit(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$"))
    # Any few digits would be a phone number with a plus, so a word must say that they are one.
    phone = valid("phone", number) & _named("phone")
    return (
        F.when(F.col("kind") == "email", address)
        .when(F.col("kind") == "ip", valid("ip", F.col("match")))
        .when(F.col("kind") == "card", valid("card", number))
        .otherwise(phone)
    )


def _number_kind(match: Column) -> Column:
    """What a group of digits would be: by dots, by count of digits."""
    n = F.length(digits(match))
    dotted = F.rlike(match, F.lit(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")) & valid("ip", match)
    return F.when(dotted, "ip").when(n.between(13, 19), "card").when(n.between(8, 12), "phone")


FEATURES = ("length", "digits", "groups", "longest", "shortest", "dots", "dashes", "spaces", "brackets", "luhn", "octets", "repeats", "labels", "named", "after_letter", "kind_no")


def candidates(texts: DataFrame) -> DataFrame:
    """doc, kind, start, end, features and ``sound`` (see :func:`sound`) of the spans the generators propose."""
    spelled = texts.filter(F.rlike("text", F.lit(r"@|[(\[]at[)\]]")))
    email = matches(spelled, GENERATORS["email"]).withColumn("kind", F.lit("email"))
    number = matches(texts, GENERATORS["number"]).withColumn("kind", _number_kind(F.col("match"))).filter("kind is not null")
    found = email.unionByName(number)
    plain = digits(F.col("match"))
    groups = F.filter(F.split("match", "[^0-9]+"), lambda g: g != "")
    lengths = F.transform(groups, F.length)
    count = lambda characters: F.length(F.regexp_replace("match", f"[^{characters}]", ""))
    features = {
        # Without the plus that only the base pattern wants, or the trees learn nothing but the base.
        "length": F.length(F.ltrim(F.col("match"), F.lit("+"))),
        "digits": F.length(plain),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest": F.coalesce(F.array_min(lengths), F.lit(0)),
        "dots": count("."),
        "dashes": count("-"),
        "spaces": count(" "),
        "brackets": count("()\\[\\]"),
        "luhn": (luhn(plain) & (F.length(plain) >= 13)).cast("int"),
        "octets": (F.size(groups) == 4).cast("int") * F.forall(groups, _small).cast("int"),
        "repeats": F.size(F.array_distinct(F.split(plain, ""))),
        "labels": F.size(F.split(F.substring_index(plain_address(F.col("match")), "@", -1), r"\.")),
        "named": reduce(lambda a, k: F.when((F.col("kind") == k) & _named(k), 1).otherwise(a), KINDS, F.lit(0)),
        "after_letter": F.rlike("before", F.lit(r"[\p{L}_]$")).cast("int"),
        "kind_no": reduce(lambda a, k: F.when(F.col("kind") == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(0)),
    }
    return found.select("doc", "kind", "start", "end", F.coalesce(sound(), F.lit(False)).alias("sound"), *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in features.items()])


def _celled(spans: DataFrame) -> DataFrame:
    """Spans with every cell of the text they touch, so that overlapping ones meet in an equi-join."""
    return spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / _CELL), F.floor((F.col("end") - 1) / _CELL))))


def labelled(proposed: DataFrame, base: DataFrame) -> DataFrame:
    """Candidates with ``label`` and ``free``: free ones overlap no base span, and the label is 1.0 for those that overlap one
    of their kind and for free ones that are sound."""
    places = ["doc", "kind", "start", "end"]
    b = _celled(base.select("doc", F.col("kind").alias("base_kind"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), "start", "end"))
    met = _celled(proposed.select(*places)).join(b.drop("start", "end"), ["doc", "cell"])
    met = met.filter((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    touched = met.groupBy(*places).agg(F.max((F.col("base_kind") == F.col("kind")).cast("int")).alias("same"))
    joined = proposed.join(touched, places, "left")
    return joined.select(*proposed.columns, F.coalesce(F.col("same"), F.col("sound").cast("int")).cast("double").alias("label"), F.col("same").isNull().alias("free"))


def scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return model.transform(vectors).withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(rows: DataFrame, precision: float = PRECISION) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Boosted trees on all candidates, and thresholds by kind.

    Candidates with the same features, label and ``free`` are one weighted row, so that what the trees go over grows with the
    formats and not with the table. Free ones weigh as much in all as the others. A fifth, by the hash of their
    places, is held out for the thresholds. None if there are not both right and wrong candidates. A kind without a
    threshold that reaches ``precision``, among all that pass and among the free ones that do, gets none.
    """
    held_out = F.pmod(F.xxhash64("doc", "kind", "start", "end"), F.lit(5)) == 0
    counted = stage(rows.groupBy("kind", *FEATURES, "label", "free", held_out.alias("held")).agg(F.count(F.lit(1)).alias("n")))
    fitting, held = counted.filter("not held"), counted.filter("held")
    if fitting.select("label").distinct().count() < 2:
        return None
    sizes = {r["free"]: r["n"] for r in fitting.groupBy("free").agg(F.sum("n").alias("n")).collect()}
    whole = sum(sizes.values())
    weight = reduce(lambda a, f: F.when(F.col("free") == f[0], F.col("n") * (whole / len(sizes) / f[1])).otherwise(a), sizes.items(), F.lit(0.0))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(fitting.withColumn("weight", weight))
    # With the square of its bins as many as there are rows, Spark takes the borders of bins from all rows.
    bins = max(32, isqrt(fitting.count()) + 1)
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7, cacheNodeIds=False).fit(vectors)
    # For each kind the scores, of which there are no more than formats, with what passes them.
    free = F.when(F.col("free"), F.col("n"))
    by_score = scored(model, held).groupBy("kind", "p").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right"), F.sum(free).alias("n_free"), F.sum(free * F.col("label")).alias("right_free")
    )
    passes = Window.partitionBy("kind").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = lambda part, of: F.sum(part).over(passes) / F.sum(of).over(passes)
    ranked = by_score.withColumn("share", F.least(share("right", "n"), share("right_free", "n_free"))).filter(F.col("share") >= precision)
    return model, {r["kind"]: r["p"] for r in ranked.groupBy("kind").agg(F.min("p").alias("p")).collect()}


def added_spans(proposed: DataFrame, base: DataFrame, **options) -> DataFrame:
    """doc, kind, start, end of the candidates that pass and overlap no base span."""
    rows = stage(labelled(proposed, base))
    trained = train(rows, **options)
    if trained is None or not trained[1]:
        return rows.select("doc", "kind", "start", "end").limit(0)
    model, thresholds = trained
    passes = reduce(lambda a, k: a | ((F.col("kind") == k[0]) & (F.col("p") >= k[1])), thresholds.items(), F.lit(False))
    return scored(model, rows.filter("free")).filter(passes).select("doc", "kind", "start", "end").distinct()


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """For every row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added).

    Spans are written kind:start:end in code points, by kind as listed, then by start, joined by commas;
    ``base_sha256`` is the digest of the base spans written so. Null texts count as empty and have no
    spans. Rows that repeat an id and text repeat the result; rows without an id are looked at too. Other
    columns are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
    may = F.rlike("text", F.lit(_MAY))
    texts = stage(rows.filter(may).withColumn("doc", F.monotonically_increasing_id()))
    base = stage(base_spans(texts))
    added = added_spans(stage(candidates(texts)), base, **options)
    every = base.withColumn("is_base", F.lit(True)).unionByName(added.withColumn("is_base", F.lit(False)))
    order = reduce(lambda a, k: F.when(F.col("kind") == k[1], k[0]).otherwise(a), enumerate(KINDS), F.lit(0))
    span = F.struct(order.alias("order"), "start", "end", "kind", "is_base")
    lists = every.groupBy("doc").agg(F.array_sort(F.collect_list(span)).alias("list"))
    listed = texts.select("doc", "doc_id").join(lists, "doc", "left").select("doc_id", F.coalesce("list", F.array()).alias("list"))
    nothing = rows.filter(~may).select("doc_id", F.array().cast(listed.schema["list"].dataType).alias("list"))
    base_only = F.filter("list", lambda s: s["is_base"])

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(base_only, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return listed.unionByName(nothing).select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(written(base_only).cast("binary"), 256).alias("base_sha256"), written(F.col("list")).alias("spans")
    )


def redact(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (of :func:`find`) replaced by its kind in brackets. Ids must be unique."""
    spans = found.filter("spans != ''").select(F.col("doc_id").alias(id_column), F.split("spans", ",").alias("_spans"))
    joined = docs.join(spans, id_column, "left")
    parts = F.transform("_spans", lambda s: F.split(s, ":"))
    places = F.array_sort(
        F.transform(parts, lambda p: F.struct(p[1].cast("int").alias("start"), p[2].cast("int").alias("end"), p[0].alias("kind")))
    )
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    folded = F.aggregate(
        places,
        start,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                F.concat(a["done"], F.substring(F.col(text_column), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), s["kind"], F.lit("]")).alias("done"),
                s["end"].alias("at"),
            )
        ),
        lambda a: F.concat(a["done"], F.substring(F.col(text_column), a["at"] + 1, F.length(text_column))),
    )
    return joined.withColumn(text_column, F.when(F.col("_spans").isNull(), F.col(text_column)).otherwise(folded)).select(*docs.columns)
