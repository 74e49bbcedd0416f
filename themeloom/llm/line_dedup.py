"""Near-duplicate lines by an exact set-similarity join (Jaccard over the words of a line).

Texts are cut into words once, and stored as a digest and hashes of the words of every line. Lines equal
after normalisation fold first, on digests. The words of the others are ordered by rarity, counted over all
lines, and two lines of Jaccard ``threshold`` or more share a word in the prefixes of that order. Postings
of prefix words are joined with length, positional and signature filters, and candidates are verified on
their words.

A line goes if an earlier line (by document id, then place) matches it. In a long posting list a match with
its first line settles a line. Postings are then joined with themselves, short lists whole, at most a fixed
number of comparisons per posting, and long ones for the lines not settled so. A large family of near-copies
costs one comparison per member, list and round, not one per pair.

Only DataFrame functions are used. Words are compared as 32-bit hashes until they are verified, one for each
different word of a line. Words that share a hash can only bring lines nearer, so no match is missed, and a
false one does not pass the verification.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import broadcast_if_small, stage

THRESHOLD = 0.8
# Counts of words are kept in this many slots of their hash; the order only decides speed.
SLOTS = 1 << 18
# Posting lists up to this length are joined with themselves.
SHORT = 64
# One number of 64 bits tells little about lines of more words than this; their signature has WIDE numbers.
NARROW = 80
WIDE = 4


def lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, line_no (from 0), part (as it stands) of every line with a word.

    The outer explode and a test of the line as it stands keep Spark from working each line out twice,
    once for a filter.
    """
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"), docs[text_column].alias("text")).filter("doc_id is not null")
    placed = rows.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "part"))
    return placed.filter(F.rlike("part", F.lit("[^ \\t-\\r]")))


def words_of(line: Column) -> Column:
    """The words of a line in lower case, between white space."""
    lower = F.lower(line)
    # A pattern of one space is much faster, and most lines have no other white space.
    return F.array_remove(F.when(F.rlike(line, F.lit("[\\t-\\r]")), F.split(lower, "[ \\t-\\r]+")).otherwise(F.split(lower, " ")), "")


def level(n: Column) -> Column:
    """A count as a logarithm of 7 bits."""
    return F.floor(F.log2(n.cast("double")) * 3).cast("bigint")


def hashed_lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, line_no, digest (of the words with one space between) and hashes (one for each different word)."""
    worded = lines(docs, id_column, text_column).select("doc_id", "line_no", words_of(F.col("part")).alias("words"))
    digest = F.unhex(F.md5(F.array_join("words", " ").cast("binary")))
    return worded.select("doc_id", "line_no", digest.alias("digest"), F.transform(F.array_distinct("words"), lambda w: F.hash(w)).alias("hashes"))


def rarity(hashed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row: an array that has for each slot of word hashes the :func:`level` of the count of its words,
    above 32 clear bits. ``slots`` is a power of two."""
    words = hashed.select(F.explode("hashes").alias("h"))
    counted = words.groupBy(F.col("h").bitwiseAND(F.lit(slots - 1)).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    every = hashed.sparkSession.range(slots).join(counted, "id", "left")
    high = F.shiftleft(level(F.coalesce("n", F.lit(1))), 32).alias("level")
    # Bounded: one entry per slot.
    ordered = every.agg(F.sort_array(F.collect_list(F.struct(F.col("id"), high))).alias("levels"))
    return ordered.select(F.transform("levels", lambda s: s["level"]).alias("levels"))


def word_keys(hashes: str | Column, levels: Column, slots: int) -> Column:
    """The words of a line as keys, rarest first: level of rarity above 32 bits of hash."""
    low = F.lit((1 << 32) - 1).cast("bigint")
    key = lambda h: F.get(levels, h.bitwiseAND(F.lit(slots - 1))).bitwiseOR(h.cast("bigint").bitwiseAND(low))
    # Numbers that Spark knows not to be null are sorted much faster.
    return F.sort_array(F.transform(hashes, lambda h: F.coalesce(key(h), F.lit(0).cast("bigint"))))


def _signature(hashes: str | Column, part: int | None = None) -> Column:
    """64 bits, of which each word of a line (or of one of WIDE parts of its words) turns one over: lines
    differ in at most as many bits as words."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)))
    if part is None:
        turned = bit
    else:
        turned = lambda h: F.when(h.bitwiseAND(F.lit(64 * (WIDE - 1))) == 64 * part, bit(h)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(turned(h)))


def _xor(columns: list[Column]) -> Column:
    return reduce(Column.bitwiseXOR, columns)


def _overlap(size_a: Column, size_b: Column, threshold: float) -> Column:
    """The fewest common words of two sets of these sizes that reach the threshold."""
    # Rounding errors of the product must not raise the bound.
    return F.ceil((size_a + size_b) * F.lit(threshold / (1 + threshold)) - 1e-9)


# The last number of a wide signature is left out: all of them make up ``bits``.
_WIDE = [f"w{i}" for i in range(WIDE - 1)]
_POSTING = ("doc_id", "line_no", "size", "place", "bits", *_WIDE)


def postings(kept: DataFrame, levels: DataFrame, threshold: float, slots: int = SLOTS) -> DataFrame:
    """key, doc_id, line_no, size, place, bits (signature) of every prefix word of the hashed lines ``kept``,
    and w0, w1 and so on (signatures of parts of the words) for lines of more than NARROW words.

    The outer explode keeps Spark from working the keys out again for a filter.
    """
    size = F.size("hashes")
    wide = [F.when(size > NARROW, _signature("hashes", i)).alias(f"w{i}") for i in range(WIDE)]
    keyed = kept.withColumn("_levels", levels.scalar())
    keys = keyed.select("doc_id", "line_no", "hashes", word_keys("hashes", F.col("_levels"), slots).alias("keys"), *wide)
    prefix = (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int")
    bits = F.coalesce(_xor([F.col(f"w{i}") for i in range(WIDE)]), _signature("hashes"))
    cut = keys.select("doc_id", "line_no", size.alias("size"), bits.alias("bits"), *_WIDE, F.slice("keys", F.lit(1), prefix).alias("keys"))
    return cut.select("doc_id", "line_no", "size", "bits", *_WIDE, F.posexplode_outer("keys").alias("place", "key"))


def _may_match(threshold: float, a: str, b: str) -> Column:
    """Length, positional and signature filters for lines ``a`` and ``b`` that share a prefix word."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(size_a - F.col(f"{a}.place"), size_b - F.col(f"{b}.place"))
    longer, shorter = F.greatest(size_a, size_b), F.least(size_a, size_b)
    overlap = _overlap(size_a, size_b, threshold)
    turned, *parts = [F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("bits", *_WIDE)]
    apart = F.bit_count(turned)
    # Null if one of the lines has no wide signature.
    wide_apart = sum((F.bit_count(x) for x in parts), F.bit_count(_xor([turned, *parts])))
    most = size_a + size_b - overlap * 2
    near = (apart <= most) & (F.coalesce(wide_apart, apart) <= most)
    return (shorter >= longer * F.lit(threshold) - 1e-9) & (rest >= overlap) & near


def _earlier(a: str, b: str) -> Column:
    """Whether line ``a`` comes before line ``b``."""
    doc_a, doc_b = F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")
    return (doc_a < doc_b) | ((doc_a == doc_b) & (F.col(f"{a}.line_no") < F.col(f"{b}.line_no")))


def verified(pairs: DataFrame, docs: DataFrame, id_column: str, text_column: str, threshold: float) -> DataFrame:
    """The pairs (a_doc, a_line, b_doc, b_line) whose words reach the threshold, with ``jaccard``. ``pairs`` is stored and has each once."""
    ends = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_line").alias("line_no")).union(pairs.select("b_doc", "b_line"))
    ends = stage(ends.distinct())
    # Documents without such a line are passed over before their lines are worked out.
    touched = broadcast_if_small(ends.select(F.col("doc_id").alias("_id")).distinct())
    held = docs.join(touched, docs[id_column].cast("bigint") == touched["_id"], "left_semi")
    needed = lines(held, id_column, text_column).join(broadcast_if_small(ends), ["doc_id", "line_no"])
    words = stage(needed.select("doc_id", "line_no", F.array_distinct(words_of(F.col("part"))).alias("words")))
    first = words.select(F.col("doc_id").alias("a_doc"), F.col("line_no").alias("a_line"), F.col("words").alias("a_words"))
    second = words.select(F.col("doc_id").alias("b_doc"), F.col("line_no").alias("b_line"), F.col("words").alias("b_words"))
    both = pairs.join(first, ["a_doc", "a_line"]).join(second, ["b_doc", "b_line"])
    common = F.size(F.array_intersect("a_words", "b_words"))
    jaccard = common / (F.size("a_words") + F.size("b_words") - common)
    return both.select("a_doc", "a_line", "b_doc", "b_line", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-12)


def _first_match(pairs: DataFrame) -> DataFrame:
    """For every later line of verified pairs the earliest of its matches."""
    best = F.min(F.struct("a_doc", "a_line", "jaccard")).alias("m")
    return pairs.groupBy("b_doc", "b_line").agg(best).select(
        F.col("b_doc").alias("doc_id"), F.col("b_line").alias("line_no"),
        F.col("m.a_doc").alias("keep_doc_id"), F.col("m.a_line").alias("keep_line_no"), F.col("m.jaccard").alias("jaccard"),
    )


def repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    slots: int = SLOTS,
    short: int = SHORT,
) -> DataFrame:
    """The lines to remove: doc_id, line_no, keep_doc_id, keep_line_no (an earlier line it matches), jaccard.

    A line goes if the words of an earlier line have Jaccard ``threshold`` or more with its own, whether
    or not that line goes too. Lines equal after normalisation have 1.0 and name their first. A line that
    matches the earliest head of its long posting lists names the earliest of that head and its matches in
    short lists; others name their earliest match. Lists have up to ``short`` lines or are long, which decides
    speed and which match is named, not what goes. Lines without a word, null and empty texts and rows without an id give none. Rows that repeat an id are taken for one
    document's lines, of which equal places cannot match one another. Other columns are not looked at. An
    empty table gives an empty result.
    """
    hashed = stage(hashed_lines(docs, id_column, text_column))
    digests = hashed.drop("hashes")
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("head"))
    shared = stage(groups.filter("n > 1").select("digest", F.col("head.doc_id").alias("keep_doc_id"), F.col("head.line_no").alias("keep_line_no")))
    is_head = (F.col("doc_id") == F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))
    equal = stage(digests.join(broadcast_if_small(shared), "digest").filter(~is_head).drop("digest"))
    # Lines that only repeat another take no further part.
    kept = hashed.drop("digest").join(broadcast_if_small(equal.select("doc_id", "line_no").distinct()), ["doc_id", "line_no"], "left_anti")
    levels = stage(rarity(hashed, slots))
    posted = stage(postings(kept, levels, threshold, slots))
    # A list is no longer than its slot's count, so lists of low level are short; others are counted.
    may_be_long = posted.filter(F.shiftrightunsigned("key", 32) >= level(F.lit(short)))
    first = may_be_long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_POSTING)).alias("a"))
    heads = broadcast_if_small(stage(first.filter(F.col("n") > short).select("key", "a.*"))).alias("a")
    to_pairs = [F.col("a.doc_id").alias("a_doc"), F.col("a.line_no").alias("a_line"), F.col("b.doc_id").alias("b_doc"), F.col("b.line_no").alias("b_line")]
    goes = _earlier("a", "b") & _may_match(threshold, "a", "b")
    with_head = posted.alias("b").join(heads, F.col("a.key") == F.col("b.key")).filter(goes).select(*to_pairs)
    # Most candidates match: one comparison per line comes first, and whole long lists are left to lines it does not settle.
    nearest = with_head.groupBy("b_doc", "b_line").agg(F.min(F.struct("a_doc", "a_line")).alias("a")).select("a.*", "b_doc", "b_line")
    settled = stage(_first_match(verified(stage(nearest), docs, id_column, text_column, threshold)))
    gone = broadcast_if_small(settled.select("doc_id", "line_no", F.lit(True).alias("settled")))
    long_keys = heads.select("key", F.lit(True).alias("long"))
    marked = posted.join(gone, ["doc_id", "line_no"], "left").join(long_keys, "key", "left")
    # Both sides are the same and use the same columns, so that the postings are shuffled once, however long their lists are.
    compared = (F.col("b.settled").isNull() | F.col("a.long").isNull() | F.col("b.long").isNull()) & goes
    pairs = marked.alias("a").join(marked.alias("b").hint("merge"), F.col("a.key") == F.col("b.key")).filter(compared).select(*to_pairs, "a.settled")
    found = _first_match(verified(stage(pairs.distinct()), docs, id_column, text_column, threshold))
    late = found.unionByName(settled).groupBy("doc_id", "line_no").agg(F.min(F.struct("keep_doc_id", "keep_line_no", "jaccard")).alias("m")).select("doc_id", "line_no", "m.*")
    whole = equal.withColumn("jaccard", F.lit(1.0)).unionByName(late)
    return whole.select("doc_id", "line_no", "keep_doc_id", "keep_line_no", "jaccard")
