"""Conversation structure repair: the cheapest edits as one whole number, found by shortest paths.

A conversation's rows become a string of one character a row (who speaks, and whether the row must or
had better go). Repairs are paths through the four states of the wanted order of roles, and a path's
weight is one big integer: its high digits are the cost, its low digits the letters of the edits, the
first letter in the highest place, with zeros after the last. The smaller integer is then the cheaper
repair and, of equally cheap ones, the one whose letters come first, and an ordinary minimum at every
node decides everything. Equally cheap paths over the same rows are never one the beginning of the
other (what the longer one adds would be insertions, which cost), so the minimum of a part stays the minimum
whatever follows. That lets long conversations be cut: rows are put in order across all tasks, pieces
of bounded length are solved for every state they can start in, and the pieces of a conversation are
chained. What one task sees of a whole conversation is its letters, which the result has in one cell
anyway, and its repaired text, streamed in order since a digest has to be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.storage import freeze, stage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# Rows of a piece of a conversation.
PIECE_ROWS = 512
# A row's character: who speaks (s, u, a or other), by what is wrong (nothing, truncated, must go).
CODES = "suaoSUAO0123"
# The letters of the edits as digits; 0 is the padding.
LETTERS = " DIKR"
_DIGIT = {letter: digit for digit, letter in enumerate(LETTERS)}
_BITS = 3
# States: nothing yet, after the system's row, after a user's, after an assistant's. Ends: nothing or assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
STATES = range(4)
ENDS = (_START, _ASSISTANT)
# A role leads from these states to its own.
_FROM = {"s": (_START,), "u": (_START, _SYSTEM, _ASSISTANT), "a": (_USER,)}
_TO = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}
# More than two insertions in one place would come back to a state they have passed.
_INSERTIONS = 2
# White space that makes no character of a text.
_BLANK = "\\x20\\x09-\\x0D"


@lru_cache(len(CODES))
def _edges(code: str) -> tuple[tuple[int, int, int, str], ...]:
    """What can be done with a row: (state before, state after, cost, letter)."""
    speaker, wrong = CODES[CODES.index(code) % 4], CODES.index(code) // 4
    edges = [(q, q, DELETE, "D") for q in STATES]
    if wrong < 2:
        more = TRUNCATED * wrong
        edges += [(q, _TO[speaker], KEEP + more, "K") for q in _FROM.get(speaker, ())]
        edges += [(q, _TO[role], REROLE + more, "R") for role in "ua" for q in _FROM[role]]
    return tuple(edges)


_INSERTS = tuple((q, _TO[role], INSERT, "I") for role in "ua" for q in _FROM[role])


def shortest(codes: str, start: int) -> list[tuple[int, str] | None]:
    """Cost and letters of the best path over the rows from a state to each state, None where none leads.

    Insertions may come before each row and after the last one.
    """
    places = len(codes) + _INSERTIONS * (len(codes) + 1)
    cost_at = _BITS * places

    def step(best: dict[int, tuple[int, int]], edges, onto: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
        # A node holds its weight and how many letters that has.
        made = dict(onto)
        for before, after, cost, letter in edges:
            if before in best:
                weight, n = best[before]
                weight += (cost << cost_at) + (_DIGIT[letter] << (cost_at - _BITS * (n + 1)))
                if after not in made or weight < made[after][0]:
                    made[after] = (weight, n + 1)
        return made

    best = {start: (0, 0)}
    for code in codes:
        for _ in range(_INSERTIONS):
            best = step(best, _INSERTS, best)
        best = step(best, _edges(code), {})
    for _ in range(_INSERTIONS):
        best = step(best, _INSERTS, best)

    def read(weight: int, n: int) -> tuple[int, str]:
        return weight >> cost_at, "".join(LETTERS[weight >> (cost_at - _BITS * (i + 1)) & 7] for i in range(n))

    return [read(*best[q]) if q in best else None for q in STATES]


def chain(pieces: list[list[tuple[int, str] | None]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost of the best repair, and for each piece the state it starts in and its letters.

    ``pieces`` have, at 4 * start + end, cost and letters of the best path through the piece. The weights
    are those of :func:`shortest`, with room for all pieces.
    """
    places = sum(max(len(p[1]) for p in piece if p) for piece in pieces)
    cost_at = _BITS * places
    digits = str.maketrans(LETTERS, "01234")
    best: dict[int, tuple[int, int]] = {_START: (0, 0)}
    came: list[dict[int, int]] = []
    for piece in pieces:
        made: dict[int, tuple[int, int]] = {}
        source: dict[int, int] = {}
        for before, (weight, n) in best.items():
            for after in STATES:
                path = piece[4 * before + after]
                if path is None:
                    continue
                cost, letters = path
                low = int(letters.translate(digits) or "0", 8) << (cost_at - _BITS * (n + len(letters)))
                total = weight + (cost << cost_at) + low
                if after not in made or total < made[after][0]:
                    made[after] = (total, n + len(letters))
                    source[after] = before
        best = made
        came.append(source)
    end = min((q for q in ENDS if q in best), key=lambda q: best[q][0])
    cost, taken, state = best[end][0] >> cost_at, [], end
    for piece, source in zip(reversed(pieces), reversed(came)):
        taken.append((source[state], piece[4 * source[state] + state][1]))
        state = source[state]
    return cost, taken[::-1]


def decisions(codes: str, start: int, letters: str) -> tuple[list[list[str]], list[str | None]]:
    """The roles inserted before each row and after the last, and each row's role: None if it goes, empty if it keeps its own."""
    before: list[list[str]] = [[]]
    roles: list[str | None] = []
    state = start
    for letter in letters:
        if letter == "I" or letter == "R":
            state = _ASSISTANT if state == _USER else _USER
            if letter == "I":
                before[-1].append(_NAME[state])
                continue
            roles.append(_NAME[state])
        elif letter == "K":
            state = _TO[CODES[CODES.index(codes[len(roles)]) % 4]]
            roles.append("")
        else:
            roles.append(None)
        before.append([])
    return before, roles


@lru_cache(1 << 14)
def _paths(codes: str) -> list[tuple[int, str] | None]:
    return [p for start in STATES for p in shortest(codes, start)]


def _misplaced(said: str) -> int:
    return sum(said[i : i + 2] not in ("su", "ua", "au") for i in range(len(said) - 1))


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # Short conversations have few different codes.
        paths = [_paths(c) if len(c) <= 32 else _paths.__wrapped__(c) for c in batch["codes"]]
        said = ["".join(CODES[CODES.index(c) % 4] for c in codes) for codes in batch["codes"]]
        yield batch.drop(columns="codes").assign(
            costs=[[p[0] if p else -1 for p in row] for row in paths],
            letters=[[p[1] if p else "" for p in row] for row in paths],
            illegal=[_misplaced(t) for t in said],
            ends=[t[:1] + t[-1:] for t in said],
        )


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        costs, taken, between = [], [], []
        for pieces in batch["pieces"]:
            ordered = sorted(pieces, key=lambda p: p["piece"])
            cost, parts = chain([[(int(c), w) if c >= 0 else None for c, w in zip(p["costs"], p["letters"])] for p in ordered])
            ends = "".join(p["ends"] for p in ordered)
            costs.append(cost)
            taken.append([{"piece": p["piece"], "start": s, "letters": w} for p, (s, w) in zip(ordered, parts)])
            between.append(sum(_misplaced(ends[i : i + 2]) for i in range(1, len(ends) - 1, 2)))
        yield batch.drop(columns="pieces").assign(cost=costs, taken=taken, illegal=batch["illegal"] + between)


_DECISIONS = "before array<array<string>>, after array<array<string>>, roles array<string>"


def _decide(codes: pd.Series, starts: pd.Series, letters: pd.Series) -> pd.DataFrame:
    made = [decisions(*row) for row in zip(codes, starts, letters)]
    # What is inserted after the last row of a piece goes with that row.
    after = [[[]] * (len(roles) - 1) + before[-1:] for before, roles in made]
    return pd.DataFrame({"before": [before[:-1] for before, _ in made], "after": after, "roles": [roles for _, roles in made]})


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations from their rows in order, each row's text ahead of what becomes of it."""
    now, digest, lines, key, own = None, None, 0, None, ("", "")
    for batch in batches:
        done = []
        for conv, missing, row_key, text, role, before, after, kept in zip(
            batch["conv"], batch["missing"], batch["key"], batch["text"], batch["role"], batch["before"], batch["after"], batch["kept"]
        ):
            if now != (conv, missing):
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest, lines, key = (conv, missing), hashlib.sha256(), 0, None
            if text is not None:
                key, own = row_key, (role, text)
                continue
            if kept and key != row_key:
                raise ValueError(f"no text for a row of conversation {conv}")
            added = [f"{r}:" for r in before] + ([f"{role or own[0]}:{own[1]}"] if kept else []) + [f"{r}:" for r in after]
            for line in added:
                digest.update((b"\n" if lines else b"") + line.encode("utf-8", "surrogatepass"))
                lines += 1
        if done:
            yield pd.DataFrame(done, columns=["conv", "missing", "repaired_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, digest.hexdigest())], columns=["conv", "missing", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as damaged by a checksum of conversation and turn: conv_id, turn, role, text, times (0 to 2).

    In the checksum, the role and the text a null counts as one space.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )


def _row_key(role: Column, text: Column) -> Column:
    """A digest of role and text; the length keeps different pairs apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text).cast("binary"), 256))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """For every conversation of ``rows`` (conv_id, turn, role, text and ``times`` each row occurs) its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.
    Rows are in order of turn, nulls first, those of one turn by SHA-256 of role and text; a row occurs
    ``times`` times in a row. A row's first fault counts: blank (nothing but white space), duplicate (role
    and text of an earlier row), truncated (not ending in one of ``.!?``). Kept roles must read as one system row or
    none and then user and assistant in turn, or nothing. Edits and costs: Keep 0, Rerole to user or assistant 1, Delete 2
    (a must for blank and duplicate rows), Insert an empty user or assistant row 5, and 5 more for a truncated row that
    stays. Of equally cheap repairs the one whose letters come first counts. ``illegal`` counts neighbours whose roles'
    first letters are not su, ua or au. Null conversations are one conversation; null roles and texts count as
    one space. A conversation whose rows all occur no times has zeros, no letters and the digest of
    nothing. Gaps beyond 64 bits are null. An empty table gives no row; other columns are not looked at.
    """
    conv = F.coalesce(rows["conv_id"].cast("bigint"), F.lit(0)).alias("conv")
    missing = rows["conv_id"].isNull().alias("missing")
    turn = rows["turn"].cast("bigint").alias("turn")
    role, text = (F.coalesce(rows[c], F.lit(" ")).alias(c) for c in ("role", "text"))
    key = _row_key(role, text).alias("key")
    speaker = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring(role, 1, 1)), F.lit(0)), F.lit(4))
    # instr finds an empty string at 1.
    speaker = F.when(role == "", 4).otherwise(speaker)
    blank = ~text.rlike(f"[^{_BLANK}]")
    cut = ~text.rlike(f"[.!?][{_BLANK}]*\\z")
    narrow = rows.select(
        conv, missing, turn, key, speaker.cast("tinyint").alias("speaker"), blank.alias("blank"), cut.alias("cut"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), rows["times"]) - 1)).alias("copy"),
        (rows["times"] > 0).alias("there"),
    )
    # Rows alike in everything are interchangeable; the last key lets range partitioning split many of them.
    narrow = narrow.withColumn("spread", F.monotonically_increasing_id())
    order = [F.col("missing").desc(), F.col("conv"), F.asc_nulls_first("turn"), F.col("key"), F.col("copy"), F.col("spread")]
    ordered = freeze(narrow.repartitionByRange(*order).sortWithinPartitions(*order).drop("copy", "spread"))
    ordered = ordered.withColumn("at", F.monotonically_increasing_id())
    same = ["missing", "conv"]
    firsts = ordered.filter("there").groupBy(*same, "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    again = F.col("first").isNull()
    wrong = F.when(F.col("blank") | again, 2).when(F.col("cut"), 1).otherwise(0)
    coded = (
        ordered.join(firsts, "at", "left")
        .withColumn("code", F.when(F.col("there"), F.substring(F.lit(CODES), (wrong * 4 + F.col("speaker")).cast("int"), F.lit(1))).otherwise(""))
        .withColumn("piece", F.expr(f"at div {piece_rows}"))
    )
    counted = lambda c: F.count_if(F.col("there") & c)
    pieces = stage(
        coded.groupBy(*same, "piece").agg(
            F.array_sort(F.collect_list(F.struct("at", "code", "turn", "key"))).alias("rows"),
            counted(F.col("blank")).alias("blank"),
            counted(~F.col("blank") & again).alias("duplicate"),
            counted(~F.col("blank") & ~again & F.col("cut")).alias("truncated"),
        )
    )
    codes = F.array_join(F.transform("rows", lambda r: r["code"]), "")
    # Rows that are not there have no code and nothing happens to them.
    pieces = pieces.withColumn("rows", F.filter("rows", lambda r: r["code"] != "")).withColumn("codes", codes)
    counts = ("blank", "duplicate", "truncated")
    solved = pieces.select(*same, "piece", "codes", *counts).mapInPandas(
        _solve,
        "conv bigint, missing boolean, piece bigint, blank bigint, duplicate bigint, truncated bigint, costs array<int>, letters array<string>, illegal bigint, ends string",
    )
    linked = solved.groupBy(*same).agg(
        F.collect_list(F.struct("piece", "costs", "letters", "ends")).alias("pieces"), *[F.sum(c).alias(c) for c in (*counts, "illegal")]
    )
    solution = stage(
        linked.mapInPandas(
            _chain,
            "conv bigint, missing boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, taken array<struct<piece bigint, start int, letters string>>",
        )
    )
    taken = solution.select(*same, F.explode("taken").alias("t")).select(*same, "t.piece", "t.start", "t.letters")
    decided = (
        pieces.select(*same, "piece", "rows", "codes")
        .join(taken, [*same, "piece"])
        .filter("letters != ''")
        .withColumn("made", F.pandas_udf(_decide, _DECISIONS)("codes", "start", "letters"))
        .select(*same, "rows", "made.*")
        .select(*same, F.explode(F.arrays_zip("rows", "before", "after", "roles")).alias("d"))
        .select(*same, "d.rows.turn", "d.rows.key", "d.rows.at", F.lit(None).cast("string").alias("text"), F.col("d.roles").alias("role"), "d.before", "d.after")
        .withColumn("kept", F.col("role").isNotNull())
        .filter(F.col("kept") | (F.size("before") > 0) | (F.size("after") > 0))
    )
    nothing = F.array().cast("array<string>")
    texts = rows.filter(rows["times"] > 0).select(
        conv, missing, turn, key, F.lit(-1).cast("bigint").alias("at"), text, role, nothing.alias("before"), nothing.alias("after"), F.lit(False).alias("kept")
    )
    lines = texts.unionByName(decided).repartition(*same).sortWithinPartitions(*same, F.asc_nulls_first("turn"), "key", "at").drop("turn", "at")
    digests = lines.mapInPandas(_digests, "conv bigint, missing boolean, repaired_sha256 string")
    # Turns count once each, however many rows have one.
    turns = rows.select(conv, missing, F.when(rows["times"] > 0, turn).alias("turn")).groupBy(*same, "turn").agg(F.lit(1)).groupBy(*same)
    turns = turns.agg(F.min("turn").cast("decimal(20,0)").alias("low"), F.max("turn").cast("decimal(20,0)").alias("high"), F.count("turn").alias("n"))
    gaps = F.when(F.col("n") == 0, 0).otherwise(F.expr("try_cast(high - low + 1 - n as bigint)")).cast("bigint")
    letters = F.array_join(F.transform("taken", lambda t: t["letters"]), "")
    return (
        turns.join(solution, same)
        .join(digests, same, "left")
        .select(
            F.when(~F.col("missing"), F.col("conv")).alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", letters.alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
