import hashlib
import itertools
import random
import re
import zlib

import pytest

from themeloom.llm import conversation_repair as repair

SPACE = " \t\n\x0b\x0c\r"
WANTED = re.compile("(s?(ua)+)?")


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def damage(rows):
    """The rows after damage, restated; nulls as one space where they become text."""
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif text.rstrip(SPACE)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def cheapest(rows, wrong):
    """All sequences of edits up to the cost of deleting everything."""
    most = 2 * len(rows)
    best = None

    def go(i, cost, letters, made):
        nonlocal best
        if cost > most or best and cost > best[0]:
            return
        if i == len(rows):
            if WANTED.fullmatch("".join(r[:1] or "?" for r, _ in made)):
                found = (cost, letters, made)
                best = min(best, found, key=lambda f: f[:2]) if best else found
        else:
            role, text = rows[i][2:]
            go(i + 1, cost + 2, letters + "D", made)
            if wrong[i] not in ("blank", "duplicate"):
                more = 5 * (wrong[i] == "truncated")
                go(i + 1, cost + more, letters + "K", made + [(role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, cost + 1 + more, letters + "R", made + [(r, text)])
        for r in ("user", "assistant"):
            go(i, cost + 5, letters + "I", made + [(r, "")])

    go(0, 0, "", [])
    return best


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept = sorted((r for r in damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, key(*r[2:])))
        wrong = faults(kept)
        cost, audit, made = cheapest(kept, wrong)
        turns = {r[1] for r in kept} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(kept)]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(wrong.count(w) for w in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return sorted((tuple(r) for r in repair.repair(repair.damaged(table), **options).collect()), key=repr)


def some_rows(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Well.", "Yes!", "cut off", "", " \n", "Really? ", "a.b", "é.", None]
    roles = ["user", "assistant"] * 4 + ["system", "usher", "", None, "tool"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn + 3, None, 1]), rng.choice(roles), rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece_rows", [1, 2, 512])
def test_against_all_sequences_of_edits(spark, piece_rows):
    rows = some_rows(1, 150, 6) + [(900, 1, "user", "Hi.")] * 3
    assert found(spark, rows, piece_rows=piece_rows) == brute(rows)


def test_shortest_paths_of_every_short_string():
    for n in range(4):
        for codes in map("".join, itertools.product(repair.CODES, repeat=n)):
            if n == 3 and hash(codes) % 5:
                continue
            rows = [(0, 0, {"s": "system", "u": "user", "a": "assistant", "o": "tool"}[repair.CODES[repair.CODES.index(c) % 4]], str(i)) for i, c in enumerate(codes)]
            wrong = [["", "truncated", "blank"][repair.CODES.index(c) // 4] for c in codes]
            paths = repair.shortest(codes, 0)
            assert min(p for q, p in enumerate(paths) if p and q in repair.ENDS) == cheapest(rows, wrong)[:2]


def test_pieces_chain_to_the_whole():
    rng = random.Random(5)
    for _ in range(60):
        codes = "".join(rng.choices(repair.CODES, [4, 9, 9, 2, 1, 3, 3, 1, 1, 2, 2, 1], k=rng.randint(1, 70)))
        size = rng.randint(1, 20)
        parts = [codes[i : i + size] for i in range(0, len(codes), size)]
        cost, taken = repair.chain([repair._paths(p) for p in parts])
        best = min(p for q, p in enumerate(repair.shortest(codes, 0)) if p and q in repair.ENDS)
        assert (cost, "".join(t for _, t in taken)) == best


def test_a_long_conversation_in_pieces(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {t}{rng.choice(['.', '.', ''])}") for t in range(3_000)] + [(2, 1, "user", "x" * 2_000_000 + ".")]
    whole, cut = found(spark, rows, piece_rows=10_000), found(spark, rows, piece_rows=64)
    assert whole == cut and len(whole[0][7]) >= len(damage(rows[:-1]))


def test_edges(spark):
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, gone, "user", "Hello."), (6, None, "user", "Hello."), (6, None, "assistant", "Hi.")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows)[0] == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, []) == []
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    clashing = table.selectExpr("*", *[f"'x' as {c}" for c in ("conv", "missing", "key", "at", "piece", "codes", "kept", "before", "copy", "there", "cost", "speaker", "times_", "blank")])
    assert sorted((tuple(r) for r in repair.repair(repair.damaged(clashing)).collect()), key=repr) == brute(rows)
    wide = [(7, -(2**63), "user", "Hello."), (7, 2**63 - 1, "assistant", "Hi.")]
    assert found(spark, wide)[0][1] in (None, 0)


def test_given_table_against_all_sequences(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in repair.repair(repair.damaged(table)).collect()), key=repr) == brute(rows)
