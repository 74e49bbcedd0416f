import re

import pytest

from tests.llm.conftest import EDGE, LONG, SPACE, as_rows, words
from themeloom.llm import substring_dedup as sd

WORD = re.compile(f"[^{SPACE}]+")


def spans(text, kind):
    """(start, end) of the units of a text, word by word."""
    found, open_at = [], None
    marks = list(WORD.finditer(text or ""))
    for k, m in enumerate(marks):
        open_at = m.start() if open_at is None else open_at
        gap = text[m.end() : marks[k + 1].start()] if k + 1 < len(marks) else "\n\n"
        ends = {"line": "\n" in gap, "sentence": m.group()[-1] in ".!?" or k + 1 == len(marks), "paragraph": gap.count("\n") > 1}
        if ends[kind]:
            found.append((open_at, m.end()))
            open_at = None
    return found


def expected(rows, kinds=sd.KINDS, min_words=sd.MIN_WORDS):
    out = []
    for kind in kinds:
        seen = {}
        for doc_id, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            run = []
            for unit, (start, end) in enumerate(spans(text, kind)):
                key = " ".join(words(text[start:end]))
                if key in seen:
                    run.append((doc_id, kind, unit, start, end, len(words(key)), seen[key]))
                    continue
                seen[key] = doc_id
                out += run if sum(r[5] for r in run) >= min_words else []
                run = []
            out += run if sum(r[5] for r in run) >= min_words else []
    return sorted(out, key=repr)


def table(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string")


def test_edges(edge, clashing, empty):
    for n in (1, sd.MIN_WORDS):
        for kinds in (sd.KINDS, (sd.PARAGRAPH,)):
            assert as_rows(sd.repeated_units(edge, kinds=kinds, min_words=n)) == expected(EDGE, kinds, n)
            assert as_rows(sd.repeated_units(clashing, kinds=kinds, min_words=n)) == expected(EDGE, kinds, n)
    assert sd.repeated_units(empty).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = as_rows(sd.repeated_units(docs))
    assert found == expected(rows) and len(found) > 100
    texts = dict(rows)
    for doc_id, _, _, start, end, n, keep in found[:50]:
        assert len(words(texts[doc_id][start:end])) == n and " ".join(words(texts[doc_id][start:end])) in " ".join(words(texts[keep]))


# Sixty words in six sentences.
PASSAGE = " ".join(" ".join(f"Word{s}x{k}" for k in range(9)) + f" end{s}." for s in range(6))


def gone(spark, *texts):
    """For each text how many of the passage's words are left after removal."""
    rows, df = table(spark, *texts)
    left = dict(as_rows(sd.remove_units(df, sd.repeated_units(df))))
    wanted = set(words(PASSAGE))
    return [sum(w in wanted for w in words(left[i])) for i, _ in rows]


def test_a_passage_wrapped_otherwise(spark):
    """Twelve words a line in two documents, on one line in a third."""
    w = PASSAGE.split(" ")
    wrapped = "\n".join(" ".join(w[i : i + 12]) for i in range(0, 60, 12))
    assert gone(spark, f"Intro one.\n{wrapped}\nOutro.", f"Other words.\n{wrapped}\nMore.", f"Third.\n{PASSAGE}\nLast.") == [60, 0, 0]


def test_a_passage_inside_a_longer_line(spark):
    # What stands before its first full stop and after its last belongs to other sentences.
    assert gone(spark, f"One is here. {PASSAGE} And on it goes.", f"Quite another line, with {PASSAGE} and more.", f"{PASSAGE}") == [60, 10, 0]


def test_short_repeats_stay_and_short_runs_go(spark):
    rows, df = table(spark, "All rights reserved.\nA b c.", "All rights reserved.\nD e f.", "x\n\n" + "\n\n".join(f"line number {i} of ten" for i in range(10)), "\n".join(f"line number {i} of ten" for i in range(10)))
    found = as_rows(sd.repeated_units(df))
    assert {r[0] for r in found} == {3} and len([r for r in found if r[1] == "line"]) == 10
    assert found == expected(rows)


def test_paragraphs_and_removal(spark):
    passage = "one two three four\nfive six"
    rows, df = table(spark, f"a\n\n{passage}\n\nb", f"{passage}\n\n\U0001f600 c", None, f"{passage}\n\n{passage.upper()}", f"d\n\n{passage}\n \n")
    found = sd.repeated_units(df, kinds=(sd.PARAGRAPH,), min_words=6)
    assert as_rows(found) == expected(rows, (sd.PARAGRAPH,), 6)
    assert dict(as_rows(sd.remove_units(df, found))) == {0: rows[0][1], 1: "\U0001f600 c", 2: None, 3: "", 4: "d"}


def test_missing_and_repeated_ids(spark):
    rows = [(None, LONG), (4, LONG), (4, LONG), (9, LONG + "\n" + LONG)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(sd.repeated_units(df, kinds=(sd.LINE,)), "doc_id", "unit", "keep_id") == [(9, 0, 4), (9, 1, 4)]


def test_a_passage_on_a_third_of_the_rows(spark):
    line = " ".join(f"w{i}" for i in range(30))
    df = spark.range(6000).selectExpr("id as doc_id", f"case when id % 3 = 1 then concat('x', id, '.\\n{line}') else concat('only ', id) end as text")
    found = sd.repeated_units(df, kinds=(sd.LINE,))
    assert found.count() == 1999 and {r["keep_id"] for r in found.collect()} == {1}
