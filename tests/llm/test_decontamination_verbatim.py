"""Verbatim passages whatever their share of slots, their case and their line breaks."""

from tests.llm.test_decontamination import found
from themeloom.llm import decontamination

SUMS = "Evaluate 12 + 7 - 3 * 4 + 9 / 2 - 8 + 15 - 6 and then add 5 + 6 - 11 * 2 + 30"
NAMES = "Natalia sold clips to Anna in April, and then Maria gave half of them to Peter so that Julia could lend two to Carla on Friday."


def test_items_of_mostly_slots(spark):
    short = "Anna met Bob"
    got = found(spark, [(1, f"Some text. {SUMS} = what?"), (2, SUMS.replace("12", "13").replace("9", "8")), (3, "in may 7 8 9"), (4, "then anna met bob")],
                [(1, SUMS), (2, "7 8 9"), (3, short)])
    assert {(1, 1), (4, 3)} <= set(got) <= {(1, 1), (2, 1), (4, 3)}
    assert got[1, 1]["coverage"] == 1.0 and got[1, 1]["verbatim"]


def test_case_and_line_breaks_of_names(spark):
    wrapped = NAMES
    for name in ("Anna", "April", "Maria", "Peter", "Julia", "Carla", "Friday"):
        wrapped = wrapped.replace(f" {name}", f"\n {name}")
    docs = [(1, NAMES), (2, NAMES.lower()), (3, NAMES.upper()), (4, wrapped), (5, f"as they say, {NAMES.replace(' ', '  ')}")]
    got = found(spark, docs, [(1, NAMES)])
    assert {k: r["coverage"] for k, r in got.items()} == {(i, 1): 1.0 for i in range(1, 6)}


def test_changed_names_across_line_breaks_are_slots(spark):
    text = NAMES.replace("Maria", "\nLaura").replace("Peter", "\nPaul").replace("Julia", "\tSara").replace("Carla", " Emma")
    got = found(spark, [(1, text)], [(1, NAMES)])
    assert set(got) == {(1, 1)} and got[1, 1]["changed"] == 4 and got[1, 1]["coverage"] == 1.0


def test_words_for_numbers_and_longer_names_are_not_verbatim(spark):
    """Slots that became other words break windows; only a whole copy is verbatim."""
    item = "Mary walked 12 km to the old mill by the river and then, with Peter, she walked 4 km back to the small house on the hill."
    copies = [item, item.lower(), item.replace("12", "twelve").replace(" 4 ", " four "), item.replace("Peter", "Peter Paul"), item.replace("12", "15")]
    docs = spark.createDataFrame([(i, f"Some words before it. {t} And some after.") for i, t in enumerate(copies)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    found = {r["doc_id"]: r["verbatim"] for r in decontamination.matches(docs, bench).collect()}
    assert found == {0: True, 1: True, 2: False, 3: False, 4: False}
