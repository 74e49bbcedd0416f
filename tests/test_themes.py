import random

import pytest
from pyspark.sql import functions as F

from themeloom.operators import similar, themes


def entry_frame(spark, *lists):
    rows = [(i, [(t, float(c)) for t, c in pairs]) for i, pairs in enumerate(lists)]
    return spark.createDataFrame(rows, "row_id bigint, original array<struct<theme:string,confidence:double>>")


def named(spark, *lists):
    return entry_frame(spark, *[[(t, 1.0) for t in names] for names in lists])


def stats_of(spark, *lists):
    return themes.theme_stats(themes.occurrences(named(spark, *lists)))


def case_map(spark, mode, *lists):
    return {r["theme"]: r["target"] for r in themes.case_map(stats_of(spark, *lists), mode).collect()}


def running_rule(lists):
    """The running case map, theme by theme."""
    counts = {}
    for names in lists:
        for t in names:
            counts[t] = counts.get(t, 0) + 1
    best, out = {}, {}
    for t in counts:
        key = t.lower()
        if key not in best:
            best[key] = t
            continue
        if counts[t] > counts[best[key]]:
            best[key] = t
        out[t] = best[key]
    return out


def test_case_map_modes(spark):
    lists = [["A"], ["a"], ["a"], ["a"]]
    assert case_map(spark, "running", *lists) == {"a": "a"}
    assert case_map(spark, "global", *lists) == {"A": "a", "a": "a"}


@pytest.mark.parametrize("seed", range(6))
def test_running_case_map_equals_the_rule(spark, seed):
    rng = random.Random(seed)
    spell = lambda w: "".join(rng.choice([c.lower(), c.upper()]) for c in w)
    lists = [list(dict.fromkeys(spell(rng.choice(["ab", "cd", "xyz"])) for _ in range(rng.randint(0, 4)))) for _ in range(60)]
    assert case_map(spark, "running", *lists) == running_rule(lists)
    merged = themes.themes_merged(stats_of(spark, *lists)).first()["themes_merged"]
    assert merged == len(running_rule(lists))


def test_mapped_entry_keeps_first_confidence_and_all_for_the_mean(spark):
    df = entry_frame(spark, [("A", 0.9), ("a", 0.5), ("B", 0.8), ("C", 0.7), ("D", 0.6)], [])
    mapping = spark.createDataFrame([("a", "A")], "theme string, target string")
    out = themes.entry_themes(df, mapping).withColumn("avg", themes.average_confidence("merged"))
    first, second = out.orderBy("row_id").collect()
    assert first["themes"] == ["A", "B", "C"]
    assert [(e["theme"], e["confidence"]) for e in first["merged"]] == [("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6)]
    assert first["avg"] == pytest.approx((0.9 + 0.8 + 0.7 + 0.6) / 4)
    assert (second["themes"], second["merged"], second["avg"]) == ([], [], 1.0)


def test_large_mapping_gives_the_same_without_broadcast(spark, monkeypatch):
    df = named(spark, ["x", "y", "z"], ["y"], [])
    mapping = spark.createDataFrame([("x", "K"), ("y", "K")], "theme string, target string")
    small = sorted(map(str, themes.map_themes(df, mapping, "original", "m").collect()))
    monkeypatch.setattr(themes, "broadcast_if_small", lambda t: t)
    assert sorted(map(str, themes.map_themes(df, mapping, "original", "m").collect())) == small


def limited(spark, confidences, n):
    pairs = [(f"t{i}", c) for i, c in enumerate(confidences)]
    out = entry_frame(spark, pairs).select(themes.limit_themes("original", n).alias("k")).first()["k"]
    return [(e["theme"], e["confidence"]) for e in out]


def test_limit(spark):
    assert limited(spark, [0.9, 0.5, 0.4], 3) == [("t0", 0.9), ("NA", 0.0)]
    assert limited(spark, [0.6, 0.9, 0.9, 0.7], 3) == [("t1", 0.9), ("t2", 0.9), ("t3", 0.7)]
    assert limited(spark, [0.1], 1) == [("NA", 0.0)]
    assert limited(spark, [], 3) == []
    assert limited(spark, [0.7], 3) == [("t0", 0.7)]


def test_high_confidence(spark):
    df = entry_frame(spark, [("a", 0.8), ("b", 0.79), ("c", 1.0)])
    assert df.select(themes.high_confidence("original")).first()[0] == ["a", "c"]
    assert df.select(themes.high_confidence("original", F.array(F.lit("c")))).first()[0] == ["c"]


@pytest.mark.parametrize("order", [["job", "Job", "job "], ["Job", "job", "job "], ["job ", "Job", "job"]])
def test_a_text_may_hold_spellings_of_one_theme(spark, order):
    df = entry_frame(spark, [(t, 0.5) for t in order])
    row = themes.register(themes.occurrences(df)).first()
    assert (row["theme"], row["n"], row["first_pos"]) == (order[0].strip(), 3, 0)


def test_first_sightings_of_any_row_id(spark):
    rows = [(-5, 3, "a"), (-5, 2, "a"), (2**62, 0, "b"), (0, 7, "a"), (-(2**62), 1, "c")]
    df = spark.createDataFrame(rows, "row_id bigint, pos int, theme string")
    found = {r["theme"]: (r["first_row"], r["first_pos"]) for r in themes.theme_stats(df).collect()}
    assert found == {"a": (-5, 2), "b": (2**62, 0), "c": (-(2**62), 1)}


def test_register_folds_onto_the_first_spelling(spark):
    df = entry_frame(spark, [(" Jobs ", 0.5)], [("jobs", 1.0), ("  ", 0.1)], [("JOBS", 0.3), ("x", 0.2)])
    rows = themes.register(themes.occurrences(df)).orderBy("first_row", "first_pos").collect()
    assert [(r["theme"], r["n"]) for r in rows] == [("Jobs", 3), ("x", 1)]
    assert rows[0]["confidence"] == pytest.approx(0.6)


def consolidated(spark, names, mapping):
    df = spark.createDataFrame([(0, names)], "row_id bigint, themes array<string>")
    table = None if mapping is None else spark.createDataFrame(list(mapping.items()), "theme string, target string")
    return themes.consolidated(df, table).first()["consolidated"]


def test_consolidated(spark):
    assert consolidated(spark, ["x", "NA", "y"], {"x": "K", "y": "K"}) == ["K"]
    assert consolidated(spark, ["y", "z", "NA"], {"y": "K"}) == ["K", "z"]
    assert consolidated(spark, [], {"y": "K"}) == []
    assert consolidated(spark, ["x", "NA"], None) == ["x", "NA"]


def test_distinct_themes_and_skip_rule(spark):
    stats = stats_of(spark, ["b", "NA"], ["a", "b"], ["c"])
    found = themes.distinct_themes(stats).orderBy("seq")
    assert [r["theme"] for r in found.collect()] == ["b", "a", "c"]
    assert themes.needs_consolidation(found, 2) and not themes.needs_consolidation(found, 3)


def test_sorted_themes_break_ties_by_first_sighting(spark):
    stats = stats_of(spark, ["b", "a"], ["c", "a"], ["c"])
    assert [r["theme"] for r in themes.sorted_themes(stats).collect()] == ["a", "c", "b"]
    assert [r["theme"] for r in themes.sorted_themes(stats, 1).collect()] == ["a"]


def test_merging_needs_both_themes(spark):
    stats = stats_of(spark, ["a", "b"], ["a"])
    merges = spark.createDataFrame([("a", "b"), ("b", "zzz"), ("q", "a"), ("b", "b")], "from_theme string, to_theme string")
    assert [(r["theme"], r["n"]) for r in themes.merge_themes(stats, merges).collect()] == [("b", 3)]
    outcome = {(r["from_theme"], r["to_theme"]): r["merged"] for r in themes.merge_outcome(stats, merges).collect()}
    assert outcome == {("a", "b"): True, ("b", "zzz"): False, ("q", "a"): False, ("b", "b"): False}


def test_examples_are_the_first_with_the_total(spark):
    df = named(spark, *[["t"] for _ in range(40)], ["u"])
    texts = spark.range(41).select(F.col("id").alias("row_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = themes.theme_examples(themes.occurrences(df), texts).filter("theme = 't'").orderBy("rank").collect()
    assert [(r["rank"], r["row_id"], r["total"]) for r in rows] == [(i + 1, i, 40) for i in range(30)]


def suggestions(spark, names, **options):
    df = spark.createDataFrame([(t, i) for i, t in enumerate(names)], "theme string, seq bigint")
    rows = similar.merge_suggestions(df, **options).orderBy("seq1", "seq2").collect()
    return [(r["theme1"], r["theme2"]) for r in rows]


def containment_rule(names):
    low = [n.lower() for n in names]
    return [(names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names)) if low[i] in low[j] or low[j] in low[i]]


def test_suggestions(spark):
    assert suggestions(spark, ["job", "Job search", "search"]) == [("job", "Job search"), ("Job search", "search")]


@pytest.mark.parametrize("seed", range(4))
def test_containment_equals_the_nested_loop(spark, seed):
    rng = random.Random(seed)
    names = list({"".join(rng.choice("abAB ") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    pairs = containment_rule(names)
    assert suggestions(spark, names, k=None) == pairs
    assert suggestions(spark, names, k=10) == pairs[:10]
    assert suggestions(spark, names, k=25) == pairs[:25]


def test_many_short_themes_are_joined(spark, monkeypatch):
    names = ["a", "b", "ab", "ba", "abba", "bb", "c", "xyz", "xy", "A"]
    expected = containment_rule(names)
    assert suggestions(spark, names, k=None) == expected
    monkeypatch.setattr(similar, "SHORT_THEMES", 3)
    assert suggestions(spark, names, k=None) == expected


def test_totals_may_come_from_the_counts(spark):
    occ = themes.occurrences(named(spark, ["a", "b"], ["a"], ["a"]))
    plain = sorted(map(tuple, themes.example_rows(occ, 2).collect()))
    assert sorted(map(tuple, themes.example_rows(occ, 2, themes.theme_stats(occ)).collect())) == plain
    assert {(r[0], r[3]) for r in plain} == {("a", 3), ("b", 1)}


def test_cooccurrence(spark):
    df = spark.createDataFrame([(0, ["b", "a"]), (1, ["a", "b", "c"]), (2, ["a"]), (3, [])], "row_id bigint, themes array<string>")
    rows = {(r["theme1"], r["theme2"]): (r["n_both"], r["n1"], r["n2"], round(r["jaccard"], 3)) for r in similar.cooccurrence(df).collect()}
    assert rows == {("a", "b"): (2, 3, 2, 0.667), ("a", "c"): (1, 3, 1, 0.333), ("b", "c"): (1, 2, 1, 0.5)}


def test_hierarchy_counts_a_text_once_per_parent(spark):
    occ = themes.occurrences(named(spark, ["a", "b"], ["a"], ["z"]))
    edges = spark.createDataFrame([("P", "a"), ("P", "b"), ("Q", "b")], "parent string, child string")
    rows = {(r["parent"], r["child"]): r["n_texts"] for r in similar.hierarchy_rollup(occ, edges).collect()}
    assert rows == {("P", "a"): 2, ("P", "b"): 1, ("P", None): 2, ("Q", "b"): 1, ("Q", None): 1, (None, None): 2}


def test_quality(spark):
    df = entry_frame(spark, [("ok", 0.9), ("low", 0.5), ("Var", 0.9)], [("ok", 0.9), ("low", 0.5), ("var", 0.9), ("one", 0.9)])
    rows = {r["theme"]: r["status"] for r in similar.theme_quality(themes.theme_stats(themes.occurrences(df))).collect()}
    assert rows == {"ok": "ok", "low": "review", "Var": "review", "var": "review", "one": "review"}


def test_totals(spark):
    occ = themes.occurrences(named(spark, ["a", "b"], ["a"], []))
    assert tuple(themes.theme_totals(themes.theme_stats(occ)).first()) == (2, 3)
    assert tuple(themes.approximate_theme_totals(occ).first()) == (2, 3)
    rows = {r["theme"]: r["n"] for r in themes.theme_lookup(themes.theme_stats(occ), spark.createDataFrame([("a",), ("q",)], "theme string")).collect()}
    assert rows == {"a": 2, "q": 0}


def test_registries_of_runs_merge_to_that_of_all(spark):
    rng = random.Random(4)
    rows = [(i, p, rng.choice(["Tea", "tea", "TEA ", " Café", "café", "  ", "x"]), rng.random()) for i in range(60) for p in range(rng.randint(0, 3))]
    schema = "row_id bigint, pos int, theme string, confidence double"
    whole = themes.register(spark.createDataFrame(rows, schema))
    runs = [themes.run_registry(spark.createDataFrame([r for r in rows if r[0] // 25 == k], schema), k) for k in range(3)]
    rounded = lambda df: sorted((r["theme"], r["n"], round(r["confidence"], 9), r["first_row"], r["first_pos"]) for r in df.collect())
    expected = rounded(whole)
    empty = runs[0].limit(0)
    for a, b, c in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        for merged in (
            themes.merge_registries(themes.merge_registries(runs[a], runs[b]), runs[c]),
            themes.merge_registries(empty, themes.merge_registries(runs[a], themes.merge_registries(runs[b], runs[c]))),
        ):
            assert rounded(merged.withColumn("confidence", F.col("confidence_sum") / F.col("n"))) == expected
    assert [r["theme"] for r in themes.known_themes(merged, 2).collect()] == [r["theme"] for r in themes.known_themes(whole, 2).collect()]


def test_the_registry_aggregates_numbers_only(spark):
    occ = spark.createDataFrame([(1, 0, "Tea", 0.5)], "row_id bigint, pos int, theme string, confidence double")
    plan = themes.register(occ)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "min_by" not in plan
