from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelway.config import HierConfig
from labelway.operators import joins, taxonomy

SCHEMA = "id long, category string, issue string, subissue string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def labels(df, column="subissue_unique"):
    return [r[column] for r in df.orderBy("id").collect()]


def test_ambiguity_is_global_and_ignores_nulls(spark):
    rows = [
        ("c1", "i1", "x"), ("c2", "i2", "x"),  # two issues, other categories
        ("c1", "i1", "y"), ("c2", "i1", "y"),  # one issue
        ("c1", None, "z"), ("c1", "i1", "z"),  # a null issue does not count
        ("c1", "i1", None), ("c1", "i2", None),  # a null name is not a name
    ]
    df = frame(spark, rows)
    found = taxonomy.ambiguous_labels(df, "issue", "subissue").collect()
    assert [tuple(r) for r in found] == [("x", 2)]
    got = labels(taxonomy.disambiguate_labels(df, HierConfig()))
    assert got == ["x ⟨i1⟩", "x ⟨i2⟩", "y", "y", "z", "z", "nan", "nan"]


def test_one_name_in_all_pairs_is_looked_up_in_salts(spark, monkeypatch):
    rows = [(f"c{i % 9}", f"i{i % 300}", "same" if i % 3 else f"own{i}") for i in range(1200)]
    df = frame(spark, rows)
    want = labels(taxonomy.disambiguate_labels(df, HierConfig()))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 20)
    cells = taxonomy.count_cells(df, "issue", "subissue")
    named = taxonomy._unique_names(cells, HierConfig())
    assert "__salt" in named._jdf.queryExecution().toString()
    assert {(r["issue"], r["subissue"]): r["subissue_unique"] for r in named.collect()} == {
        (i, n): f"same ⟨{i}⟩" if n == "same" else n for _, i, n in rows
    }
    assert labels(taxonomy.disambiguate_labels(df, HierConfig())) == want


def test_literal_nan_shares_the_fate_of_null(spark):
    rows = [("c", "i1", "nan"), ("c", "i2", "nan"), ("c", None, None), ("c", "i3", None)]
    got = labels(taxonomy.disambiguate_labels(frame(spark, rows), HierConfig()))
    assert got == ["nan ⟨i1⟩", "nan ⟨i2⟩", "nan ⟨nan⟩", "nan ⟨i3⟩"]


def test_rare_names_become_others_except_the_top(spark):
    rows = [("c", "i", s) for s in "aaaabbbccd"] + [("c", "j", "d2"), ("c", "j", "e2")]
    df = frame(spark, rows).withColumn("subissue_unique", F.col("subissue"))
    cfg = HierConfig(min_count=3, top_keep=1)
    got = labels(taxonomy.group_lowfreq(df, cfg))
    assert got == list("aaaabbb") + ["others"] * 3 + ["d2", "others"]  # tie in j: by name


def test_null_keys_are_never_grouped(spark):
    rows = [(None, "i", "a"), ("c", None, "b"), ("c", "i", "k"), ("c", "i", "k"), ("c", "i", "r")]
    df = frame(spark, rows).withColumn("subissue_unique", F.col("subissue"))
    got = labels(taxonomy.group_lowfreq(df, HierConfig(min_count=2, top_keep=1, max_share=0.9)))
    assert got == ["a", "b", "k", "k", "others"]


def test_relaxing(spark):
    rows = [("c", "i", f"s{k}") for k in range(10)]
    df = frame(spark, rows).withColumn("subissue_unique", F.col("subissue"))
    cfg = HierConfig(min_count=3, top_keep=2)  # 8 of 10 rare: above 0.6
    assert set(labels(taxonomy.group_lowfreq(df, cfg))) == {f"s{k}" for k in range(10)}
    report = taxonomy.curation_report(df, cfg).first()
    assert report["final_others_rows"] == 0 and report["min_count"] == 3
    assert report["note"] == "auto-relaxed threshold 3->1, share=0.0000"
    # a floor of 2 still groups the names with one row
    cfg = HierConfig(min_count=3, top_keep=2, min_floor=2)
    assert Counter(labels(taxonomy.group_lowfreq(df, cfg)))["others"] == 8
    report = taxonomy.curation_report(df, cfg).first()
    assert (report["final_others_rows"], report["final_others_share"]) == (8, 0.8)
    # no relaxing when the floor is not below the threshold
    cfg = HierConfig(min_count=3, top_keep=2, min_floor=3)
    assert taxonomy.curation_report(df, cfg).first()["note"] == ""


def test_others_merges_with_a_label_of_that_name(spark):
    rows = [("c", "i", "others")] * 3 + [("c", "i", "a"), ("c", "i", "b")]
    df = frame(spark, rows)
    got = labels(taxonomy.curate(df, HierConfig(min_count=2, top_keep=1)))
    assert got == ["others"] * 5


@pytest.mark.parametrize("seed", [1, 2])
def test_curate_equals_the_two_steps(spark, seed):
    import random

    rng = random.Random(seed)
    pick = lambda pool: rng.choice(pool + [None])
    rows = [
        (pick(["c1", "c2"]), pick(["i1", "i2", "i3"]), pick([f"s{k}" for k in range(12)] + ["nan"]))
        for _ in range(400)
    ]
    df = frame(spark, rows)
    cfg = HierConfig(min_count=6, top_keep=2)
    once = labels(taxonomy.curate(df, cfg))
    twice = labels(taxonomy.group_lowfreq(taxonomy.disambiguate_labels(df, cfg), cfg))
    assert once == twice and len(once) == 400 and "others" in once


def test_empty_table(spark):
    df = frame(spark, []).where("false")
    assert taxonomy.curate(df, HierConfig()).count() == 0
    report = taxonomy.curation_report(df, HierConfig()).first()
    assert report["final_others_rows"] == 0 and report["final_others_share"] == 0.0


def test_salted_lookup_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_SHARE", 20)
    rows = [(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 50}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string")
    counts = df.groupBy("k").agg(F.count("*").alias("cnt")).where("k is null or k <> 'k6'")
    table = counts.withColumn("v", F.concat(F.lit("v_"), F.coalesce("k", F.lit("null"))))
    for how in ("left", "inner"):
        plain = joins.attach(df, table, ["k"], "cnt", ["id"], how)
        salted = joins.attach(df, table, ["k"], "cnt", ["id"], how, broadcast_bytes=-1)
        assert plain.columns == salted.columns == ["id", "k", "v"]
        assert sorted(map(repr, plain.collect())) == sorted(map(repr, salted.collect()))
    assert plain.count() < df.count()
    # the hot key meets in more than one shuffle partition's worth of salts
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan


def test_curate_without_broadcast(spark, monkeypatch):
    rows = [("c", "i", s) for s in "aaaaaaaabbbccd" * 5] + [(None, "i", "a"), ("c", None, None)]
    df = frame(spark, rows)
    cfg = HierConfig(min_count=12, top_keep=1)
    want = labels(taxonomy.curate(df, cfg))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(joins, "HOT_SHARE", 4)
    assert labels(taxonomy.curate(df, cfg)) == want
