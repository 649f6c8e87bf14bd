import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelway.operators import sampling


def order(rows, seed):
    return sorted(rows, key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))


def expected_split(rows, val=0.05, test=0.05, seed=42):
    """Brute force for one group: {id: split}."""
    classes = defaultdict(list)
    for i, label in rows:
        classes[label].append(i)
    pool = sum(len(v) for v in classes.values() if len(v) > 1)
    draws = max(0, pool - math.ceil((val + test) * len(rows)))
    base = {c: len(v) * draws // pool for c, v in classes.items() if len(v) > 1}
    rest = {c: len(classes[c]) * draws % pool for c in base}
    for c in sorted(base, key=lambda c: (-rest[c], c))[: draws - sum(base.values())]:
        base[c] += 1
    held = []
    for c, n in base.items():
        held += order(classes[c], seed)[: len(classes[c]) - n]
    out = {i: "train" for i, _ in rows}
    n_test = math.ceil(test / (val + test) * len(held))
    for rank, i in enumerate(order(held, f"{seed}-test")):
        shared = len(held) < 2 or val <= 0 or test <= 0
        out[i] = "both" if shared else "test" if rank < n_test else "val"
    return out


CASES = {
    "one": [(1, "a")],
    "nine": [(i, "a") for i in range(9)],
    "ten": [(i, "ab"[i % 2]) for i in range(10)],
    "eleven": [(i, "a") for i in range(11)],
    "hundred": [(i, "abcd"[i % 4]) for i in range(100)],
    "hot": [(i, "hot" if i % 3 else f"c{i % 7}") for i in range(500)],
    "small classes": [(i, f"c{i // 3}") for i in range(60)],
    "singletons": [(i, "a" if i < 50 else f"u{i}") for i in range(60)],
}


@pytest.mark.parametrize("name", CASES)
def test_split_matches_brute_force(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame(rows, "row_id long, label string")
    got = sampling.stratified_split(df, "row_id", None, "label", 0.05, 0.05, 42)
    assert {r["row_id"]: r["split"] for r in got.collect()} == expected_split(rows)


def test_split_per_group_with_small_buckets(spark):
    rows = [(i, f"g{i % 3}", None if i % 11 == 0 else f"l{i % 5}") for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, grp string, label string")
    table = sampling.split_table(df, "row_id", "grp", "label", 0.1, 0.1, 7, bucket_rows=4)
    got = df.join(table.drop("cnt"), ["grp", "label"], "left").withColumn(
        "split", sampling.split_column("row_id", 7, F.col("label"), F.col("cuts"))
    )
    got = {r["row_id"]: r["split"] for r in got.collect()}
    assert all(got[i] is None for i, _, label in rows if label is None)
    for g in ("g0", "g1", "g2"):
        mine = [(i, label) for i, grp, label in rows if grp == g and label is not None]
        want = expected_split(mine, 0.1, 0.1, 7)
        assert {i: got[i] for i, _ in mine} == want


def test_zero_test_size_shares_the_hold_out(spark):
    df = spark.createDataFrame([(i, "a") for i in range(40)], "row_id long, label string")
    got = sampling.stratified_split(df, "row_id", None, "label", 0.1, 0.0, 1)
    assert Counter(r["split"] for r in got.collect()) == {"train": 36, "both": 4}
    twice = sampling.one_row_per_split(got)
    assert Counter(r["split"] for r in twice.collect()) == {"train": 36, "val": 4, "test": 4}


@pytest.mark.parametrize("bucket_rows", [1, 16, 1 << 16])
def test_sample_is_exact(spark, bucket_rows):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    for n in (1, 137, 999, 1000, 1001):
        got = sampling.sample_rows(df, "row_id", n, 42, bucket_rows)
        ids = {r["row_id"] for r in got.collect()}
        assert ids == set(order(range(1000), 42)[:n])


def test_quotas_do_not_overflow(spark):
    classes = spark.createDataFrame(
        [("a", 60_000_000_000), ("b", 30_000_000_001), ("c", 1)], "label string, cnt long"
    )
    rows = {r["label"]: r for r in sampling.split_quotas(classes, None, "label", 0.05, 0.05).collect()}
    assert rows["c"]["hold_n"] == 0
    assert sum(r["hold_n"] for r in rows.values()) == math.ceil(0.1 * 90_000_000_002)


@pytest.mark.parametrize("level_digits", [1, 2])
def test_cuts_level_by_level(spark, monkeypatch, level_digits):
    """Digits found one or two at a time give the same cuts; a level counts few prefixes a group."""
    df = spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 7 % 3).cast("int").alias("grp"))
    sizes = df.groupBy("grp").agg(F.count(F.lit(1)).alias("cnt"))
    quotas = sampling.stage_table(sizes.withColumn("quota", F.col("grp") * 400), "quotas")
    want = sorted(sampling.hash_cuts(df, "row_id", quotas, ["grp"], 1, 1 << 16).collect())
    monkeypatch.setattr(sampling, "LEVEL_DIGITS", level_digits)
    levels = []
    real = sampling.stage_table
    monkeypatch.setattr(sampling, "stage_table", lambda frame, name: levels.append(name) or real(frame, name))
    got = sorted(sampling.hash_cuts(df, "row_id", quotas, ["grp"], 1, 2).collect())
    assert got == want and len(got) == 2
    assert len(levels) == -(-3 // level_digits)
