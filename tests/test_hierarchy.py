from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from labelway.config import TICKET_SCHEMA, HierConfig
from labelway.operators import encoding, linear
from labelway.plans import hierarchy, tune
from labelway.sources import model_store
from labelway.sources.tables import load_table
from labelway.streaming.requests import score_requests

WORDS = {
    "water": "pipe tap leak flood drain pump well tank",
    "roads": "road hole bridge lane sign asphalt crossing kerb",
    "schools": "school pupil lesson exam book class teacher desk",
}


def ticket_rows():
    """Separable texts; sub-labels have their own words. Odd categories on top."""
    rows = []
    for i in range(360):
        cat = list(WORDS)[0 if i % 3 else 1 + i // 3 % 2]  # one category holds two thirds
        words = WORDS[cat].split()
        sub = i // 7 % 2
        text = f"{words[i % 8]} {words[(i + 3) % 8]} {cat} {['late bill', 'rude staff'][sub]} no {i}!"
        rows.append((text, cat, "service", ["billing", "people"][sub], "5" if i % 5 else "4"))
    rows += [("lonely text", "alone", "x", "y", "5")]  # one row: no head
    rows += [(f"quiet {i}", "mono", "x", "only", "5") for i in range(4)]  # one label
    rows += [(f"odd thing {i}", "unique", "x", f"u{i}", "5") for i in range(3)]  # no label twice
    rows += [("12 34", "water", "service", "billing", "5"), (None, "water", "service", "billing", "5")]
    rows += [("bad grade", "water", "service", "billing", g) for g in ("3", "n/a", None)]
    rows += [("no category", None, None, None, "4"), ("none either", None, None, None, "4")]
    return [(i, *r) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def tickets(spark):
    return spark.createDataFrame(ticket_rows(), TICKET_SCHEMA).repartition(3)


CFG = HierConfig(model_id="m1", val_size=0.1, test_size=0.1, min_count=1)


@pytest.fixture(scope="module")
def trained(tickets):
    return hierarchy.fit_hierarchy(tickets, CFG)


def test_kinds_of_heads(trained):
    mapping = {r["category"]: r for r in trained.mapping.collect()}
    assert {c: r["head_saved"] for c, r in mapping.items()} == {
        "water": True, "roads": True, "schools": True, "mono": True, "unique": True, "nan": True, "alone": False,
    }
    assert mapping["alone"]["dir_name"] is None and mapping["water"]["dir_name"].startswith("water__")
    heads = {}
    for r in trained.classes.where("category is not null").orderBy("category", "class_idx").collect():
        heads.setdefault(r["category"], []).append((r["label"], r["only_label"]))
    assert heads["water"] == [("service__SEP__billing", None), ("service__SEP__people", None)]
    assert heads["mono"] == [("__single__", "x__SEP__only")]
    assert heads["unique"] == [("__single__", None)]
    assert heads["nan"] == [("__single__", "nan__SEP__nan")]
    router = trained.classes.where("category is null").orderBy("class_idx")
    assert [r["label"] for r in router.collect()] == sorted(mapping)


def test_accuracy_floor(trained):
    stats = {r["category"]: r for r in trained.stats.collect()}
    assert set(stats) == {None, "water", "roads", "schools", "mono", "unique", "nan"}
    assert stats[None]["val_top1_acc"] >= 0.8 and stats[None]["val_top3_acc"] >= 0.9
    for cat in ("water", "roads", "schools"):
        assert stats[cat]["test_top1_acc"] >= 0.9
    assert stats["mono"]["note"] == "single-class head" and stats["mono"]["val_top1_acc"] is None


def test_summary(trained):
    row = hierarchy.train_summary(trained).first()
    assert row["kept_categories"] == ["alone", "mono", "nan", "roads", "schools", "unique", "water"]
    assert row["heads_saved"] == ["mono", "nan", "roads", "schools", "unique", "water"]
    assert 0.8 <= row["router_val_top1"] <= 1


def test_save_load_and_score(spark, trained, tickets, tmp_path):
    root = str(tmp_path / "models")
    model_store.save_model(trained, root)
    # a second model in the same root leaves the first alone
    other = model_store.ModelTables(
        *[getattr(trained, t).withColumn("model_id", F.lit("m2")) for t in model_store.TABLES]
    )
    model_store.save_model(other, root)
    model = model_store.load_model(model_store.open_tables(spark, root, "m1"))
    assert model.model_id == "m1" and set(model.heads) == {"water", "roads", "schools", "mono", "unique", "nan"}
    with pytest.raises(FileNotFoundError, match="m3"):
        model_store.open_tables(spark, root, "m3")
    with pytest.raises(FileNotFoundError):
        model_store.open_tables(spark, root + "-none", "m1")

    good = tickets.where("category in ('water','roads','schools') and text_obr rlike 'bill|staff'")
    reqs = good.select("category", "subissue", F.to_json(F.struct(F.col("text_obr").alias("text"))).alias("value"))
    top = F.col("predictions")[0]
    out = score_requests(reqs, [model], "m1").select(
        "category", "subissue", top["category"].alias("c"), top["subissues"][0]["subissue_unique"].alias("s")
    )
    n, right, right_sub = out.agg(
        F.count("*"), F.count_if(F.col("c") == F.col("category")), F.count_if(F.col("s") == F.col("subissue"))
    ).first()
    assert n == 360 and right >= 340 and right_sub >= 340


def test_rows_that_train(tickets):
    rows = hierarchy.prepare_rows(tickets, CFG)
    assert rows.count() == 370  # without bad grades and empty texts
    assert rows.where("category = 'nan'").select("label").distinct().first()[0] == "nan__SEP__nan"
    no_filter = replace(CFG, use_grade_filter=False)
    assert hierarchy.prepare_rows(tickets, no_filter).count() == 373
    assert hierarchy.prepare_rows(tickets.drop("grade"), CFG).count() == 373
    small = hierarchy.prepare_rows(tickets, replace(CFG, max_rows=50))
    assert small.count() == 50
    assert hierarchy.prepare_rows(tickets.drop("row_id"), CFG).select("row_id").distinct().count() == 370


def test_training_set_layout(tickets):
    rows = hierarchy.prepare_rows(tickets, CFG).withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))
    data = hierarchy.build_training_set(rows, F.col("x"), 2, CFG)
    assert data.rows.count() == 370
    parts = data.rows.groupBy(F.input_file_name().alias("f")).agg(
        F.count("*").alias("n"), F.count_distinct("cat_idx").alias("cats")
    )
    sizes = [r["n"] for r in parts.collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * 370 / len(sizes)  # the hot category is spread
    splits = {r["router_split"]: r["count"] for r in data.rows.groupBy("router_split").count().collect()}
    assert sum(splits.values()) == 370 and splits["train"] == 370 - 74
    heads = data.rows.where("head_idx is null").select("head_split").distinct().collect()
    assert [r[0] for r in heads] == [None]


def test_bad_sizes():
    with pytest.raises(ValueError, match="Invalid val/test sizes"):
        HierConfig(val_size=0.5, test_size=0.5)
    with pytest.raises(ValueError, match="Invalid val/test sizes"):
        HierConfig(val_size=0.0, test_size=0.0)


def test_trial_table_and_best(spark):
    trials = tune.trial_table(spark, 50, 42, CFG)
    rows = trials.collect()
    given = next(r for r in rows if r["trial"] == 0)
    assert (given["router_lr"], given["router_epochs"]) == (CFG.router_lr, CFG.router_epochs)
    assert all(5e-3 <= r["router_lr"] <= 0.5 and 10 <= r["router_epochs"] <= 80 for r in rows if r["trial"])
    assert len({r["router_lr"] for r in rows}) == 50 and len({r["router_epochs"] for r in rows}) > 20
    assert {(r["head_lr"], r["head_epochs"]) for r in rows} == {(CFG.head_lr, CFG.head_epochs)}
    scored = trials.withColumn("score", F.when(F.col("trial").isin(7, 3, 9), 0.9).otherwise(0.1))
    assert tune.best_trial(scored).first()["trial"] == 3


def test_tuning_retrains_with_the_best(tickets):
    space = tune.TuneSpace(lr_low=0.001, lr_high=0.2, epochs_low=2, epochs_high=12)
    trials, tables = tune.tune_hierarchy(tickets, replace(CFG, head_epochs=2, features=256), n_trials=3, space=space)
    rows = {r["trial"]: r for r in trials.collect()}
    router = tables.stats.where("category is null").first()
    best = max(r["score"] for r in rows.values() if r["finished"])
    assert len(rows) == 3 and rows[0]["finished"] and best >= rows[0]["score"]
    assert abs(router["val_top1_acc"] - best) < 1e-9


def test_tournament_stops_the_worse_half(spark, tickets, monkeypatch):
    prepared = hierarchy.prepare_rows(tickets, CFG)
    encoder, embedded = hierarchy.embed_rows(prepared, replace(CFG, features=64))
    data = hierarchy.build_training_set(embedded, F.col("x"), encoder.dim, CFG)
    cfg = replace(CFG, router_epochs=6)
    space = tune.TuneSpace(lr_low=1e-4, lr_high=0.3, epochs_low=4, epochs_high=8)
    rows = {r["trial"]: r for r in tune.run_trials(data, cfg, 6, space=space, rungs=(2, 4)).collect()}
    finished = {t for t, r in rows.items() if r["finished"]}
    assert 0 in finished and 2 <= len(finished) <= 3 and len(rows) == 6
    assert max(rows[t]["score"] for t in finished) >= rows[0]["score"]
    # models larger than a broadcast are scored in blocks, and no trial is stopped
    monkeypatch.setattr(linear, "MODEL_BYTES", 3 * 65 * 8)
    large = {r["trial"]: r for r in tune.run_trials(data, cfg, 1, space=space).collect()}
    assert abs(large[0]["score"] - rows[0]["score"]) < 1e-9


def test_tiny_heads(spark):
    rows = [("one", "a")] + [("mono", "a")] * 3 + [("uniq", c) for c in "abc"] + [("good", c) for c in "aabbc"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, category string, label string")
    sizes = encoding.label_sizes(df, "category", "label")
    plan = {r["category"]: (r["kind"], r["only_label"], r["train_rows"]) for r in encoding.head_plan(sizes, "category", "label").collect()}
    assert plan == {
        "one": ("none", None, 0), "mono": ("single", "a", 3), "uniq": ("single", None, 0), "good": ("trained", None, 4),
    }
    kept = encoding.head_training_rows(df, "category", "label", "row_id")
    assert kept.count() == 7
    codes = {(r["category"], r["label"]): r for r in encoding.label_codes(sizes).collect()}
    assert [codes[("good", c)]["head_idx"] for c in "abc"] == [0, 1, None]
    assert codes[("one", "a")]["head_idx"] is None and codes[("mono", "a")]["head_idx"] is None
    assert [codes[(c, "a")]["cat_idx"] for c in ("good", "mono", "one", "uniq")] == [0, 1, 2, 3]
    assert [codes[(c, "a")]["before"] for c in ("good", "mono", "one", "uniq")] == [0, 5, 8, 9]


def test_load_table(spark, tmp_path):
    path = tmp_path / "t.CSV"
    path.write_text('text_obr,category,grade\n"two\nlines, ""quoted""",c,5\nx,NA,n/a\n,null,4\n', encoding="utf-8")
    rows = [tuple(r) for r in load_table(spark, str(path)).collect()]
    assert rows == [('two\nlines, "quoted"', "c", "5"), ("x", None, None), (None, None, "4")]
    df = spark.createDataFrame([(1, "a")], "row_id long, text_obr string")
    df.write.parquet(str(tmp_path / "t.parquet"))
    assert load_table(spark, str(tmp_path / "t.parquet")).count() == 1
    with pytest.raises(FileNotFoundError):
        load_table(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="Unsupported format"):
        load_table(spark, str(tmp_path / "t.xlsx"))
