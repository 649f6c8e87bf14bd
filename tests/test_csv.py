import csv
import io
import random

import pytest

from labelway.sources.csv_records import csv_records, ends_inside
from labelway.sources.tables import load_table


def test_state_of_quotes():
    cases = [
        ('a,b', False, False), ('a,"b', False, True), ('a,"b"', False, False), ('a,"b""', False, True),
        ('a,"b""",c', False, False), ('5" pipe,x', False, False), ('5" pipe,"x', False, True), ('', False, False),
        ('still open', True, True), ('end",x', True, False), ('end","x', True, True), ('say ""hi""', True, True),
        ('', True, True), ('"', True, False), ('"",x', True, True), ('end"', True, False), ('"x",y"', False, False),
    ]
    for line, before, after in cases:
        assert ends_inside(line, before) is after, (line, before)


def make(rng, n, end):
    cells = ["plain", "", "with, comma", 'say "hi"', "two\nlines", 'a\n"\n,b', " spaced ", "x" * 70, "Я\nя", "\n\n"]
    rows = [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(n)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["id", "a b", "c"])
    writer.writerows(rows)
    return rows, out.getvalue()


@pytest.mark.parametrize("size, end", [(50, "\n"), (300, "\r\n")])
def test_split_files_equal_one_reader(spark, tmp_path, size, end):
    want = []
    for i in range(2):
        rows, text = make(random.Random(10 * size + i), 6 * size // 5 + 20, end)
        want += [tuple(v if v else None for v in r) for r in rows]
        (tmp_path / f"part{i}.csv").write_text(text, encoding="utf-8", newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path / "part*.csv")
        records = csv_records(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 15
        assert records.where("first").count() == 2
        df = load_table(spark, path)
        assert df.columns == ["id", "a b", "c"]
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
