"""Records of CSV files with quoted line breaks, read in many tasks per file.

Spark can split a text file at line ends, but a line end inside quotes does not end a
record, and only the text before tells whether it is. A line is a function on two
states, outside and inside of quotes; lines of a split compose to one such
function. A first pass gives the function of each split, a scan over the splits of a file
gives the state in which each begins, and a second pass cuts records. What a
split's ends cut off are fragments, few and short, which are put together in file order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fields of a line from its beginning, up to one whose quotes stay open.
_CLOSED = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
OPEN_AT_END = regex.compile(rf'(?:{_CLOSED},)*+"(?:[^"]|"")*+')
# What follows up to the end of quotes that were open before the line.
REST_OF_QUOTES = regex.compile(r'(?:[^"]|"")*+("[^,]*+(,|$))?')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line, given whether they are at its beginning."""
    if inside:
        m = REST_OF_QUOTES.match(line)
        if m.group(1) is None:
            return True
        if not m.group(2):
            return False
        line = line[m.end() :]
    elif '"' not in line:
        return False
    return OPEN_AT_END.fullmatch(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str], bool]]:
    """(split, lines, whether they are its first) in order; a task can hold several splits."""
    seen = None
    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        lines = batch.column(2).to_pylist()
        at = 0
        while at < len(lines):
            end = at + 1
            while end < len(lines) and starts[end] == starts[at] and files[end] == files[at]:
                end += 1
            split = (files[at], starts[at])
            yield split, lines[at:end], split != seen
            seen, at = split, end


def _split_functions(lines: DataFrame) -> DataFrame:
    """(file, start, if_outside, if_inside): whether quotes are open after each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for split, part, _ in _runs(batches):
            a, b = found.get(split, (False, True))
            for line in part:
                a, b = ends_inside(line, a), (ends_inside(line, b) if a != b else ends_inside(line, a))
            found[split] = (a, b)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f for f, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()),
                pa.array([found[k][0] for k in keys], pa.bool_()), pa.array([found[k][1] for k in keys], pa.bool_()),
            ],
            ["file", "start", "if_outside", "if_inside"],
        )

    return lines.mapInArrow(run, "file string, start long, if_outside boolean, if_inside boolean")


def _begin_states(functions: DataFrame) -> dict[tuple[str, int], bool]:
    """The splits that begin inside quotes; one short row per split passes the driver."""
    states, file, inside = {}, None, False
    for r in functions.orderBy("file", "start").toLocalIterator():
        inside = inside and r["file"] == file
        file = r["file"]
        if inside:
            states[file, r["start"]] = True
        inside = r["if_inside"] if inside else r["if_outside"]
    return states


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first): every record of the files under ``path``, and whether it is the first of its file."""
    lines = _lines(spark, path)
    shared = spark.sparkContext.broadcast(_begin_states(_split_functions(lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, inside, fragment, top = None, [], False, False, False

        def rest() -> str:
            return "middle" if fragment else "first_tail" if top else "tail"

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()),
                    pa.array([r[2] for r in out], pa.string()), pa.array([r[3] for r in out], pa.string()),
                ],
                ["file", "start", "kind", "record"],
            )

        for now, part, first in _runs(batches):
            out = []
            if first:
                if held:  # the split before ends inside a record
                    out.append((*split, rest(), "\n".join(held)))
                split, held, inside = now, [], shared.value.get(now, False)
                fragment, top = inside, now[1] == 0
            for line in part:
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    kind = "head" if fragment else "first" if top else "whole"
                    out.append((*split, kind, "\n".join(held)))
                    held, fragment, top = [], False, False
            yield rows(out)
        if held:
            yield rows([(*split, rest(), "\n".join(held))])

    cut = lines.mapInArrow(run, "file string, start long, kind string, record string")
    # a record that crosses splits: a tail, middles, and a head
    pieces = cut.where("kind not in ('first', 'whole')")
    place = F.when(F.col("kind").isin("tail", "first_tail"), 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("start", "place")
    joined = (
        pieces.withColumn("place", place)
        .withColumn("number", F.sum("place").over(order))
        .groupBy("file", "number")
        .agg(F.sort_array(F.collect_list(F.struct("start", "place", "kind", "record"))).alias("parts"))
        .select(
            F.array_join(F.col("parts.record"), "\n").alias("record"),
            (F.col("parts.kind")[0] == "first_tail").alias("first"),
        )
    )
    whole = cut.where("kind in ('first', 'whole')").select("record", (F.col("kind") == "first").alias("first"))
    return whole.unionByName(joined).select(F.regexp_replace("record", "\r$", "").alias("record"), "first")
