"""CSV records (RFC 4180) of large files, cut by many tasks.

A quoted field may hold line breaks, so whether a line begins a record depends on all lines
before it. But it depends on them through one bit, whether a quote is open, and a block of
lines maps that bit to a bit. So every block is walked once for both cases (open or not at
its start), the blocks of a file are chained, and a second pass cuts the blocks' records
knowing how each begins. Both passes run over Spark's splits; only one small row a block is
ever put in order. A record that reaches over a block's end is put together from its pieces.

A quote opens a field only at the field's start and is doubled inside; elsewhere it is text.
Lines end with a line feed, with or without a carriage return before it. Blank lines outside
fields are no records. An unclosed quote takes the rest of its file."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.functions.expr import null_if_token
from carelake.session import cut_lineage

#: Blocks whose table is broadcast (some 100 bytes each); beyond that lines meet it by a shuffle.
BROADCAST_BLOCKS = 500_000


def _cutting():
    """The functions that tasks run, made here so that they travel by value."""

    def after(line: str, is_open: bool) -> bool:
        """Whether a quote is open after the line."""
        at = 0
        while True:
            if not is_open:
                if line.startswith('"', at):
                    is_open, at = True, at + 1
                    continue
            else:
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('"', at + 1):
                    at += 2
                    continue
                is_open = False
            at = line.find(",", at) + 1
            if not at:
                return False

    def runs(batches: Iterator[pa.RecordBatch]):
        """(path, block, lines, whether each holds a quote, further columns' first values)."""
        for b in batches:
            if not b.num_rows:
                continue
            paths, starts = b.column("path").to_pylist(), b.column("block").to_pylist()
            lines, quoted = b.column("value").to_pylist(), pc.match_substring(b.column("value"), '"').to_pylist()
            begin = 0
            for i in range(1, len(lines) + 1):
                if i == len(lines) or starts[i] != starts[begin] or paths[i] != paths[begin]:
                    yield paths[begin], starts[begin], lines[begin:i], quoted[begin:i], b.slice(begin, 1)
                    begin = i

    def blank(line: str) -> bool:
        return line == "" or line == "\r"

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per block and case: the records that begin in it, and whether a quote is open at its end."""
        found: dict[tuple, list] = {}
        for path, start, lines, quoted, _ in runs(batches):
            cases = found.setdefault((path, start), [[0, False], [0, True]])
            for case in cases:
                n, is_open = case
                for line, q in zip(lines, quoted, strict=True):
                    if not is_open and not blank(line):
                        n += 1
                    if q:
                        is_open = after(line, is_open)
                case[:] = n, is_open
        keys = list(found)
        yield pa.RecordBatch.from_pydict({
            "path": pa.array([p for p, _ in keys], pa.string()), "block": pa.array([s for _, s in keys], pa.int64()),
            "n_shut": pa.array([found[k][0][0] for k in keys], pa.int64()), "n_open": pa.array([found[k][1][0] for k in keys], pa.int64()),
            "shut_ends": pa.array([found[k][0][1] for k in keys], pa.bool_()), "open_ends": pa.array([found[k][1][1] for k in keys], pa.bool_())})

    def chain(key, blocks):
        """How each block of a file begins: open or not, and after how many records."""
        rows, is_open, n, out = blocks.sort_by("block").to_pylist(), False, 0, []
        for r in rows:
            out.append((is_open, n))
            n, is_open = (n + r["n_open"], r["open_ends"]) if is_open else (n + r["n_shut"], r["shut_ends"])
        return pa.table({"path": pa.array([r["path"] for r in rows], pa.string()), "block": pa.array([r["block"] for r in rows], pa.int64()),
                         "is_open": pa.array([o for o, _ in out], pa.bool_()), "before": pa.array([b for _, b in out], pa.int64()),
                         "in_file": pa.array([n] * len(rows), pa.int64())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, place, block, text, whole): records, and pieces of those over a block's end."""
        out, held, at = [], None, None

        def flush(whole: bool):
            if held is not None and held[2]:
                out.append((at[0], held[0], at[1], "\n".join(held[2]), whole and held[1]))

        def ready():
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["path", "place", "block", "text", "whole"])

        for path, start, lines, quoted, first in runs(batches):
            if (path, start) != at:
                flush(held is not None and not held[3])
                at = (path, start)
                is_open, n = first.column("is_open")[0].as_py(), first.column("before")[0].as_py()
                held = [n - 1, False, [], is_open]  # place, begun here, lines, still open
            for line, q in zip(lines, quoted, strict=True):
                if not held[3]:
                    if blank(line):
                        continue
                    flush(True)
                    held = [held[0] + 1, True, [], False]
                held[2].append(line)
                if q:
                    held[3] = after(line, held[3])
            if len(out) >= 4096:
                yield ready()
        if held is not None:
            flush(not held[3])
        if out:
            yield ready()

    return survey, chain, cut


def csv_records(spark: SparkSession, paths) -> DataFrame:
    """(path, place, row_id, text): every record of the files; ``place`` counts in the file
    from 0, which is the header, and ``row_id`` counts data records over all files by path
    (null for headers)."""
    survey, chain, cut = _cutting()
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = cut_lineage(
        lines.mapInArrow(survey, "path string, block long, n_shut long, n_open long, shut_ends boolean, open_ends boolean")
        .groupBy("path").applyInArrow(chain, "path string, block long, is_open boolean, before long, in_file long"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # over one row a file
    files = blocks.groupBy("path").agg(F.max("in_file").alias("n")).select(
        "path", F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(earlier), F.lit(0)).alias("_offset"))
    starts = blocks.select("path", "block", "is_open", "before")
    if blocks.count() <= BROADCAST_BLOCKS:
        begun = lines.join(F.broadcast(starts), ["path", "block"])
    else:
        begun = (lines.withColumn("_line", F.monotonically_increasing_id()).join(starts, ["path", "block"])
                 .repartition("path", "block").sortWithinPartitions("path", "block", "_line"))
    pieces = cut_lineage(begun.select("path", "block", "value", "is_open", "before")
                         .mapInArrow(cut, "path string, place long, block long, text string, whole boolean"))
    joined = (pieces.where("NOT whole").groupBy("path", "place").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
              .select("path", "place", F.array_join(F.col("p.text"), "\n").alias("text")))
    every = pieces.where("whole").select("path", "place", "text").unionByName(joined)
    return (every.join(F.broadcast(files), "path")  # one row a file: records stay spread, however few the files
            .select("path", "place", F.when(F.col("place") > 0, F.col("place") - 1 + F.col("_offset")).alias("row_id"),
                    F.regexp_replace("text", "\r$", "").alias("text")))


def header_names(text: str) -> list[str]:
    """The names in a header; one without a name, or whose name is there twice, gets its place."""
    names = next(csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")), [])
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def by_header(spark: SparkSession, paths, resolve=None) -> DataFrame:
    """(row_id, columns...): the data records of files that each have a header of their own,
    as text. ``resolve`` maps the names of a header to column names (several may get one
    name; then the first value that is no placeholder counts). One pass reads all files; its
    columns choose by the file's header, so only distinct headers make the plan larger."""
    records = cut_lineage(csv_records(spark, paths))
    headers = records.where("place = 0").select("path", F.col("text").alias("_header"))
    distinct = sorted(r[0] for r in headers.select("_header").distinct().collect())
    layouts = [header_names(h) for h in distinct]
    named = [[resolve(names)[n] for n in names] if resolve else names for names in layouts]
    order = list(dict.fromkeys(c for names in named for c in names))
    width = max(map(len, layouts), default=0)
    if not width:
        return records.select("row_id").limit(0)
    numbers = spark.createDataFrame(list(enumerate(distinct)), "_sig int, _header string")
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = (records.where("place > 0").join(F.broadcast(headers.join(F.broadcast(numbers), "_header").select("path", "_sig")), "path")
              .select("row_id", "_sig", F.from_csv("text", schema, {"quote": '"', "escape": '"'}).alias("r")))

    def value(name: str) -> Column:
        out = None
        for k, names in enumerate(named):
            at = [F.col(f"r.c{i}") for i, n in enumerate(names) if n == name]
            if at:
                found = at[0] if len(at) == 1 else F.coalesce(*[null_if_token(c) for c in at])
                out = found if len(named) == 1 else F.when(F.col("_sig") == k, found) if out is None else out.when(F.col("_sig") == k, found)
        return out.alias(name)

    return parsed.select("row_id", *[value(c) for c in order])
