"""A4/A5 for files of any size: JSON array files read by byte range.

A JSON array has no row separator, so the multi-line reader takes a file as one
task.  Here Spark's text reader cuts a file at every ``}`` byte, which it does
in parallel: a fragment belongs to the byte range in which it starts.  Whether
a ``}`` ends a record depends on what stands before it, which a first pass
settles: per range it reports how the range changes the two things that reach
across a border, being inside a string and the nesting depth (for either start,
outside or inside a string).  Running sums over the ranges of a file, one row
each, give every range its start state.  The second pass walks each range from
that state: a record that lies in it is emitted whole, one that crosses borders
as one piece a range, and the pieces are put together by the range in which
the record starts.

A file holds an array of objects or one object.  It is skipped whole if its
brackets do not close, if anything but objects stands in its array, or if a
record does not decode; for that the records are read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import broadcast_if_bounded
from .io import ARTICLE_JSON_SCHEMA, replace_table, scratch_path

ESCAPED = re.compile(rb"\\.", re.S)
OPENS = {0: re.compile(rb"\s*"), 1: re.compile(rb"\s*\[\s*")}
BETWEEN = re.compile(rb"\s*,\s*")
CLOSES = {0: re.compile(rb"\s*"), 1: re.compile(rb"\s*\]\s*")}
EMPTY = re.compile(rb"\s*\[\s*\]\s*")
RANGE = ["_file", "_block"]
STEPS = ("_file string, _block long, size long, bytes long, first string, flips long, "
         "change0 long, change1 long, least0 long, least1 long, last0 long, last1 long")
RECORDS = "_file string, _block long, _origin long, _pos long, whole boolean, value binary, bad boolean"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between ``}`` bytes, in file order within each range."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"),
                      F.col("_metadata.file_size").alias("size"),
                      F.col("value").cast("binary").alias("value"))


def write_json_arrays_streamed(rows: DataFrame, path: str) -> None:
    """The objects in ``value`` as JSON array files, one for each partition; a
    task streams its objects, so a file may be of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = "["
        for batch in batches:
            values = batch.column("value").to_pylist()
            if values:
                yield pa.record_batch([pa.array([opener + ",".join(values)])], names=["value"])
                opener = ","
        yield pa.record_batch([pa.array(["[]" if opener == "[" else "]"])], names=["value"])

    rows.mapInArrow(run, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)


def step(value: bytes, inside: bool) -> tuple[bool, int]:
    """Inside a string after the fragment?  And its change of depth, without the
    ``}`` behind it.  An escape never reaches over that byte."""
    parts = ESCAPED.sub(b"", value).split(b'"')
    depth = 0
    for part in parts[inside::2]:
        depth += part.count(b"{") + part.count(b"[") - part.count(b"]")
    return inside != (len(parts) % 2 == 0), depth


def range_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: its bytes, first character, quote parity, and for
    either start the change of depth, the least depth behind a ``}``, and
    whether the last ``}`` counted."""
    at, row = None, None

    def done():
        return pa.RecordBatch.from_pylist([dict(zip(names(STEPS), (*at, *row)))], schema=STEP_TYPES)

    for batch in batches:
        for file, block, size, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block, size) != at:
                if at is not None:
                    yield done()
                at, row, inside, depth = (file, block, size), [0, "", 0, 0, 0, None, None, 0, 0], [False, True], [0, 0]
            row[0] += len(value) + 1
            row[1] = row[1] or value.lstrip()[:1].decode("latin-1")
            for i in (0, 1):
                inside[i], change = step(value, inside[i])
                depth[i] += change - (not inside[i])
                row[7 + i] = int(not inside[i])
                if not inside[i]:
                    row[5 + i] = depth[i] if row[5 + i] is None else min(row[5 + i], depth[i])
            row[2:5] = [int(inside[0]), *depth]
    if at is not None:
        yield done()


STEP_TYPES = pa.schema([(n, pa.string() if n in ("_file", "first") else pa.int64()) for n in names(STEPS)])


def range_states(spark: SparkSession, path: str) -> DataFrame:
    """Start state of every range: inside a string, depth, the range in which an
    open record starts, and what holds for its file."""
    order = Window.partitionBy("_file").orderBy("_block")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_file")
    s = fragments(spark, path).mapInArrow(range_steps, STEPS)
    s = s.select("*", (F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1).alias("inside"),
                 (F.col("_block") == F.max("_block").over(whole)).alias("final"),
                 # is the last fragment of the file followed by "}"?
                 (F.sum("bytes").over(whole) == F.col("size")).alias("full"),
                 F.min_by("first", F.when(F.col("first") != "", F.col("_block"))).over(whole).alias("opens"))

    def by_start(name):
        return F.when(F.col("inside"), F.col(name + "1")).otherwise(F.col(name + "0"))

    spare = F.when(F.col("final") & ~F.col("full"), by_start("last")).otherwise(0)
    s = s.withColumn("change", by_start("change") + spare).withColumn("base", (F.col("opens") == "[").cast("long"))
    s = s.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    s = s.withColumn("ended", F.coalesce(F.col("depth") + by_start("least") <= F.col("base"), F.lit(False)))
    return s.select(
        *RANGE, "inside", "depth", "base", (F.col("final") & ~F.col("full")).alias("open_end"),
        F.coalesce(F.max(F.when(F.col("ended"), F.col("_block"))).over(before),
                   F.min("_block").over(whole)).alias("_origin"),
        ((F.sum("change").over(whole) == 0) & (F.sum("flips").over(whole) % 2 == 0)).alias("closes"))


class Walk:
    """One range: cuts its fragments into records and pieces of records."""

    def __init__(self, file, block, inside, depth, base, open_end, origin):
        self.file, self.block, self.inside, self.depth = file, block, inside, depth
        self.base, self.open_end, self.origin = base, open_end, origin
        # inside a record, or at the very start of a file (depth 0 before its "[")
        self.joined = depth > base
        self.text: list[bytes] = []
        self.start, self.index, self.fresh = None, 0, block == 0
        self.rows: list[tuple] = []

    def put(self, whole: bool, bad: bool = False) -> None:
        self.rows.append((self.file, self.block, self.origin, self.start, whole, b"".join(self.text), bad))

    def between(self, value: bytes, followed: bool) -> bytes | None:
        """What stands between records; returns the start of the next one."""
        at = value.find(b"{")
        if at < 0:
            ok = not followed and (CLOSES[self.base].fullmatch(value) if not self.fresh
                                   else EMPTY.fullmatch(value) or not value.strip())
            if not ok:
                self.put(True, bad=True)
            return None
        allowed = OPENS[self.base] if self.fresh else BETWEEN
        if not allowed.fullmatch(value[:at]) or (not self.fresh and not self.base):
            self.put(True, bad=True)
        self.depth, self.fresh, self.start = self.base, False, self.block + self.index
        return value[at:]

    def add(self, value: bytes, followed: bool) -> None:
        if not self.text and not self.joined:
            value = self.between(value, followed)
            if value is None:
                self.index += 1
                return
        self.inside, change = step(value, self.inside)
        self.depth += change - (followed and not self.inside)
        self.text.append(value + b"}" if followed else value)
        self.index += 1
        if followed and not self.inside and self.depth <= self.base:
            self.put(not self.joined)
            self.text, self.joined, self.start, self.origin = [], False, None, self.block

    def end(self) -> None:
        if self.text:
            if not self.joined:
                self.origin = self.block
            self.put(False)


def walk_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, at, held = None, None, None

    def flush(rows):
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, RECORD_TYPES)], schema=RECORD_TYPES)

    def finish():
        walk.add(held, not walk.open_end)
        walk.end()

    for batch in batches:
        for file, block, value, *state in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if walk is not None:
                    finish()
                    if walk.rows:
                        yield flush(walk.rows)
                walk, at = Walk(file, block, *state), (file, block)
            else:
                walk.add(held, True)
            held = value
        if walk is not None and walk.rows:
            yield flush(walk.rows)
            walk.rows = []
    if walk is not None:
        finish()
        if walk.rows:
            yield flush(walk.rows)


RECORD_TYPES = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_origin", pa.int64()),
                          ("_pos", pa.int64()), ("whole", pa.bool_()), ("value", pa.binary()), ("bad", pa.bool_())])


def split_records(spark: SparkSession, path: str, max_bytes: int = 64 << 20) -> DataFrame:
    """``(_file, _pos, value, bad)``: the text of every record, and a bad row for
    what is not one.  ``_pos`` ascends in file order."""
    # one row a range, stored: read three times, and counted before it is broadcast
    states = replace_table(range_states(spark, path), scratch_path(spark, "json-ranges"))
    side = broadcast_if_bounded(states, max_bytes, states.count())
    rows = fragments(spark, path).withColumn("_n", F.monotonically_increasing_id()).join(side, RANGE)
    if side is states:   # too many ranges to broadcast: the join has dealt the fragments anew
        rows = rows.repartition(*RANGE).sortWithinPartitions(*RANGE, "_n")
    found = rows.select(*RANGE, "value", "inside", "depth", "base", "open_end", "_origin") \
        .mapInArrow(walk_ranges, RECORDS)
    whole = found.where("whole").select("_file", "_pos", "value", "bad")
    pieces = F.array_sort(F.collect_list(F.struct("_block", "value")))
    joined = (found.where("NOT whole").groupBy("_file", "_origin")
              .agg(F.min("_pos").alias("_pos"), pieces.alias("p"))
              .select("_file", "_pos", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["value"])).alias("value"),
                      F.lit(False).alias("bad")))
    broken = states.where("NOT closes").groupBy("_file").agg(F.min("_block").alias("_pos")) \
        .select("_file", "_pos", F.lit(b"").alias("value"), F.lit(True).alias("bad"))
    return whole.unionByName(joined).unionByName(broken)


def read_json_splits(spark: SparkSession, path: str, schema=ARTICLE_JSON_SCHEMA) -> DataFrame:
    """As ``io.read_json_articles``, by byte range instead of by file.  A nested
    value under a text column comes without white space between its tokens."""
    records = split_records(spark, path)
    parsed = records.select("_file", "_pos", "bad", F.from_json(
        F.col("value").cast("string"), schema,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    parsed = parsed.withColumn("bad", F.col("bad") | F.col("r._corrupt_record").isNotNull())
    skipped = parsed.where("bad").select("_file").distinct()
    return (parsed.join(skipped, "_file", "left_anti").select("r.*", "_file", "_pos")
            .drop("_corrupt_record").withColumn("id", F.expr("try_cast(id AS BIGINT)")))
