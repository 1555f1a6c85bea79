"""Processing only new or changed records: processed sequence numbers as disjoint intervals.

A record's sequence number counts as processed while its current version has been; intervals of processed
numbers are subtracted from the available ranges, and the gaps are the work, late commits included. A run's
output and its merged intervals are published together, by one file that only one run can claim, so a run that fails at any point
leaves the ledger as it was: nothing is skipped, nothing is done twice.

All interval arithmetic is per (lane, block of 2**BLOCK_BITS numbers), so every window is bounded; equal
numbers are combined map-side before it. Defined cases: null numbers or lanes are left out; empty inputs
give no rows; repeated rows count once; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterloom.session import checkpoint_dir, written

BLOCK_BITS = 13
INTERVALS = "lane string, lo long, hi long"


def intervals(numbers: DataFrame, lane: str = "lane", seq: str = "seq", block_bits: int = BLOCK_BITS) -> DataFrame:
    """lane, block, lo, hi: the numbers as disjoint closed intervals, cut at block borders."""
    one = numbers.select(F.col(lane).alias("lane"), F.col(seq).cast("long").alias("seq")).dropna().distinct().withColumn("block", F.shiftright("seq", block_bits))
    island = F.col("seq") - F.row_number().over(Window.partitionBy("lane", "block").orderBy("seq"))
    return one.withColumn("island", island).groupBy("lane", "block", "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).drop("island")


def cut_at_blocks(ranges: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """lane, block, lo, hi: intervals of any length, cut at block borders."""
    block = F.explode(F.sequence(F.shiftright("lo", block_bits), F.shiftright("hi", block_bits)))
    return ranges.where("lo <= hi").select("lane", "lo", "hi", block.alias("block")).select(
        "lane", "block", F.greatest("lo", F.shiftleft("block", block_bits)).alias("lo"), F.least("hi", F.shiftleft(F.col("block") + 1, block_bits) - 1).alias("hi")
    )


def _sweep(left: DataFrame, right: DataFrame) -> DataFrame:
    """lane, block, lo, hi, in_left, in_right: maximal pieces between the ends of any interval."""
    ends = []
    for side, df in (("l", left), ("r", right)):
        zero = F.lit(0)
        for column, step in (("lo", 1), ("hi", -1)):
            at = F.col(column) + (0 if step == 1 else 1)
            ends.append(df.select("lane", "block", at.alias("at"), (F.lit(step) if side == "l" else zero).alias("l"), (F.lit(step) if side == "r" else zero).alias("r")))
    union = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3])
    steps = union.groupBy("lane", "block", "at").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    order = Window.partitionBy("lane", "block").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = steps.select("lane", "block", F.col("at").alias("lo"), (F.lead("at").over(order) - 1).alias("hi"), (F.sum("l").over(so_far) > 0).alias("in_left"), (F.sum("r").over(so_far) > 0).alias("in_right"))
    return pieces.where(F.col("hi").isNotNull())


def subtract(available: DataFrame, processed: DataFrame) -> DataFrame:
    """lane, block, lo, hi: what is available and not processed. Both sides cut at block borders."""
    return _sweep(available, processed).where("in_left AND NOT in_right").select("lane", "block", "lo", "hi")


def merge(one: DataFrame, other: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """lane, block, lo, hi: the union as disjoint intervals; neighbours inside a block are joined."""
    pieces = _sweep(one, other).where("in_left OR in_right").select("lane", "block", "lo", "hi")
    order = Window.partitionBy("lane", "block").orderBy("lo")
    starts = pieces.withColumn("start", F.coalesce((F.lag("hi").over(order) < F.col("lo") - 1).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("lane", "block", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def numbers(gaps: DataFrame) -> DataFrame:
    """lane, seq: the single numbers of the intervals (at most 2**BLOCK_BITS each)."""
    return gaps.select("lane", F.explode(F.sequence("lo", "hi")).alias("seq"))


def pending(available: DataFrame, processed: DataFrame) -> DataFrame:
    """lane, seq of the records to process: available numbers (lane, seq) minus processed ones (lane, seq)."""
    return numbers(subtract(intervals(available), intervals(processed)))


class Ledger:
    """Processed intervals kept beside the output of the runs, in one folder of a shared file system.

    ``state.<n>`` is a small file that names the run whose folder holds the valid intervals; the largest n holds. A run
    writes its output and intervals first and then claims the next number: the file appears whole or not at all, and of two
    runs that started from one state only one can claim it, so neither loses the other's intervals. Folders of broken or
    beaten runs are never named and so never read. Every ``FOLD`` runs the earlier outputs are written together."""

    FOLD = 64

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        at = self._path(self.folder)
        numbers = [int(n) for f in (self._fs.listStatus(at) if self._fs.exists(at) else []) if (n := f.getPath().getName().removeprefix("state.")).isdigit()]
        if not numbers:
            return {"number": 0, "run": None, "outputs": []}
        stream = self._fs.open(self._path(f"{self.folder}/state.{max(numbers)}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def processed(self) -> DataFrame:
        """lane, block, lo, hi of all published runs."""
        return self._processed(self._state())

    def _processed(self, state: dict) -> DataFrame:
        if state["run"] is None:
            return cut_at_blocks(self.spark.createDataFrame([], INTERVALS))
        return cut_at_blocks(self.spark.read.schema(INTERVALS).parquet(f"{self.folder}/runs/{state['run']}/intervals"))

    def output(self) -> DataFrame | None:
        """The output rows of all published runs; None before the first."""
        return self._output(self._state())

    def _output(self, state: dict) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.folder}/runs/{part}" for part in state["outputs"]]) if state["outputs"] else None

    def adopt(self, done: DataFrame) -> str:
        """Take over what was processed before there was a ledger: done has lane and seq."""
        state, run = self._state(), uuid.uuid4().hex
        own = intervals(done)
        (own if state["run"] is None else merge(self._processed(state), own)).select("lane", "lo", "hi").write.parquet(f"{self.folder}/runs/{run}/intervals")
        self._publish({"number": state["number"] + 1, "run": run, "outputs": state["outputs"]})
        return run

    def run(self, available: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Process the gaps and publish: available has lane and seq; process gets the (lane, seq) to do and returns rows to
        write. Returns the rows written."""
        state, run = self._state(), uuid.uuid4().hex
        gaps = subtract(intervals(available), self._processed(state))
        at = f"{self.folder}/runs/{run}"
        # the work list is written first: what is committed is exactly what was processed, whatever arrives meanwhile
        gaps.write.parquet(f"{at}/work")
        work = self.spark.read.schema("lane string, block long, lo long, hi long").parquet(f"{at}/work")
        process(numbers(work)).write.parquet(f"{at}/output")
        merge(self._processed(state), work).select("lane", "lo", "hi").write.parquet(f"{at}/intervals")
        outputs = state["outputs"]
        if len(outputs) >= self.FOLD:
            self._output(state).write.parquet(f"{at}/earlier")
            outputs = [f"{run}/earlier"]
        self._publish({"number": state["number"] + 1, "run": run, "outputs": [*outputs, f"{run}/output"]})
        return self.spark.read.parquet(f"{at}/output")

    def _publish(self, new: dict) -> None:
        draft, target = self._path(f"{self.folder}/draft.{new['run']}"), self._path(f"{self.folder}/state.{new['number']}")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(new).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename would replace the other run's file
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                context.rename(draft, target, options)
        except (OSError, Py4JJavaError) as e:
            raise RuntimeError("another run was published meanwhile; this one is void") from e


def current_assets(assets: DataFrame) -> DataFrame:
    """The row with the latest seen_at per asset (ties: the largest fingerprint), with kind and format, and last_seen."""
    fields = ["source_modified_ns", "source_size", "media_kind", "media_format"]
    latest = F.max(F.struct("seen_at", *fields))
    return assets.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(latest.alias("row")).select("asset_id", F.col("row.seen_at").alias("last_seen"), *[F.col(f"row.{f}").alias(f) for f in fields])


def pending_text_assets(assets: DataFrame, pruned: DataFrame, recognised: DataFrame, state: DataFrame, spaces: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """space, asset_id: the recognised assets that the next embedding run of each space must process.

    A sequence number is an asset_id; it counts as processed in a space while the state holds the current
    row's fingerprint with an embedding, whatever the outcome of the run that wrote it. What was processed is taken over
    into the ledger (a new one in the shared folder if none is given), the gaps of the available ranges are the run's
    work, and the work list is published with the merged intervals."""
    gone = pruned.where(F.col("asset_id").isNotNull()).groupBy("asset_id").agg(F.max("pruned_at").alias("gone"))
    texts = recognised.where(F.trim("content") != "").select("asset_id").distinct()
    now = current_assets(assets)
    eligible = (F.col("media_kind") == "image") & F.col("media_format").isin("png", "jpeg", "gif", "webp")
    current = now.where(eligible).join(gone, "asset_id", "left").where(F.col("gone").isNull() | (F.col("gone") <= F.col("last_seen"))).join(texts, "asset_id", "left_semi").select("asset_id", "source_modified_ns", "source_size")
    current = written(current)
    done = state.where(F.col("embedding").isNotNull()).select("space", "asset_id", "source_modified_ns", "source_size").distinct()
    lanes = spaces.select("space").dropna().distinct()
    ledger = ledger or Ledger(assets.sparkSession, f"{checkpoint_dir(assets.sparkSession)}/ledger-{uuid.uuid4().hex}")
    ledger.adopt(current.join(done, ["asset_id", "source_modified_ns", "source_size"]).select(F.col("space").alias("lane"), F.col("asset_id").alias("seq")))
    available = _each_space(current, lanes).select(F.col("space").alias("lane"), F.col("asset_id").alias("seq"))
    return ledger.run(available, lambda todo: todo.select(F.col("lane").alias("space"), F.col("seq").alias("asset_id")))


def _each_space(current: DataFrame, lanes: DataFrame) -> DataFrame:
    """One row for each space and asset: the spaces are collected (refused beyond 1,000) and exploded as a literal."""
    names = [r[0] for r in lanes.limit(1001).collect()]
    if len(names) > 1000:
        raise ValueError("more than 1,000 declared spaces")
    if not names:
        return current.withColumn("space", F.lit("")).where(F.lit(False))
    return current.withColumn("space", F.explode(F.array(*[F.lit(n) for n in sorted(names)])))
