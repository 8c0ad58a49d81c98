"""Processing of new or changed records: sequence numbers already processed are kept as disjoint intervals.

A ledger is a DataFrame `(lo bigint, hi bigint)` of closed, disjoint, non-adjacent intervals. What a run must
process is the source minus the ledger, holes included, so that a record committed late, below the highest
number seen, is still found. Intervals are merged, subtracted and looked up by blocks of sequence numbers, in
whole numbers throughout (a double can't tell numbers above 2**53 apart), by sorting, never by all pairs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.functions.text import digest
from weftmark.operators.versions import SECTION_KEY, current_versions

#: Sequence numbers per block of intervals, and blocks per block of the next level. Both are powers of two.
BLOCK = FAN = 1 << 16

#: The greatest sequence number.
LAST = (1 << 63) - 1

#: A ledger of at most this many interval pieces (24 bytes each) is broadcast; a larger one is joined by blocks.
BROADCAST_PIECES = 20_000

LEDGER = "lo bigint, hi bigint"

#: Runs that one commit file of a ledger names at most.
SUMMARY = 64

#: Groups of keys that are numbered apart, and numbers each of them has.
GROUPS, SPAN = 1 << 14, 1 << 40


def _block(x: str, block: int) -> Column:
    """The block of a number: a division rounded down that never leaves the whole numbers."""
    return F.expr(f"CAST(`{x}` DIV {block}L - IF(`{x}` % {block}L < 0, 1, 0) AS BIGINT)")


def _islands(parts: DataFrame, by: str = "_b") -> DataFrame:
    """Merges overlapping and adjacent intervals that share a value of `by`."""
    w = Window.partitionBy(by).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = reach.isNull() | ((reach < F.lit(LAST)) & (F.col("lo") > reach + 1))
    return (
        parts.withColumn("_new", F.when(apart, 1).otherwise(0))
        .withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(by, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def _blocks(intervals: DataFrame, block: int) -> DataFrame:
    """Cuts intervals at block borders; column `_b` is the block."""
    b = F.col("_b") * F.lit(block)
    return (
        intervals.where(F.col("lo") <= F.col("hi"))
        .withColumn("_b", F.explode(F.sequence(_block("lo", block), _block("hi", block))))
        .select("_b", F.greatest("lo", b).alias("lo"), F.least("hi", b + F.lit(block - 1)).alias("hi"))
    )


def intervals_of(df: DataFrame, seq: str, block: int = BLOCK) -> DataFrame:
    """The sequence numbers of `df` as disjoint intervals. Null numbers are left out; repeats count once."""
    points = df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("bigint").alias("lo")).distinct()
    return merge_intervals(points.withColumn("hi", F.col("lo")), block=block)


def merge_intervals(*ledgers: DataFrame, block: int = BLOCK) -> DataFrame:
    """The union of ledgers, as disjoint, non-adjacent intervals.

    Islands are found within blocks, in parallel. Of these only the ones that touch a border of their block are
    merged again, within blocks of `FAN` blocks, and so on: no group ever holds more than two intervals for each
    of its `FAN` parts. A block that covers all numbers ends it.
    """
    both = ledgers[0].select("lo", "hi")
    for x in ledgers[1:]:
        both = both.unionByName(x.select("lo", "hi"))
    found, size = _islands(_blocks(both, block)).select(F.struct(F.lit(0).alias("level"), F.col("_b").alias("b")).alias("_b"), "lo", "hi"), block
    level = 0
    while size < 1 << 62:
        wider, level = min(size * FAN, 1 << 62), level + 1
        # what ends inside its block stays in its group; an island of this level touches a border of it or ends inside
        low = _block("lo", size) * F.lit(size)
        touches = (F.col("_b.level") == level - 1) & ((F.col("lo") == low) | (F.col("hi") == _block("hi", size) * F.lit(size) + F.lit(size - 1)))
        up = F.struct(F.lit(level).alias("level"), _block("lo", wider).alias("b"))
        found, size = _islands(found.withColumn("_b", F.when(touches, up).otherwise(F.col("_b")))), wider
    # the few that touch the last borders
    return _islands(found.withColumn("_b", F.when(F.col("_b.level") == level, F.lit(None)).otherwise(F.col("_b")))).select("lo", "hi")


def gaps_of(ledger: DataFrame, by: str) -> DataFrame:
    """(by, lo, hi): what lies between the intervals of a group, below its first and above its last.

    `ledger(by, lo, hi, first, last)` has the intervals of a group and the range that is available in it; an
    interval that is null says that nothing of the range is processed.
    """
    w = Window.partitionBy(by).orderBy("lo")
    end = F.lag("hi").over(w)
    rows = ledger.withColumn("_from", F.coalesce(end + 1, F.col("first"))).withColumn("_top", F.lead("lo").over(w).isNull())
    below = F.struct(F.col("_from").alias("lo"), F.coalesce(F.col("lo") - 1, F.col("last")).alias("hi"))
    above = F.when(F.col("_top") & F.col("hi").isNotNull(), F.struct((F.col("hi") + 1).alias("lo"), F.col("last").alias("hi")))
    return rows.select(by, F.explode(F.array_compact(F.array(below, above))).alias("g")).select(by, "g.lo", "g.hi").where("lo <= hi")


def _held(df: DataFrame, seq: str, ledger: DataFrame, inside: bool, block: int) -> DataFrame:
    pieces = ledger.limit(BROADCAST_PIECES + 1).collect()
    how = "left_semi" if inside else "left_anti"
    if len(pieces) <= BROADCAST_PIECES:
        # a small ledger may be one block, which would send all rows to one task
        cut = F.broadcast(_blocks(df.sparkSession.createDataFrame(pieces, LEDGER), block))
        cut = cut.select(F.col("_b").alias("_lb"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        rows = df.withColumn("_s", F.col(seq).cast("bigint"))
        return rows.join(cut, (_block("_s", block) == F.col("_lb")) & (F.col("_s") >= F.col("_lo")) & (F.col("_s") <= F.col("_hi")), how).drop("_s")
    # a large one is sorted together with the distinct numbers; a number is inside if the last start before it reaches it
    cut = _blocks(ledger, block).select("_b", F.col("lo").alias("_s"), "hi", F.lit(0).alias("_kind"))
    numbers = df.select(F.col(seq).cast("bigint").alias("_s")).where("_s IS NOT NULL").distinct()
    numbers = numbers.select(_block("_s", block).alias("_b"), "_s", F.lit(None).cast("bigint").alias("hi"), F.lit(1).alias("_kind"))
    w = Window.partitionBy("_b").orderBy("_s", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.unionByName(numbers).withColumn("_reach", F.last("hi", ignorenulls=True).over(w))
    known = marked.where((F.col("_kind") == 1) & (F.col("_reach") >= F.col("_s"))).select(F.col("_s").alias("_known"))
    return df.join(known, F.col(seq).cast("bigint") == F.col("_known"), how)


def covered(df: DataFrame, seq: str, ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows whose number lies in the ledger; a null number lies in none."""
    return _held(df, seq, ledger, True, block)


def pending(df: DataFrame, seq: str, ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows whose number lies in a gap of the ledger: below, between and above its intervals."""
    return _held(df.where(F.col(seq).isNotNull()), seq, ledger, False, block)


class Ledger:
    """A ledger in a folder of the shared file system, committed together with the output.

    Layout: `batches/<id>/` holds the output of a run, `ledgers/<id>/` the merged intervals, and
    `commits/<n>.json` names both, and the runs before it up to the last multiple of `SUMMARY`, so that a reader
    opens one file for so many runs. The commit file appears by one rename, so a run that dies before it leaves
    nothing that readers see, and its numbers stay pending; a run that dies after it is complete. Two runs at
    once: the rename of the second fails, and with it that run, before its output is visible.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def _commits(self) -> list[str]:
        files = self._fs.listStatus(self._path(f"{self.root}/commits"))
        return sorted(str(f.getPath()) for f in files if str(f.getPath()).endswith(".json"))

    def _read(self, path: str) -> dict:
        stream = self._fs.open(self._path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def intervals(self) -> DataFrame:
        commits = self._commits()
        if not commits:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledgers/{self._read(commits[-1])['ids'][-1]}")

    def output(self) -> DataFrame | None:
        """The output of all committed runs, or None before the first."""
        commits = self._commits()
        last = self._read(commits[-1]) if commits else {"ids": []}
        ids = [i for n in range(SUMMARY - 1, len(commits) - len(last["ids"]), SUMMARY) for i in self._read(commits[n])["ids"]] + last["ids"]
        return self.spark.read.parquet(*[f"{self.root}/batches/{i}" for i in ids]) if ids else None

    def drop(self) -> None:
        """Deletes the ledger and all it holds."""
        self._fs.delete(self._path(self.root), True)

    def run(self, source: DataFrame, seq: str, process: Callable[[DataFrame], DataFrame]) -> str:
        """Processes the rows of `source` that are pending, and commits output and ledger; returns the batch id."""
        commits, batch = self._commits(), uuid.uuid4().hex
        ledger = self.intervals()
        # written first: the numbers to commit and the rows processed must be of one snapshot of the source
        taken = f"{self.root}/taken/{batch}"
        pending(source, seq, ledger).write.parquet(taken)
        rows = self.spark.read.schema(source.schema).parquet(taken)
        process(rows).write.parquet(f"{self.root}/batches/{batch}")
        merge_intervals(ledger, intervals_of(rows, seq)).write.parquet(f"{self.root}/ledgers/{batch}")
        self._commit(len(commits), batch)
        self._fs.delete(self._path(taken), True)
        return batch

    def _commit(self, n: int, batch: str) -> None:
        before = self._read(self._commits()[n - 1])["ids"] if n % SUMMARY else []
        temp, final = (self._path(f"{self.root}/commits/{x}") for x in (f".{batch}.tmp", f"{n:09d}.json"))
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps({"ids": [*before, batch]}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temp, final):
            self._fs.delete(temp, False)
            raise RuntimeError(f"commit {n} was made by another run; batch {batch} stays invisible")


def numbered(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows`, one per key, with `_group` and `_seq`: numbers without holes within each group, in the order of the keys.

    Equal rows get equal numbers in every run and every retry.
    """
    group = F.pmod(F.xxhash64(*key), F.lit(GROUPS))
    w = Window.partitionBy("_group").orderBy(*key)
    grouped = rows.withColumn("_group", group)
    return grouped.withColumn("_seq", F.col("_group") * F.lit(SPAN) + F.row_number().over(w))


def unprocessed(rows: DataFrame, done: str) -> DataFrame:
    """Rows of `numbered` that lie in the gaps which the intervals of the `done` ones leave in the available ranges.

    Intervals, gaps and rows are all grouped alike, so that after numbering nothing is shuffled again; a row is in
    a gap if the last gap that begins at or before its number reaches it, which takes a sort and no pairs.
    """
    available = rows.groupBy("_group").agg(F.min("_seq").alias("first"), F.max("_seq").alias("last"))
    taken = rows.where(done).select("_group", F.col("_seq").alias("lo"), F.col("_seq").alias("hi"))
    ledger = available.join(_islands(taken, "_group"), "_group", "left")
    starts = gaps_of(ledger, "_group").select("_group", F.col("lo").alias("_seq"), F.col("hi").alias("_gap"))
    w = Window.partitionBy("_group").orderBy("_seq", F.col("_gap").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.unionByName(starts, allowMissingColumns=True).withColumn("_reach", F.last("_gap", ignorenulls=True).over(w))
    return merged.where(F.col("_gap").isNull() & (F.col("_reach") >= F.col("_seq")))


def stale_keys(
    sections: DataFrame,
    doc_map: DataFrame,
    runs: DataFrame,
    key: Sequence[str] = SECTION_KEY,
    map_key: Sequence[str] = ("doc_file", "heading", "chunk_index"),
    success: str = "succeeded",
) -> DataFrame:
    """Keys of `sections` that the next analysis must process.

    The runs that succeeded form a ledger of run ids. Of `doc_map`, only rows of runs in that ledger count,
    and of these the latest run per key (then written_at, then the greatest digest). The current versions are
    numbered; the numbers of those whose digest that row has are processed, and make up intervals. These are
    subtracted from the ranges of numbers there are, and the rows in the gaps come out, each key once. A digest
    written differently is equal; a null or blank hash, on either side, equals nothing, and a failed run, whatever
    it wrote, changes nothing. Null key parts match null ones. Empty tables: without runs or rows every key is
    returned; without sections none. Columns other than those named here are pruned.
    """
    status = F.lower(F.trim(F.col("status")))
    ledger = intervals_of(runs.where(status == success).select("run_id"), "run_id")
    recorded = covered(doc_map.select(*map_key, "hash", "run_id", "written_at"), "run_id", ledger)
    # a struct of the key: null parts are equal to null ones, and window and join need one shuffle only
    recorded = recorded.select(F.struct(*[F.col(m).alias(k) for m, k in zip(map_key, key)]).alias("_key"), digest(F.col("hash")).alias("_was"), "run_id", "written_at")
    w = Window.partitionBy("_key").orderBy(F.col("run_id").desc(), F.col("written_at").desc_nulls_last(), F.col("_was").desc_nulls_last())
    last = recorded.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).select("_key", "_was")
    keyed = sections.select(F.struct(*key).alias("_key"), "hash", "committed_at", "seen_at")
    now = current_versions(keyed, ("hash",), ("_key",))
    done = F.coalesce(digest(F.col("hash")) == F.col("_was"), F.lit(False))
    rows = now.join(last, "_key", "left").select("_key.*", done.alias("_done"))
    return unprocessed(numbered(rows, key), "_done").select(*key)
