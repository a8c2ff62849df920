"""Line de-duplication over levelled sorted runs of line hashes.

Documents are taken in batches of ascending ids. A batch's distinct line keys are merge-joined with the runs of earlier
batches; those that no run holds (the anti-join) are the batch's own run. A run is a table of one file a bucket, sorted by
key, so it is merged as it lies, with neither an exchange nor a sort. When a level holds ``fanout`` runs they are compacted
into one run of the next level. Everything is built-in DataFrame functions; no group of lines is ever gathered.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch, delete, shuffle_partitions

#: Stripped at both ends of a line.
WHITE = " \t\n\x0b\f\r"
FIRST_ID = -(2**63)
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), ascii_uppercase, ascii_lowercase)


@contextmanager
def _ordered_scans(spark: SparkSession):
    """Within it, plans take the files of a bucketed table as sorted, which they are with one file a bucket."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levelled runs (h1, h2): every key is in one run at most.

    With a ``name`` the runs stay in the catalog as tables ``line_run_<name>_<level>_<number>``, and a later ``LineRuns`` of
    that name goes on from them; ``folder`` is where their files are. Without one they go with ``close``.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 3, name: str | None = None):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.folder, self.fanout, self.kept = spark, folder.rstrip("/"), fanout, name is not None
        self.prefix = f"line_run_{name or uuid.uuid4().hex}_"
        self.levels: list[list[str]] = []
        self.compactions, self.number = 0, 0
        for t in sorted(t.name for t in spark.catalog.listTables(pattern=f"{self.prefix}*")):
            level, number = map(int, t.removeprefix(self.prefix).split("_"))
            self._level(level).append(t)
            self.number = max(self.number, number + 1)

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _write(self, df: DataFrame, level: int) -> str:
        """A run of ``df``, dealt by key; keys seen before are in a partition of their own."""
        name = f"{self.prefix}{level}_{self.number:06d}"
        self.number += 1
        parts = shuffle_partitions(self.spark)
        (
            df.write.partitionBy("seen").bucketBy(parts, *KEY).sortBy(*KEY).format("parquet")
            .option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        )
        self._level(level).append(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, f"{self.folder}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n).where(~F.col("seen")).select(*KEY) for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Merge a batch's distinct keys (h1, h2, ...) against all runs and add those that none holds as a run.

        Returns the batch's keys with ``seen``: whether an earlier batch holds the key. Read it before the next batch is added.
        """
        self.compact()
        with _ordered_scans(self.spark):
            out, marks = keys.repartition(shuffle_partitions(self.spark), *KEY), []
            for i, run in enumerate(self.runs()):
                out = out.join(run.withColumn(f"run{i}", F.lit(True)).hint("merge"), KEY, "left")
                marks.append(F.coalesce(F.col(f"run{i}"), F.lit(False)))
            seen = F.lit(False)
            for m in marks:
                seen = seen | m
            return self.spark.table(self._write(out.select(*keys.columns, seen.alias("seen")), 0))

    def compact(self) -> None:
        """Merge the runs of every level that is full into one of the next."""
        level = 0
        while level < len(self.levels):
            if len(full := self.levels[level]) >= self.fanout:
                merged = self.spark.table(full[0]).where(~F.col("seen")).select(*KEY)
                for n in full[1:]:
                    merged = merged.unionByName(self.spark.table(n).where(~F.col("seen")).select(*KEY))
                merged = merged.repartition(shuffle_partitions(self.spark), *KEY)
                self._write(merged.withColumn("seen", F.lit(False)), level + 1)
                for n in full:
                    self._drop(n)
                self.levels[level] = []
                self.compactions += 1
            level += 1

    def close(self, whole: bool = False) -> None:
        """Drop the runs and their files, unless they have a name; ``whole`` drops those as well."""
        if whole or not self.kept:
            for n in [n for level in self.levels for n in level]:
                self._drop(n)
            self.levels = []


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, fanout: int = 2,
    carry: tuple[str, ...] = (), runs: LineRuns | None = None, batch_docs: int = 50_000_000,
) -> DataFrame:
    r"""Drop every line whose key also occurs in a document of smaller id.

    Lines end at ``\n``; a key is the line stripped of ASCII white space with A-Z lower-cased. Keys of under ``min_chars``
    code points never lose lines; all lines of a key stay in the smallest id that holds it, repeats included.

    Returns (id, text, n_lines, n_dropped), text being the kept lines joined by ``\n``. Null text counts as empty, which is
    one empty line; an empty table gives an empty result. A null id sorts before every other id. Repeated rows of one id
    count as the same document. Columns named in ``carry`` are added to the result as they are; others, whatever their names,
    are not read. Without ``batches`` there is one for every ``batch_docs`` documents, and three at least.

    With ``runs`` the keys of earlier calls count as held by documents before all of these, and those of this call are
    added, so that a later call goes on from here.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    at = F.coalesce(F.col("id").cast("long"), F.lit(FIRST_ID))

    batches = batches or max(3, -(-docs.count() // batch_docs))
    cuts = base.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else None
    batch = F.lit(0)
    for c in cuts or []:
        batch = batch + (F.col("at") > F.lit(c)).cast("int")
    key = line_key(F.col("line"))
    lines = scratch.save(
        base.select(at.alias("at"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(F.length(key) >= min_chars)
        .select("at", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"), batch.alias("batch")),
        "lines",
        ["batch"],
    )

    own, verdicts = runs or LineRuns(spark, scratch.path("runs"), fanout), []
    try:
        for b in range(len(cuts or []) + 1):
            here = F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("rows")
            keys = own.add(lines.where(F.col("batch") == b).groupBy(*KEY).agg(*here))
            held = keys.where(F.col("seen") | (F.col("last") > F.col("first")))
            verdicts.append(scratch.save(held.select(F.lit(b).alias("batch"), *KEY, F.when(~F.col("seen"), F.col("first")).alias("first"), "rows"), "verdict"))
    finally:
        own.close()
    verdict = verdicts[0]
    for v in verdicts[1:]:
        verdict = verdict.unionByName(v)
    dropped = (
        join_unique(lines, verdict, ["batch", *KEY], "rows", row_bytes=60).where(F.col("first").isNull() | (F.col("at") > F.col("first")))
        .groupBy("at", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    )
    dropped = scratch.save(dropped, "dropped")
    scratch.drop(lines, *verdicts)

    out = (
        base.select("id", "text", "carried", at.alias("at"), F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
        .join(dropped, ["at", "text_hash"], "left")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
        .alias(text_col),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("carried")[c].alias(c) for c in carry],
    )
