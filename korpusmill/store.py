"""Stored chunks and vectors: Parquet by what made them, so that a configuration is a folder and not a table's name, and a manifest of whole documents.

A load writes its rows below ``rows/<configuration>/load=<id>`` and then commits: a manifest (case_no, content, replaces) is written beside and gets
its name, with the next number, by a rename. Readers see the loads that the manifests since the last full one name, without the documents that a later one
replaces; so a document is there whole or not at all, in its newest text, and what a broken run left is never read.

A column ``weights`` (map<string, float>) is stored as map<bigint, float> by the tokens' numbers, and below ``tokens`` every load has its dictionary.
"""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.functions.text import to_day
from korpusmill.functions.vector import coded, token_id
from korpusmill.operators.chunk import chunks
from korpusmill.schema import CHUNK
from korpusmill.storage import Scratch, delete

PARTITIONS = ("model", "chunk_size", "overlap")
KEY = ["case_no", "chunk_index"]
WEIGHTS = "weights"
TOKENS = "token_id long, token string"
#: Tokens of a dictionary that is broadcast; a larger one is joined by shuffle, with skewed partitions split at run time.
SMALL_TOKENS = 500_000
MANIFEST = "case_no string, content string, replaces string"


class Commit(NamedTuple):
    """A manifest: its number, its kind (``full`` starts anew, ``add`` has new documents only, ``mend`` replaces some), its load and its folder."""

    number: int
    kind: str
    load: str
    path: str


def content_key(text: str = "chunk_text") -> Column:
    """Of a document's chunks, in any order, what tells two contents apart: their number and two combined hashes of place and text."""
    one, two = F.xxhash64("chunk_index", text), F.xxhash64(F.lit("second"), text, "chunk_index")
    return F.concat_ws("-", F.count(F.lit(1)), F.hex(F.bit_xor(one)), F.hex(F.bit_xor(two)))


class ChunkStore:
    """Chunk rows (``schema.CHUNK`` without or with vectors, and any further columns) below one folder, by model, chunk size and overlap.

    One writer at a time: a second one's commit of the same number fails, and its rows stay unread. ``vacuum`` deletes what no reader sees.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, files = self._path(path)
        return sorted(s.getPath().getName() for s in files.listStatus(p) if s.isDirectory()) if files.exists(p) else []

    def _folder(self, kind: str, model: str, size: int, overlap: int) -> str:
        return f"{self.root}/{kind}/model={quote(model, safe='')}/chunk_size={size}/overlap={overlap}"

    def configurations(self) -> list[tuple[str, int, int]]:
        """(model, chunk_size, overlap) of all that were loaded."""
        value, base = (lambda n: unquote(n.partition("=")[2])), f"{self.root}/documents"
        out = [(m, s, o) for m in self._names(base) for s in self._names(f"{base}/{m}") for o in self._names(f"{base}/{m}/{s}")]
        return [(value(m), int(value(s)), int(value(o))) for m, s, o in out if self._commits(value(m), int(value(s)), int(value(o)))]

    def _commits(self, model: str, size: int, overlap: int) -> list[Commit]:
        """The manifests since the last full one, oldest first."""
        base = self._folder("documents", model, size, overlap)
        found = [Commit(int(n), kind, load, f"{base}/{name}") for name in self._names(base) if name[0] not in "._" for n, kind, load in [name.split("-")]]
        first = max((k for k, c in enumerate(found) if c.kind == "full"), default=0)
        return found[first:]

    def _commit(self, model: str, size: int, overlap: int, kind: str, load: str, documents: DataFrame) -> None:
        base, commits = self._folder("documents", model, size, overlap), self._commits(model, size, overlap)
        temp, name = f"{base}/_{load}", f"{base}/{commits[-1].number + 1 if commits else 0:09d}-{kind}-{load}"
        documents.select("case_no", "content", "replaces").write.mode("overwrite").parquet(temp)
        (old, files), (new, _) = self._path(temp), self._path(name)
        if any(n.startswith(name.rpartition("/")[2][:10]) for n in self._names(base)) or not files.rename(old, new):
            raise RuntimeError(f"another writer has committed to {base}")

    def _checked(self, chunks: DataFrame) -> DataFrame:
        if missing := [c for c in (*KEY, "chunk_text") if c not in chunks.columns]:
            raise ValueError(f"chunks without {', '.join(missing)}")
        required = [f.name for f in CHUNK if not f.nullable and f.name in chunks.columns]
        return chunks.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)).alias(c) if c in required else F.col(c) for c in chunks.columns])

    def _put(self, chunks: DataFrame, model: str, size: int, overlap: int) -> tuple[str, DataFrame]:
        """The load that rows were written as, and they as read again. Rows are sorted by document inside files, so that look-ups prune row groups."""
        load = uuid.uuid4().hex
        path = f"{self._folder('rows', model, size, overlap)}/load={load}"
        chunks = self._checked(chunks)
        if not _named(chunks):
            chunks.sortWithinPartitions(*KEY).write.parquet(path)
            return load, self.spark.read.schema(chunks.schema).parquet(path)
        scratch = Scratch(self.spark, "weights")
        saved = scratch.save(chunks, "rows")  # read twice, encoded once
        tokens = saved.select(F.explode(F.map_keys(WEIGHTS)).alias("token")).groupBy(token_id("token").alias("token_id")).agg(F.min("token").alias("token"), F.max("token").alias("_last"))
        same = F.when(F.col("token") == F.col("_last"), F.col("token")).otherwise(F.raise_error(F.concat(F.lit("one number for the tokens "), "token", F.lit(" and "), "_last")))
        tokens.select("token_id", same.alias("token")).write.parquet(f"{self._folder('tokens', model, size, overlap)}/load={load}")
        rows = saved.withColumn(WEIGHTS, coded(WEIGHTS))
        rows.sortWithinPartitions(*KEY).write.parquet(path)
        scratch.drop(saved)
        return load, self.spark.read.schema(rows.schema).parquet(path)

    def write(self, chunks: DataFrame, model: str, size: int, overlap: int) -> None:
        """Replace one configuration, by nothing if there are no rows; the others stay. Readers see the old rows until all new ones are there."""
        load, rows = self._put(chunks, model, size, overlap)
        self._commit(model, size, overlap, "full", load, rows.groupBy("case_no").agg(content_key().alias("content")).withColumn("replaces", F.lit(None).cast("string")))

    def exists(self) -> bool:
        return bool(self.configurations())

    def documents(self, model: str, size: int, overlap: int) -> DataFrame:
        """(case_no, content, load) of the documents that readers see."""
        commits = self._commits(model, size, overlap)
        if not commits:
            return self.spark.createDataFrame([], "case_no string, content string, load string")
        out = None
        for c in commits:
            own = self.spark.read.schema(MANIFEST).parquet(c.path).withColumns({"load": F.lit(c.load), "number": F.lit(c.number)})
            out = own if out is None else out.unionByName(own)
        if any(c.kind == "mend" for c in commits):
            out = out.groupBy("case_no").agg(F.max_by(F.struct("content", "load"), "number").alias("newest")).select("case_no", "newest.*")
        return out.select("case_no", "content", "load")

    def read(self, model: str, size: int, overlap: int) -> DataFrame:
        """The rows of all documents, each in its newest text; of a configuration that was never loaded none."""
        commits = self._commits(model, size, overlap)
        if not commits:
            return self.spark.createDataFrame([], CHUNK)
        base = self._folder("rows", model, size, overlap)
        rows = self.spark.read.option("basePath", base).parquet(*[f"{base}/load={c.load}" for c in commits])
        mended = [c for c in commits if c.kind == "mend"]
        if mended:  # only documents that were replaced need a join
            old = self.spark.read.schema(MANIFEST).parquet(*[c.path for c in mended]).where("replaces IS NOT NULL")
            rows = rows.join(old.select("case_no", F.col("replaces").alias("load")), ["case_no", "load"], "left_anti")
        return rows.drop("load")

    def tokens(self, model: str, size: int, overlap: int) -> DataFrame:
        """(token_id, token) of the weights of all loads that readers see; raises if two tokens share a number."""
        base = self._folder("tokens", model, size, overlap)
        held = set(self._names(base))
        paths = [f"{base}/load={c.load}" for c in self._commits(model, size, overlap) if f"load={c.load}" in held]
        if not paths:
            return self.spark.createDataFrame([], TOKENS)
        every = self.spark.read.schema(TOKENS).parquet(*paths)
        if len(paths) == 1:
            return every
        both = every.groupBy("token_id").agg(F.min("token").alias("token"), F.max("token").alias("_last"))
        return both.select("token_id", F.when(F.col("token") == F.col("_last"), F.col("token")).otherwise(F.raise_error(F.lit("one number for two tokens"))).alias("token"))

    def terms(self, model: str, size: int, overlap: int) -> DataFrame:
        """(case_no, chunk_index, token, weight) of the stored weights; null and empty weights have no rows."""
        rows = self.read(model, size, overlap)
        if WEIGHTS not in rows.columns:
            return self.spark.createDataFrame([], "case_no string, chunk_index int, token string, weight float")
        tokens = self.tokens(model, size, overlap)
        if tokens.limit(SMALL_TOKENS + 1).count() <= SMALL_TOKENS:
            tokens = F.broadcast(tokens)
        return rows.select(*KEY, F.explode(WEIGHTS).alias("token_id", "weight")).join(tokens, "token_id").select(*KEY, "token", "weight")

    def append_missing(
        self, chunks: DataFrame, model: str, size: int, overlap: int, encoder=None, vector_col: str = "embedding", slice_rows: int = 5_000_000
    ) -> None:
        """Encode and add the documents that the configuration lacks or has with another content, which the new one replaces.

        ``chunks`` has whole documents, each once. What is missing is saved first and then encoded and committed in slices of about ``slice_rows`` rows, by
        document, so a broken run keeps the slices that were done, and running it again adds the rest.
        """
        scratch = Scratch(self.spark, "missing")
        chunks = scratch.save(self._checked(chunks), "chunks")
        known = self.documents(model, size, overlap).select("case_no", F.col("content").alias("held"), F.col("load").alias("replaces"))
        offered = chunks.groupBy("case_no").agg(content_key().alias("content"), F.count(F.lit(1)).alias("n"))
        new = scratch.save(offered.join(known, "case_no", "left").where("held IS NULL OR held <> content"), "documents")
        rows = new.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        slices = -(-rows // slice_rows)
        for k in range(slices):
            own = new.where(F.pmod(F.xxhash64("case_no"), F.lit(slices)) == k) if slices > 1 else new
            part = chunks.join(own.select("case_no"), "case_no", "left_semi")
            load, _ = self._put(part if encoder is None else encoder.encode(part, "chunk_text", vector_col), model, size, overlap)
            mends = not own.where("replaces IS NOT NULL").isEmpty()
            self._commit(model, size, overlap, "mend" if mends else "add", load, own)
        scratch.drop(chunks, new)

    def load(self, cases: DataFrame, model: str, size: int = 300, overlap: int = 100, encoder=None) -> DataFrame:
        """Replace a configuration by all chunks of the cases, with name, court, date and category of each; returns (n_documents, n_chunks, seconds)."""
        began = time.perf_counter()
        rows = chunk_rows(cases, size, overlap)
        self.write(rows if encoder is None else encoder.encode(rows, "chunk_text", "embedding"), model, size, overlap)
        own = self.read(model, size, overlap).groupBy("case_no").agg(F.count(F.lit(1)).alias("n"))
        return own.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks")).withColumn("seconds", F.lit(round(time.perf_counter() - began, 3)))

    def of_document(self, case_nos: DataFrame, model: str, size: int, overlap: int) -> DataFrame:
        """Chunks of many documents by one join."""
        return self.read(model, size, overlap).join(case_nos.select("case_no").distinct(), "case_no", "left_semi")

    def _all(self, read) -> DataFrame | None:
        out = None
        for model, size, overlap in self.configurations():
            own = read(model, size, overlap).withColumns({"model": F.lit(model), "chunk_size": F.lit(size), "overlap": F.lit(overlap)})
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out

    def as_table(self, name: str, bucket_count: int = 64) -> None:
        """All configurations as a catalog table bucketed by document, with statistics: joins on ``case_no`` need no shuffle of it."""
        rows = self._all(self.read)
        if rows is None:
            return create_chunk_table(self.spark, name)
        rows.write.mode("overwrite").format("parquet").partitionBy(*PARTITIONS).bucketBy(bucket_count, "case_no").sortBy(*KEY).saveAsTable(name)
        columns = ", ".join(c for c, kind in rows.dtypes if not kind.startswith(("array", "map")))
        self.spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {columns}")

    def report(self) -> DataFrame:
        """(model, chunk_size, overlap, n_documents, n_chunks, mean_chars, bytes) of every configuration; bytes are those of the files that readers open."""
        rows = self._all(lambda *c: self.read(*c).select("case_no", F.length("chunk_text").alias("chars")))
        if rows is None:
            return self.spark.createDataFrame([], "model string, chunk_size int, overlap int, n_documents long, n_chunks long, mean_chars double, bytes long")
        rows = rows.groupBy(*PARTITIONS, "case_no").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
        found = rows.groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chunks"), F.round(F.sum("chars") / F.sum("n"), 2).alias("mean_chars"))
        sizes = []
        for c in self.configurations():
            paths = [self._path(f"{self._folder('rows', *c)}/load={k.load}") for k in self._commits(*c)]
            sizes.append((*c, sum(files.getContentSummary(p).getLength() for p, files in paths)))
        sizes = self.spark.createDataFrame(sizes, "model string, chunk_size int, overlap int, bytes long")  # a row per configuration
        zero = {"n_documents": 0, "n_chunks": 0}
        return sizes.join(found, list(PARTITIONS), "left").na.fill(zero).select(*PARTITIONS, "n_documents", "n_chunks", "mean_chars", "bytes")

    def vacuum(self) -> int:
        """Delete loads that no manifest in use names and manifests before the last full one; returns the number of folders. No reader or writer may be at work."""
        gone = []
        for c in self.configurations():
            commits = self._commits(*c)
            loads = {f"load={k.load}" for k in commits}
            for kind, held in (("rows", loads), ("tokens", loads), ("documents", {k.path.rpartition("/")[2] for k in commits})):
                base = self._folder(kind, *c)
                gone += [f"{base}/{n}" for n in self._names(base) if n not in held]
        for path in gone:
            delete(self.spark, path)
        return len(gone)


def _named(chunks: DataFrame) -> bool:
    """Whether the chunks have weights by token."""
    return WEIGHTS in chunks.columns and isinstance(kind := chunks.schema[WEIGHTS].dataType, T.MapType) and isinstance(kind.keyType, T.StringType)


def chunk_rows(cases: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of ``sources.cases.corpus`` rows with the columns of ``schema.CHUNK`` but the vector: the date is made one, or null if it spells none."""
    cut = chunks(cases, "case_no", "content", size, overlap, carry=("case_name", "court_name", "judgment_date", "case_type"))
    return cut.withColumn("judgment_date", to_day("judgment_date")).select(*[f.name for f in CHUNK if f.name != "embedding"])


def create_chunk_table(spark: SparkSession, name: str) -> None:
    """An empty chunk table of the catalog, with the partitions of a store, unless there is one."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CHUNK)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, model STRING, chunk_size INT, overlap INT) USING parquet PARTITIONED BY ({', '.join(PARTITIONS)})")
