"""Vector index of residual product codes: few bytes a row, exact re-ranking of few rows, optionally with a certificate that nothing is missed.

A unit vector is its cell's centroid plus a residual, of which every ``PART`` numbers are replaced by the nearest of up to 256 code words: a
byte. The inner product of a query with centroid and code words estimates the cosine, and is off by at most the length of what the code words miss,
which is stored with the row. Searches read cells, codes and lengths; whole vectors are read for the rows that may matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.operators.search import DIGITS, SLICE, CellIndex, DenseExact, _Best, _blocks, _finite, _matrix, _ranked, _Shared, _sizes, _unit
from korpusmill.storage import Scratch

PART, WORDS, ROUNDS = 2, 256, 8
#: Bytes of the sample of vectors that code words are fitted on, broadcast to the tasks that fit a part each.
SAMPLE_BYTES = 16 << 20
SLACK = 2.0 * 10**-DIGITS


def _clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to ``k`` centres of the rows by Lloyd's rounds from a seeded choice of distinct rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.sort(np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False))]
    for _ in range(ROUNDS):
        own = (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(own, minlength=len(c))
        sums = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class CodeIndex(CellIndex):
    """Centroids and, for every ``PART`` numbers of a residual, code words (parts, 256, PART)."""

    def __init__(self, centroids: np.ndarray, words: np.ndarray):
        super().__init__(centroids)
        self.words = words

    @classmethod
    def fit(cls, corpus: DataFrame, vector_col: str = "embedding", cells: int = 64, sample_rows: int = 50_000, seed: int = 42) -> CodeIndex:
        """Fitted on at most about ``sample_rows`` vectors and ``SAMPLE_BYTES``, by a hash of the vector; the parts' code words are fitted by tasks of their own."""
        spark = corpus.sparkSession
        base = CellIndex.fit(corpus, vector_col, cells, sample_rows, seed)
        dim = base.centroids.shape[1]
        parts = -(-dim // PART)
        own = corpus.where(_finite(vector_col) & (F.size(vector_col) == dim))
        n, most = own.count(), min(sample_rows, max(WORDS, SAMPLE_BYTES // (8 * dim)))
        if n > most:
            own = own.where(F.pmod(F.xxhash64(vector_col, F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
        x = np.array([r[0] for r in own.select(vector_col).limit(2 * most).collect()], np.float64).reshape(-1, dim)  # a bounded sample
        x = _unit(x)
        if not len(x):
            return cls(base.centroids, np.zeros((parts, 1, PART)))
        c = base.centroids
        left = np.pad(x - c[(2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)], ((0, 0), (0, parts * PART - dim)))
        shared = spark.sparkContext.broadcast(left)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for p in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"part": pa.array([p]), "words": pa.array([_clusters(shared.value[:, p * PART : (p + 1) * PART], WORDS, seed + p).ravel().tolist()], pa.list_(pa.float64()))})

        rows = spark.range(0, parts, 1, min(parts, 64)).mapInArrow(fit, "part long, words array<double>").collect()  # code words of a part
        words = [np.array(r.words).reshape(-1, PART) for r in sorted(rows, key=lambda r: r.part)]
        most = max(map(len, words))
        return cls(c, np.stack([np.vstack([w, np.repeat(w[-1:], most - len(w), axis=0)]) for w in words]))

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, f"{path}/centroids")
        rows = [(p, w.ravel().tolist()) for p, w in enumerate(self.words)]
        spark.createDataFrame(rows, "part int, words array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/words")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeIndex:
        rows = spark.read.parquet(f"{path}/words").orderBy("part").collect()  # a row per part
        return cls(CellIndex.load(spark, f"{path}/centroids").centroids, np.array([np.array(r.words).reshape(-1, PART) for r in rows]))

    def save_rows(self, coded: DataFrame, path: str) -> DataFrame:
        """The coded rows below the index, a folder per cell, so that searches read the cells they probe; returns them as read again."""
        coded.repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        return self.load_rows(coded.sparkSession, path)

    @staticmethod
    def load_rows(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{path}/rows")

    def code(self, corpus: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
        """(id, carried columns, cell, codes, miss) of the rows that can be ranked: an id, a vector of the index's length, finite numbers only."""
        shared, dim = corpus.sparkSession.sparkContext.broadcast((self.centroids, self.words)), self.centroids.shape[1]
        columns = list(dict.fromkeys([id_col, *carry]))
        fields = [*(corpus.schema[c] for c in columns), T.StructField("cell", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("miss", T.FloatType())]
        schema = T.StructType(fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, words = shared.value
            for batch in batches:
                x = _matrix(batch.column(len(columns)), dim)
                ok = np.flatnonzero(np.isfinite(x).all(axis=1))
                x, kept = _unit(x[ok]), batch.take(pa.array(ok))
                cell = (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
                left = np.pad(x - c[cell], ((0, 0), (0, len(words) * PART - dim)))
                codes, miss = np.empty((len(x), len(words)), np.uint8), np.zeros(len(x))
                for p, w in enumerate(words):
                    own = left[:, p * PART : (p + 1) * PART]
                    codes[:, p] = (2 * own @ w.T - (w * w).sum(axis=1)).argmax(axis=1)
                    miss += ((own - w[codes[:, p]]) ** 2).sum(axis=1)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(words)), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
                length = np.nextafter(np.sqrt(miss).astype(np.float32), np.float32(2))  # rounded up, so that it stays a bound
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(columns)], pa.array(cell, pa.int32()), binary, pa.array(length, pa.float32())], names=schema.names)

        usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) == dim)
        return corpus.where(usable).select(*columns, vector_col).mapInArrow(run, schema)

    def estimated(self, cells: np.ndarray, codes: pa.Array) -> np.ndarray:
        """Vectors as centroid and code words give them; their product with a block of queries is the sum of the queries' distance tables at the codes."""
        at = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(self.words))
        return self.centroids[cells] + self.words[np.arange(len(self.words)), at].reshape(len(at), -1)[:, : self.centroids.shape[1]]


def _pass(coded: DataFrame, index: CodeIndex, shared: _Shared, id_type: T.DataType, columns: list[str], within: str | None, k: int, sign: int, least: bool) -> DataFrame:
    """(query_id, columns, sim) over the codes: of every task the k best by estimate + ``sign`` * miss, or with ``least`` all rows whose estimate + miss reaches the query's bound."""
    fields = [T.StructField("query_id", id_type), *(coded.schema[c] for c in columns), T.StructField("sim", T.DoubleType())]
    names, extra = ["query_id", *columns, "sim"], [within] if within else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.parts(batches):
            for block, bound in shared:
                best, step = _Best(len(block.ids), k, ["q", "key", "sim", *columns]), max(1, SLICE // len(block.ids))
                for batch in part:
                    for lo in range(0, batch.num_rows, step):
                        own = batch.slice(lo, step)
                        own = own.take(pc.sort_indices(own.column(0)))
                        rows, at = own.select(list(range(len(columns)))), len(columns)
                        cells, miss = (own.column(at + j).to_numpy(zero_copy_only=False) for j in (0, 2))
                        x = index_.value.estimated(cells, own.column(at + 1))
                        for those, which in block.matches(cells, own.column(at + 3) if within else None, own.num_rows):
                            sims = block.matrix[which] @ x[those].T + sign * miss[those]
                            if not least:
                                best.add(sims, which, rows.take(pa.array(those)))
                                continue
                            q, r = np.nonzero(sims >= bound[which][:, None] - SLACK)
                            if len(q):
                                yield pa.RecordBatch.from_arrays([block.named(pa.array(which[q])), *rows.take(pa.array(those[r])).columns, pa.array(sims[q, r])], names=names)
                table = best.cut()
                if table is not None:
                    yield from pa.Table.from_arrays([block.named(table["q"].combine_chunks()), *(table[c] for c in columns), table["sim"]], names=names).combine_chunks().to_batches()

    index_ = coded.sparkSession.sparkContext.broadcast(index)
    return coded.select(*columns, "cell", "codes", "miss", *extra).mapInArrow(run, T.StructType(fields))


def _cosines(pairs: DataFrame, dim: int) -> DataFrame:
    """Pairs (.., query's vector q, row's vector x) with the cosine in place of both."""
    columns = [c for c in pairs.columns if c not in ("q", "x")]
    schema = T.StructType([*(pairs.schema[c] for c in columns), T.StructField("sim", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = (_unit(_matrix(batch.column(len(columns) + j), dim)) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array((q * x).sum(axis=1))], names=schema.names)

    return pairs.select(*columns, "q", "x").mapInArrow(run, schema)


def code_top_k(
    coded: DataFrame, corpus: DataFrame, index: CodeIndex, queries: DataFrame, k: int = 500, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id",
    query_vector: str = "embedding", carry: tuple[str, ...] = (), within: str | None = None, nprobe: int = 48, rerank: int = 4, share: float = 0.1, exact: bool = False,
) -> DataFrame:
    """(query_id, id, carried columns, sim, exact, compared, rank): the k nearest rows by ``coded`` (``CodeIndex.code`` of ``corpus``, whose ids are unique).

    Approximate: of the ``nprobe`` nearest cells the best by estimate, of which the first rerank * k, but no more than the ``share`` of all rows, are
    ranked again by their whole vectors; ``exact`` marks these, the similarity of others is the estimate, and ``compared`` counts them for the query. There are k rows if so many can be ranked.

    ``exact=True``: the result of ``search.top_k`` over the rows of the index's vector length. All codes are read twice: for the k-th largest lower bound of each query, and for
    the rows whose upper bound reaches it; those, and no others, are compared by their whole vectors.

    ``within`` is as in ``search.top_k``. Queries of other lengths than the index's have no result.
    """
    spark, dim = coded.sparkSession, index.centroids.shape[1]
    id_type = T.StringType() if isinstance(queries.schema[query_id].dataType, T.StringType) else T.LongType()
    columns, scratch = list(dict.fromkeys([id_col, *carry])), Scratch(spark, "codes")
    own = queries.where(F.size(query_vector) == dim)
    blocks = next((list(b) for d, b in _blocks(own, query_id, query_vector, within, k if exact else rerank * k) if d == dim), [])
    if not blocks:
        fields = [T.StructField("query_id", id_type), *(coded.schema[c] for c in columns), T.StructField("sim", T.DoubleType()), T.StructField("exact", T.BooleanType()), T.StructField("compared", T.LongType()), T.StructField("rank", T.IntegerType())]
        return spark.createDataFrame([], T.StructType(fields))
    sizes = _sizes(coded, within)
    rows = sum(sizes.values())
    top = max(1, min(rerank * k, int(share * rows)))
    probes = index.probes(len(index.centroids) if exact else nprobe)
    blocks = [b._replace(probes=probes(b.matrix, max(k, top), sizes, b.values)) for b in blocks]
    find = lambda bounds, sign, least: _pass(coded, index, _Shared(spark, iter(zip(blocks, bounds, strict=True))), id_type, columns, within, max(k, top) if not exact else k, sign, least)
    none = [None] * len(blocks)
    if exact:
        lower = _ranked(find(none, -1, False), k, id_col).where(F.col("rank") == k).select("query_id", "sim").collect()  # a row per query
        bound = {r.query_id: r.sim for r in lower}
        found = scratch.save(find([np.array([bound.get(i, -np.inf) for i in b.ids]) for b in blocks], 1, True).withColumn("rank", F.lit(0)), "found")
        again = found
    else:
        found = scratch.save(_ranked(find(none, 0, False), max(k, top), id_col), "found")
        again = found.where(F.col("rank") <= top)
    vectors = corpus.select(id_col, F.col(vector_col).alias("x"))
    pairs = again.select("query_id", *columns).join(vectors, id_col).join(own.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("q")), "query_id")
    compared = _cosines(pairs, dim).withColumn("exact", F.lit(True))
    if not exact and top < k:
        compared = compared.unionByName(found.where((F.col("rank") > top) & (F.col("rank") <= k)).select("query_id", *columns, "sim").withColumn("exact", F.lit(False)))
    return _ranked(compared.withColumn("compared", F.count_if("exact").over(Window.partitionBy("query_id"))), k, id_col)


class DenseCodes(DenseExact):
    """The same contract over coded rows; see ``code_top_k``."""

    def __init__(self, corpus: DataFrame, index: CodeIndex, coded: DataFrame, nprobe: int = 48, rerank: int = 4, exact: bool = False, **options):
        super().__init__(corpus, **options)
        self.index, self.coded, self.nprobe, self.rerank, self.exact = index, coded, nprobe, rerank, exact

    def pool(self, queries: DataFrame) -> DataFrame:
        return code_top_k(
            self.coded, self.corpus, self.index, self.vectors(queries), self.pool_k, self.id_col, self.vector_col, query_vector=self.vector_col,
            carry=(self.doc_col,), nprobe=self.nprobe, rerank=self.rerank, exact=self.exact,
        )
