"""Ranked search: exact and partitioned vector search, sparse search, rank fusion.

Rankings are long: (query_id, rank, document, score). Orders are total: score rounded to six decimals descending, then id
ascending. A query set is taken in blocks whose vectors have a bounded size; the corpus is read once, a task takes all
blocks in turn over what it holds, and ships at most k rows per query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.functions.vector import LEAST_NORM, coded, l2_normalize
from korpusmill.storage import Scratch

#: Bytes of query vectors, rows that are kept for them, query terms and characters of passages that are taken at once, similarities that are computed at once.
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 1 << 19
BLOCK_TERMS = 500_000
PASSAGE_CHARS = 2 << 20
SLICE = 1 << 20
DIGITS = 6
#: Bytes of a corpus part that several blocks pass over, and categories that a scan is filtered by.
HELD_BYTES, MANY_VALUES = 64 << 20, 1000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), LEAST_NORM)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Best:
    """The k best rows of each query so far, as an Arrow table (q, key, sim, id, ...)."""

    def __init__(self, queries: int, k: int, names: list[str]):
        self.k, self.names, self.limit = k, names, max(1 << 19, 2 * queries * k)
        self.least, self.parts, self.rows = np.full(queries, np.iinfo(np.int64).min), [], 0

    def add(self, sims: np.ndarray, which: np.ndarray, rows: pa.RecordBatch) -> None:
        """Similarities (queries ``which``, rows), the rows in order of their ids."""
        n = sims.shape[1]
        key = np.where(np.isfinite(sims), np.rint(np.nan_to_num(sims) * 10**DIGITS), np.nan)
        open_ = key >= self.least[which][:, None]
        if n > self.k and open_.sum(axis=1).max(initial=0) > self.k:
            place = np.where(open_, key * n + np.arange(n, 0, -1), -np.inf)
            keep = np.zeros_like(open_)
            np.put_along_axis(keep, np.argpartition(-place, self.k - 1, axis=1)[:, : self.k], True, axis=1)
            open_ &= keep
        q, r = np.nonzero(open_)
        if len(q):
            taken = rows.take(pa.array(r))
            self.parts.append(pa.Table.from_arrays([pa.array(which[q]), pa.array(key[q, r].astype(np.int64)), pa.array(sims[q, r]), *taken.columns], names=self.names))
            self.rows += len(q)
        if self.rows > self.limit:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.parts:
            return None
        table = pa.concat_tables(self.parts).sort_by([("q", "ascending"), ("key", "descending"), (self.names[3], "ascending")])
        q = table["q"].to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        table = table.filter(pa.array(nth < self.k)).combine_chunks()
        last = nth == self.k - 1
        self.least[q[last]] = table["key"].to_numpy()[nth[nth < self.k] == self.k - 1]
        self.parts, self.rows = [table], len(table)
        self.limit = max(self.limit, 2 * self.rows)
        return table


class _Shared:
    """Blocks of a query set that tasks take in turn: a single one is broadcast, several are files in the shared folder, of which a task holds one at a time."""

    def __init__(self, spark: SparkSession, blocks: Iterator):
        first, more = next(blocks, None), next(blocks, None)
        self.single, self.paths, self.one = more is None, [], None
        if self.single:
            self.one = spark.sparkContext.broadcast(first)
            return
        folder = Scratch(spark, "blocks").path("queries")
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for k, block in enumerate(chain([first, more], blocks)):
            with store.open_output_stream(f"{path}/{k:06d}", compression=None) as out:
                pickle.dump(block, out)
            self.paths.append(f"{folder}/{k:06d}")

    def __iter__(self) -> Iterator:
        if self.single:
            yield self.one.value
        for uri in self.paths:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(path, compression=None) as stream:
                block = pickle.loads(stream.read())
            yield block

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator:
        """What is held while all blocks pass over it: everything, as a stream, for a single block, else batches of about ``HELD_BYTES``."""
        if self.single:
            yield batches
            return
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                yield held
                held = []
        if held:
            yield held


class _Block(NamedTuple):
    """Queries of one vector length: ids, unit vectors, cells to search, and the values that a row's ``within`` must have."""

    ids: list
    matrix: np.ndarray
    probes: np.ndarray | None
    values: list | None

    def named(self, q: pa.Array) -> pa.Array:
        return pa.array(self.ids, None if not len(self.ids) or isinstance(self.ids[0], str) else pa.int64()).take(q)

    def matches(self, cells: np.ndarray | None, values: pa.Array | None, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, queries): rows of one cell and value, and the queries that search these."""
        every = np.arange(len(self.ids))
        if cells is None and values is None:
            yield np.arange(n), every
            return
        kinds = [np.zeros(n, np.int64) if cells is None else cells.astype(np.int64)]
        if values is not None:
            kinds.append(pc.index_in(values, value_set=pa.array(sorted(set(self.values)), values.type)).fill_null(-1).to_numpy(zero_copy_only=False))
        own = {v: k for k, v in enumerate(sorted(set(self.values)))} if values is not None else {}
        of = np.array([own[v] for v in self.values]) if values is not None else None
        for kind in np.unique(np.stack(kinds), axis=1).T:
            which = np.ones(len(every), bool) if cells is None else (self.probes == kind[0]).any(axis=1)
            if values is not None:
                which &= of == kind[1]
            if which.any():
                yield np.flatnonzero(np.all(np.stack(kinds) == kind[:, None], axis=0)), np.flatnonzero(which)


def _blocks(queries: DataFrame, query_id: str, vector: str, within: str | None, k: int) -> Iterator[tuple[int, Iterator[_Block]]]:
    """By vector length blocks of at most about ``BLOCK_BYTES`` of vectors and ``BLOCK_ROWS`` rows, k a query. Queries of several blocks are saved first, so that they are made once."""
    value = F.col(within) if within else F.lit(None)
    own = queries.where(F.col(query_id).isNotNull() & (F.size(vector) > 0)).select(query_id, F.col(vector).alias("v"), value.alias("w"))
    own = own.where("w IS NOT NULL") if within else own.drop("w")
    lengths = sorted(map(tuple, own.groupBy(F.size("v")).count().collect()))  # a row per length
    number = lambda dim, n: max(-(-n * dim * 8 // BLOCK_BYTES), -(-n * k // BLOCK_ROWS))
    if sum(number(*x) for x in lengths) > 1:
        own = Scratch(queries.sparkSession, "queries").save(own, "vectors")

    def of(dim: int, blocks: int) -> Iterator[_Block]:
        alike = own.where(F.size("v") == dim)
        for b in range(blocks):
            part = alike.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else alike
            rows = sorted(part.collect(), key=lambda r: r[0])  # a block's size is bounded
            if rows:
                yield _Block([r[0] for r in rows], _unit(np.array([r[1] for r in rows], np.float64)), None, [r[2] for r in rows] if within else None)

    for dim, n in lengths:
        yield dim, of(dim, number(dim, n))


def _cell_sizes(corpus: DataFrame, vector: str, dim: int, within: str | None = None) -> dict:
    """Rows of each cell (and value of ``within``) that can be ranked: vectors of length ``dim`` of finite numbers."""
    return _sizes(corpus.where(_finite(vector) & (F.size(vector) == dim)), within)


def _finite(vector: str) -> Column:
    """Whether a vector is not null and all its elements are finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, number)


def _sizes(rows: DataFrame, within: str | None) -> dict:
    value = F.col(within) if within else F.lit(None)
    return {(r.cell, r.w): r.n for r in rows.groupBy("cell", value.alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell and category


def _candidates(corpus: DataFrame, shared: _Shared, dim: int, id_type: T.DataType, k: int, columns: list[str], vector: str, cells: bool, within: str | None) -> DataFrame:
    fields = [T.StructField("query_id", id_type), *(corpus.schema[c] for c in columns), T.StructField("sim", T.DoubleType())]
    usable = F.col(vector).isNotNull() & (F.size(vector) == dim)
    extra, names = [*(["cell"] if cells else []), *([within] if within else [])], ["query_id", *columns, "sim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.parts(batches):
            for block in shared:
                best, step = _Best(len(block.ids), k, ["q", "key", "sim", *columns]), max(1, SLICE // len(block.ids))
                for batch in part:
                    for lo in range(0, batch.num_rows, step):
                        own = batch.slice(lo, step)
                        own = own.take(pc.sort_indices(own.column(0)))
                        rows, x, at = own.select(list(range(len(columns)))), _unit(_matrix(own.column(len(columns)), dim)), len(columns) + 1
                        cell = own.column(at).to_numpy(zero_copy_only=False) if cells else None
                        for those, which in block.matches(cell, own.column(at + cells) if within else None, own.num_rows):
                            best.add(block.matrix[which] @ x[those].T, which, rows.take(pa.array(those)))
                table = best.cut()
                if table is not None:
                    q = block.named(table["q"].combine_chunks())
                    yield from pa.Table.from_arrays([q, *(table[c] for c in columns), table["sim"]], names=names).combine_chunks().to_batches()

    return corpus.where(usable).select(*columns, vector, *extra).mapInArrow(run, T.StructType(fields))


def _ranked(pool: DataFrame, k: int, id_col: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("sim", DIGITS).desc(), F.col(id_col)))
    return pool.withColumn("rank", place).where(F.col("rank") <= k)


def top_k(
    corpus: DataFrame, queries: DataFrame, k: int = 500, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id",
    query_vector: str = "embedding", carry: tuple[str, ...] = (), probes=None, within: str | None = None,
) -> DataFrame:
    """(query_id, id, carried columns, sim, rank) of the k rows of largest cosine with each query; fewer rows give fewer.

    Queries are searched among rows of their vector's length, in one scan whatever their number. Null vectors and ids take no part; a zero vector has the similarity 0 with all. Ids are
    integers or strings. Without queries the result is empty. With ``probes`` (see ``CellIndex.probes``) a query sees the rows of some cells only, but k rows if there are as many.

    ``within`` names a column of both tables, a category: a query ranks rows of its own value only, and a null value none. A corpus that is partitioned
    by this column is read for the queries' values only.
    """
    id_type = T.StringType() if isinstance(queries.schema[query_id].dataType, T.StringType) else T.LongType()
    columns = [id_col, *carry]
    rows = corpus.where(F.col(id_col).isNotNull())
    if within:
        values = [r[0] for r in queries.select(within).where(F.col(within).isNotNull()).distinct().limit(MANY_VALUES + 1).collect()]
        rows = rows.where(F.col(within).isin(values)) if len(values) <= MANY_VALUES else rows
    parts = []
    for dim, blocks in _blocks(queries, query_id, query_vector, within, k):
        if probes:
            sizes = _cell_sizes(rows, vector_col, dim, within)
            blocks = (b._replace(probes=probes(b.matrix, k, sizes, b.values)) for b in blocks)
        parts.append(_candidates(rows, _Shared(corpus.sparkSession, blocks), dim, id_type, k, columns, vector_col, bool(probes), within))
    if not parts:
        fields = [T.StructField("query_id", id_type), *(corpus.schema[c] for c in columns), T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        return corpus.sparkSession.createDataFrame([], T.StructType(fields))
    return _ranked(reduce(DataFrame.unionByName, parts), k, id_col)


def document_rank(pool: DataFrame, doc_col: str, max_k: int = 20) -> DataFrame:
    """(query_id, doc, score, rank): documents by their best chunk in the pool. Documents that have none there are not ranked."""
    best = pool.groupBy("query_id", doc_col).agg(F.max("sim").alias("sim"))
    return _ranked(best, max_k, doc_col).select("query_id", doc_col, F.col("sim").alias("score"), "rank")


def best_per_document(pool: DataFrame, doc_col: str, id_col: str) -> DataFrame:
    """Of each query's pool the best row of every document, whole rows."""
    nth = F.row_number().over(Window.partitionBy("query_id", doc_col).orderBy(F.round("sim", DIGITS).desc(), F.col(id_col)))
    return pool.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


class DenseExact:
    """Exact retriever: ``retrieve(queries, max_k)`` -> (query_id, doc, score, rank); the pool of ``pool_k`` chunks is cut before documents are told apart."""

    def __init__(self, corpus: DataFrame, encoder=None, pool_k: int = 500, id_col: str = "chunk_id", doc_col: str = "case_no", vector_col: str = "embedding"):
        self.corpus, self.encoder, self.pool_k = corpus, encoder, pool_k
        self.id_col, self.doc_col, self.vector_col = id_col, doc_col, vector_col

    def vectors(self, queries: DataFrame) -> DataFrame:
        """Queries with the column of their vectors: encoded from ``query``, each once, unless there is no encoder."""
        if self.encoder is None:
            return queries
        return Scratch(queries.sparkSession, "encoded").save(self.encoder.encode(queries, "query", self.vector_col), "queries")

    def pool(self, queries: DataFrame) -> DataFrame:
        return top_k(self.corpus, self.vectors(queries), self.pool_k, self.id_col, self.vector_col, query_vector=self.vector_col, carry=(self.doc_col,))

    def retrieve(self, queries: DataFrame, max_k: int = 20) -> DataFrame:
        return document_rank(self.pool(queries), self.doc_col, max_k)


class CellIndex:
    """Inverted-file index: centroids of a k-means fitted on a bounded sample; every row is put in the cell of its nearest centroid."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @classmethod
    def fit(cls, corpus: DataFrame, vector_col: str = "embedding", cells: int = 64, sample_rows: int = 50_000, seed: int = 42) -> CellIndex:
        """``sample_rows`` bounds the rows, by a hash of the vector, that the centroids are fitted on; of several vector lengths that of most rows is the index's."""
        own = corpus.where(_finite(vector_col) & (F.size(vector_col) > 0))
        length = own.groupBy(F.size(vector_col).alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
        if length is None:
            return cls(np.zeros((1, 1)))
        own, n = own.where(F.size(vector_col) == length.dim), length.n
        rate = min(1.0, sample_rows / n)
        sample = own.where(F.pmod(F.xxhash64(vector_col), F.lit(1 << 30)) < int(rate * (1 << 30))) if rate < 1 else own
        x = sample.select(array_to_vector(l2_normalize(vector_col)).alias("features"))
        model = KMeans(k=max(1, min(cells, n)), seed=seed, maxIter=15).fit(x)
        return cls(np.array(model.clusterCenters()))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(k, c) for k, c in enumerate(self.centroids.tolist())], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        return cls(np.array([r.centroid for r in spark.read.parquet(path).orderBy("cell").collect()]))  # a row per cell

    def assign(self, corpus: DataFrame, vector_col: str = "embedding") -> DataFrame:
        """Rows with ``cell``; -1 for vectors that are null or of another length."""
        shared, dim = corpus.sparkSession.sparkContext.broadcast(self.centroids), self.centroids.shape[1]

        @F.pandas_udf("int")
        def nearest(v):
            import pandas as pd

            c = shared.value
            ok = np.array([x is not None and len(x) == dim for x in v])
            out = np.full(len(v), -1, np.int32)
            if ok.any():
                x = _unit(np.nan_to_num(np.array([np.asarray(y, np.float64) for y in v[ok]])))
                out[ok] = (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
            return pd.Series(out)

        return corpus.withColumn("cell", nearest(vector_col))

    def probes(self, nprobe: int):
        """Cells to search by query: the ``nprobe`` nearest, and on to further ones while these hold fewer than k rows (of the query's value); -2 is no cell."""

        def of(queries: np.ndarray, k: int, sizes: dict, values: list | None = None) -> np.ndarray:
            c = self.centroids
            if queries.shape[1] != c.shape[1]:  # rows of this length are in no cell
                return np.full((len(queries), 1), -1, np.int32)
            near = np.argsort(-(2 * queries @ c.T - (c * c).sum(axis=1)), axis=1, kind="stable").astype(np.int32)
            rows = {v: np.array([sizes.get((i, v), 0) for i in range(len(c))]) for v in set(values or [None])}
            before = np.cumsum(np.stack([rows[v] for v in values or [None] * len(near)])[np.arange(len(near))[:, None], near], axis=1)
            before = np.hstack([np.zeros((len(near), 1), before.dtype), before[:, :-1]])
            return np.where((np.arange(len(c)) < nprobe) | (before < k), near, -2).astype(np.int32)

        return of


class DenseCells(DenseExact):
    """The same contract over rows that ``CellIndex.assign`` put in cells: a query sees those of its ``nprobe`` nearest cells, and of more while they hold fewer than ``pool_k`` rows."""

    def __init__(self, corpus: DataFrame, index: CellIndex, nprobe: int = 48, **options):
        super().__init__(corpus, **options)
        self.index, self.nprobe = index, nprobe

    def pool(self, queries: DataFrame) -> DataFrame:
        probes = self.index.probes(self.nprobe)
        return top_k(self.corpus, self.vectors(queries), self.pool_k, self.id_col, self.vector_col, query_vector=self.vector_col, carry=(self.doc_col,), probes=probes)


def _sparse_blocks(queries: DataFrame, query_id: str, weights: str) -> Iterator[tuple[list, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of queries of about ``BLOCK_TERMS`` terms: their ids, the tokens, and of each the places and weights of the queries that have it. Several blocks' queries are saved first."""
    own = queries.where(F.col(query_id).isNotNull()).select(query_id, F.col(weights).alias("w"))
    own = Scratch(queries.sparkSession, "queries").save(own, "weights")
    terms = own.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    blocks = max(1, -(-terms // BLOCK_TERMS))
    for b in range(blocks):
        part = own.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else own
        rows = sorted(part.where(F.size("w") > 0).collect(), key=lambda r: r[0])  # a block's size is bounded
        by: dict[str, list[tuple[int, float]]] = {}
        for k, r in enumerate(rows):
            for token, w in r[1].items():
                if w is not None:
                    by.setdefault(token, []).append((k, w))
        if by:
            flat = np.array([x for xs in by.values() for x in xs], np.float64).reshape(-1, 2)
            yield [r[0] for r in rows], list(by), np.append(0, np.cumsum([len(x) for x in by.values()])), flat[:, 0].astype(np.int64), flat[:, 1]


def _cuts(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows over which running totals grow by ``SLICE`` at most, or of one row."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
        yield lo, hi
        lo = hi


def _products(row: np.ndarray, n: np.ndarray, rows: int) -> Iterator[tuple[int, int, slice]]:
    """Ranges of rows whose entries, of n products each, have about ``SLICE`` of them, and the entries of each; a row stays whole."""
    ends = np.append(0, np.cumsum(n))[np.searchsorted(row, np.arange(rows), side="right")]  # products up to a row's end
    for lo, hi in _cuts(ends):
        yield lo, hi, slice(*np.searchsorted(row, [lo, hi]))


def _sparse_candidates(docs: DataFrame, shared: _Shared, id_type: T.DataType, k: int, id_col: str, weights: str) -> DataFrame:
    """Of every task the k documents of each query with the largest inner product."""
    fields = [T.StructField("query_id", id_type), docs.schema[id_col], T.StructField("sim", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in shared.parts(batches):
            for ids, tokens, starts, which, w in shared:
                best, tokens, every = _Best(len(ids), k, ["q", "key", "sim", id_col]), pa.array(tokens), np.arange(len(ids))
                for batch in held:
                    for lo, hi in _cuts(np.cumsum(len(ids) + 4 * np.diff(batch.column(1).offsets.to_numpy()))):  # a token takes some numbers
                        part = batch.slice(lo, hi - lo)
                        part = part.take(pc.sort_indices(part.column(0)))
                        maps = part.column(1)
                        at = pc.index_in(maps.keys, value_set=tokens)
                        entry = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                        token, value = at.take(pa.array(entry)).to_numpy(zero_copy_only=False).astype(np.int64), maps.items.take(pa.array(entry)).to_numpy(zero_copy_only=False).astype(np.float64)
                        row = np.searchsorted(maps.offsets.to_numpy(), entry, side="right") - 1
                        n = starts[token + 1] - starts[token]
                        for a, b, some in _products(row, n, part.num_rows):
                            m = n[some]
                            term = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(starts[token[some]], m)
                            at = which[term] * (b - a) + np.repeat(row[some] - a, m)
                            sims = np.bincount(at, w[term] * np.repeat(value[some], m), len(ids) * (b - a)).reshape(len(ids), -1)
                            best.add(np.where(sims != 0, sims, np.nan), every, part.select([0]).slice(a, b - a))
                table = best.cut()
                if table is not None:
                    queries = pa.array(ids, None if not len(ids) or isinstance(ids[0], str) else pa.int64()).take(table["q"].combine_chunks())
                    yield from pa.Table.from_arrays([queries, table[id_col], table["sim"]], names=["query_id", id_col, "sim"]).combine_chunks().to_batches()

    return docs.select(id_col, weights).mapInArrow(run, T.StructType(fields))


def sparse_top_k(docs: DataFrame, queries: DataFrame, k: int = 100, id_col: str = "doc_id", query_id: str = "query_id", weights: str = "weights") -> DataFrame:
    """(query_id, id, sim, rank) by the inner product of map<string, float> columns; documents that share no token do not rank.

    Documents may have the tokens' numbers instead of tokens, as the store keeps them; the queries' are then coded alike.

    The documents are streamed once past all blocks of query terms, and a task ships at most k rows per
    query and part of it. Null ids and maps and null weights take no part; without queries the result is empty.
    """
    id_type = T.StringType() if isinstance(queries.schema[query_id].dataType, T.StringType) else T.LongType()
    rows = docs.where(F.col(id_col).isNotNull() & F.col(weights).isNotNull())
    by_number, named = (isinstance(df.schema[weights].dataType.keyType, kind) for df, kind in ((docs, T.LongType), (queries, T.StringType)))
    if by_number and named:
        queries = queries.withColumn(weights, coded(weights))
    blocks = _sparse_blocks(queries, query_id, weights)
    if (first := next(blocks, None)) is None:
        fields = [T.StructField("query_id", id_type), docs.schema[id_col], T.StructField("sim", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    return _ranked(_sparse_candidates(rows, _Shared(docs.sparkSession, chain([first], blocks)), id_type, k, id_col, weights), k, id_col)


def fuse(rankings: list[DataFrame], id_col: str, k: int = 60, top_n: int = 20) -> DataFrame:
    """Reciprocal-rank fusion: (query_id, id, score, rank) by the sum of 1 / (k + rank); ties go to the better place in the first ranking, then in the next."""
    marked = [r.select("query_id", id_col, "rank", F.lit(m).alias("m")) for m, r in enumerate(rankings)]
    places = [F.min(F.when(F.col("m") == m, F.col("rank"))).alias(f"r{m}") for m in range(len(rankings))]
    sums = reduce(DataFrame.unionByName, marked).groupBy("query_id", id_col).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *places)
    order = [F.round("score", 9).desc(), *[F.col(f"r{m}").asc_nulls_last() for m in range(len(rankings))], F.col(id_col)]
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= top_n).select("query_id", id_col, "score", "rank")


def diversify(pool: DataFrame, k: int = 10, weight: float = 0.9, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): greedy maximal marginal relevance inside each query's pool (query_id, id, sim, vector).

    Each place goes to the row of the largest ``weight`` * sim - (1 - weight) * (largest cosine with a row placed before, 0 for the first), rounded to six decimals, ties to the smaller
    id. A pool is the first rows of a search, so a group is bounded by that; rows with a null vector, or of a length other than that of the pool's first, are not placed.
    """
    if not 0 <= weight <= 1:
        raise ValueError("weight must be from 0 to 1")
    schema = T.StructType([pool.schema["query_id"], pool.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(id_col, "ascending")]).combine_chunks()
        x, sims = _unit(_matrix(group[vector_col].chunk(0), len(group[vector_col][0]))), group["sim"].to_numpy()
        most, open_, picked, scores = np.zeros(len(x)), np.ones(len(x), bool), [], []
        for _ in range(min(k, len(x))):
            score = np.where(open_, np.rint((weight * sims - (1 - weight) * most) * 10**DIGITS), -np.inf)
            best = int(score.argmax())  # of equal ones the first, which has the smaller id
            picked.append(best)
            scores.append(score[best] / 10**DIGITS)
            open_[best] = False
            near = x @ x[best]
            most = near if len(picked) == 1 else np.maximum(most, near)
        at = pa.array(picked, pa.int64())
        return pa.table([group["query_id"].take(at), group[id_col].take(at), pa.array(scores, pa.float64()), pa.array(range(1, len(picked) + 1), pa.int32())], schema.names)

    own = pool.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select("query_id", id_col, F.col("sim").cast("double").alias("sim"), vector_col)
    length = F.first(F.size(vector_col)).over(Window.partitionBy("query_id").orderBy(F.round("sim", DIGITS).desc(), id_col))
    return own.withColumn("_n", length).where(F.col("_n") == F.size(vector_col)).drop("_n").groupBy("query_id").applyInArrow(run, schema)


def verbatim(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage_id: str = "item_id", passage_col: str = "text") -> DataFrame:
    """(passage id, id) of documents that contain a passage, in one pass over the documents.

    A block of ``PASSAGE_CHARS`` characters of passages is one automaton (of the package ``pyahocorasick``), which reads a text once whatever their number. Null and empty passages are in no
    document; null ids of passages take no part; rows of documents are judged one by one.
    """
    rows = passages.where(F.col(passage_id).isNotNull() & (F.col(passage_col) != "")).select(passage_id, F.col(passage_col).alias("passage"))
    rows = Scratch(docs.sparkSession, "passages").save(rows, "passages")
    chars = rows.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // PASSAGE_CHARS))
    kinds = T.StructType([passages.schema[passage_id], docs.schema[id_col]])

    def block(b: int) -> dict[str, list]:
        own: dict[str, list] = {}
        for i, passage in rows.where(F.pmod(F.xxhash64(passage_id, "passage"), F.lit(blocks)) == b).collect():  # a block's size is bounded
            own.setdefault(passage, []).append(i)
        return own

    shared = _Shared(docs.sparkSession, map(block, range(blocks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ahocorasick import Automaton

        for part in shared.parts(batches):
            for own in shared:
                machine = Automaton()
                for passage, ids in own.items():
                    machine.add_word(passage, ids)
                if not len(machine):
                    continue
                machine.make_automaton()
                for batch in part:
                    row, found = [], []
                    for k, text in enumerate(batch.column(1)):
                        hits = {id(ids): ids for _, ids in machine.iter(text.as_py() or "")}
                        for ids in hits.values():
                            found += ids
                            row += [k] * len(ids)
                    if row:
                        yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(0).take(pa.array(row, pa.int64()))], names=kinds.names)

    return docs.select(id_col, text_col).mapInArrow(run, kinds)
