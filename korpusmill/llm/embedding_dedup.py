"""Near-duplicate embeddings: an exact metric range join on unit vectors.

Equal vectors of a label are one row with a weight. Pivots partition the vectors of a label into cells of their nearest pivot.
Two unit vectors of cosine c or more are at most r = sqrt(2 - 2c) apart, so by the triangle inequality x can have a partner in
the cell of pivot q only if d(x, q) <= d(x, p) + 2r, p being its own pivot, and only if it is within r of the plane halfway
between p and q. There it is replicated; of two cells the one of smaller number takes the other's boundary. The first
pivots, of bounded number, are broadcast; cells that these leave large are partitioned once more by pivots of their own,
which are joined to them. Cells are cut in blocks of bounded size, and every pair of blocks is a group of its own, so
neither a dense cell nor a label with most rows is a large group. Blocks report counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from korpusmill.llm.components import components
from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

#: Rows aimed at in a block, and first pivots over all labels at most (their choice changes the work, not the result).
BLOCK_ROWS = 8192
MAX_PIVOTS = 1024
#: Bytes of a block's vectors in double precision, and similarities that are computed at once.
BLOCK_BYTES, SLICE = 64 << 20, 1 << 22
HASHES = 1 << 30


def _pivots(vectors: DataFrame) -> dict[str, np.ndarray]:
    """By group: unit vectors taken by a hash of their ids, about one for ``BLOCK_ROWS`` rows."""
    spark = vectors.sparkSession
    counts = vectors.groupBy("g").count().orderBy(F.desc("count"), "g").limit(MAX_PIVOTS)
    top = [(g, n) for g, n in counts.collect() if n > BLOCK_ROWS]
    total = sum(n for _, n in top)
    rate = min(1 / BLOCK_ROWS, MAX_PIVOTS / max(total, 1))
    if not top:
        return {}
    chosen = spark.createDataFrame([(g,) for g, _ in top], "g string")
    rows = (
        vectors.join(F.broadcast(chosen), "g").where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(HASHES)) < int(rate * HASHES))
        .select("g", "id", "v").limit(2 * MAX_PIVOTS).collect()
    )
    by: dict[str, list] = {}
    for g, _, v in sorted((r.g, r.id, r.v) for r in rows):
        by.setdefault(g, []).append(v)
    return {g: _unit(np.array(v, np.float64)) for g, v in by.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1))


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and the cells (vectors, pivots) that it may have partners in, its own among them."""
    d = np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))
    home = d.argmin(axis=1)
    own = d[np.arange(len(x)), home][:, None]
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    slack = 1e-9
    near = (d <= own + 2 * radius + slack) & (d * d - own * own <= 2 * apart * (radius + slack) + slack)
    near[np.arange(len(x)), home] = True
    return home, near


def _below(near: np.ndarray, home: np.ndarray) -> np.ndarray:
    return near & (np.arange(near.shape[1])[None, :] < home[:, None])


def _assigned(vectors: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """(g, id, v, n, cell, boundary): a row per vector and cell it is in."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column(0).to_pylist(), dtype=object)
            rows, cells = [np.arange(len(groups))], [np.zeros(len(groups), np.int64)]
            for g in set(groups.tolist()) & shared.value.keys():
                own = np.flatnonzero(groups == g)
                home, near = cells_of(_matrix(batch.column(2).take(pa.array(own))), shared.value[g], radius)
                cells[0][own] = home
                r, c = np.nonzero(_below(near, home))
                rows.append(own[r])
                cells.append(c)
            row, cell = np.concatenate(rows), np.concatenate(cells).astype(np.int64)
            edge = np.arange(len(row)) >= len(groups)
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell), pa.array(edge)], names=["g", "id", "v", "n", "cell", "boundary"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("g", "id", "v", "n").mapInArrow(run, f"g string, id long, v {kind}, n long, cell long, boundary boolean")


def _divided(placed: DataFrame, radius: float, scratch: Scratch) -> DataFrame:
    """``placed`` with ``sub``, a cell within the cell: cells of over 4 * ``BLOCK_ROWS`` rows are partitioned by pivots out of themselves.

    A cell's rows go to pivots in parts of ``BLOCK_ROWS``, each with a copy of them. A boundary row is in every inner cell
    in which it may have partners, as boundary.
    """
    sizes = placed.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 4 * BLOCK_ROWS)
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("rows") / BLOCK_ROWS)), "large-cells")
    whole = placed.withColumn("sub", F.lit(0).cast("long"))
    if not sizes.limit(1).count():
        return whole
    keys, zero = ["g", "cell"], F.lit(0).cast("long")
    large = join_unique(placed, sizes.withColumn("count", F.col("rows")), keys, "count", "inner", 60)
    rest = whole.join(sizes.select(*keys), keys, "left_anti")
    rate = F.least(1 / F.lit(float(BLOCK_ROWS)), MAX_PIVOTS / F.col("rows")) * HASHES
    chosen = ~F.col("boundary") & (F.pmod(F.xxhash64("id", F.lit("inner pivot")), F.lit(HASHES)) < rate)
    pivots = large.where(chosen).select(*keys, F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), "id", "v", "n", "boundary", F.lit(True).alias("pivot"))
    members = large.select(*keys, F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).alias("part"), "id", "v", "n", "boundary", F.lit(False).alias("pivot"))

    def assign(key, table):
        pivot = table["pivot"].to_numpy()
        own = table.filter(pa.array(~pivot)).drop_columns(["part", "pivot"])
        inner = table.filter(pa.array(pivot)).sort_by("id")
        edge = own["boundary"].to_numpy()
        if not len(inner):
            return own.append_column("sub", pa.array(np.zeros(len(own), np.int64)))
        rows, cells = [], []
        q = _matrix(inner["v"])
        step = max(1, SLICE // len(q))
        for lo in range(0, len(own), step):
            x = _matrix(own["v"].slice(lo, step))
            home, near = cells_of(x, q, radius)
            e = edge[lo : lo + step]
            near = np.where(e[:, None], near, _below(near, home))
            r, c = np.nonzero(near)
            inside = np.flatnonzero(~e)
            rows += [inside + lo, r + lo]
            cells += [home[inside], c]
        row, cell = np.concatenate(rows), np.concatenate(cells).astype(np.int64)
        out = own.take(pa.array(row))
        at_home = np.concatenate([np.full(len(r), k % 2 == 0) for k, r in enumerate(rows)])
        return out.set_column(out.schema.get_field_index("boundary"), "boundary", pa.array(~at_home)).append_column("sub", pa.array(cell))

    kind = placed.schema["v"].dataType.simpleString()
    schema = f"g string, cell long, id long, v {kind}, n long, boundary boolean, sub long"
    inner = members.unionByName(pivots).groupBy(*keys, "part").applyInArrow(assign, schema)
    return scratch.save(rest.unionByName(inner), "inner-cells")


def _joined(within: bool, table: pa.Table, least: float) -> pa.Table:
    """Of one pair of blocks: (id, links, root) of vectors with links; root is the least id reachable within the pair. A row counts as ``n`` vectors."""
    ids, side, n = table["id"].to_numpy(), table["side"].to_numpy(), table["n"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    right = left if within else right
    links, root = np.zeros(len(ids), np.int64), ids.copy()
    most = np.iinfo(np.int64).max
    if len(left) and len(right):
        x, y, pairs = _matrix(table["v"].take(pa.array(left))), None, []
        y = x if within else _matrix(table["v"].take(pa.array(right)))
        step = max(1, SLICE // len(right))
        for lo in range(0, len(left), step):
            own = left[lo : lo + step]
            near = x[lo : lo + step] @ y.T >= least
            if within:
                near[np.arange(len(own)), np.arange(lo, lo + len(own))] = False
            r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(r):
                continue
            near = near[np.ix_(r, c)]
            links[own[r]] += near @ n[right[c]]
            if not within:
                links[right[c]] += n[own[r]] @ near
            pairs.append((own[r], right[c], np.packbits(near, axis=1), near.shape[1]))
        changed = True
        while changed:
            before = root.copy()
            for r, c, bits, width in pairs:
                near = np.unpackbits(bits, axis=1, count=width).view(bool)
                np.minimum.at(root, r, np.where(near, root[c][None, :], most).min(1))
                np.minimum.at(root, c, np.where(near, root[r][:, None], most).min(0))
            changed = bool((before != root).any())
    some = links > 0
    return pa.table({"id": ids[some], "links": links[some], "root": root[some]})


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Components of vectors linked by a cosine of ``least`` or more, compared within equal labels.

    Returns (id, n_links, component_id, kept): other vectors linked directly, the smallest id reachable, whether it is the
    vector's own. Null, empty or zero vectors, those with null or non-finite components, and rows with a null label link
    with nothing; vectors of unequal length never link. Ids are integers; null ids link with nothing; rows equal in id,
    label and vector are one, links of different vectors that share an id are added up. Vectors are read in their own precision
    and compared in double. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    double = isinstance(vectors.schema[vector_col].dataType.elementType, T.DoubleType)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = every.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.concat_ws(" ", F.size("v"), F.col("label").cast("string")).alias("g"), "id", F.transform("v", lambda x: x + 0).cast(every.schema["v"].dataType).alias("v")
    )
    # equal vectors are the row of their smallest id; hashes of 128 bits tell vectors apart
    keys = ["g", "h1", "h2"]
    hashed = scratch.save(usable.select("g", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"), "id").distinct(), "hashes")
    sets = scratch.save(hashed.groupBy(*keys).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "equal")
    copies = scratch.save(join_unique(hashed, sets.where("n > 1").withColumn("rows", F.col("n")), keys, "rows", row_bytes=60).select("id", "first", "n"), "copies")
    wanted = sets.select(*keys, F.col("first").alias("id"), "n")
    rows = usable.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    distinct = scratch.save(rows.join(wanted, [*keys, "id"]).dropDuplicates([*keys, "id"]).select("g", "id", "v", "n"), "distinct")
    radius = (2 - 2 * least) ** 0.5
    placed = scratch.save(_assigned(distinct, _pivots(distinct), radius), "cells")
    placed = _divided(placed, radius, scratch)

    cell = ["g", "cell", "sub"]
    size = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES / 8) / F.first(F.size("v")))))
    ceil = lambda edge: F.greatest(F.lit(1), F.ceil(F.count_if(F.col("boundary") == edge) / size))
    sizes = scratch.save(placed.groupBy(*cell).agg(ceil(False).alias("blocks"), ceil(True).alias("edges"), F.count_if("boundary").alias("outer"), F.count(F.lit(1)).alias("rows")), "sizes")
    cut = join_unique(placed, sizes, cell, "rows", row_bytes=80).withColumn("b", F.pmod(F.xxhash64("id"), F.when(F.col("boundary"), F.col("edges")).otherwise(F.col("blocks"))))
    pair = lambda i, j, side, edge: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"), F.lit(edge).alias("edge"))
    b, blocks, edges, zero = F.col("b"), F.col("blocks"), F.col("edges"), F.lit(0).cast("long")
    home = F.transform(F.sequence(zero, blocks - 1), lambda k: pair(F.least(b, k), F.greatest(b, k), (b > k), False))
    outer = F.when(F.col("outer") > 0, F.transform(F.sequence(zero, edges - 1), lambda k: pair(b, k, F.lit(0), True))).otherwise(F.slice(F.transform(F.sequence(zero, zero), lambda k: pair(b, k, F.lit(0), True)), 1, 0))
    other = F.transform(F.sequence(zero, blocks - 1), lambda k: pair(k, b, F.lit(1), True))
    pairs = (
        cut.withColumn("at", F.explode(F.when(F.col("boundary"), other).otherwise(F.concat(home, outer))))
        .select(*cell, F.col("at.i").alias("i"), F.col("at.j").alias("j"), F.col("at.edge").alias("edge"), F.col("at.side").alias("side"), "id", "v", "n")
    )

    def join(key, table):
        _, _, _, i, j, edge = (k.as_py() for k in key)
        return _joined(i == j and not edge, table, least)

    found = scratch.save(pairs.groupBy(*cell, "i", "j", "edge").applyInArrow(join, "id long, links long, root long"), "links")
    pairs_ = found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(copies.select(F.col("id").alias("a"), F.col("first").alias("b")))
    labels = components(pairs_, scratch)
    # a copy has the links of its first row, and the other copies
    first = found.groupBy("id").agg(F.sum("links").alias("links"), F.count(F.lit(1)).alias("rows"))
    own = copies.groupBy("first").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("first", "id")
    first = scratch.save(first.drop("rows").join(own, "id"), "copied-links")
    passed = join_unique(copies.where("id <> first").select("id", F.col("first")), first.withColumnRenamed("id", "first"), ["first"], "rows", row_bytes=32).select("id", "links")
    counts = found.select("id", "links").unionByName(passed).unionByName(copies.select("id", (F.col("n") - 1).alias("links"))).groupBy("id").agg(F.sum("links").alias("links"))
    known = every.where("id IS NOT NULL").select("id").join(counts, "id", "left").join(labels, "id", "left")
    out = known.select("id", "links", F.coalesce("component", "id").alias("component_id")).unionByName(
        every.where("id IS NULL").select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component_id"))
    )
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", kept)
