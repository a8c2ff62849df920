"""Near-duplicate documents: SetSketch registers, bands, joint likelihood estimate, exact verification.

A document's sketch holds for each register the exponentially spaced, truncated minimum of an exponentially distributed
hash over its shingles; the sketch of a union is the registers' maximum. Bands of register values nominate
candidates; the likelihood of the registers' joint counts says which of them are far from the threshold.

Documents with equal shingle sets are one node. Candidates that the likelihood leaves are joined to families: a bucket's
members are first held against its smallest id, and buckets whose members this leaves in several families are compared
throughout, in pairs of blocks of sketches. The texts of a family are then compared on their whole sets: a family of up to
``TEXTS`` throughout; in a larger one every text is held against a few of its members (hubs), so that each is shipped once,
and only what these leave outside of the family's largest component is compared with the others in pairs of blocks. Groups
are of bounded size and report spanning links only, so no pairs are emitted, no group is one task's, and none has a limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from korpusmill.llm.components import components
from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Base, rate and largest register value of the sketch.
BASE, RATE, LARGEST = 1.001, 20.0, 2**16 - 2
#: Standard errors by which an estimate must miss the threshold before a pair is left unverified.
ERRORS = 6.0
_RNG = np.random.default_rng(9)
_ODD = _RNG.integers(0, 2**32, (2, REGISTERS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
#: Rows of a block of sketches and of texts; columns of a 0/1 matrix, and products in it up to which sets are compared by one.
SKETCHES, TEXTS = 512, 128
#: Members of a larger family that all of it is held against: the smallest id and the least by hashes.
HUBS = 4
COLUMNS, DENSE = 1 << 14, 1 << 23
#: Shingles that are hashed into all registers at once.
BLOCK = 1 << 15
FLUSH = 4 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``words`` words; a text of fewer words is one shingle, without words none.

    A-Z are lower-cased; words are separated by ASCII white space.
    """
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, own), np.uint64, len(own))
    k = min(words, len(own))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (one row per non-empty set)."""
    minima = np.full((REGISTERS, len(sets)), 2**32 - 1, np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= BLOCK):
            size += len(sets[j])
            j += 1
        block, lens = np.concatenate(sets[i:j]), [len(s) for s in sets[i:j]]
        for lo in range(0, len(block), 8 * BLOCK):  # one very large set goes in parts
            part = (block[lo : lo + 8 * BLOCK] >> np.uint64(16)).astype(np.uint32)
            at = np.cumsum([0, *lens[:-1]]) if j - i > 1 else np.zeros(1, np.int64)
            for r in range(REGISTERS):
                x = part * _ODD[0, r]
                x ^= x >> np.uint32(15)
                x *= _ODD[1, r]
                minima[r, i:j] = np.minimum(minima[r, i:j], np.minimum.reduceat(x, at))
        i = j
    least = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16).T.copy()


def band_keys(registers: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys of the bands' register values."""
    out = np.empty((len(registers), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(registers), b + 1, np.uint64)
        for r in registers[:, b * ROWS : (b + 1) * ROWS].T:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + r)
        out[:, b] = key
    return out


def likely_jaccard(one: np.ndarray, two: np.ndarray, n1: np.ndarray, n2: np.ndarray, grid: int = 100) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sketches, given the sets' sizes."""
    more, less = (one > two).sum(1), (one < two).sum(1)
    same = one.shape[1] - more - less
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)
    j = top[:, None] * np.linspace(0, 1, grid + 1)[None, :]
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = share(u[:, None] - v[:, None] * j), share(v[:, None] - u[:, None] * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = more[:, None] * log(p) + less[:, None] * log(q) + same[:, None] * log(1 - p - q)
    return j[np.arange(len(j)), fit.argmax(1)]


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, texts = 0, batch.column(1)
            while i < len(texts):
                sets, size, first = [], 0, i
                while i < len(texts) and size < FLUSH:
                    text = texts[i].as_py() or ""
                    sets.append(shingles(text, words))
                    size += len(text)
                    i += 1
                some = [k for k, s in enumerate(sets) if len(s)]
                regs: list = [None] * len(sets)
                for k, r in zip(some, sketches([sets[k] for k in some]), strict=True):
                    regs[k] = r.tobytes()
                sums = [[int(np.bitwise_xor.reduce(s)) if len(s) else 0, int(np.sum(_mix(s ^ np.uint64(77)), dtype=np.uint64))] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(np.array([x[k] for x in sums], np.uint64).view(np.int64)) for k in (0, 1)), pa.array(regs, pa.binary()),
                    ],
                    names=["id", "n", "s1", "s2", "registers"],
                )

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, registers binary")


def _buckets(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(band_keys(regs).ravel().view(np.int64)), pa.array(ids)], names=["key", "id"])

    return nodes.select("id", "registers").mapInArrow(run, "key long, id long")


def _likely_pairs(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of sketches may be of sets that reach ``least``."""
    floor = least - ERRORS * (least * (1 - least) / REGISTERS) ** 0.5
    keep = ((ra == rb).sum(axis=1) >= 0.97 * floor * REGISTERS) & (np.minimum(na, nb) >= (least - 1e-9) * np.maximum(na, nb))
    if len(some := np.flatnonzero(keep)):
        keep[some] = likely_jaccard(ra[some], rb[some], na[some], nb[some]) >= floor
    return keep


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(pairs: DataFrame, nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) that may reach ``least``; an ``a`` may have very many."""
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    one = scratch.save(nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra")).join(hubs, "a"), "hub-sketches")
    two = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                na, nb = (batch.column(k).to_numpy().astype(float) for k in (2, 3))
                keep = _likely_pairs(_registers(batch.column(4)), _registers(batch.column(5)), na, nb, least)
                yield batch.select([0, 1]).filter(pa.array(keep))

    joined = join_unique(pairs, one, ["a"], "pairs", row_bytes=2 * REGISTERS + 40).join(two, "b").select("a", "b", "na", "nb", "ra", "rb")
    return joined.mapInArrow(run, "a long, b long")


def _apart(rows: DataFrame, group: str, size: int, scratch: Scratch) -> DataFrame:
    """Rows (group, id, component, ...) of the groups of several components as pairs of blocks (group, i, j, side, id, component, ...).

    What is outside of a group's largest component, in blocks of about ``size`` rows (i, side false), meets all of the
    group in such blocks (j, side true), so that work follows what is apart and a pair of blocks is of bounded size.
    """
    counts = rows.groupBy(group, "component").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy(group).agg(F.max(F.struct("c", "component")).alias("best"), F.sum("c").alias("rows"), F.count(F.lit(1)).alias("several")).where("several > 1")
    ceil = lambda n: F.ceil(n / size)
    main = sums.select(group, F.col("best.component").alias("main"), "rows", ceil(F.col("rows")).alias("across"), ceil(F.col("rows") - F.col("best.c")).alias("down"))
    cut = join_unique(rows, scratch.save(main, "main"), [group], "rows", row_bytes=40)
    block = lambda n, name: F.pmod(F.xxhash64("id", F.lit(name)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    whole = F.transform(every("down"), lambda i: at(i, block("across", "whole"), True))
    apart = F.transform(every("across"), lambda j: at(block("down", "apart"), j, False))
    here = F.when(F.col("component") == F.col("main"), whole).otherwise(F.concat(whole, apart))
    return cut.withColumn("at", F.explode(here)).select(group, "at.i", "at.j", "at.side", *[c for c in rows.columns if c != group])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each group, given rows (group, i, j, ...) in order; a pair of blocks is of bounded size."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if rest and (keys[lo] != last).any():
                yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            rest.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _forest(side: np.ndarray, within: bool, alike: Callable[[int, np.ndarray], np.ndarray], root: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of a group; ``alike(i, others)`` is asked only for members that are not yet in one component (``root``)."""
    root, out = np.arange(len(side)) if root is None else root, []
    for i in np.flatnonzero(~side).tolist():
        others = np.flatnonzero(root != root[i])
        others = others[others > i] if within else others[side[others]]
        if not len(others):
            continue
        hits = others[alike(i, others)]
        roots, first = np.unique(root[hits], return_index=True)
        if len(roots):
            out += [(i, h) for h in hits[first].tolist()]
            every = np.append(roots, root[i])
            root[np.isin(root, every)] = every.min()
    return out


def _links(group: pa.RecordBatch, found: list[tuple[int, int]]) -> pa.RecordBatch:
    ids = group.column(4)
    return pa.RecordBatch.from_arrays([ids.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1)], names=["a", "b"])


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _likely_within(held: DataFrame, nodes: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Links (a, b) that span, in every bucket, the members that may reach ``least`` with each other; ``held``: (key, id, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            regs, n = _registers(g.column(7)), g.column(6).to_numpy().astype(float)
            alike = lambda i, o: _likely_pairs(regs[np.full(len(o), i)], regs[o], n[np.full(len(o), i)], n[o], least)  # noqa: B023, E731
            yield _links(g, _forest(g.column(3).to_numpy(zero_copy_only=False), False, alike, _roots(g.column(5))))

    rows = _apart(held, "key", SKETCHES, scratch).join(nodes, "id").select("key", "i", "j", "side", "id", "component", "n", "registers")
    return _dealt(rows, "key").mapInArrow(run, "a long, b long").distinct()


def _roots(components_: pa.Array) -> np.ndarray:
    return np.unique(components_.to_numpy(), return_inverse=True)[1]


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the sets' elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((len(sets), len(sets)))
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, len(every), COLUMNS):
        a, b = np.searchsorted(at, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        out += x @ x.T
    return out


def _compare(sets: list[np.ndarray], num: int, den: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """alike(i, others): whether den * intersection >= num * union."""
    n = np.array([len(s) for s in sets])
    both = _shared(sets) if len(sets) > 4 and len(sets) * n.sum() <= DENSE else None

    def alike(i: int, others: np.ndarray) -> np.ndarray:
        ok = den * np.minimum(n[i], n[others]) >= num * np.maximum(n[i], n[others])
        for k in np.flatnonzero(ok).tolist():
            o = others[k]
            common = both[i, o] if both is not None else len(np.intersect1d(sets[i], sets[o], assume_unique=True))
            ok[k] = common > 0 and den * common >= num * (n[i] + n[o] - common)
        return ok

    return alike


def _verified(families: DataFrame, texts: DataFrame, words: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) whose components are, in every family, those of the texts whose whole sets have den * intersection >= num * union; ``families``: (id, family), ``texts``: (id, text)."""
    zero, no = F.lit(0).cast("long"), F.lit(False)
    hashes = [F.xxhash64("id", F.lit(k)) for k in range(1, HUBS)]
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first"), *[F.min(h).alias(f"h{k}") for k, h in enumerate(hashes)])
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("rows") / TEXTS)), "family-sizes")
    is_hub = F.col("id") == F.col("first")
    for k, h in enumerate(hashes):
        is_hub = is_hub | (h == F.col(f"h{k}"))
    placed = scratch.save(
        join_unique(families, sizes, ["family"], "rows", row_bytes=8 * (HUBS + 3))
        .select("family", "id", F.col("parts").alias("parts"), (is_hub & (F.col("parts") > 1)).alias("hub"), F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).alias("part")), "placed"
    )
    # j = 0: a whole family; j = -1: a part of one with its hubs, which every part gets (side)
    j = F.when(F.col("parts") > 1, F.lit(-1)).otherwise(F.lit(0)).cast("long").alias("j")
    members = texts.join(placed, "id")
    own = members.select("family", F.col("part").alias("i"), j, no.alias("side"), "id", "text")
    hubs = members.where("hub").select("family", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), j, (~no).alias("side"), "id", "text")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            alike = _compare([shingles(t.as_py(), words) for t in g.column(5)], num, den)
            side = g.column(3).to_numpy(zero_copy_only=False)
            if g.column(2)[0].as_py() == 0:
                yield _links(g, _forest(side, True, alike))
                continue
            rest, ids = np.flatnonzero(~side), g.column(4).to_numpy()
            yield _links(g, [(h, int(o)) for h in np.flatnonzero(side).tolist() for o in rest[alike(h, rest)] if ids[h] != ids[o]])

    links = scratch.save(_dealt(own.unionByName(hubs), "family").mapInArrow(first, "a long, b long"), "links")

    # what the hubs leave outside of a family's largest component
    large = placed.where("parts > 1").select("family", "id")
    if not large.limit(1).count():
        return links
    found = scratch.save(components(links, scratch), "found")
    held = scratch.save(large.join(found, "id", "left").select("family", "id", F.coalesce("component", "id").alias("component")), "members")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            alike = _compare([shingles(t.as_py(), words) for t in g.column(6)], num, den)
            yield _links(g, _forest(g.column(3).to_numpy(zero_copy_only=False), False, alike, _roots(g.column(5))))

    pairs = texts.join(_apart(held, "family", TEXTS, scratch), "id").select("family", "i", "j", "side", "id", "component", "text")
    more = scratch.save(_dealt(pairs, "family").mapInArrow(second, "a long, b long"), "more-links")
    return more.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Components of documents linked by den * intersection >= num * union of their sets of ``words``-word shingles.

    Returns (id, n_shingles, component_id, kept): the smallest id reachable by links, and whether it is the document's own.
    Texts without words (null, empty, blank) have no shingles and no links. Ids are integers; a null id has a null component
    and is kept; rows that share an id are one node, linked if any of their texts is. An empty table gives an empty
    result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = scratch.save(_sketch(own, words), "sketches")
    usable = sketch.where(F.col("id").isNotNull() & (F.col("n") > 0))

    count = F.count(F.lit(1)).alias("rows")
    sets = scratch.save(usable.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.max("id").alias("last"), count).where(F.col("first") < F.col("last")).drop("last"), "equal-sets")
    copies = scratch.save(join_unique(usable.select("id", "s1", "s2"), sets, ["s1", "s2"], "rows", row_bytes=40).where(F.col("id") != F.col("first")), "copies")
    nodes = usable.join(copies.select("id", "s1", "s2"), ["id", "s1", "s2"], "left_anti")

    buckets = _buckets(nodes)
    hubs = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), count).where(F.col("hub") < F.col("last")).drop("last")
    members = scratch.save(join_unique(buckets, scratch.save(hubs, "hubs"), ["key"], "rows", row_bytes=24), "members")
    ids = members.select("id").distinct()
    candidates = scratch.save(usable.join(ids, "id", "left_semi").select("id", "n", "registers"), "candidates")

    # links that may be: of a bucket's members with its smallest id, then among members that these leave apart
    least = num / den
    pairs = scratch.save(members.where(F.col("id") != F.col("hub")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    stars = scratch.save(_likely(pairs, candidates, least, scratch), "stars")
    labels = scratch.save(components(stars, scratch), "star-labels")
    held = scratch.save(members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "held")
    more = scratch.save(_likely_within(held, candidates, least, scratch), "more")
    stars = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
    families = scratch.save(components(stars.unionByName(more), scratch).withColumnRenamed("component", "family"), "families")

    links = _verified(families, own, words, num, den, scratch).unionByName(copies.select(F.col("id").alias("a"), F.col("first").alias("b")))
    labels = components(links, scratch)

    found = sketch.where("id IS NOT NULL").select("id", F.col("n").alias("n_shingles")).join(labels, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    null = sketch.where("id IS NULL").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = found.select("id", "n_shingles", "component_id").unionByName(null)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
