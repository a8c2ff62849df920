"""Repair of conversation structure at least cost.

Roles must read ``(s?(ua)+)?``. A conversation's rows go through an automaton of four states (nothing yet, system, user,
assistant) by keeping, re-roling and deleting rows and inserting empty ones. Conversations are taken in blocks, bucketed by length; a bucket is
a time-major tensor (turn, conversation, state) of backward costs, filled one turn at a time for all conversations, and edits are
traced forward one turn at a time as well.

A conversation of more than ``PIECE_ROWS`` rows is cut into pieces that tasks of their own solve: a piece's costs between
all states at its two ends are a small matrix, matrices are folded from the last piece to the first, and pieces are traced from
every state they may begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from korpusmill.llm.ranks import numbered
from korpusmill.llm.skew import join_unique
from korpusmill.storage import Scratch

WHITE = " \t\n\x0b\f\r"
#: Costs of edits; a truncated row that stays adds CUT.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
NEVER = 1 << 40
#: States: nothing yet, system, user, assistant. Initials: s, u, a, other. STEP: the state that the one role that may be inserted leads to.
STEP = np.array([2, 2, 3, 2])
#: By initial and state the state that keeping the row leads to; 4 is none.
KEEP = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: Costs after the last row, by state.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
ROLE_OF = {2: "user", 3: "assistant"}
LEGAL = np.array([[False, True, False, False], [False, False, True, False], [False, True, False, False], [False] * 4])
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
PIECE_ROWS, BLOCK_ROWS, BLOCK_BYTES = 4096, 20_000, 32 << 20
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, present): rows damaged by crc32(conv:turn) mod 20, nulls of role, text and in the hash being one space.

    0 drops the row (it stays with ``present`` false, so that its conversation is known), 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_col), F.lit(":"), blank(turn_col))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank(text_col), ".!?", "")).otherwise(blank(text_col))
    role = F.when(kind == 4, "user").otherwise(blank(role_col))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.select(F.col(conv_col).alias(conv_col), F.col(turn_col).alias(turn_col), role.alias(role_col), text.alias(text_col), (kind != 0).alias("present"), F.explode(copies).alias("_copy"))
    return out.drop("_copy")


def backward(initial: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Costs (turn + 1, conversation, state) of finishing from before each turn, insertions included; rows are (turn, conversation), ``end`` the costs after the last."""
    turns, n = initial.shape
    costs = np.empty((turns + 1, n, 4), np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        stay = np.minimum(_kept(after, initial[t]), after[:, STEP] + REROLE) + CUT * cut[t][:, None]
        row = np.minimum(after + DELETE, np.where(must[t][:, None], NEVER, stay))
        row = np.minimum(np.minimum(row, row[:, STEP] + INSERT), row[:, STEP[STEP]] + 2 * INSERT)
        costs[t] = np.where((t < length)[:, None], row, after)
    return costs


def _kept(after: np.ndarray, initial: np.ndarray) -> np.ndarray:
    return np.take_along_axis(np.hstack([after, np.full((len(after), 1), NEVER)]), KEEP[initial], axis=1)


def trace(costs: np.ndarray, initial: np.ndarray, must: np.ndarray, cut: np.ndarray, length: np.ndarray, state: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, rows, roles, states): of every step and conversation the edit (0: none), its row or -1, the role given (0: its own), and the states at the end.

    Of the edits on a cheapest way the least letter is taken at every step, which gives the least string. ``last`` adds what must follow the last row.
    """
    turns, n = initial.shape
    every, steps = np.arange(n), []
    for t in range(turns):
        here, after = costs[t], costs[t + 1]
        open_ = t < length
        for _ in range(3):
            if not open_.any():
                break
            cost = here[every, state]
            delete = after[every, state] + DELETE == cost
            insert = here[every, STEP[state]] + INSERT == cost
            keep = ~must[t] & (_kept(after, initial[t])[every, state] + CUT * cut[t] == cost)
            letter = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
            letter = np.where(open_, letter, 0).astype(np.uint8)
            given = np.isin(letter, [ord("I"), ord("R")])
            state = np.where(given, STEP[state], np.where(letter == ord("K"), KEEP[initial[t], state], state))
            steps.append((letter, np.where(np.isin(letter, [ord("K"), ord("R"), ord("D")]), t, -1), np.where(given, state, 0)))
            open_ = open_ & (letter == ord("I"))
    for _ in range(2 if last else 0):
        open_ = END[state] > 0
        state = np.where(open_, STEP[state], state)
        steps.append((np.where(open_, ord("I"), 0).astype(np.uint8), np.full(n, -1), np.where(open_, state, 0)))
    return *(np.stack(x, axis=1) if steps else np.zeros((n, 0), np.int64) for x in (zip(*steps, strict=True) if steps else ([], [], []))), state


class _Block:
    """Whole conversations or pieces, one after another: rows (role, text, initial, fault) and where each begins."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.role, self.text = (table[c].combine_chunks() for c in ("role", "text"))
        self.initial, self.fault = (table[c].to_numpy() for c in ("initial", "fault"))
        self.starts, self.lengths = starts[:-1], np.diff(starts)

    def classes(self) -> Iterator[np.ndarray]:
        """Groups of like length: up to 1, 2, 4, ... rows."""
        size = np.ceil(np.log2(np.maximum(self.lengths, 1))).astype(int)
        for c in np.unique(size):
            yield np.flatnonzero(size == c)

    def tensor(self, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Time-major initials, rows that must go and rows that are cut, and the lengths."""
        length = self.lengths[which]
        at = np.arange(length.max(initial=0))[:, None] + self.starts[which]
        at = np.minimum(at, max(len(self.initial) - 1, 0))
        fault = self.fault[at] if len(self.fault) else np.zeros(at.shape, np.int8)
        return (self.initial[at] if len(self.initial) else fault), (fault == BLANK) | (fault == DUPLICATE), fault == TRUNCATED, length

    def written(self, which: np.ndarray, letters: np.ndarray, rows: np.ndarray, roles: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Of each the audit string and the list of repaired (role, text)."""
        mask = letters > 0
        ends = np.append(0, np.cumsum(mask.sum(axis=1)))
        audit = pa.StringArray.from_buffers(len(which), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(letters[mask].astype(np.uint8).tobytes()))
        mask &= letters != ord("D")
        ends = np.append(0, np.cumsum(mask.sum(axis=1)))
        own = (self.starts[which][:, None] + rows)[mask]
        at, given = pa.array(own, mask=rows[mask] < 0), pa.array(roles[mask])
        role = pc.if_else(pc.equal(given, 0), self.role.take(at), pc.if_else(pc.equal(given, 2), ROLE_OF[2], ROLE_OF[3]))
        lines = pa.StructArray.from_arrays([role, pc.fill_null(self.text.take(at), "")], ["role", "text"])
        return audit, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(values))[np.append(self.starts, self.starts[-1:] + self.lengths[-1:])]) if len(self.starts) else np.zeros(0, np.int64)

    def illegal(self) -> np.ndarray:
        bad = np.zeros(len(self.initial), np.int64)
        bad[1:] = ~LEGAL[self.initial[:-1], self.initial[1:]]
        bad[self.starts[self.lengths > 0]] = 0
        return self.sums(bad)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Blocks of rows sorted by the keys, and where their groups begin; a group is in one block."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            code = table[k].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS or sum(b.nbytes for b in held) >= BLOCK_BYTES:
            table = pa.Table.from_batches(held)
            starts = cut(table)
            if len(starts) > 1:
                yield table.slice(0, starts[-1]), starts
                held = table.slice(starts[-1]).combine_chunks().to_batches()
            else:
                held = table.combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)


def _duplicates(group: np.ndarray, role: pa.Array, text: pa.Array) -> np.ndarray:
    """Whether a row's role and text are those of an earlier row of its group."""
    codes = [c.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text)]
    order = np.lexsort((np.arange(len(group)), *codes, group))
    same = np.ones(max(len(group) - 1, 0), bool)
    for c in (group, *codes):
        same &= c[order][1:] == c[order][:-1]
    out = np.zeros(len(group), bool)
    out[order[1:]] = same
    return out


def _gaps(group: np.ndarray, n: int, turn: np.ndarray) -> np.ndarray:
    """Of every group the whole numbers between its least and largest turn that are no turn; rows are sorted by group and turn and have one."""
    lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(lo, group, turn)
    np.maximum.at(hi, group, turn)
    new = np.ones(len(turn), bool)
    new[1:] = (group[1:] != group[:-1]) | (turn[1:] != turn[:-1])
    distinct = np.bincount(group, new, n).astype(np.int64)
    return np.where(distinct > 0, hi - lo + 1 - distinct, 0)


def _lines(name: str) -> T.StructField:
    return T.StructField(name, T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])))


def _solve_whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for table, starts in _groups(batches, ["key"]):
        starts = np.append(starts, table.num_rows) if starts[-1] != table.num_rows else starts
        n, present = len(starts) - 1, table["present"].to_numpy()
        group = np.repeat(np.arange(n), np.diff(starts))[present]
        first, table = table["conv"].take(pa.array(starts[:-1])), table.filter(table["present"])
        fault = table["fault"].to_numpy().copy()
        fault[_duplicates(group, table["role"].combine_chunks(), table["text"].combine_chunks()) & (fault != BLANK)] = DUPLICATE
        block = _Block(table.drop_columns("fault").append_column("fault", pa.array(fault)), np.searchsorted(group, np.arange(n + 1)))
        timed = table["turn"].is_valid().to_numpy()
        counts = [_gaps(group[timed], n, table["turn"].drop_null().to_numpy()), *(block.sums(fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)), block.illegal()]
        for which in block.classes():
            rows = block.tensor(which)
            costs = backward(*rows, np.broadcast_to(END, (len(which), 4)))
            *steps, _ = trace(costs, *rows, np.zeros(len(which), int), True)
            own = [*(c[which] for c in counts), costs[0][:, 0]]
            yield pa.RecordBatch.from_arrays([first.take(pa.array(which)).combine_chunks(), *(pa.array(c, pa.int64()) for c in own), *block.written(which, *steps)], names=names)


def _piece_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every piece the least costs from each state before it to each state after it."""
    for table, starts in _groups(batches, ["key", "piece"]):
        starts = np.append(starts, table.num_rows) if starts[-1] != table.num_rows else starts
        block, first = _Block(table, starts), pa.array(starts[:-1])
        for which in block.classes():
            rows = block.tensor(which)
            each = [backward(*rows, np.broadcast_to(np.where(np.arange(4) == j, 0, NEVER), (len(which), 4)))[0] for j in range(4)]
            flat = pa.array(np.minimum(np.stack(each, axis=2), NEVER).reshape(-1))
            own = first.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([table["key"].combine_chunks().take(own), table["piece"].combine_chunks().take(own), pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1) * 16, pa.int32()), flat)], names=["key", "piece", "costs"])


def _fold(pdf):
    """Of a conversation's pieces (key, piece, costs) the costs after each, by state: from the last piece back."""
    pdf, after, out = pdf.sort_values("piece"), END, []
    for m in reversed(pdf["costs"].tolist()):
        out.append(after.tolist())
        before = np.minimum((np.asarray(m).reshape(4, 4) + after).min(axis=1), NEVER)
        step = np.minimum(before[STEP] + INSERT, before[STEP[STEP]] + 2 * INSERT)
        after = np.minimum(before, step)
    pdf["after"] = out[::-1]
    return pdf[["key", "piece", "after"]]


def _solve_pieces(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per piece and state that it may begin in."""
    for table, starts in _groups(batches, ["key", "piece"]):
        starts = np.append(starts, table.num_rows) if starts[-1] != table.num_rows else starts
        block, first = _Block(table, starts), pa.array(starts[:-1])
        after = table["after"].combine_chunks().take(first).flatten().to_numpy().reshape(-1, 4)
        last = table["is_last"].combine_chunks().take(first).to_numpy(zero_copy_only=False)
        counts = [*(block.sums(block.fault == f) for f in (BLANK, DUPLICATE, TRUNCATED)), block.illegal()]
        heads, tails = block.initial[block.starts], block.initial[block.starts + block.lengths - 1]
        for every in block.classes():
            for ends in (False, True):
                which = every[last[every] == ends]
                if not len(which):
                    continue
                rows = block.tensor(which)
                costs = backward(*rows, after[which])
                for state in range(4):
                    *steps, to = trace(costs, *rows, np.full(len(which), state), ends)
                    keys = [table[c].combine_chunks().take(first.take(pa.array(which))) for c in ("key", "conv", "piece")]
                    numbers = [np.full(len(which), state), to, heads[which], tails[which], *(c[which] for c in counts), costs[0][:, state]]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int64()) for x in numbers), *block.written(which, *steps)], names=names)


def _join_pieces(batches: Iterator[pa.RecordBatch], names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of ``_solve_pieces`` sorted by conversation and piece, put together one piece at a time: a piece's variant is that of the state the last one ended in."""
    key, own = None, None

    def done() -> pa.RecordBatch:
        values = [own["conv"], own["blank"], own["duplicate"], own["truncated"], own["illegal"], own["cost"], "".join(own["audit"]), own["sha"].hexdigest()]
        kinds = [kind, *[pa.int64()] * 5, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i] for n in ("key", "conv", "piece", "state", "to", "head", "tail", "blank", "duplicate", "truncated", "illegal", "cost")}
            r = {n: v.as_py() for n, v in r.items()}
            if r["key"] != key:
                if own:
                    yield done()
                key, own = r["key"], {"conv": r["conv"], "piece": -1, "to": 0, "tail": None, "audit": [], "sha": hashlib.sha256(), "any": False} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
                own["cost"] = 0
            if r["piece"] == own["piece"] or r["state"] != own["to"]:
                continue
            if own["piece"] < 0:
                own["cost"] = r["cost"]
            for c in ("blank", "duplicate", "truncated", "illegal"):
                own[c] += r[c]
            own["illegal"] += own["tail"] is not None and not LEGAL[own["tail"], r["head"]]
            own["audit"].append(batch.column("audit")[i].as_py())
            for line in batch.column("repaired")[i].as_py():
                own["sha"].update(("\n" if own["any"] else "").encode() + f"{line['role']}:{line['text']}".encode())
                own["any"] = True
            own |= {"piece": r["piece"], "to": r["to"], "tail": r["tail"]}
    if own:
        yield done()


def digest(repaired: Column) -> Column:
    """SHA-256 of the repaired rows as ``role:text`` lines."""
    return F.sha2(F.encode(F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"), "UTF-8"), 256)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256) of every conversation.

    Rows are in the order of turn (nulls first), role and text, so ties have one order and equal rows are neighbours. A row's fault is the first of
    blank (no character but ASCII white space), duplicate (role and text of an earlier row), truncated (does not end in ``.!?``). ``cost`` is that of the cheapest edits, ``audit``
    their letters in order, the ASCII-least of equal cost, ``repaired`` the rows (role, text) that they give, and the digest that of these as ``role:text`` lines.
    Null roles and texts count as one space. Rows with a null conversation are one conversation. Rows whose ``present_col`` is false are not there but name their conversation; one without rows has zeros, no edits and no
    rows. An empty table gives an empty result; other columns are not read.

    Conversations of more than ``piece_rows`` rows are solved in pieces; their ``repaired`` is null, as such a text need not fit in a
    row, while all else is whole. An audit is a value of one row and a digest a sequence, so for these alone one task passes over a conversation's edits, a piece at a time.
    """
    spark = rows.sparkSession
    scratch, conv_type = Scratch(spark, "conversations"), rows.schema[conv_col].dataType
    text, role = F.coalesce(F.col(text_col), F.lit(" ")), F.coalesce(F.col(role_col), F.lit(" "))
    bare = F.btrim(text, F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    initial = F.position(F.substring(role, 1, 1), F.lit("sua")) - 1
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    own = rows.select(
        key.alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.when((initial < 0) | (role == ""), 3).otherwise(initial).cast("tinyint").alias("initial"), fault.cast("tinyint").alias("fault"), present.alias("present"),
    )
    long_ = scratch.save(rows.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece_rows), "long")
    numbers = [T.StructField(c, T.LongType()) for c in COUNTS]
    schema = T.StructType([T.StructField("conv", conv_type), *numbers, T.StructField("audit", T.StringType()), _lines("repaired")])
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    any_long = not long_.isEmpty()
    short = join_unique(own, long_.withColumn("_long", F.lit(True)), ["key"], "n", "left").where("_long IS NULL").drop("_long") if any_long else own
    solved = short.repartition("key").sortWithinPartitions("key", *order).mapInArrow(lambda b: _solve_whole(b, schema.names), schema)
    solved = solved.withColumn("repaired_sha256", digest(F.col("repaired")))
    if any_long:
        solved = solved.unionByName(_repair_long(join_unique(own, long_, ["key"], "n"), order, scratch, conv_type, piece_rows).withColumn("repaired", F.lit(None).cast(_lines("r").dataType)))
    return solved.withColumnRenamed("conv", conv_col)


def _repair_long(own: DataFrame, order: list[Column], scratch: Scratch, conv_type: T.DataType, piece_rows: int) -> DataFrame:
    both = F.concat(F.col("role"), F.lit("\0"), F.col("text"))
    placed = numbered(own.where("present"), order, scratch, ("key",), "nth")
    placed = scratch.save(placed.withColumns({"h1": F.xxhash64(both), "h2": F.xxhash64(F.lit("second"), both)}), "long")
    firsts = scratch.save(placed.groupBy("key", "h1", "h2").agg(F.min("nth").alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    marked = join_unique(placed, firsts, ["key", "h1", "h2"], "n")
    again = (F.col("nth") > F.col("first")) & (F.col("fault") != BLANK)
    marked = marked.withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault")).cast("tinyint")).withColumn("piece", F.floor((F.col("nth") - 1) / piece_rows))
    pieces = scratch.save(marked.select("key", "conv", "piece", "nth", "role", "text", "initial", "fault").repartition("key", "piece").sortWithinPartitions("key", "piece", "nth"), "pieces")

    dealt = lambda df: df.repartition("key", "piece").sortWithinPartitions("key", "piece", "nth")
    costs = dealt(pieces.select("key", "piece", "nth", "initial", "fault").withColumns({"role": F.lit(""), "text": F.lit("")})).mapInArrow(_piece_costs, "key string, piece long, costs array<long>")
    after = costs.groupBy("key").applyInPandas(_fold, "key string, piece long, after array<long>")  # a small row per piece
    latest = F.col("piece") == F.max("piece").over(Window.partitionBy("key"))
    after = scratch.save(after.withColumn("is_last", latest), "after")

    names = ("state", "to", "head", "tail", "blank", "duplicate", "truncated", "illegal", "cost")
    numbers = [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("conv", conv_type), T.StructField("piece", T.LongType()), *numbers, T.StructField("audit", T.StringType()), _lines("repaired")])
    parts = dealt(pieces.join(after, ["key", "piece"])).mapInArrow(lambda b: _solve_pieces(b, schema.names), schema)
    parts = scratch.save(parts, "parts")
    out = T.StructType([T.StructField("conv", conv_type), *[T.StructField(c, T.LongType()) for c in COUNTS[1:]], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    kind = pa.string() if isinstance(conv_type, T.StringType) else pa.int64()
    joined = parts.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(lambda b: _join_pieces(b, out.names, kind), out)
    turns = own.where("present").groupBy("key").agg(F.first("conv").alias("conv"), (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    keyed = joined.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    # a conversation all of whose rows are absent is in neither
    gone = own.groupBy("key").agg(F.first("conv").alias("conv"), F.bool_or("present").alias("there")).where("NOT there")
    none = gone.select("conv", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    found = keyed.join(turns.select("key", F.coalesce("gaps", F.lit(0)).alias("gaps")), "key").select("conv", *COUNTS, "audit", "repaired_sha256")
    return found.unionByName(none)
