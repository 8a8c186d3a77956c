"""Conversation structure repair by Four-Russians block tables.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles. Rows are kept, given another
role, deleted, or rows are inserted, at the least cost; this is an alignment of the rows with an
automaton of four states. Cost vectors hold, for each state, the least cost of all that follows.

* A row is one of nine symbols: must go, or an initial with or without a cut-off text. A row turns
  the vector of what follows into its own. Less their minimum, only few vectors occur; they are
  found once, by following every symbol from the end's vector.
* Block tables have the next vector and the cost added for every such vector and every block of
  ``BLOCK`` symbols. Rows are read block by block from the last one on, a look-up each.
* The edits are told from the first row on. Each block is expanded backward from the vector at its
  end, which gives the vectors within it, so that of all cheapest edits the least letter is
  taken at every step. What a block's edits are depends on its symbols, the vector and the
  state it is entered in; that is kept for when they occur again.

A conversation of any length is spread over tasks: rows are dealt by ranges of conversation and
turn, and cut into chunks of ``CHUNK`` rows at most. A chunk gives the map from each vector at
its end to the one at its beginning, and for each vector the map of states. For conversations of
several chunks these maps, one row a chunk and without texts, are composed from the last to the
first, and then the states from the first to the last. Only the digest of the repaired texts
goes through one stream, as it must.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from footfall.llm.tables import written

#: Symbols of a block, and rows and bytes of text of a chunk.
BLOCK, CHUNK, CHUNK_BYTES = 4, 4096, 1 << 22

# Costs of the edits.
KEEP, RETELL, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
NEVER = 1 << 30
# States: nothing yet, after s, after u, after a; it may end in the first and the last.
BEGIN, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES, ENDS = 4, (BEGIN, AFTER_A)
#: The role that comes next where one is inserted or retold, and the state then.
NEXT = {BEGIN: ("user", AFTER_U), AFTER_S: ("user", AFTER_U), AFTER_U: ("assistant", AFTER_A), AFTER_A: ("user", AFTER_U)}
#: Symbols: GONE must be deleted; else 1 + 2 * place of the initial + (1 if cut off).
INITIALS = "sua?"
GONE, SYMBOLS = 0, 1 + 2 * len(INITIALS)

#: ASCII blanks, ends of a whole text, and roles that may follow each other.
BLANKS, STOPS, LEGAL = " \t\n\x0b\x0c\r", ".!?", {"su", "ua", "au"}


def symbol(role: str, cut_off: bool) -> int:
    place = "sua".find(role[:1]) if role else -1
    return 1 + 2 * (place if place >= 0 else 3) + cut_off


def _kept(state: int, symbol_: int) -> int | None:
    """The state after a row that is kept as it is."""
    initial = INITIALS[(symbol_ - 1) // 2]
    if initial == "s":
        return AFTER_S if state == BEGIN else None
    if initial == "u":
        return AFTER_U if state != AFTER_U else None
    return AFTER_A if initial == "a" and state == AFTER_U else None


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    """The vector where rows may be inserted before what follows."""
    out = list(costs)
    for _ in range(STATES):
        out = [min(out[s], INSERT + out[NEXT[s][1]]) for s in range(STATES)]
    return tuple(out)


def _before(after: tuple[int, ...], symbol_: int) -> tuple[int, ...]:
    """The vector before a row, from the one after it."""
    out = []
    for state in range(STATES):
        choices = [DELETE + after[state]]
        if symbol_ != GONE:
            more = CUT_OFF if (symbol_ - 1) % 2 else 0
            kept = _kept(state, symbol_)
            if kept is not None:
                choices.append(KEEP + more + after[kept])
            choices.append(RETELL + more + after[NEXT[state][1]])
        out.append(min(choices))
    return _with_inserts(out)


class Tables:
    """All normalised vectors, and the block tables."""

    def __init__(self) -> None:
        end = _with_inserts([0 if s in ENDS else NEVER for s in range(STATES)])
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.end, _ = self._named(end)
        steps, costs = [], []
        for vector in self.vectors:  # grows as new vectors are met
            found = [self._named(_before(vector, x)) for x in range(SYMBOLS)]
            steps.append([f[0] for f in found])
            costs.append([f[1] for f in found])
        #: The vector before a symbol, from the one after it, and the cost that it adds.
        self.step, self.cost = np.array(steps, np.int16), np.array(costs, np.int64)
        #: The same for blocks. The first symbol leads in a block's code; the last is read first.
        self.block, self.block_cost = self.step, self.cost
        for _ in range(BLOCK - 1):
            cost = self.block_cost[self.step] + self.cost[:, :, None]
            self.block = self.block[self.step].transpose(0, 2, 1).reshape(len(steps), -1)
            self.block_cost = cost.transpose(0, 2, 1).reshape(len(steps), -1)

    def _named(self, vector: tuple[int, ...]) -> tuple[int, int]:
        least = min(vector)
        vector = tuple(v - least for v in vector)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def _codes(symbols: list[int]) -> tuple[list[int], list[int]]:
    """The symbols before the first whole block, and the codes of the blocks."""
    head = len(symbols) % BLOCK
    codes = []
    for i in range(head, len(symbols), BLOCK):
        code = 0
        for x in symbols[i : i + BLOCK]:
            code = code * SYMBOLS + x
        codes.append(code)
    return symbols[:head], codes


def vectors_before(symbols: list[int], after: int) -> tuple[list[int], int, int]:
    """Vectors at the ends of all blocks (in order), the one before all, and the cost between."""
    t = tables()
    head, codes = _codes(symbols)
    ends, vector, cost = [], after, 0
    for code in reversed(codes):
        ends.append(vector)
        cost += int(t.block_cost[vector, code])
        vector = int(t.block[vector, code])
    ends.append(vector)
    for x in reversed(head):
        cost += int(t.cost[vector, x])
        vector = int(t.step[vector, x])
    return ends[::-1], vector, cost


@lru_cache(maxsize=1 << 18)
def _block_edits(symbols: tuple[int, ...], after: int, state: int) -> tuple[str, int]:
    """The edits of a block's rows and the state after them: the least letter at each step."""
    t = tables()
    inner, vector, cost = [(after, 0)], after, 0
    for x in reversed(symbols):  # backward: costs to go before each row, up to one constant
        cost += int(t.cost[vector, x])
        vector = int(t.step[vector, x])
        inner.append((vector, cost))
    inner.reverse()

    def togo(i: int, s: int) -> int:
        return t.vectors[inner[i][0]][s] + inner[i][1]

    out = []
    for i, x in enumerate(symbols):
        while True:
            now = togo(i, state)
            if now == DELETE + togo(i + 1, state):
                out.append("D")
                break
            if now == INSERT + togo(i, NEXT[state][1]):
                out.append("I")
                state = NEXT[state][1]
                continue
            kept = _kept(state, x) if x != GONE else None
            more = CUT_OFF if x != GONE and (x - 1) % 2 else 0
            if kept is not None and now == KEEP + more + togo(i + 1, kept):
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = NEXT[state][1]
            break
    return "".join(out), state


def _closing(state: int) -> tuple[str, int]:
    """Inserts after the last row."""
    return ("", state) if state in ENDS else ("I" + _closing(NEXT[state][1])[0], AFTER_A)


def edits(symbols: list[int], after: int, state: int, last: bool) -> tuple[str, int]:
    """The edits of the rows in order, from the vector after them and the state before them."""
    ends, _, _ = vectors_before(symbols, after)
    head = len(symbols) % BLOCK
    parts = []
    for k, vector in enumerate(ends):
        begin = 0 if k == 0 else head + (k - 1) * BLOCK
        found, state = _block_edits(tuple(symbols[begin : head if k == 0 else begin + BLOCK]), vector, state)
        parts.append(found)
    if last:
        found, state = _closing(state)
        parts.append(found)
    return "".join(parts), state


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: int) -> Iterator[str]:
    """``role:text`` of the rows that the edits leave, from the state before them."""
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        if letter == "K":
            role, text = next(rows)
            state = _kept(state, symbol(role, False))
        else:
            text = "" if letter == "I" else next(rows)[1]
            role, state = NEXT[state]
        yield f"{role}:{text}"


# --- rows -----------------------------------------------------------------------------


def _space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, _row (tells equal rows apart), and _dropped.

    A dropped row stays as a mark of its conversation. NULL role and text are one space.
    """
    kind = F.crc32(F.concat_ws(":", _space("conv_id"), _space("turn")).cast("binary")) % 20
    given = conversations.select(
        "conv_id",
        "turn",
        _space("role").alias("role"),
        _space("text").alias("text"),
        kind.alias("_kind"),
        F.monotonically_increasing_id().alias("_id"),
    )
    text = (
        F.when(F.col("_kind") == 1, F.lit(""))
        .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return given.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_kind") == 0).alias("_dropped"),
        "_id",
        F.explode(copies).alias("_copy"),
    ).select("conv_id", "turn", "role", "text", "_dropped", F.struct("_id", "_copy").alias("_row"))


def with_duplicates(rows: DataFrame) -> DataFrame:
    """``_seen``: the row's role and text stand earlier in its conversation.

    The first row of each role and text comes from an aggregation without texts; only roles and
    texts that occur more than once are joined to the rows.
    """
    digest = F.sha2("text", 256)
    first = (
        rows.where("NOT _dropped")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), digest.alias("_text"))
        .agg(F.min(F.struct("turn", "_row")).alias("_first"), F.count("*").alias("_n"))  # NULL turns first
        .where("_n > 1")
        .select("_conv", "_role", "_text", "_first._row")
        .withColumnRenamed("_row", "_first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
    seen = F.coalesce((F.col("_first") != F.col("_row")) & ~F.col("_dropped"), F.lit(False))
    joined = rows.join(first, same & (digest == F.col("_text")), "left")
    return joined.select("conv_id", "turn", "role", "text", "_dropped", "_row", seen.alias("_seen"))


# --- chunks ---------------------------------------------------------------------------

COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: What a chunk tells of its rows besides the counts.
EDGES = ("first_role", "last_role", "first_turn", "last_turn", "n_turns")


class Chunk:
    """Consecutive rows of a conversation: their symbols, faults, turns and texts."""

    def __init__(self) -> None:
        self.symbols, self.roles, self.texts, self.size = [], [], [], 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.edges = dict.fromkeys(EDGES)
        self.edges["n_turns"] = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        end = text.rstrip(BLANKS)[-1:]
        fault = "blank" if not end else "duplicate" if seen else "truncated" if end not in STOPS else None
        if fault:
            self.counts[fault] += 1
        gone = fault in ("blank", "duplicate")
        self.symbols.append(GONE if gone else symbol(role, fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(role) + len(text)
        initial, edges = role[:1], self.edges
        if edges["first_role"] is None:
            edges["first_role"] = initial
        elif edges["last_role"] + initial not in LEGAL:
            self.counts["illegal"] += 1
        edges["last_role"] = initial
        if turn is not None and turn != edges["last_turn"]:
            edges["n_turns"] += 1
            edges["last_turn"] = turn
            if edges["first_turn"] is None:
                edges["first_turn"] = turn

    def full(self, rows: int) -> bool:
        return len(self.symbols) >= rows or self.size >= CHUNK_BYTES


def _joined(chunks: list[dict]) -> tuple[list[int], int]:
    """The counts of a whole conversation and its gaps, from its chunks in order."""
    counts, n_turns, low, role, turn = dict.fromkeys(COUNTS, 0), 0, None, None, None
    for c in chunks:
        for name in COUNTS:
            counts[name] += c[name]
        if c["first_role"] is not None:
            counts["illegal"] += role is not None and role + c["first_role"] not in LEGAL
            role = c["last_role"]
        if c["first_turn"] is not None:
            n_turns += c["n_turns"] - (turn == c["first_turn"])
            low = c["first_turn"] if low is None else low
            turn = c["last_turn"]
    return [counts[name] for name in COUNTS], (0 if low is None else turn - low + 1 - n_turns)


NAMES = ["gaps", *COUNTS, "cost", "audit", "repaired_sha256"]
RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
LIGHT = (
    "part int, chunk int, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " first_role string, last_role string, first_turn bigint, last_turn bigint, n_turns bigint,"
    " before array<int>, costs array<bigint>, states array<int>"
)


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per conversation that lies in one chunk and one task, with its result, and a row per
    chunk of any other, with its maps and its rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {RESULT}, audit string, repaired_sha256 string"
    schema += "".join(f", c_{x.strip()}" for x in LIGHT.split(","))
    schema += ", symbols binary, roles array<string>, texts array<string>"
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "_row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = ordered.select("conv_id", F.col("turn").cast("bigint"), "role", "text", "_dropped", "_seen")

    def told(conv: object, chunk: Chunk) -> dict:
        found = {**chunk.counts, **chunk.edges}
        counts, gaps = _joined([found])
        _, vector, cost = vectors_before(chunk.symbols, tables().end)
        audit, _ = edits(chunk.symbols, tables().end, BEGIN, last=True)
        left = "\n".join(repaired(audit, zip(chunk.roles, chunk.texts, strict=True), BEGIN))
        cost += tables().vectors[vector][BEGIN]
        digest = hashlib.sha256(left.encode()).hexdigest()
        return {"conv_id": conv, **dict(zip(NAMES, [gaps, *counts, cost, audit, digest], strict=True))}

    def part(conv: object, chunk: Chunk, number: int) -> dict:
        n = len(tables().vectors)
        after = [vectors_before(chunk.symbols, v)[1:] for v in range(n)]
        maps = {
            "before": [v for v, _ in after],
            "costs": [c for _, c in after],
            "states": [edits(chunk.symbols, v, s, last=False)[1] for v in range(n) for s in range(STATES)],
        }
        light = {"part": TaskContext.get().partitionId(), "chunk": number, **chunk.counts, **chunk.edges, **maps}
        held = {"symbols": bytes(chunk.symbols), "roles": chunk.roles, "texts": chunk.texts}
        return {"conv_id": conv, **{f"c_{k}": v for k, v in light.items()}, **held}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, chunk, number, known = None, None, 0, False
        for batch in batches:
            out = []
            for row_conv, turn, role, text, dropped, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk is None:
                    conv, chunk = row_conv, Chunk()
                elif row_conv != conv:
                    # known: it began in this task, and nothing of it is out yet
                    out.append(told(conv, chunk) if known else part(conv, chunk, number))
                    number += not known
                    conv, chunk, known = row_conv, Chunk(), True
                elif chunk.full(size):
                    out.append(part(conv, chunk, number))
                    number += 1
                    chunk, known = Chunk(), False
                if not dropped:
                    chunk.add(turn, role, text, seen)
            yield from _batches(out, batch.schema.field("conv_id").type)
        if chunk is not None:
            yield from _batches([part(conv, chunk, number)], batch.schema.field("conv_id").type)

    names = [f.split()[0] for f in schema.split(", ")]

    def _batches(found: list[dict], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if found:
            columns = [pa.array([r.get(n) for r in found], _KINDS.get(n, id_type)) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ordered.mapInArrow(made, schema)


_KINDS = {
    **dict.fromkeys([*NAMES[:-2], *(f"c_{c}" for c in (*COUNTS, "first_turn", "last_turn", "n_turns"))], pa.int64()),
    **dict.fromkeys(["audit", "repaired_sha256", "c_first_role", "c_last_role"], pa.string()),
    **dict.fromkeys(["c_part", "c_chunk"], pa.int32()),
    **dict.fromkeys(["c_before", "c_states"], pa.list_(pa.int32())),
    "c_costs": pa.list_(pa.int64()),
    "symbols": pa.binary(),
    "roles": pa.list_(pa.string()),
    "texts": pa.list_(pa.string()),
}


def _scanned(light: DataFrame) -> DataFrame:
    """For each chunk: the vector after it, the state before it, whether it is the last, and in
    the last the conversation's counts. The maps are composed in both directions."""
    schema = f"part int, chunk int, after int, state int, last boolean, {RESULT}"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int32()] * 4 + [pa.bool_()] + [pa.int64()] * 6

    def placed(found: list[dict]) -> list[tuple]:
        t = tables()
        vector, cost, after = t.end, 0, []
        for c in reversed(found):
            after.append(vector)
            cost += c["costs"][vector]
            vector = c["before"][vector]
        counts, gaps = _joined(found)
        whole = [gaps, *counts, cost + t.vectors[vector][BEGIN]]
        state, out = BEGIN, []
        for c, v in zip(found, reversed(after), strict=True):
            last = c is found[-1]
            out.append((c["part"], c["chunk"], v, state, last, *(whole if last else [None] * 6)))
            state = c["states"][v * STATES + state]
        return out

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row["conv_id"] != held[0]["conv_id"]:
                    out += placed(held)
                    held = []
                held.append(row)
            yield from rows_of(out)
        yield from rows_of(placed(held) if held else [])

    def rows_of(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        if out:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return ordered.mapInArrow(made, schema)


def _finished(pieces: DataFrame) -> DataFrame:
    """The results of conversations of several chunks."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {RESULT}, audit string, repaired_sha256 string"
    names = ["conv_id", *NAMES]

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, texts = [], []
            for r in batch.to_pylist():
                audit, _ = edits(list(r["symbols"]), r["after"], r["state"], r["last"])
                audits.append(audit)
                texts.append("\n".join(repaired(audit, zip(r["roles"], r["texts"], strict=True), r["state"])))
            held = batch.select(["conv_id", "part", "chunk", "last", *NAMES[:-2]])
            yield held.append_column("audit", pa.array(audits, pa.string())).append_column("left", pa.array(texts, pa.string()))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, digest, first = [], hashlib.sha256(), True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit.append(r["audit"])
                if r["left"]:
                    digest.update((("" if first else "\n") + r["left"]).encode())
                    first = False
                if r["last"]:
                    out.append([r["conv_id"], *(r[n] for n in NAMES[:-2]), "".join(audit), digest.hexdigest()])
                    audit, digest, first = [], hashlib.sha256(), True
            if out:
                kinds = [batch.schema.field("conv_id").type, *(_KINDS[n] for n in NAMES)]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    middle = f"conv_id {kind}, part int, chunk int, last boolean, {RESULT}, audit string, left string"
    ordered = (
        pieces.mapInArrow(edited, middle)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", "chunk")
    )
    return ordered.mapInArrow(told, schema)


def repair(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """What is wrong with each conversation and its cheapest repair.

    ``rows`` are those of ``damaged``. Returns conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit and repaired_sha256. Rows stand by turn, NULL turns first; rows of equal turn by
    role and a hash of their text. NULL conv_ids are one conversation. An initial other than s, u
    and a is never kept. An empty table gives no rows.
    """
    found = written(chunks(with_duplicates(rows), size), "conversation-chunks")
    done = found.where("audit IS NOT NULL").select("conv_id", *NAMES)
    open_ones = found.where("audit IS NULL")
    names = [x.split()[0] for x in LIGHT.split(", ")]
    light = open_ones.select("conv_id", *(F.col(f"c_{n.strip()}").alias(n.strip()) for n in names))
    placed = _scanned(light)
    heavy = open_ones.select(
        "conv_id",
        F.col("c_part").alias("part"),
        F.col("c_chunk").alias("chunk"),
        "symbols",
        "roles",
        "texts",
    )
    return done.unionByName(_finished(heavy.join(placed, ["part", "chunk"])))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged ``conversations``; every conv_id given has a row.

    NULL roles and texts are one space. A conversation without rows left has zeros, an empty audit
    and the digest of nothing. Repeated rows are rows like any other. Other columns don't matter.
    """
    return repair(damaged(conversations))
