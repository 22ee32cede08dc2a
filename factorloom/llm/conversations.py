"""Conversations: the faults of their turns, and the cheapest repair of their order of roles.

A legal order of role initials is ``(s?(ua)+)?``. Edits keep, rerole, delete or insert turns at a cost.
The weighted automaton of legal orders under these edits is made deterministic lazily: a state is the
vector of the costs from each of the automaton's four states to the end, less the least of them, and is
numbered when it is first met; a transition is computed once and then looked up. A scan reads the turns
from the last one to the first; the sum of what was taken off on its way is the cost. The trace goes back over
the scan's states and follows tight arcs, those on a cheapest way. As it meets the turns in their order, the
least letter of all tight ones at each step gives the least audit.

A conversation of any length is cut into blocks of turns. Blocks are scanned side by side, for each of the four
ends they may have; how they fit together is found on four numbers squared for each block, and only then
are they traced. Only a digest of a whole conversation, which is a chain, takes one task; it is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import materialize

#: What edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. Where an initial leads from each (e: an empty role has none; o: any
#: other is illegal), and where a turn of user or assistant does.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "e": (0, 1, 2, 3), "o": (None,) * 4}
FORCED = (2, 2, 3, 2)
NEVER = 1 << 40
ENDS = (0, NEVER, NEVER, 0)
LEGAL = {"su", "ua", "au"}
#: Turns of a block are 2 to this power.
BLOCK_BITS = 14
WHITE = " \t\n\x0b\x0c\r"

Vector = tuple[int, int, int, int]


def inserted(base: list[int]) -> Vector:
    """Costs when turns may be inserted first."""
    u, a = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    return min(base[0], INSERT + u), min(base[1], INSERT + u), u, a


def before(after: Vector, symbol: str) -> Vector:
    """The costs before a turn, from those after it.

    A symbol is x for a turn that must go, else its initial (s, u, a, e or o), in capitals if the turn is truncated.
    """
    base = [DELETE + after[s] for s in range(4)]
    if symbol != "x":
        extra, leads = TRUNCATED * symbol.isupper(), AFTER[symbol.lower()]
        for s in range(4):
            kept = NEVER if leads[s] is None else KEEP + extra + after[leads[s]]
            base[s] = min(base[s], kept, REROLE + extra + after[FORCED[s]])
    return inserted(base)


class Determinised:
    """The deterministic automaton as far as it has been met."""

    def __init__(self) -> None:
        self.numbers: dict[Vector, int] = {}
        self.vectors: list[Vector] = []
        self.table: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}

    def state(self, costs: Vector) -> tuple[int, int]:
        """The number of a normalised vector, and what was taken off."""
        least = min(costs)
        vector = tuple(NEVER if c >= NEVER else c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def scan(self, word: str, end: Vector) -> tuple[list[int], int]:
        """The states after each turn, the last first, then the one before all turns; and the sum of what was taken off."""
        now, total = self.state(end)
        seen = [now]
        for symbol in reversed(word):
            found = self.table.get((now, symbol))
            if found is None:
                found = self.table[now, symbol] = self.state(before(self.vectors[now], symbol))
            now = found[0]
            total += found[1]
            seen.append(now)
        return seen, total

    def costs(self, word: str, end: Vector) -> Vector:
        """From each of the four states before the word."""
        seen, total = self.scan(word, end)
        return tuple(min(NEVER, total + c) for c in self.vectors[seen[-1]])

    def trace(self, word: str, end: Vector, start: int) -> tuple[list[str], int]:
        """A code for each turn, by tight arcs from the start; and the state at the end.

        Codes: u and a for a turn inserted before, then D, K, or U and A for a changed role.
        """
        seen, _ = self.scan(word, end)
        codes, now = [], start
        for i, symbol in enumerate(word):
            after = seen[len(word) - 1 - i]
            found = self.arcs.get((after, symbol, now))
            if found is None:
                found = self.arcs[after, symbol, now] = tight(self.vectors[after], symbol, now)
            codes.append(found[0])
            now = found[1]
        return codes, now


def tight(after: Vector, symbol: str, now: int) -> tuple[str, int]:
    """The letters of the least cheapest way over a turn, D before I before K before R, and where it leads."""
    costs, code = before(after, symbol), ""
    extra, leads = TRUNCATED * symbol.isupper(), AFTER.get(symbol.lower(), (None,) * 4)
    while True:
        if costs[now] == DELETE + after[now]:
            return code + "D", now
        if costs[now] == INSERT + costs[FORCED[now]]:
            now = FORCED[now]
            code += "u" if now == 2 else "a"
        elif leads[now] is not None and costs[now] == KEEP + extra + after[leads[now]]:
            return code + "K", leads[now]
        else:
            return code + ("U" if FORCED[now] == 2 else "A"), FORCED[now]


def closing(now: int) -> str:
    """The turns inserted after the last one."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[now]


AUTOMATON = Determinised()  # one for each Python worker
END = inserted(list(ENDS))
UNITS = tuple(tuple(0 if s == t else NEVER for s in range(4)) for t in range(4))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds codes and cost to blocks: from the state ``start`` to the costs ``after``; null for a whole conversation."""
    for batch in batches:
        codes, costs = [], []
        for word, start, after, closes in zip(*(batch.column(c).to_pylist() for c in ("word", "start", "after", "closes")), strict=True):
            end = END if after is None else tuple(after)
            made, last = AUTOMATON.trace(word, end, start or 0)
            if closes:
                made[-1] += closing(last)
            codes.append(made)
            costs.append(AUTOMATON.costs(word, end)[start or 0])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "block", "ats")), pa.array(codes, pa.list_(pa.string())), pa.array(costs, pa.int64())], names=["conv", "block", "ats", "codes", "cost"])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block costs from each state (row) to each (column)."""
    for batch in batches:
        found = []
        for word in batch.column("word").to_pylist():
            columns = [AUTOMATON.costs(word, unit) for unit in UNITS]
            found.append([columns[t][s] for s in range(4) for t in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv", "block", "matrix"])


def _ends(table: pa.Table) -> pa.Table:
    """``after`` of each block of a conversation: the costs from each state at its end."""
    table = table.sort_by("block")
    after, now = [], END
    for matrix in reversed(table.column("matrix").to_pylist()):
        after.append(list(now))
        now = tuple(min(NEVER, min(matrix[4 * s + t] + now[t] for t in range(4))) for s in range(4))
    return pa.table([table.column("conv"), table.column("block"), pa.array(after[::-1], pa.list_(pa.int64()))], names=["conv", "block", "after"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the trace of a block ends from each state at its start."""
    for batch in batches:
        found = [[AUTOMATON.trace(word, tuple(after), s)[1] for s in range(4)] for word, after in zip(batch.column("word").to_pylist(), batch.column("after").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "block", "after")), pa.array(found, pa.list_(pa.int32()))], names=["conv", "block", "after", "leads"])


def _starts(table: pa.Table) -> pa.Table:
    """The state at the start of each block, and whether it is the last one."""
    table = table.sort_by("block")
    starts, now = [], 0
    for leads in table.column("leads").to_pylist():
        starts.append(now)
        now = leads[now]
    closes = [i == len(starts) - 1 for i in range(len(starts))]
    return pa.table([*(table.column(c) for c in ("conv", "block", "after")), pa.array(starts, pa.int32()), pa.array(closes)], names=["conv", "block", "after", "start", "closes"])


def _same(a: DataFrame, b: DataFrame, *more: str) -> tuple[Column, DataFrame]:
    """A null-safe condition on conv, and on more columns; the right side's are renamed."""
    right = b.withColumnsRenamed({c: f"__{c}" for c in ("conv", *more)})
    on = a["conv"].eqNullSafe(right["__conv"])
    for c in more:
        on = on & (a[c] == right[f"__{c}"])
    return on, right


def _joined(a: DataFrame, b: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    on, right = _same(a, b, *more)
    return a.join(right, on, how).drop(*[f"__{c}" for c in ("conv", *more)])


def _in_order(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, at: ``at`` grows with the conversation and its turns, so ranges of it cut them anywhere."""
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    ranged = rows.repartitionByRange("conv", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv", "turn", "role", "text")
    return materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")


def _marked(rows: DataFrame) -> DataFrame:
    """conv, at, turn, fault, initial: without texts. Equal turns are told by 128 bits of hash."""
    hashes = [F.xxhash64(*head, "conv", "role", "text").alias(f"h{i}") for i, head in enumerate(([], [F.lit(1)]))]
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    first = F.substring("role", 1, 1)
    light = rows.select(
        "conv",
        "turn",
        "at",
        F.when(first.isin("s", "u", "a"), first).when(first == "", "e").otherwise("o").alias("initial"),
        (body == "").alias("is_blank"),
        (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut_off"),
        *hashes,
    )
    light = materialize(light, "light-turns")
    again = light.groupBy("h0", "h1").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    told = light.join(again, ["h0", "h1"], "left")
    fault = F.when(F.col("is_blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("cut_off"), "truncated")
    return told.select("conv", "at", "turn", "initial", fault.alias("fault"))


def _repairs(marked: DataFrame) -> DataFrame:
    """conv, block, ats, codes, cost: the edits of each block's turns; costs are from the block's start to the end."""
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    turn = F.struct("at", symbol.alias("symbol"))
    blocks = marked.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = blocks.select("conv", "block", F.col("turns.at").alias("ats"), F.array_join("turns.symbol", "").alias("word"))
    blocks = materialize(blocks, "blocks")
    long = blocks.groupBy("conv").agg(F.count("*").alias("of")).where("of > 1")
    conv = f"conv {blocks.schema['conv'].dataType.simpleString()}, block bigint"
    ready, shape = "conv, block, ats, word, start, after, closes".split(", "), f"{conv}, ats array<bigint>, codes array<string>, cost bigint"
    on, right = _same(blocks, long)
    short = blocks.join(right, on, "left_anti").withColumns({"start": F.lit(0), "after": F.lit(None).cast("array<bigint>"), "closes": F.lit(True)})

    parts = materialize(_joined(blocks, long).drop("of"), "long-blocks")
    ends = parts.mapInArrow(_matrices, f"{conv}, matrix array<bigint>").groupBy("conv").applyInArrow(_ends, f"{conv}, after array<bigint>")
    leads = _joined(parts, ends, "block").mapInArrow(_leads, f"{conv}, after array<bigint>, leads array<int>")
    starts = leads.groupBy("conv").applyInArrow(_starts, f"{conv}, after array<bigint>, start int, closes boolean")
    return materialize(short.select(*ready).unionByName(_joined(parts, starts, "block").select(*ready)).mapInArrow(_codes, shape), "edits")


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, the repaired turns) of ``turns``: conv_id, turn, role, text.

    The first has conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (a letter for each edit). The
    repaired turns have conv_id, place, role, text; a conversation's turns are in one partition and in order.

    Turns are taken by ``turn``, nulls first; ties by role, then text. A null role or text counts as one
    space; an empty role has no initial, so it may stay anywhere, but is no legal neighbour; null ids are one conversation; repeated rows are duplicates; an empty table gives
    empty results; other columns are not carried. Texts of any length are read once and whole.
    """
    rows = _in_order(turns)
    marked = materialize(_marked(rows), "faults")
    edits = _repairs(marked)

    count = lambda fault: F.sum((F.col("fault") == fault).cast("bigint"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    faults = marked.groupBy("conv").agg(F.coalesce(gaps, F.lit(0)).cast("bigint").alias("gaps"), *[F.coalesce(count(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")])
    # neighbours within a block, then the edges of blocks, so no task holds a whole conversation
    cut = marked.select("conv", "at", "initial", F.shiftright("at", BLOCK_BITS).alias("block"))
    inside = cut.select("conv", "initial", F.lag("initial").over(Window.partitionBy("conv", "block").orderBy("at")).alias("last"))
    edges = cut.groupBy("conv", "block").agg(F.min_by("initial", "at").alias("initial"), F.max_by("initial", "at").alias("end"))
    edges = edges.select("conv", "initial", F.lag("end").over(Window.partitionBy("conv").orderBy("block")).alias("last"))
    wrong = (~F.concat("last", "initial").isin(*LEGAL)).cast("bigint")
    illegal = inside.unionByName(edges).groupBy("conv").agg(F.sum(wrong).alias("illegal"))
    letters = F.translate(F.array_join("codes", ""), "uaUA", "IIRR")
    audits = edits.groupBy("conv").agg(F.min_by("cost", "block").alias("cost"), F.sort_array(F.collect_list(F.struct("block", letters.alias("letters")))).alias("parts"))
    audits = audits.select("conv", "cost", F.array_join("parts.letters", "").alias("audit"))
    summary = _joined(_joined(faults, illegal, how="left"), audits)
    summary = summary.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).cast("bigint").alias("illegal"), "cost", "audit")

    # a turn's code comes just before it, so one exchange brings the two together and the turns in order
    codes = edits.select("conv", F.inline(F.arrays_zip("ats", "codes"))).select("conv", F.col("ats").alias("at"), F.lit(0).alias("kind"), F.col("codes").alias("code"))
    both = rows.select("conv", "at", F.lit(1).alias("kind"), "role", "text").unionByName(codes, allowMissingColumns=True)
    told = both.withColumn("code", F.lag("code").over(Window.partitionBy("conv").orderBy("at", "kind"))).where("kind = 1 and code != 'D'")
    letter = F.col("letter")
    role = F.when(F.lower(letter) == "u", "user").when(F.lower(letter) == "a", "assistant").otherwise(F.col("role"))
    text = F.when(letter.isin("K", "U", "A"), F.col("text")).otherwise("")
    told = told.select("conv", "at", "role", "text", F.posexplode(F.split("code", "")).alias("step", "letter")).where("letter not in ('D', '')")
    return summary, told.select(F.col("conv").alias("conv_id"), F.struct("at", "step").alias("place"), role.alias("role"), text.alias("text"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id and the digest of its turns as they pass by; whatever the length, one line is held."""
    now, digest, kind = None, None, None
    for batch in batches:
        kind, done = batch.schema.field("conv_id").type, []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        yield _digests(done, kind)
    if digest is not None:
        yield _digests([(now, digest.hexdigest())], kind)


def _digests(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv_id", "sha256"])


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the conversation's ``role:text`` lines; conversations without turns have no row."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    return repaired.select("conv_id", "role", "text").mapInArrow(_digested, f"conv_id {kind}, sha256 string")
