"""Conversation structure repair by weighted CYK interval parsing.

A repaired conversation has role initials ``(s?(ua)+)?``. Every row is kept (K, cost 0), given another role (R, 2) or
deleted (D, 3); empty turns may be inserted anywhere (I, 2). Blank rows and repeats must be deleted; a truncated row that
stays adds 1. The cheapest edits win, ties by the ASCII order of their initials, the audit.

The grammar is in Chomsky normal form. A symbol ``pq`` stands for rows that lead from what came before, p, to what
comes after, q (nothing yet, after the system turn, after a user turn, after an assistant turn); its rules are
``pq -> pr rq``. A cell of the chart holds the least (cost, audit) of each symbol over a span of rows. Cells of one row
are closed under insertion on both sides; longer spans are filled bottom-up by length from all their splits. Over one span two
audits of equal cost never are a prefix of each other, since their difference would be inserted turns, which cost. So
least cells stay least under concatenation, and whole cells combine like rows.

That is what makes long conversations possible: rows are sorted into ranges by (conversation, turn), parsed in blocks of
at most 64 rows, and the cells of blocks are parsed again, 64 at a time, until one is left for a conversation. No task
holds the rows of a conversation; the audit, one character for each edit, is the only value that grows with it.

Defined results: null role or text counts as one space, so such text is blank and such a role is never kept. Rows of one turn are
ordered by role, then by the first characters of the text, then by its digest; exact repeats are alike, the first stays. Null turns
come first. Null is a conversation like another. An empty table gives empty results. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.llm.common import WHITE, written

START, SYSTEM, USER, ASSISTANT = "0sua"
# Symbols of the grammar, and for each the symbols of its two sides.
SYMBOLS = ["00", "0s", "0u", "0a", "ss", "su", "sa", "uu", "ua", "aa", "au"]
_AT = {s: i for i, s in enumerate(SYMBOLS)}
_RULES = [
    (_AT[p + q], _AT[p + r], _AT[r + q])
    for p in "0sua"
    for q in "0sua"
    for r in "0sua"
    if p + q in _AT and p + r in _AT and r + q in _AT
]
_STEPS = {"0s": "s", "0u": "u", "su": "u", "au": "u", "ua": "a"}  # symbol -> initial of the one turn it makes
BLOCK = 64
_CHART = 16
ROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

Cell = tuple  # (cost, audit) or None for each symbol
_CELL_TYPE = "array<struct<cost:long,audit:string>>"


def _join(left: Cell, right: Cell, best: list) -> None:
    """Take into ``best`` what two neighbouring spans make together."""
    for whole, a, b in _RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        cost = x[0] + y[0]
        now = best[whole]
        if now is None or cost < now[0] or (cost == now[0] and x[1] + y[1] < now[1]):
            best[whole] = (cost, x[1] + y[1])


def _nothing() -> Cell:
    """The cell of an empty span: inserted turns only."""
    cell: list = [None] * len(SYMBOLS)
    for stay in ("00", "ss", "uu", "aa"):
        cell[_AT[stay]] = (0, "")
    for symbol in ("0u", "su", "ua", "au"):
        cell[_AT[symbol]] = (INSERT, "I")
    for symbol in ("0a", "sa"):
        cell[_AT[symbol]] = (2 * INSERT, "II")
    return tuple(cell)


NOTHING = _nothing()


@lru_cache(maxsize=64)
def _row(code: str) -> Cell:
    """The cell of one row, closed under insertion. Codes: ``x`` must go; s, u, a, o by role, upper case if truncated."""
    edits: list = [None] * len(SYMBOLS)
    for stay in ("00", "ss", "uu", "aa"):
        edits[_AT[stay]] = (DELETE, "D")
    if code != "x":
        extra = TRUNCATED if code.isupper() else 0
        for symbol, initial in _STEPS.items():
            if initial == code.lower():
                edits[_AT[symbol]] = (extra, "K")
            elif initial != SYSTEM:
                edits[_AT[symbol]] = (extra + ROLE, "R")
    before: list = [None] * len(SYMBOLS)
    _join(NOTHING, tuple(edits), before)
    closed: list = [None] * len(SYMBOLS)
    _join(tuple(before), NOTHING, closed)
    return tuple(closed)


def parse(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans: a full chart by span length, over stretches of 16 that are parsed again."""
    while len(cells) > _CHART:
        cells = [parse(cells[i : i + _CHART]) for i in range(0, len(cells), _CHART)]
    if not cells:
        return NOTHING
    chart = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, len(cells) + 1):
        for i in range(len(cells) - length + 1):
            best: list = [None] * len(SYMBOLS)
            for k in range(i + 1, i + length):
                _join(chart[i, k], chart[k, i + length], best)
            chart[i, i + length] = tuple(best)
    return chart[0, len(cells)]


@lru_cache(maxsize=1 << 15)
def parse_codes(codes: str) -> Cell:
    """The cell of a block of rows; blocks with the same codes are parsed once."""
    return parse([_row(code) for code in codes])


def cheapest(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) that leaves no turn, or ends after an assistant turn."""
    return min(c for c in (cell[_AT["00"]], cell[_AT["0a"]]) if c is not None)


def _code(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """Role initial, whether the text is blank, whether it is truncated."""
    trimmed = F.rtrim(text, F.lit(WHITE))
    return F.substring(role, 1, 1), F.length(trimmed) == 0, ~F.substring(trimmed, -1, 1).isin(".", "!", "?")


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, init, blank, cut, key, at): light rows in order; ``at`` numbers all rows of the table without gaps."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    init, blank, cut = _code(role, text)
    key = F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text)))
    order = ["conv", "turn", "role", "head", "key"]
    light = rows.select(
        F.col("conv_id").alias("conv"), "turn", role.alias("role"), F.substring(text, 1, 32).alias("head"),
        key.alias("key"), init.alias("init"), blank.alias("blank"), cut.alias("cut"),
    )
    ranged = light.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = written(ranged.withColumn("raw", F.monotonically_increasing_id()).drop("role", "head"))
    part = F.shiftright("raw", 33)
    sizes = stored.groupBy(part.alias("part")).agg(F.max(F.col("raw").bitwiseAND((1 << 33) - 1)).alias("last"))
    # One row for each partition, so it may be broadcast: how many rows the partitions before it hold.
    starts = sizes.select("part", F.expr("coalesce(sum(last + 1) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("start"))
    dense = stored.withColumn("part", part).join(F.broadcast(starts), "part")
    return dense.select(
        "conv", "turn", "init", "blank", "cut", "key", (F.col("start") + F.col("raw").bitwiseAND((1 << 33) - 1)).alias("at")
    )


def _classified(light: DataFrame) -> DataFrame:
    """Adds ``code``, ``dup``: a row that is no first of its role and text in the conversation is a repeat."""
    firsts = light.filter("NOT blank").groupBy("conv", "key").agg(F.min("at").alias("first_at"))
    marked = light.join(firsts.select(F.col("first_at").alias("at"), F.lit(True).alias("first")), "at", "left")
    dup = ~F.col("blank") & F.col("first").isNull()
    kind = F.when(F.col("init").isin("s", "u", "a"), F.col("init")).otherwise("o")
    code = F.when(F.col("blank") | dup, "x").when(F.col("cut"), F.upper(kind)).otherwise(kind)
    return marked.select("*", dup.alias("dup"), code.alias("code"))


_SEGMENT = f"conv long, at long, n long, first string, last string, illegal long, cell {_CELL_TYPE}"
_LEGAL = {"su", "ua", "au"}


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


_SEGMENT_SCHEMA = pa.schema(
    [
        ("conv", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.string()), ("last", pa.string()),
        ("illegal", pa.int64()), ("cell", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))),
    ]
)


def _plain(cell: Cell) -> list:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in cell]


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, at, rows of (at, code, init)) -> the segment's cell."""
    for batch in batches:

        def rows(batch=batch):
            for conv, at, members in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "rows")), strict=True):
                inits = [m["init"] for m in members]
                illegal = sum(a + b not in _LEGAL for a, b in zip(inits, inits[1:]))
                cell = parse_codes("".join(m["code"] for m in members))
                yield conv, at, len(members), inits[0], inits[-1], illegal, _plain(cell)

        yield from _batches(rows(), _SEGMENT_SCHEMA)


def _parse_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, at, neighbouring segments) -> one segment."""
    for batch in batches:

        def rows(batch=batch):
            for conv, at, parts in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "parts")), strict=True):
                cell = parse([tuple(None if c is None else (c["cost"], c["audit"]) for c in p["cell"]) for p in parts])
                illegal = sum(p["illegal"] for p in parts) + sum(
                    a["last"] + b["first"] not in _LEGAL for a, b in zip(parts, parts[1:])
                )
                yield conv, at, sum(p["n"] for p in parts), parts[0]["first"], parts[-1]["last"], illegal, _plain(cell)

        yield from _batches(rows(), _SEGMENT_SCHEMA)


def _segments(classified: DataFrame) -> DataFrame:
    """One segment for each conversation: blocks first, then neighbouring segments, up to 64 in each round."""
    block = F.shiftright("at", 6)
    blocks = (
        classified.groupBy("conv", block.alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "code", "init"))).alias("rows"))
        .select("conv", F.get("rows", F.lit(0))["at"].alias("at"), "rows")
    )
    done = None
    now = written(blocks.mapInArrow(_parse_blocks, _SEGMENT))
    shift = 6
    while True:
        counts = now.groupBy("conv").agg(F.count("*").alias("parts"))
        many = counts.filter("parts > 1").select(F.col("conv").alias("c"))
        single = now.join(many, F.col("conv").eqNullSafe(F.col("c")), "left_anti")
        done = single if done is None else done.unionByName(single)
        open_ = now.join(many, F.col("conv").eqNullSafe(F.col("c")), "left_semi")
        shift += 6
        merged = (
            open_.groupBy("conv", F.shiftright("at", shift).alias("block"))
            .agg(F.array_sort(F.collect_list(F.struct("at", "n", "first", "last", "illegal", "cell"))).alias("parts"))
            .select("conv", F.get("parts", F.lit(0))["at"].alias("at"), "parts")
        )
        now = written(merged.mapInArrow(_parse_segments, _SEGMENT))
        if now.isEmpty():
            return done


_EDITS = "conv long, at long, out_idx long, edit string, new_role string"
_EDITS_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("at", pa.int64()), ("out_idx", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())]
)
_SUMMARY = "conv long, at long, illegal long, cost long, audit string"
_SUMMARY_SCHEMA = pa.schema(
    [("conv", pa.int64()), ("at", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [cheapest(tuple(c and (c["cost"], c["audit"]) for c in cell)) for cell in batch.column("cell").to_pylist()]
        columns = [batch.column(c) for c in ("conv", "at", "illegal")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
            schema=_SUMMARY_SCHEMA,
        )


def edits_of(audit: str, at: int) -> Iterator[tuple[int | None, int | None, str, str]]:
    """(row, place in the repaired conversation, edit, role of a new or changed turn) for each edit of an audit.

    A conversation of odd length starts with the system turn that was kept; all others alternate.
    """
    made = len(audit) - audit.count("D")
    out = 0
    for edit in audit:
        row = None
        if edit != "I":
            row, at = at, at + 1
        if edit == "D":
            yield row, None, edit, None
            continue
        yield row, out, edit, ("user" if (out - made) % 2 == 0 else "assistant") if edit in "IR" else None
        out += 1


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:

        def rows(batch=batch):
            for conv, at, audit in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "audit")), strict=True):
                for row, out, edit, role in edits_of(audit, at):
                    yield conv, row, out, edit, role

        yield from _batches(rows(), _EDITS_SCHEMA)


class Repair:
    """What ``repair`` found: one summary for each conversation, and the rows of the repaired conversations."""

    def __init__(self, summary: DataFrame, rows: DataFrame) -> None:
        self.summary = summary
        self.rows = rows


def repair(rows: DataFrame) -> Repair:
    """Cheapest repair of (conv_id, turn, role, text).

    ``summary``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation.
    ``rows``: conv_id, out_idx, edit, turn, role, text of what is left, in order of ``out_idx``; an inserted turn has no
    turn and empty text.
    """
    light = written(_classified(_sorted_rows(rows)))
    faults = light.groupBy("conv").agg(
        F.count_if("blank").alias("blank"),
        F.count_if("dup").alias("duplicate"),
        F.count_if(~F.col("blank") & ~F.col("dup") & F.col("cut")).alias("truncated"),
    )
    turns = light.filter("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    parsed = written(_segments(light).select("conv", "at", "illegal", "cell").mapInArrow(_summaries, _SUMMARY))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnRenamed("conv", "c")
        return left.join(other, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")

    summary = beside(beside(parsed, faults), turns).select(
        F.col("conv").alias("conv_id"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )
    edits = written(parsed.select("conv", "at", "audit").mapInArrow(_edit_rows, _EDITS))
    kept = edits.filter("edit IN ('K', 'R')").join(light.select("at", "turn", "key"), "at")
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    # A conversation keeps at most one row of a role and text, so the key finds it; repeats are folded before the join.
    texts = rows.select(
        F.col("conv_id").alias("c"),
        F.unhex(F.md5(F.concat(F.octet_length(role), F.lit(":"), role, text))).alias("k"),
        role.alias("role"),
        text.alias("text"),
    ).groupBy("c", "k").agg(F.max("role").alias("role"), F.max("text").alias("text"))
    found = kept.join(texts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    stay = found.select("conv", "out_idx", "edit", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    new = edits.filter("edit = 'I'").select(
        "conv", "out_idx", "edit", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text")
    )
    return Repair(summary, stay.unionByName(new).withColumnRenamed("conv", "conv_id"))
