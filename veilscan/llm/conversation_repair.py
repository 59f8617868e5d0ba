"""Repair of conversations: the cheapest edits that make roles alternate, found by the auction algorithm for shortest paths over a lattice of rows and role states."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import tidy
from .storage import plain_columns, settled, small_batches

# What was put out so far: nothing, a system row alone, a user row last, an assistant row last; the state that the next user or assistant row leads to; its role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# A row is a symbol: 4 times its role's class (0: other, else the state it stands for) and its fault.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
_NEVER = 1 << 40


@dataclass(frozen=True)
class RepairCosts:
    """Costs of the edits; truncated: added for a truncated row that stays; block: rows that one auction takes at most."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1
    block: int = 32


@functools.lru_cache(maxsize=1 << 12)
def arcs_of(symbol: int, state: int, costs: RepairCosts) -> tuple[tuple[str, int, int, int], ...]:
    """The edits at a row in a state, by letter: (letter, cost, rows taken, new state)."""
    role, fault = divmod(symbol, 4)
    arcs = [("D", costs.delete, 1, state), ("I", costs.insert, 0, NEXT[state])]
    if fault < BLANK:
        more = costs.truncated if fault == TRUNCATED else 0
        if role == NEXT[state] or (role == SYSTEM and state == START):
            arcs.append(("K", more, 1, role))
        arcs.append(("R", costs.rerole + more, 1, NEXT[state]))
    return tuple(arcs)


def auction(symbols: bytes, exits: tuple[int, ...], entries: tuple[int, ...], costs: RepairCosts) -> list[list[int]]:
    """Node prices, a line per row boundary and a column per state, that are exact for the entry states at the first boundary; exits: what is still to pay from each state at the last.

    A price never exceeds the cost of an arc and the price behind it. From an entry a path grows along an arc that meets this bound; where none does, the last node's price rises to the bound and the path
    shrinks by it. When the path reaches the end, the entry's price is its distance."""
    n = len(symbols)
    prices = [[min(exits)] * 4 for _ in range(n + 1)]
    for entry in entries:
        path = [(0, entry)]
        while True:
            row, state = path[-1]
            if row == n:
                best, target = exits[state], None
            else:
                best = _NEVER
                for _, cost, taken, to in arcs_of(symbols[row], state, costs):
                    reach = cost + prices[row + taken][to]
                    if reach < best:
                        best, target = reach, (row + taken, to)
            if prices[row][state] < best:
                prices[row][state] = best
                if len(path) > 1:
                    path.pop()
            elif target is None:
                break
            else:
                path.append(target)
    return prices


def tight_arcs(symbols: bytes, exits: tuple[int, ...], prices: list[list[int]], costs: RepairCosts) -> list[list[list[tuple[str, int, int]]]]:
    """For each node the arcs on shortest paths, by letter: those that meet the price bound and lead on to the end by such arcs."""
    n = len(symbols)
    tight: list[list[list[tuple[str, int, int]]]] = [[[] for _ in range(4)] for _ in range(n + 1)]
    open_nodes = [[False] * 4 for _ in range(n)] + [[prices[n][q] == exits[q] for q in range(4)]]
    for row in reversed(range(n)):
        for _ in range(3):  # inserts stay in the row: user and assistant lead to each other
            for state in range(4):
                tight[row][state] = [
                    (letter, row + taken, to) for letter, cost, taken, to in arcs_of(symbols[row], state, costs) if prices[row][state] == cost + prices[row + taken][to] and open_nodes[row + taken][to]
                ]
                open_nodes[row][state] = bool(tight[row][state])
    return tight


@functools.lru_cache(maxsize=1 << 15)
def block_paths(symbols: bytes, exits: tuple[int, ...], entries: tuple[int, ...], costs: RepairCosts) -> tuple[tuple[int, str, int] | None, ...]:
    """For each entry state the distance, the ASCII-least audit of a shortest path, and the state that it ends in."""
    prices = auction(symbols, exits, entries, costs)
    tight = tight_arcs(symbols, exits, prices, costs)
    found: list[tuple[int, str, int] | None] = [None] * 4
    for entry in entries:
        row, state, letters = 0, entry, []
        while row < len(symbols):
            letter, row, state = tight[row][state][0]
            letters.append(letter)
        found[entry] = (prices[0][entry], "".join(letters), state)
    return tuple(found)


def cheapest_edits(symbols: bytes, costs: RepairCosts = RepairCosts()) -> tuple[int, str]:
    """The least cost and, of the cheapest audits, the ASCII-least. A long conversation is cut into blocks; from the last to the first, the prices at a block's start are the exits of the one before."""
    ends = (0, 2 * costs.insert, costs.insert, 0)
    blocks = [symbols[at : at + costs.block] for at in range(0, len(symbols), costs.block)]
    paid, exits, paths = 0, ends, []
    for k in reversed(range(len(blocks))):
        least = min(exits)
        paid += least
        found = block_paths(blocks[k], tuple(x - least for x in exits), (START,) if k == 0 else (START, SYSTEM, USER, ASSISTANT), costs)
        paths.append(found)
        exits = tuple(f[0] if f else _NEVER for f in found)
    state, letters = START, []
    for found in reversed(paths):
        _, audit, state = found[state]
        letters.append(audit)
    letters.append("I" * (ends[state] // costs.insert))
    return paid + exits[START], "".join(letters)


def edited_rows(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(role, text) rows in order -> (letter, role, text) of the repaired conversation."""
    state, at = START, 0
    for role, text in rows:
        while audit[at] == "I":
            state = NEXT[state]
            yield "I", ROLE[state], ""
            at += 1
        letter = audit[at]
        at += 1
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and state == START and role.startswith("s") else NEXT[state]
        yield letter, role if letter == "K" else ROLE[state], text
    for letter in audit[at:]:
        state = NEXT[state]
        yield letter, ROLE[state], ""


STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def _audit(costs: RepairCosts):
    """Slim rows sorted by conversation and place -> a row per conversation. A conversation is held as a byte per row; its turns are looked at as they pass."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, conv, turns, last, least = bytearray(), None, 0, None, None

        def done() -> tuple:
            roles = [s // 4 for s in symbols]
            faults = [s % 4 for s in symbols]
            illegal = sum(pair not in _LEGAL for pair in zip(roles, roles[1:], strict=False))
            gaps = min(last - least + 1 - turns, (1 << 63) - 1) if turns else 0
            return (conv, gaps, *(faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, *cheapest_edits(bytes(symbols), costs))

        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                if batch.column("_place")[row].as_py() == 1:
                    if symbols:
                        out.append(done())
                    symbols, conv, turns, last, least = bytearray(), batch.column("conv_id")[row], 0, None, None
                symbols.append(batch.column("_symbol")[row].as_py())
                turn = batch.column("_turn")[row].as_py()
                if turn is not None and turn != last:
                    least, last, turns = turn if least is None else least, turn, turns + 1
            if out:
                yield _stat_rows(out, batch.schema.field("conv_id").type)
        if symbols:
            yield _stat_rows([done()], conv.type)

    return run


def _stat_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    arrays = [pa.array([c.as_py() for c in columns[0]], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *names])


def _conversations(batches: Iterator[pa.RecordBatch], stats: list[str]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """Batches in which a row of place 0, with conv_id and stats, stands ahead of the rows of its conversation -> that row, and the rows as they pass. Each conversation is to be read to its end."""

    def rows():
        for batch in batches:
            places, roles, texts = (batch.column(c) for c in ("_place", "role", "text"))
            for k in range(batch.num_rows):
                place = places[k].as_py()
                yield (place, tuple(batch.column(c)[k].as_py() for c in stats)) if place == 0 else (place, (roles[k].as_py(), texts[k].as_py()))

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        head = ahead[1]

        def members() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            ahead = next(stream, None)
            while ahead is not None and ahead[0] > 0:
                yield ahead[1]
                ahead = next(stream, None)

        yield head, members()


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the conversation and their symbol, written to the shared folder."""
    blank, ended = "text NOT RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'", "text RLIKE '[.!?][\\\\x20\\\\x09-\\\\x0D]*\\\\z'"
    first = Window.partitionBy("conv_id", "role", "text").orderBy("_place")  # by place, so that of equal rows of one turn the later ones are the duplicates
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("_turn"), "role", "text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("_turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").withColumn("_place", F.row_number().over(order).cast("long")).withColumn("_seen", F.row_number().over(first))
    fault = F.expr(f"CASE WHEN {blank} THEN {BLANK} WHEN _seen > 1 THEN {DUPLICATE} WHEN {ended} THEN {SOUND} ELSE {TRUNCATED} END")
    role = F.expr(f"CASE left(role, 1) WHEN 's' THEN {SYSTEM} WHEN 'u' THEN {USER} WHEN 'a' THEN {ASSISTANT} ELSE 0 END")
    return settled(rows.select("conv_id", "_turn", "_place", "role", "text", (role * 4 + fault).cast("int").alias("_symbol")), "turns")


def _with_audits(conversations: DataFrame, costs: RepairCosts) -> tuple[DataFrame, str]:
    """Rows sorted by conversation and place, ahead of each conversation a row with its statistics and audit; and the type of conv_id."""
    small_batches(conversations)
    turns = _turns(conversations)
    kind = turns.schema["conv_id"].dataType.simpleString()
    slim = turns.select("conv_id", "_turn", "_place", "_symbol").repartition("conv_id").sortWithinPartitions("conv_id", "_place")
    audits = settled(slim.mapInArrow(_audit(costs), f"conv_id {kind}, {STATS}"), "audits")
    both = turns.select("conv_id", "_place", "role", "text").unionByName(audits.withColumn("_place", F.lit(0).cast("long")), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "_place"), kind


def conversation_repairs(conversations: DataFrame, costs: RepairCosts = RepairCosts()) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows are taken by turn (nulls first), equal turns by role and text. A row's fault is the first that fits: blank (only white space), duplicate (role and text stand in an
    earlier row), truncated (doesn't end in `.`, `!` or `?`). Edits: K keeps a row, R gives it the role user or assistant, D deletes it (blank rows and duplicates always), I inserts a user or assistant row without text; they lead
    to roles `(s?(ua)+)?` by first letters. The cost is the least; the audit is the letters of the cheapest edits in order, of several the ASCII-least. gaps: turns missing between the first and the last; illegal: neighbours whose
    roles don't follow each other. repaired_sha256: of the repaired rows `role:text`, joined by line breaks.

    Nodes of the lattice are (rows taken, last role); prices come from auctions over blocks of `block` rows, each block's prices are the exits of the one before; arcs that meet the prices lie on shortest paths and
    are followed by letter. Faults and places are windows over rows dealt by conversation; the auction reads a byte per row, the hash reads rows as they pass, so a task holds no conversation's texts. The hash
    of one conversation is sequential, so one conversation's rows go through one task.

    A null role or text is one space; a null conv_id is a conversation, as is any number of repeated rows. Other columns are not looked at. An empty table gives no rows; gaps beyond 64 bits are the largest 64-bit number.
    """
    rows, kind = _with_audits(conversations, costs)
    stats = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def noted(stream):
            nonlocal schema
            for batch in stream:
                schema = batch.schema
                yield batch

        out: list[tuple] = []

        def block() -> pa.RecordBatch:
            names = [*stats, "repaired_sha256"]
            kinds = [schema.field(c).type for c in stats] + [pa.string()]
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=names)

        for head, members in _conversations(noted(batches), stats):
            digest, between = hashlib.sha256(), b""
            for _, role, text in edited_rows(members, head[-1]):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            out.append((*head, digest.hexdigest()))
            if len(out) >= 4096:
                yield block()
                out.clear()
        if out:
            yield block()

    return rows.mapInArrow(run, f"conv_id {kind}, {STATS}, repaired_sha256 string")


def repaired_turns(conversations: DataFrame, costs: RepairCosts = RepairCosts()) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 0), edit (K, R or I), role, text. Rows are treated as conversation_repairs says; conversations without a row left have none here."""
    rows, kind = _with_audits(conversations.select(*plain_columns(conversations, "place", "edit")), costs)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, out, size = None, [], 0

        def noted(stream):
            nonlocal conv_type
            for batch in stream:
                conv_type = batch.schema.field("conv_id").type
                yield batch

        def block() -> pa.RecordBatch:
            kinds = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "place", "edit", "role", "text"])

        for head, members in _conversations(noted(batches), ["conv_id", "audit"]):
            for place, (edit, role, text) in enumerate(edited_rows(members, head[1])):
                out.append((head[0], place, edit, role, text))
                size += len(text)
                if len(out) >= 4096 or size > 1 << 22:
                    yield block()
                    out, size = [], 0
        if out:
            yield block()

    return rows.mapInArrow(run, f"conv_id {kind}, place long, edit string, role string, text string")
