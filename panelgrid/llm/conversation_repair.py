"""Cheapest repair of conversations so that turns alternate, by dynamic programming over runs.

A repaired conversation has the role initials ``(s?(ua)+)?``. Rows with equal role and fault are
equal symbols. Each symbol is a 4 by 4 matrix of costs between the states of that pattern; a run
of equal symbols is a power of it under (min, +), put together from cached binary powers. Matrices
compose, so a long conversation is cut into segments that are worked on apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelgrid.llm.frames import materialize

#: Different rows of one segment.
SEGMENT_ROWS = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 50
#: Where each state of the pattern goes: start, after s, after u, after a (the last may end, as may the start).
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: State and role that a row gets which is free to choose.
FREE = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
END = (0, NEVER, NEVER, 0)
LEGAL = {"su", "ua", "au"}

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The product under (min, +): ``a`` first, then ``b``."""
    columns = list(zip(*b))
    return tuple(tuple(min(min(x + y for x, y in zip(row, column)), NEVER) for column in columns) for row in a)


def before(matrix: Matrix, rest: Vector) -> Vector:
    """Least costs from each state when ``rest`` are those after ``matrix``."""
    return tuple(min(min(x + y for x, y in zip(row, rest)), NEVER) for row in matrix)


UNIT: Matrix = tuple(tuple(0 if i == j else NEVER for j in range(4)) for i in range(4))


def _with_inserts() -> Matrix:
    """Any number of inserted rows; more than three states apart never pays."""
    one = tuple(tuple(0 if i == j else INSERT if FREE[i][0] == j else NEVER for j in range(4)) for i in range(4))
    return times(times(one, one), one)


INSERTS = _with_inserts()


@lru_cache(maxsize=None)
def step(symbol: str) -> Matrix:
    """Costs of one row with inserts before it. Symbols: ``x`` must go; else an initial, ``!`` if truncated."""
    rows = []
    for state in range(4):
        costs = [NEVER] * 4
        costs[state] = DELETE
        if symbol != "x":
            extra = TRUNCATED if symbol.endswith("!") else 0
            for to, cost in ((FREE[state][0], REROLE), (NEXT[state].get(symbol[0]), 0)):
                if to is not None:
                    costs[to] = min(costs[to], cost + extra)
        rows.append(tuple(costs))
    return times(INSERTS, tuple(rows))


@lru_cache(maxsize=None)
def binary_power(symbol: str, exponent: int) -> Matrix:
    """The matrix of ``2 ** exponent`` equal rows."""
    if not exponent:
        return step(symbol)
    half = binary_power(symbol, exponent - 1)
    return times(half, half)


def run_matrix(symbol: str, count: int) -> Matrix:
    """The matrix of ``count`` equal rows, by the binary digits of the count."""
    out = UNIT
    for bit in range(count.bit_length()):
        if count >> bit & 1:
            out = times(out, binary_power(symbol, bit))
    return out


@lru_cache(maxsize=1 << 16)
def _cached_run(symbol: str, count: int) -> Matrix:
    return run_matrix(symbol, count)


def symbol_of(initial: str, blank: bool, repeats: bool, truncated: bool) -> str:
    if blank or repeats:
        return "x"
    return (initial if initial in ("s", "u", "a") else "-") + ("!" if truncated else "")


def runs_of(symbols: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """Equal neighbours collapsed: (symbol, rows)."""
    return [(s, sum(n for _, n in group)) for s, group in groupby(symbols, key=lambda x: x[0])]


def runs_matrix(runs: list[tuple[str, int]]) -> Matrix:
    out = UNIT
    for symbol, count in runs:
        out = times(out, _cached_run(symbol, count))
    return out


def unroll(runs: list[tuple[str, int]], state: int, rest: Vector) -> tuple[str, int]:
    """Letters of the cheapest edits and the state after them; of equal ones the ASCII-least.

    ``rest`` are the costs after the runs. Costs at the runs' borders come from their matrices;
    inside a run of rows that stay or go they are stepped, row by row, only while it is unrolled.
    """
    borders = [rest]
    for symbol, count in reversed(runs):
        borders.append(before(_cached_run(symbol, count), borders[-1]))
    borders.reverse()
    out: list[str] = []
    for k, (symbol, count) in enumerate(runs):
        if symbol == "x":
            # D comes before I, and deleting leaves the state as it is.
            out.append("D" * count)
            continue
        inside = [borders[k + 1]]
        for _ in range(count - 1):
            inside.append(before(step(symbol), inside[-1]))
        inside.append(borders[k])
        extra = TRUNCATED if symbol.endswith("!") else 0
        for at in range(count, 0, -1):
            while True:
                wanted, after = inside[at][state], inside[at - 1]
                free = FREE[state][0]
                kept = NEXT[state].get(symbol[0])
                if DELETE + after[state] == wanted:
                    out.append("D")
                elif INSERT + inside[at][free] == wanted:
                    out.append("I")
                    state = free
                    continue
                elif kept is not None and extra + after[kept] == wanted:
                    out.append("K")
                    state = kept
                else:
                    out.append("R")
                    state = free
                break
    return "".join(out), state


def closing(state: int) -> str:
    """Rows inserted at the end of a conversation."""
    out = ""
    while END[state]:
        out, state = out + "I", FREE[state][0]
    return out


ENDING: Vector = before(INSERTS, END)


def find_faults(rows: DataFrame) -> DataFrame:
    """Different rows of (conv, turn, role, text) with their number, faults and order.

    Blank texts, texts whose role and text came at an earlier turn, and texts that don't end a
    sentence. Equal rows of one turn are one row here with a count; all but one are repeats.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    small = rows.select(
        "conv", "turn", "role", "row_key", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("truncated"),
    ).groupBy("conv", "turn", "role", "row_key", "digest", "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = small.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(place).alias("first_place"))
    return small.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
                      ).withColumn("repeats", F.col("first_place") < place).drop("c", "r", "d", "first_place")


_ROW = "struct<turn:long,row_key:binary,role:string,blank:boolean,repeats:boolean,truncated:boolean,copies:long>"
_ROW_ARROW = pa.struct([("turn", pa.int64()), ("row_key", pa.binary()), ("role", pa.string()), ("blank", pa.bool_()),
                        ("repeats", pa.bool_()), ("truncated", pa.bool_()), ("copies", pa.int64())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _symbols(row: dict) -> list[tuple[str, int]]:
    own = (symbol_of(row["role"][:1], row["blank"], row["repeats"], row["truncated"]), 1)
    return [own, ("x", row["copies"] - 1)] if row["copies"] > 1 else [own]


def _runs(rows: list[dict]) -> list[tuple[str, int]]:
    return runs_of(s for row in rows for s in _symbols(row))


def _described(rows: list[dict]) -> dict:
    """Counts of one segment and what its neighbours must know of it."""
    initials = [r["role"][:1] for r in rows]
    turns = [r["turn"] for r in rows]
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return {
        "blank": sum(r["copies"] for r in rows if r["blank"]),
        "duplicate": sum(r["copies"] - (not r["repeats"]) for r in rows if not r["blank"]),
        "truncated": sum(r["truncated"] for r in rows if not r["blank"] and not r["repeats"]),
        "illegal": pairs + sum(r["copies"] - 1 for r in rows),
        "turns": len({t for t in turns if t is not None}),
        "first_initial": initials[0], "last_initial": initials[-1],
        "first_turn": min((t for t in turns if t is not None), default=None),
        "last_turn": max((t for t in turns if t is not None), default=None),
    }


_SEGMENT = [("part", "int", pa.int32()), ("number", "long", pa.int64()),
            *((c, "long", pa.int64()) for c in _COUNTS), ("first_initial", "string", pa.string()),
            ("last_initial", "string", pa.string()), ("first_turn", "long", pa.int64()), ("last_turn", "long", pa.int64()),
            ("matrix", "array<long>", pa.list_(pa.int64()))]


def _segmenter(conv: pa.DataType):
    names = [f.name for f in _ROW_ARROW]
    schema = pa.schema([("conv", conv), *((n, t) for n, _, t in _SEGMENT), ("rows", pa.list_(_ROW_ARROW))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, done, size = TaskContext.get().partitionId(), 0, [], [], 0

        def closed() -> None:
            nonlocal number, held, size
            rows = [{k: r[k] for k in names} for r in held]
            matrix = [x for line in runs_matrix(_runs(rows)) for x in line]
            done.append({"conv": held[0]["conv"], "part": part, "number": number, **_described(rows),
                         "matrix": matrix, "rows": rows})
            number, size, held = number + 1, size + len(held), []

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv"] != held[0]["conv"] or len(held) >= SEGMENT_ROWS):
                    closed()
                    if size >= SEGMENT_ROWS:
                        yield pa.RecordBatch.from_pylist(done, schema=schema)
                        done, size = [], 0
                held.append(row)
        if held:
            closed()
        yield pa.RecordBatch.from_pylist(done, schema=schema)

    return cut


def _segments(faults: DataFrame) -> DataFrame:
    """Stored segments of consecutive rows of one conversation; (part, number) is their order."""
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    fields = faults.schema
    conv = fields["conv"].dataType
    ordered = faults.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", "turn", "row_key", "role", "blank", "repeats", "truncated", "copies")
    kind = f"conv {conv.simpleString()}, " + ", ".join(f"{n} {t}" for n, t, _ in _SEGMENT) + f", rows array<{_ROW}>"
    return materialize(ordered.mapInArrow(_segmenter(to_arrow_type(conv)), kind), "segments")


_SPINE = [("part", pa.int32()), ("number", pa.int64()), ("after", pa.list_(pa.int64())), ("entry", pa.int32()),
          ("last", pa.bool_()), ("cost", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS[:-1])]
_SPINE_KIND = ("part int, number long, after array<long>, entry int, last boolean, cost long, gaps long, "
               + ", ".join(f"{c} long" for c in _COUNTS[:-1]))


def _carried_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation the costs after it; counts on the first one."""
    schema = pa.schema(_SPINE)
    for batch in batches:
        out = []
        for pieces in batch.column(0).to_pylist():
            rest, rows = ENDING, []
            for piece in reversed(pieces):
                rows.append({"part": piece["part"], "number": piece["number"], "after": list(rest), "entry": None,
                             "last": not rows, "cost": None, "gaps": None, **{c: 0 for c in _COUNTS[:-1]}})
                m = piece["matrix"]
                rest = before(tuple(tuple(m[i : i + 4]) for i in range(0, 16, 4)), rest)
            first = rows[-1]
            first |= {c: sum(p[c] for p in pieces) for c in _COUNTS[:-1]} | {"entry": 0, "cost": rest[0]}
            first["illegal"] += sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(pieces, pieces[1:]))
            known = [p for p in pieces if p["first_turn"] is not None]
            turns = sum(p["turns"] for p in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:]))
            first["gaps"] = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - turns if known else 0
            out += rows
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _exits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after a segment for each state before it; -1 where that state can't be."""
    schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("exits", pa.list_(pa.int32()))])
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            runs = _runs(row["rows"])
            out.append({"part": row["part"], "number": row["number"],
                        "exits": [unroll(runs, q, tuple(row["after"]))[1] for q in range(4)]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _carried_forward(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("entered", pa.int32())])
    for batch in batches:
        out = []
        for pieces in batch.column(0).to_pylist():
            state = 0
            for piece in pieces:
                out.append({"part": piece["part"], "number": piece["number"], "entered": state})
                state = piece["exits"][state]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


_EDIT = pa.struct([("letter", pa.string()), ("role", pa.string()), ("turn", pa.int64()), ("row_key", pa.binary())])


def _edits(rows: list[dict], state: int, rest: Vector, last: bool) -> tuple[str, list[dict]]:
    """Letters of a segment and the rows of its result; rows of equal ones that go have no edit of their own."""
    letters, final = unroll(_runs(rows), state, rest)
    if last:
        letters += closing(final)
    owners = iter([(row, k) for row in rows for k in range(min(row["copies"], 2))])
    out, at = [], 0
    while at < len(letters):
        letter = letters[at]
        if letter == "I":
            state, role = FREE[state]
            out.append({"letter": "I", "role": role, "turn": None, "row_key": None})
            at += 1
            continue
        row, again = next(owners)
        if letter != "D":
            state, role = (NEXT[state][row["role"][0]], row["role"]) if letter == "K" else FREE[state]
            out.append({"letter": letter, "role": role, "turn": row["turn"], "row_key": row["row_key"]})
        at += row["copies"] - 1 if again else 1
    return letters, out


def _decider(conv: pa.DataType):
    schema = pa.schema([("conv", conv), ("part", pa.int32()), ("number", pa.int64()), ("letters", pa.string()),
                        ("edits", pa.list_(_EDIT))])

    def decide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                letters, edits = _edits(row["rows"], row["state"], tuple(row["after"]), row["last"])
                out.append({"conv": row["conv"], "part": row["part"], "number": row["number"], "letters": letters, "edits": edits})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return decide


def plan_repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summaries (conv, blank, duplicate, truncated, illegal, gaps, cost, audit) and decisions of segments."""
    segments = _segments(find_faults(rows))
    id_ = ["part", "number"]
    summary_fields = ["part", "number", *_COUNTS, "first_initial", "last_initial", "first_turn", "last_turn", "matrix"]
    spines = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*summary_fields))).alias("pieces"))
    spine = materialize(spines.select("pieces").mapInArrow(_carried_back, _SPINE_KIND), "spine")
    # Only conversations of several segments need to know the state in which each of them begins.
    several = segments.select("conv", *id_, "rows").join(
        spine.where("entry is null or not last").select(*id_, "after"), id_)
    exits = several.select(*id_, "rows", "after").mapInArrow(_exits, "part int, number long, exits array<int>")
    entered = several.select("conv", *id_).join(exits, id_).groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct(*id_, "exits"))).alias("pieces")).select("pieces").mapInArrow(
        _carried_forward, "part int, number long, entered int")
    known = spine.join(entered, id_, "left").select(*id_, "after", "last", F.coalesce("entered", F.lit(0)).alias("state"))
    conv = segments.schema["conv"].dataType
    decided = materialize(
        segments.select("conv", *id_, "rows").join(known, id_).mapInArrow(
            _decider(to_arrow_type(conv)), f"conv {conv.simpleString()}, part int, number long, letters string, "
            "edits array<struct<letter:string,role:string,turn:long,row_key:binary>>"), "decisions")
    letters = decided.select("conv", *id_, "letters").join(spine.drop("after", "entry", "last"), id_)
    summary = letters.groupBy("conv").agg(
        *[F.sum(c).alias(c) for c in _COUNTS[:-1]], F.max("gaps").alias("gaps"), F.max("cost").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*id_, "letters"))), lambda x: x["letters"]), "").alias("audit"))
    return summary, decided


def _keyed(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(
        F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    named = F.to_json(F.struct("conv", "turn", "role", "text"))
    return rows.withColumn("row_key", F.unhex(F.sha2(named, 256)))


def repair_conversations(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Summaries of all conversations, and the rows of the repaired ones.

    The rows of a conversation are taken by turn, nulls first; ties by role, then by the sha256
    of the text. A row's first fault counts: blank (nothing but ASCII white space), duplicate
    (role and text seen earlier in the conversation), truncated (its last other character is none of .!?). Keeping a
    row costs 0, another role (user or assistant) 3, deleting 4; blank rows and duplicates must
    go; inserting an empty user or assistant row costs 3; each truncated row that stays adds 3. The cheapest edits that leave
    the role initials ``(s?(ua)+)?`` are taken, of equal ones those whose letters D, I, K, R are ASCII-least.

    Summary: (key, gaps, blank, duplicate, truncated, illegal, cost, audit): turns missing between the least and the greatest,
    rows by fault, neighbours whose initials are not su, ua or au, and the edits' letters. Repaired
    rows: (key, part, number, place, role, text), in the order of part, number and place.

    Null roles and texts count as one space. An empty role has no initial, and so does one that begins with
    another letter than s, u or a: it must be changed or go. All rows with a null key are one conversation. Rows repeated in
    full are copies at one turn, all but the first of them duplicates. A conversation of which
    nothing stays has no repaired rows. No rows give no rows. Other columns are ignored; texts of any length are read whole.
    """
    rows = _keyed(conversations, key, turn, role, text)
    summary, decided = plan_repairs(rows)
    edits = decided.select("conv", "part", "number", F.posexplode("edits").alias("place", "edit")).select(
        "conv", "part", "number", "place", F.col("edit.role").alias("role"), F.col("edit.row_key").alias("row_key"))
    texts = rows.groupBy("row_key").agg(F.first("text").alias("text"))
    kept = edits.where("row_key is not null").join(texts, "row_key").select("conv", "part", "number", "place", "role", "text")
    inserted = edits.where("row_key is null").select("conv", "part", "number", "place", "role", F.lit("").alias("text"))
    return summary.withColumnRenamed("conv", key), kept.unionByName(inserted).withColumnRenamed("conv", key)


def _hasher(conv: pa.DataType):
    schema = pa.schema([("conv", conv), ("sha256", pa.string())])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, some = None, None, False
        for batch in batches:
            out = []
            for conv_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if some and conv_id == now:
                    state.update(b"\n" + line)
                    continue
                if some:
                    out.append({"conv": now, "sha256": state.hexdigest()})
                now, state, some = conv_id, hashlib.sha256(line), True
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist([{"conv": now, "sha256": state.hexdigest()}] if some else [], schema=schema)

    return digest


def transcript_digests(repaired: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, sha256) of each conversation's lines ``role:text``, joined by line feeds.

    A digest reads its lines one after the other, so a conversation is one task here; it streams
    through it in sorted order, whatever its length.
    """
    line = F.concat_ws(":", "role", "text").cast("binary").alias("line")
    ordered = repaired.select(F.col(key).alias("conv"), "part", "number", "place", line).repartition("conv").sortWithinPartitions(
        "conv", "part", "number", "place").select("conv", "line")
    kind = repaired.schema[key].dataType
    return ordered.mapInArrow(
        _hasher(to_arrow_type(kind)), f"conv {kind.simpleString()}, sha256 string").withColumnRenamed("conv", key)
