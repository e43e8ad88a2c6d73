"""Conversation structure repair: the cheapest edits that make role initials read ``(s?(ua)+)?``.

A path of edits is weighed by one integer: its high digits are the cost, its low digits the edits' letters, the first
letter in the highest place, three bits each, zeros at the end. So the lesser integer is the cheaper path and, at one
cost, the one whose letters sort first; a shorter text of letters sorts before its continuations. A minimum over the
integers of a path graph (rows times four states of the role grammar, from the last row to the first) decides all.

Rows are moved once, by ranges of (conversation, turn, ...), so that one conversation may fill many tasks. One that
lies inside a task and is no longer than a chunk is repaired there. Of the others, each chunk gives the paths from
each state to each state, one pass over these few letters picks the path of the whole conversation, and the chunks
are then written out with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marketloom.llm.common import written

#: A chunk of a conversation ends at so many rows or characters.
CHUNK_ROWS, CHUNK_CHARS = 1024, 4 << 20
#: Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Letters of the edits in ASCII order; zero is the end.
LETTERS = "\0DIKR"
#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row. Whole in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: The role that continues each state, and the state after it.
ROLE, AFTER = ("user", "user", "assistant", "user"), (USER, USER, ASSISTANT, USER)
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

COUNTS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired string, repaired_sha256 string"
ROWS = "array<struct<turn: bigint, role: string, text: string, absent: boolean>>"
THIN = (
    "conv_key string, seq bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, n_rows bigint, first_role string, last_role string, "
    "turns bigint, least bigint, greatest bigint"
)
MOVES = "moves array<struct<start: int, end: int, cost: bigint, audit: string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with faults planted by crc32 of ``conv_id:turn``; a dropped row is marked absent."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("absent"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def digest(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def faults(rows: list[tuple], earlier: Iterable[str] = ()) -> list[str]:
    """The first fault of each (turn, role, text): blank, duplicate, truncated or ''. ``earlier``: digests of rows before."""
    seen, before, out = set(), frozenset(earlier), []
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        again = (role, text) in seen or bool(before) and digest(role, text) in before
        seen.add((role, text))
        out.append("blank" if not bare else "duplicate" if again else "" if bare[-1] in ".!?" else "truncated")
    return out


class _Weights:
    """Weights of paths of at most ``most`` letters: cost << width | letters."""

    def __init__(self, most: int):
        self.width = 3 * most
        self.mask = (1 << self.width) - 1

    def put(self, found: dict[int, int], rest: dict[int, int], letter: str, cost: int) -> None:
        """Add the paths that begin with ``letter`` and go on as ``rest`` (number of letters -> least weight)."""
        head = LETTERS.index(letter) << self.width - 3
        for n, w in rest.items():
            weight = (w >> self.width) + cost << self.width | head | (w & self.mask) >> 3
            if n + 1 not in found or weight < found[n + 1]:
                found[n + 1] = weight

    def cheapest(self, found: dict[int, int]) -> dict[int, int]:
        """Of several numbers of letters, those at the least cost: only what follows can tell these apart."""
        if len(found) < 2:
            return found
        least = min(found.values()) >> self.width
        return {n: w for n, w in found.items() if w >> self.width == least}

    def inserts(self, states: list[dict[int, int]]) -> list[dict[int, int]]:
        """Up to two inserted rows before what the states hold; a third only repeats the first."""
        out = states
        for _ in range(2):
            more = [dict(x) for x in states]
            for s in range(4):
                self.put(more[s], out[AFTER[s]], "I", INSERT)
            out = [self.cheapest(x) for x in more]
        return out

    def read(self, weight: int) -> tuple[int, str]:
        """Cost and letters of a weight."""
        out, letters = [], weight & self.mask
        for place in range(self.width - 3, -1, -3):
            code = letters >> place & 7
            if not code:
                break
            out.append(LETTERS[code])
        return weight >> self.width, "".join(out)


def weights(rows: list[tuple], found: list[str], ends: Iterable[int]) -> tuple[_Weights, list[dict[int, int]]]:
    """The least weights from each state through all rows to one of ``ends``, by number of letters."""
    w = _Weights(3 * len(rows) + 2)
    states = w.inserts([{0: 0} if s in ends else {} for s in range(4)])
    for (_, role, _), fault in zip(reversed(rows), reversed(found)):
        before, initial, extra = [], role[:1], TRUNCATED if fault == "truncated" else 0
        for s in range(4):
            paths: dict[int, int] = {}
            w.put(paths, states[s], "D", DELETE)
            if fault not in ("blank", "duplicate"):
                if initial == ROLE[s][0]:
                    w.put(paths, states[AFTER[s]], "K", KEEP + extra)
                elif initial == "s" and s == START:
                    w.put(paths, states[SYSTEM], "K", KEEP + extra)
                w.put(paths, states[AFTER[s]], "R", REROLE + extra)
            before.append(w.cheapest(paths))
        states = w.inserts(before)
    return w, states


def replayed(rows: list[tuple], audit: str, state: int = START) -> list[str]:
    """The repaired ``role:text`` lines that an audit makes of rows, from a state of the grammar on."""
    lines, at = [], 0
    for letter in audit:
        _, role, text = rows[at] if letter != "I" else (None, "", "")
        at += letter != "I"
        if letter == "D":
            continue
        kept_system = letter == "K" and role[:1] == "s"
        lines.append(f"{role if letter == 'K' else ROLE[state]}:{text}")
        state = SYSTEM if kept_system else AFTER[state]
    return lines


def _illegal(roles: list[str]) -> int:
    return sum(x[:1] + y[:1] not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))


def solved(rows: list[tuple]) -> tuple:
    """The ``COUNTS`` of one conversation's rows (turn, role, text) in order."""
    found = faults(rows)
    w, states = weights(rows, found, ENDS)
    cost, audit = w.read(min(states[START].values()))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    repaired = "\n".join(replayed(rows, audit))
    counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
    return gaps, *counts, _illegal([r for _, r, _ in rows]), cost, audit, repaired, hashlib.sha256(repaired.encode()).hexdigest()


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _sorting(schema: pa.Schema):
    """Rows in order -> whole conversations solved, and chunks of the rest."""
    none = (None,) * (len(COUNTS.split(",")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, split, chars = TaskContext.get().partitionId() << 32, True, False, 0
        key: tuple = ()
        held: list[tuple] = []
        out: list[tuple] = []

        def close(edge: bool) -> None:
            nonlocal seq, held, chars
            if edge:
                seq += 1
                out.append((key[0], seq, [dict(zip(("turn", "role", "text", "absent"), r)) for r in held], *none))
            else:
                out.append((key[0], None, None, *solved([r[:3] for r in held if not r[3]])))
            held, chars = [], 0

        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (conv_id,):
                    if key:
                        close(first or split)
                        first, split = False, False
                    key = (conv_id,)
                elif len(held) >= CHUNK_ROWS or chars >= CHUNK_CHARS:
                    close(True)
                    split = True
                held.append(tuple(row))
                chars += len(row[2])
            if len(out) >= 256 or chars >= CHUNK_CHARS:
                if out:
                    yield _out(out, schema)
                out.clear()
        if key:
            close(True)  # the next task may go on with it
            yield _out(out, schema)

    return run


def _chunking(schema: pa.Schema):
    """Chunks with the digests seen before them -> counts, and their paths from state to state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, seq, rows, earlier in zip(*(batch.column(n).to_pylist() for n in ("conv_key", "seq", "rows", "earlier"))):
                own = [(r["turn"], r["role"], r["text"]) for r in rows if not r["absent"]]
                found, moves = faults(own, earlier or ()), []
                for end in range(4):
                    w, states = weights(own, found, (end,))
                    moves += [{"start": s, "end": end, "cost": c, "audit": a} for s in range(4) for c, a in map(w.read, states[s].values())]
                turns, roles = {t for t, _, _ in own if t is not None}, [r for _, r, _ in own]
                counts = [found.count(x) for x in ("blank", "duplicate", "truncated")]
                ends = (roles[0][:1], roles[-1][:1]) if own else (None, None)
                out.append((key, seq, *counts, _illegal(roles), len(own), *ends, len(turns), min(turns, default=None), max(turns, default=None), moves))
            if out:
                yield _out(out, schema)

    return run


class _Path:
    """Letters of a chunk, then those of the path after it."""

    __slots__ = ("row", "start", "audit", "rest")

    def __init__(self, row, start, audit, rest):
        self.row, self.start, self.audit, self.rest = row, start, audit, rest


def _sooner(x: _Path | None, y: _Path | None) -> bool:
    """Whether x's letters sort before y's."""
    a = b = ""
    while True:
        while x is not None and not a:
            a, x = x.audit, x.rest
        while y is not None and not b:
            b, y = y.audit, y.rest
        if not a or not b:
            return bool(b)
        if len(a) == len(b) and a == b:
            if x is y:
                return False
            a = b = ""
            continue
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            return a[:n] < b[:n]
        a, b = a[n:], b[n:]


def _choosing(schema: pa.Schema):
    """A conversation's chunks, last first -> each chunk's letters and the state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, []

        def path() -> Iterator[tuple]:
            cost, at = states[START]
            while at is not None:
                yield (*at.row, cost, at.start, at.audit)
                cost, at = 0, at.rest

        for batch in batches:
            out = []
            *columns, moves = (c.to_pylist() for c in batch.columns)
            for row, options in zip(zip(*columns), moves):
                if row[0] != key:
                    if key is not None:
                        out += path()
                    key, states = row[0], [(0, None) if s in ENDS else None for s in range(4)]
                best: list = [None] * 4
                for m in options:
                    after = states[m["end"]]
                    if after is None:
                        continue
                    s, cost, at = m["start"], m["cost"] + after[0], _Path(row, m["start"], m["audit"], after[1])
                    if best[s] is None or cost < best[s][0] or cost == best[s][0] and _sooner(at, best[s][1]):
                        best[s] = (cost, at)
                states = best
            if out:
                yield _out(out, schema)
        if key is not None:
            yield _out(list(path()), schema)

    return run


def _rendering(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names = [], [f.name for f in schema][:-1]
            for rows, start, row in zip(batch.column("rows").to_pylist(), batch.column("start").to_pylist(), zip(*(batch.column(n).to_pylist() for n in names))):
                own = [(r["turn"], r["role"], r["text"]) for r in rows if not r["absent"]]
                lines = replayed(own, row[names.index("audit")], start)
                out.append((*row, "\n".join(lines) if lines else None))
            if out:
                yield _out(out, schema)

    return run


def _folding(schema: pa.Schema, names: list[str]):
    """A conversation's written chunks in order -> its row; the text streams through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(n).to_pylist() for n in names)):
                c = dict(zip(names, row))
                if c["conv_key"] != key:
                    if fold is not None:
                        out.append(fold.row())
                    key, fold = c["conv_key"], _Fold(c["conv_id"])
                fold.add(c)
            if out:
                yield _out(out, schema)
        if fold is not None:
            yield _out([fold.row()], schema)

    return run


class _Fold:
    def __init__(self, conv_id):
        self.conv_id, self.counts, self.last, self.turns, self.span = conv_id, [0] * 5, None, 0, None
        self.audit, self.text, self.chars, self.any, self.sha = [], [], 0, False, hashlib.sha256()

    def add(self, c: dict) -> None:
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
            self.counts[k] += c[name]
        if c["n_rows"]:
            self.counts[3] += self.last is not None and self.last + c["first_role"] not in ("su", "ua", "au")
            self.last = c["last_role"]
        if c["turns"]:
            again = self.span is not None and self.span[1] == c["least"]
            self.turns += c["turns"] - again
            self.span = (self.span[0] if self.span else c["least"], c["greatest"])
        self.audit.append(c["audit"])
        if c["lines"] is not None:
            self.sha.update((b"\n" if self.any else b"") + c["lines"].encode())
            self.any, self.chars = True, self.chars + len(c["lines"])
            self.text = [*self.text, c["lines"]] if self.chars <= CHUNK_CHARS else []

    def row(self) -> tuple:
        gaps = self.span[1] - self.span[0] + 1 - self.turns if self.span else 0
        repaired = "\n".join(self.text) if self.chars <= CHUNK_CHARS else None
        return self.conv_id, gaps, *self.counts, "".join(self.audit), repaired, self.sha.hexdigest()


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent_col: str | None = None) -> DataFrame:
    """One row for each conversation: conv_id and ``COUNTS``.

    Rows are taken by turn, nulls first, then by role and a hash of the text; a null role or text counts as one space;
    rows whose id is null are one conversation. A row marked absent only makes its conversation known: one that has no
    other rows gets zeros, an empty audit and an empty text. Repeated rows are duplicates; an empty table gives no rows;
    a role without an initial is never kept; other columns are not read, whatever their names. ``repaired`` is null
    where a conversation of several chunks is longer than ``CHUNK_CHARS``; its hash is of the whole text all the same.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"),
        (F.coalesce(F.col(absent_col), F.lit(False)) if absent_col else F.lit(False)).alias("absent"),
    )
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    order = ["conv_id", "turn", "role", "mark", "deal"]  # the last deals equal rows of one turn over tasks
    dealt = rows.withColumn("mark", F.xxhash64("text")).withColumn("deal", F.monotonically_increasing_id())
    lined = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "absent")
    parts_schema = f"{conv}, seq bigint, rows {ROWS}, {COUNTS}"
    parts = written(lined.mapInArrow(_sorting(_arrow(parts_schema)), parts_schema), "conversations")
    counts = [x.split()[0] for x in COUNTS.split(", ")]
    whole = parts.where("seq IS NULL").select("conv_id", *counts)

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    chunks = parts.where("seq IS NOT NULL").select("conv_id", key.alias("conv_key"), "seq", "rows")
    each = chunks.select("conv_key", "seq", F.explode("rows").alias("r")).where("NOT r.absent")
    seen = each.select("conv_key", "seq", _digest(F.col("r.role"), F.col("r.text")).alias("digest")).distinct()
    again = seen.groupBy("conv_key", "digest").agg(F.min("seq").alias("first"), F.max("seq").alias("last")).where("first < last")
    earlier = seen.join(again, ["conv_key", "digest"]).where("seq > first").groupBy("conv_key", "seq").agg(F.collect_set("digest").alias("earlier"))
    moved = chunks.join(earlier, ["conv_key", "seq"], "left").select("conv_key", "seq", "rows", "earlier")
    thin_schema = f"{THIN}, {MOVES}"
    thin = moved.mapInArrow(_chunking(_arrow(thin_schema)), thin_schema)
    chosen_schema = f"{THIN}, cost bigint, start int, audit string"
    last_first = thin.repartition("conv_key").sortWithinPartitions("conv_key", F.desc("seq"))
    chosen = last_first.mapInArrow(_choosing(_arrow(chosen_schema)), chosen_schema)
    lines_schema = f"{conv}, {chosen_schema}, lines string"
    lines = chunks.join(chosen, ["conv_key", "seq"]).mapInArrow(_rendering(_arrow(lines_schema)), lines_schema)
    names = [f.name for f in _arrow(lines_schema)]
    rows_schema = f"{conv}, {COUNTS}"
    folded = lines.repartition("conv_key").sortWithinPartitions("conv_key", "seq").mapInArrow(_folding(_arrow(rows_schema), names), rows_schema)
    return whole.unionByName(folded)
