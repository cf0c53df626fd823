"""Conversation structure repair: the cheapest edits that make the roles alternate.

The rows of a conversation, in order of turn, are kept, given another role or deleted, and
empty turns are inserted, until the initials of the roles read ``(s?(ua)+)?``.  The edits
are found by A* over the lattice (rows consumed, state of that pattern).  The heuristic is
a suffix sum: a blank or repeated row must be deleted, a truncated one costs at least its
charge.  It is admissible and consistent, and the queue is ordered by (cost + heuristic,
audit), the audit being the initials of the edits so far; so the first arrival at a node
is the cheapest and, among equals, the first by ASCII, and the same holds for the goal.

A conversation may hold a third of all rows.  Rows that are equal in all columns are
counted before they move; what was said before is found by a join that AQE can split; the
order is a range partitioning by (conversation, turn, role, text), which cuts through a
conversation where it must.  A task streams its range and holds one piece of a
conversation, `PIECE_ROWS` rows and `PIECE_BYTES` bytes at most (or one row).  A
conversation that is whole in one piece is solved there.  For a piece of a longer one, A*
from each of the pattern's four states gives the cheapest way to each of the four; these
tables are put together in order, which is exact, as no cheapest way is the beginning of
another one to the same node.  What is left for one task is what the result demands: the
audit in one cell (one byte an edit) and the digest, a chain over the repaired texts that is
fed piece by piece.

Defined results: null ids and turns read as one space in the damage key, a null role or
text is one space; a null id is a conversation of its own; null turns come first and are
left out of ``gaps``; rows of one turn are ordered by role, then text (as they are after the
damage), and equal rows are copies of each other; a gap that does not fit a long is null; a role whose initial is none
of s, u, a can only be changed or deleted; a conversation without rows has zeros, an empty
audit and the digest of the empty text; texts are taken whole; an empty table gives an
empty result; columns other than the four named are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

BLANKS = " \t\n\x0b\x0c\r"
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (NOTHING, ASSISTANT)
#: State after an inserted or changed row; the role that such a row gets.
SPEAKS = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
#: Faults of a row, the first that counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CHARGE = 3, 4, 3, 3
PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20
#: Bytes of rows that one range holds, about.
RANGE_BYTES = 32 << 20


def cheapest(rows: list[tuple[str, int]], start: int = NOTHING, goals: tuple[int, ...] = GOALS, every: bool = False) -> dict[int, tuple[int, str]]:
    """State to (cost, audit) at the end of ``rows`` (initial, fault): of the first goal reached, or of every goal."""
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][1]
        rest[i] = rest[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else CHARGE if fault == TRUNCATED else 0)
    queue, closed, out = [(rest[0], "", 0, start)], set(), {}
    while queue:
        f, audit, i, state = heapq.heappop(queue)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == n and state in goals:
            out[state] = (f, audit)
            if not every or len(out) == len(goals):
                break
        cost = f - rest[i]
        spoken = SPEAKS[state]
        ways = [(INSERT, "I", i, spoken)]
        if i < n:
            initial, fault = rows[i]
            ways.append((DELETE, "D", i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                charge = CHARGE if fault == TRUNCATED else 0
                ways.append((REROLE + charge, "R", i + 1, spoken))
                if (kept := KEEPS.get((state, initial))) is not None:
                    ways.append((charge, "K", i + 1, kept))
        for price, letter, to, then in ways:
            if (to, then) not in closed:
                heapq.heappush(queue, (cost + price + rest[to], audit + letter, to, then))
    return out


class Composed:
    """Cheapest ways over consecutive pieces; what all states' audits share is put aside."""

    def __init__(self):
        self.shared: list[str] = []
        self.at: dict[int, tuple[int, str]] = {NOTHING: (0, "")}

    def add(self, table: dict[int, dict[int, tuple[int, str]]]) -> None:
        found: dict[int, tuple[int, str]] = {}
        for state, (cost, tail) in self.at.items():
            for to, (more, audit) in table[state].items():
                new = (cost + more, tail + audit)
                if to not in found or new < found[to]:
                    found[to] = new
        same = os.path.commonprefix([tail for _, tail in found.values()])
        self.shared.append(same)
        self.at = {to: (cost, tail[len(same) :]) for to, (cost, tail) in found.items()}

    def best(self) -> tuple[int, str]:
        cost, tail = min(self.at[s] for s in GOALS if s in self.at)
        return cost, "".join(self.shared) + tail


def slices(audit: str, sizes: list[int]) -> list[str]:
    """The audit cut by the rows of each piece; inserts go before the row that follows, the last ones to the last piece."""
    out, at = [], 0
    for size in sizes:
        end = at
        while size:
            size -= audit[end] != "I"
            end += 1
        out.append(audit[at:end])
        at = end
    if out:
        out[-1] += audit[at:]
    return out


def apply(audit: str, kept: Iterator[tuple[str, str]], state: int) -> Iterator[tuple[str, str, int]]:
    """(role, text, state) of each repaired row; ``kept`` gives role and text of the rows that need not be deleted, "" for others."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(kept)
        if letter == "D":
            continue
        state = KEEPS[state, role[:1]] if letter == "K" else SPEAKS[state]
        yield role if letter == "K" else ROLE[state], text, state


# ---- rows


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the damage that the query's contract names; dropped rows stay, with 0 copies."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return df.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_copies(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The four columns under their plain names, one copy of each row; what `repair` takes."""
    space, c = F.lit(" "), common.col
    return df.select(c(conv_col).alias("conv_id"), c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col), space).alias("role"), F.coalesce(c(text_col), space).alias("text"), F.lit(1).cast("long").alias("copies"))


def _faulty(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with the number of copies, the first copy's fault and a text of those alone that may stay."""
    gone = F.col("copies") == 0
    blank = lambda x: F.when(gone, F.lit(None)).otherwise(x)  # noqa: E731  what is dropped only names its conversation
    one = rows.select("conv_id", _key(), blank(F.col("turn").cast("long")).alias("turn"), blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"), "copies")
    one = one.groupBy("conv_id", "key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    one = common.stage(one.withColumn("digest", F.md5(F.col("text").cast("binary"))), "repair-rows")
    # null turns come first
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = one.where("copies > 0").groupBy("key", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    said = one.join(first, ["key", "role", "digest"], "left").withColumn("again", F.col("first").isNotNull() & (F.col("first") < when))
    end = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(F.octet_length(end) == 0, BLANK).when(F.col("again"), DUPLICATE).when(~F.substring(end, -1, 1).isin(*".!?"), TRUNCATED).otherwise(NONE)
    return said.select("conv_id", "key", "turn", "role", "text", "copies", F.coalesce(fault, F.lit(NONE)).alias("fault"))


def _ranges(rows: DataFrame, range_bytes: int) -> DataFrame:
    """The rows in order, cut into ranges that may cut through a conversation, never through equal rows."""
    rows = common.stage(rows, "repair-faults")
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    # the bounds are drawn from the beginnings of texts, which sort as the texts do
    by = ["key", F.asc_nulls_first("turn"), "role"]
    begun = rows.withColumn("begins", F.substring("text", 1, 64))
    return begun.repartitionByRange(max(1, -(-size // range_bytes)), *by, "begins").sortWithinPartitions(*by, "text").drop("begins")


STATS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "repaired array<struct<role: string, text: string>>"
PIECE = "part int, seq bigint, lowest bigint, highest bigint, turns bigint, first string, last string, rows bigint, ways array<array<struct<state: int, cost: bigint, audit: string>>>, kept array<struct<role: string, text: string>>"
KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}


def _long(x: int) -> int | None:
    return x if -(1 << 63) <= x < 1 << 63 else None


class _Piece:
    """Consecutive rows of one conversation, copies one by one."""

    def __init__(self, conv, key: str, seq: int):
        self.conv, self.key, self.seq = conv, key, seq
        self.codes: list[tuple[str, int]] = []
        self.kept: list[tuple[str, str]] = []
        self.bytes = self.turns = 0
        self.lowest = self.highest = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        stays = fault not in (BLANK, DUPLICATE)
        self.codes.append((role[:1], fault))
        self.kept.append((role, text) if stays else ("", ""))
        self.bytes += len(text) * 2 if stays else 0
        if turn is not None and turn != self.highest:
            self.turns += 1
            self.highest = turn
            self.lowest = turn if self.lowest is None else self.lowest

    def full(self, rows: int) -> bool:
        return len(self.codes) >= rows or self.bytes >= PIECE_BYTES

    def counts(self) -> dict:
        faults = [f for _, f in self.codes]
        pairs = sum(a + b not in LEGAL for (a, _), (b, _) in zip(self.codes, self.codes[1:]))
        return {"blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED), "illegal": pairs}

    def solved(self, turns: bool) -> dict:
        (cost, audit), = cheapest(self.codes).values()
        lines = [(r, t) for r, t, _ in apply(audit, iter(self.kept), NOTHING)]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        out = {"conv_id": self.conv, **self.counts(), "gaps": _long(gaps), "cost": cost, "audit": audit, "repaired_sha256": digest}
        return out | {"repaired": [{"role": r, "text": t} for r, t in lines]} if turns else out

    def piece(self, part: int) -> dict:
        ways = [[{"state": s, "cost": c, "audit": a} for s, (c, a) in cheapest(self.codes, start, (0, 1, 2, 3), True).items()] for start in range(4)]
        ends = {"first": self.codes[0][0], "last": self.codes[-1][0]} if self.codes else {}
        about = {"part": part, "seq": self.seq, "lowest": self.lowest, "highest": self.highest, "turns": self.turns, "rows": len(self.codes)}
        return {"conv_id": self.conv, **about, **ends, **self.counts(), "ways": ways, "kept": [{"role": r, "text": t} for r, t in self.kept]}


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("kept") or ()) + len(r.get("repaired") or ()) + 8
        if size > 4 * PIECE_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _arrow(ddl: str, conv: pa.DataType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = to_arrow_schema(StructType.fromDDL(ddl))
    return pa.schema([pa.field("conv_id", conv), *plain])


def _streamed(rows: DataFrame, turns: bool, piece_rows: int) -> DataFrame:
    """Whole conversations solved, others as pieces (``part`` is not null)."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_type

    conv, ddl = rows.schema["conv_id"].dataType, f"{STATS}, {TURNS}, {PIECE}"
    schema = _arrow(ddl, to_arrow_type(conv))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part = TaskContext.get().partitionId()
        now, opening = None, True  # the first conversation of a range may have begun before, the last may go on
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if now is None or r["key"] != now.key:
                        if now is not None:
                            yield now.solved(turns) if not opening and not now.seq else now.piece(part)
                            opening = False
                        now = _Piece(r["conv_id"], r["key"], 0)
                    for k in range(r["copies"]):
                        if now.full(piece_rows):
                            yield now.piece(part)
                            now = _Piece(now.conv, now.key, now.seq + 1)
                        now.add(r["turn"], r["role"], r["text"], DUPLICATE if k and r["fault"] != BLANK else r["fault"])
        if now is not None:
            yield now.piece(part)

    return rows.mapInArrow(lambda batches: _batched(pieces(batches), schema), f"conv_id {conv.simpleString()}, {ddl}")


def _key() -> Column:
    """A text for each conversation, also for the null id."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")


def _by_conversation(df: DataFrame) -> DataFrame:
    return df.select("*", _key()).repartition("key").sortWithinPartitions("key", "part", "seq")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """(is it the first of its conversation, row)."""
    key = None
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1).to_pylist()[0]
            yield r["key"] != key, r
            key = r["key"]


def _audited(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, cost, slice): the whole conversation's cost and each piece's part of its audit."""
    schema = "key string, part int, seq bigint, cost bigint, slice string"
    arrow = pa.schema([("key", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("cost", pa.int64()), ("slice", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, so_far = [], Composed()

        def done() -> Iterator[dict]:
            cost, audit = so_far.best()
            for (key, part, seq, _), cut in zip(known, slices(audit, [n for *_, n in known])):
                yield {"key": key, "part": part, "seq": seq, "cost": cost, "slice": cut}

        for first, r in _groups(batches):
            if first and known:
                yield from done()
                known, so_far = [], Composed()
            known.append((r["key"], r["part"], r["seq"], r["rows"]))
            so_far.add({s: {w["state"]: (w["cost"], w["audit"]) for w in ways} for s, ways in enumerate(r["ways"])})
        if known:
            yield from done()

    return _by_conversation(pieces.select("conv_id", "part", "seq", "rows", "ways")).mapInArrow(lambda b: _batched(run(b), arrow), schema)


def _joined(pieces: DataFrame, turns: bool) -> DataFrame:
    """One row a conversation that came in pieces; with ``turns``, also one a piece, whose ``audit`` is null."""
    from pyspark.sql.pandas.types import to_arrow_type

    conv = pieces.schema["conv_id"].dataType
    ddl = f"{STATS}, {TURNS}, seq bigint"
    schema = _arrow(ddl, to_arrow_type(conv))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None

        def done() -> dict:
            known = total["lowest"] is not None
            gaps = total["highest"] - total["lowest"] + 1 - total["turns"] if known else 0
            return {k: total.get(k) for k in names} | {"audit": "".join(total["cuts"]), "gaps": _long(gaps), "repaired_sha256": total["hash"].hexdigest()}

        for first, r in _groups(batches):
            if first:
                if total:
                    yield done()
                total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns", "lines"), 0) | {"conv_id": r["conv_id"], "cost": r["cost"], "lowest": None, "highest": None, "last": None, "cuts": [], "hash": hashlib.sha256(), "state": NOTHING}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                total[k] += r[k]
            if r["rows"]:
                total["illegal"] += total["last"] is not None and total["last"] + r["first"] not in LEGAL
                total["last"] = r["last"]
            if r["lowest"] is not None:
                total["turns"] += r["turns"] - (r["lowest"] == total["highest"])
                total["lowest"] = r["lowest"] if total["lowest"] is None else total["lowest"]
                total["highest"] = r["highest"]
            total["cuts"].append(r["slice"])
            begun, lines = total["lines"], []
            for role, text, total["state"] in apply(r["slice"], iter([(x["role"], x["text"]) for x in r["kept"]]), total["state"]):
                total["hash"].update(f"{chr(10) if total['lines'] else ''}{role}:{text}".encode())
                total["lines"] += 1
                if turns:
                    lines.append({"role": role, "text": text})
            if turns:
                yield {"conv_id": r["conv_id"], "repaired": lines, "seq": begun}
        if total:
            yield done()

    given = _audited(pieces)
    both = pieces.drop("ways", "cost").select("*", _key()).join(given, ["key", "part", "seq"]).drop("key")
    return _by_conversation(both).mapInArrow(lambda b: _batched(run(b), schema), f"conv_id {conv.simpleString()}, {ddl}")


def _solved(rows: DataFrame, turns: bool, piece_rows: int, range_bytes: int) -> tuple[DataFrame, DataFrame]:
    done = common.stage(_streamed(_ranges(_faulty(rows), range_bytes), turns, piece_rows), "repair-solved")
    return done.where("part IS NULL"), _joined(done.where("part IS NOT NULL"), turns)


OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a conversation: faults, cost, audit and the digest of the repaired turns, from rows of `with_copies` or `damaged`."""
    whole, joined = _solved(rows, False, piece_rows, range_bytes)
    return whole.select(*OUT).unionByName(joined.select(*OUT))


def repaired_turns(rows: DataFrame, piece_rows: int = PIECE_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(conv_id, place, role, text): the turns after repair, numbered from 0 in each conversation."""
    whole, joined = _solved(rows, True, piece_rows, range_bytes)
    parts = whole.select("conv_id", F.lit(0).cast("long").alias("seq"), "repaired").unionByName(joined.where("audit IS NULL").select("conv_id", "seq", "repaired"))
    return parts.select("conv_id", "seq", F.posexplode("repaired").alias("k", "turn")).select("conv_id", (F.col("seq") + F.col("k")).alias("place"), "turn.role", "turn.text")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(common.table(spark, sf_dir, "conversations")))


#: The query's rows by SQL: all edits of every row, the cheapest way to each state kept (ties by audit), conversation by conversation.
REPAIR_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ord(s)::BIGINT) AS b FROM conversations),
drawn AS (SELECT * EXCLUDE (b, t), xor(list_reduce(list_prepend(4294967295, b), lambda c, s: xor(c >> 8, t[(xor(c, s) & 255) + 1])), 4294967295) % 20 AS kind FROM named, crc),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS letters,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows_),
faulty AS (SELECT *, CASE WHEN letters = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(letters, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before_ FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before_ || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
-- states: 0 nothing yet, 1 after s, 2 after u, 3 after a
walk AS (
  SELECT conv_id, 0::BIGINT AS i, unnest([{q: 0, cost: 0::BIGINT, audit: '', lines: []::VARCHAR[]}, {q: 2, cost: 3, audit: 'I', lines: ['user:']}, {q: 3, cost: 6, audit: 'II', lines: ['user:', 'assistant:']}], recursive := true) FROM counts
  UNION ALL
  SELECT conv_id, i, q, cost, audit, lines FROM (
    SELECT conv_id, i, unnest([{q: q, cost: cost, audit: audit, lines: lines},
        {q: s1, cost: cost + 3, audit: audit || 'I', lines: list_append(lines, CASE s1 WHEN 2 THEN 'user:' ELSE 'assistant:' END)},
        {q: 5 - s1, cost: cost + 6, audit: audit || 'II', lines: list_append(list_append(lines, CASE s1 WHEN 2 THEN 'user:' ELSE 'assistant:' END), CASE s1 WHEN 3 THEN 'user:' ELSE 'assistant:' END)}], recursive := true)
    FROM (
      SELECT conv_id, i, e.q AS q, e.cost AS cost, e.audit AS audit, e.lines AS lines, CASE e.q WHEN 2 THEN 3 ELSE 2 END AS s1 FROM (
        SELECT w.conv_id, f.i, unnest([
            {q: w.q, cost: w.cost + 4, audit: w.audit || 'D', lines: w.lines},
            CASE WHEN f.fault IN ('n', 't') THEN {q: CASE w.q WHEN 2 THEN 3 ELSE 2 END, cost: w.cost + 3 + 3 * (f.fault = 't')::INT, audit: w.audit || 'R', lines: list_append(w.lines, CASE w.q WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text)} END,
            CASE WHEN f.fault IN ('n', 't') AND (f.initial = 's' AND w.q = 0 OR f.initial = 'u' AND w.q <> 2 OR f.initial = 'a' AND w.q = 2)
              THEN {q: CASE f.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cost: w.cost + 3 * (f.fault = 't')::INT, audit: w.audit || 'K', lines: list_append(w.lines, f.role || ':' || f.text)} END]) AS e
        FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1) WHERE e IS NOT NULL))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
best AS (
  SELECT c.*, cost, audit, sha256(array_to_string(lines, chr(10))) AS digest FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n AND w.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY cost, audit) = 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""
