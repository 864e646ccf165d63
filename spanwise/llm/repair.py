"""Repair of conversations at least cost, by a rank-compressed dynamic programme.

A repaired conversation's roles are an optional system turn and then user and assistant in
turn, ending with an assistant (or nothing at all).  Each turn is kept (K, cost 0), given
another role (R, 1) or deleted (D, 2, the only way for a blank or repeated turn), and empty
turns may be inserted anywhere (I, 5 each); a truncated turn that stays costs 5 more.  Of all
cheapest edits those are taken whose initials, in order, are least as ASCII text.

The programme runs over macro edits: up to two insertions, then one edit of a turn (more
insertions lead to the same place for more).  Their codes (D, ID, IID, IIK, ...) are free of
prefixes, so two edit texts over the same turns compare like their sequences of codes.  A
layer therefore holds no texts: for each of the four places in the pattern the least cost,
the rank of its text among the layer's and a pointer to its predecessor; a layer's ranks
come from the predecessor's rank and the rank of the code.  Ranks, and costs above the
layer's least (places much above it are given up), take few values, so each step is looked
up once it was computed.  The edits
are read back along the pointers (four bytes a turn) when the conversation ends.

Turns are numbered by conversation, by turn (null first), role and text.  They are written
once with their numbers; their kinds alone go through the programme, and its plan meets the
texts again in one sorted pass that holds one turn at a time, so a long conversation takes a
task's time but not its memory.

Nulls: a null role or text is empty, a null turn comes first and leaves gaps alone, rows with
a null conv_id form one conversation.  Repeated rows are turns of their own, all but the first
of them duplicates.  A very long text is only read and passed on.  A conversation whose turns
all go is repaired to nothing.  Extra columns are ignored, whatever their names; an empty
table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.checkpoints import Rounds
from .common import read_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Places in the pattern s?(ua)+: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: White space as the word rule has it.
SPACE = " \t\n\x0b\x0c\r"
#: Faults of a turn, the first that holds.
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
INITIALS = "uas"
NAMES = {"u": "user", "a": "assistant"}
CODES = sorted("I" * n + edit for n in range(3) for edit in "DKR")
#: A place this much dearer than the cheapest is given up: from there two insertions and one deletion (12 at most) do whatever it could.
LEAD = 2 * INSERT + DELETE
TURNS = "conv_id long, at long, turn long, role string, text string, initial int, fault int"
PLANS = "conv_id long, at long, before string, edit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, role string, text string, edit string"


def _due(place: int) -> tuple[str, int]:
    """The role whose turn it is, and the place after it."""
    return ("a", ASSISTANT) if place == USER else ("u", USER)


def _steps(initial: int, fault: int) -> list[list[tuple[int, int, int]]]:
    """For each place after a turn: (place before, rank of the code, cost) of the macro edits that lead there."""
    role, into = INITIALS[initial] if initial < len(INITIALS) else "", [[] for _ in range(4)]
    for start, code in product(range(4), CODES):
        place, cost = start, INSERT * (len(code) - 1)
        for _ in code[:-1]:
            place = _due(place)[1]
        if code[-1] == "D":
            cost += DELETE
        elif fault in (BLANK, DUPLICATE):
            continue
        else:
            cost += (REROLE if code[-1] == "R" else KEEP) + (TRUNCATED if fault == CUT_OFF else 0)
            if code[-1] == "R" or role == _due(place)[0]:
                place = _due(place)[1]
            elif role == "s" and place == START:
                place = SYSTEM
            else:
                continue
        into[place].append((start, CODES.index(code), cost))
    return into


class Programme:
    """The least edits of one conversation after another, a turn's kind at a time."""

    def __init__(self) -> None:
        self.steps = {(i, f): _steps(i, f) for i in range(4) for f in range(4)}
        self.known: dict[tuple, tuple] = {}
        self.begin()

    def begin(self) -> None:
        self.layer, self.spent, self.pointers, self.kinds = ((0, 0), None, None, None), 0, bytearray(), bytearray()

    def turn(self, initial: int, fault: int) -> None:
        key = (self.layer, initial, fault)
        found = self.known.get(key)
        if found is None:
            best = []
            for into in self.steps[initial, fault]:
                ways = [(self.layer[s][0] + cost, self.layer[s][1], code, s) for s, code, cost in into if self.layer[s] is not None]
                best.append(min(ways, default=None))
            least = min(w[0] for w in best if w is not None)
            best = [w if w is not None and w[0] <= least + LEAD else None for w in best]
            texts = sorted((w[1], w[2]) for w in best if w is not None)
            layer = tuple(None if w is None else (w[0] - least, texts.index((w[1], w[2]))) for w in best)
            found = self.known[key] = (layer, least, bytes(0 if w is None else w[3] * len(CODES) + w[2] for w in best))
        self.layer, least, pointers = found
        self.spent += least
        self.pointers += pointers

    def end(self) -> tuple[int, list[str], int]:
        """Cost, the code of each turn, and how many turns are inserted after the last."""
        ways = [(cost + INSERT * more, rank, place, more) for (place, more) in ((START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)) if self.layer[place] is not None for cost, rank in [self.layer[place]]]
        cost, _, place, more = min(ways)
        codes = []
        for at in range(len(self.pointers) - 4, -1, -4):
            place, code = divmod(self.pointers[at + place], len(CODES))
            codes.append(CODES[code])
        return self.spent + cost, codes[::-1], more


def _roles(codes: list[str], initials: list[int], more: int) -> Iterator[tuple[str, str]]:
    """For each turn, then for the end: initials of the turns inserted before, and of the role it gets (empty: its own)."""
    place = START
    for code, initial in zip([*codes, "I" * more + "."], [*initials, 3], strict=True):
        before, role = "", ""
        for _ in code[:-1]:
            due, place = _due(place)
            before += due
        if code[-1] == "R" or (code[-1] == "K" and INITIALS[initial] != "s"):
            role, place = _due(place)
            role = role if code[-1] == "R" else ""
        elif code[-1] == "K":
            place = SYSTEM
        yield before, role


_PLANS = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("before", pa.string()), ("edit", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
#: Rows and characters of one output batch.
BATCH_ROWS, BATCH_CHARS = 20_000, 4_000_000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plans of conversations whose turns come together and in order: a row for each turn, then one with the sums."""
    programme, rows = Programme(), []
    current, initials, counts, illegal, turns = None, None, None, 0, []

    def closed() -> Iterator[tuple]:
        cost, codes, more = programme.end()
        nothing = (None,) * 7
        for at, ((before, role), code) in enumerate(zip(_roles(codes, initials, more), [*codes, "."], strict=True), 1):
            if at <= len(codes):
                yield (current, at, before, code[-1] + role, *nothing)
            else:
                low, high, distinct = turns or (0, -1, 0)
                yield (current, at, before, None, high - low + 1 - distinct, counts[BLANK], counts[DUPLICATE], counts[CUT_OFF], illegal, cost, "".join(codes) + "I" * more)

    for batch in batches:
        for conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault")), strict=True):
            if initials is None or conv_id != current:
                if initials is not None:
                    for row in closed():
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS:
                            yield _batch(rows, _PLANS)
                            rows.clear()
                programme.begin()
                current, initials, counts, illegal, turns = conv_id, bytearray(), [0] * 4, 0, None
            elif (initials[-1], initial) not in ((2, 0), (0, 1), (1, 0)):
                illegal += 1
            if turn is not None:
                turns = (turn, turn, 1) if turns is None else (turns[0], turn, turns[2] + (turn != turns[1]))
            programme.turn(initial, fault)
            counts[fault] += 1
            initials.append(initial)
    if initials is not None:
        for row in closed():
            rows.append(row)
            if len(rows) >= BATCH_ROWS:
                yield _batch(rows, _PLANS)
                rows.clear()
    if rows:
        yield _batch(rows, _PLANS)


def numbered(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) with their number in the conversation, first letter of role and first fault."""
    given = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "_digest").orderBy("at")
    end = F.rtrim("text", F.lit(SPACE))
    fault = F.when(end == "", BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(F.substring(end, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), len(INITIALS)).otherwise(initial)
    at = given.withColumn("at", F.row_number().over(order).cast("long")).withColumn("_digest", F.sha2("text", 256))
    return at.select("conv_id", "at", "turn", "role", "text", initial.cast("int").alias("initial"), fault.cast("int").alias("fault"))


def planned(turns: DataFrame) -> DataFrame:
    """Edits of numbered turns: a row (conv_id, at, before, edit) for each, and one more for a conversation with its sums and audit."""
    kinds = turns.select("conv_id", "at", "turn", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return kinds.mapInArrow(_planned, PLANS)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held, plan, position, current = [], 0, None, 0, ()
    for batch in batches:
        for conv_id, at, before, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "before", "edit", "role", "text")), strict=True):
            if (conv_id,) != current:
                current, position = (conv_id,), 0
            if role is None:  # a plan, before its turn
                for due in before:
                    position += 1
                    rows.append((conv_id, position, NAMES[due], "", "I"))
                plan = edit
                continue
            if plan[0] == "D":
                continue
            position += 1
            rows.append((conv_id, position, NAMES[plan[1]] if plan[0] == "R" else role, text, plan[0]))
            held += len(text)
            if held > BATCH_CHARS or len(rows) > BATCH_ROWS:
                yield _batch(rows, _REPAIRED)
                rows, held = [], 0
    if rows:
        yield _batch(rows, _REPAIRED)


def repaired(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations' rows; a conversation's come together and in order within a partition."""
    none = F.lit(None).cast("string")
    both = plans.select("conv_id", "at", F.lit(0).alias("kind"), "before", "edit", none.alias("role"), none.alias("text")).unionByName(
        turns.select("conv_id", "at", F.lit(1).alias("kind"), none.alias("before"), none.alias("edit"), "role", "text")
    )
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")
    return dealt.select("conv_id", "at", "before", "edit", "role", "text").mapInArrow(_rebuilt, REPAIRED)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums and audit of each conversation that has turns, and the rows of the repaired ones."""
    rounds = Rounds(conversations.sparkSession)
    turns = rounds.keep(numbered(conversations), "turns")
    plans = rounds.keep(planned(turns), "plans")
    sums = plans.filter("edit is null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return sums, repaired(turns, plans)


_HASHES = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, current, whole = [], (), None
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if (conv_id,) != current:
                if current:
                    rows.append((current[0], whole.hexdigest()))
                current, whole = (conv_id,), hashlib.sha256()
            else:
                whole.update(b"\n")
            whole.update(f"{role}:{text}".encode())
        if len(rows) > BATCH_ROWS:
            yield _batch(rows, _HASHES)
            rows.clear()
    if current:
        rows.append((current[0], whole.hexdigest()))
    if rows:
        yield _batch(rows, _HASHES)


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's damage: by a checksum of conversation and turn, rows go, lose text or ends, repeat or change role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate")).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sums, rows = repair(damaged(given))
    shas = rows.mapInArrow(_hashes, "conv_id long, sha string")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    for table in (sums, shas):
        found = found.join(table, found["id"].eqNullSafe(table["conv_id"]), "left").drop("conv_id")
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in longs]
    return found.select(F.col("id").alias("conv_id"), *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: A table-driven CRC-32, the damage, and the edits by a search over texts that extends every place turn by turn.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
  FROM conversations
), d AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[CAST(xor(c, x) % 256 AS INTEGER) + 1]))) % 20 AS fate
  FROM k, crc
), r AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS time FROM d WHERE fate <> 0)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nr FROM r
), f AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nr) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY nr) AS earlier
  FROM n
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (nr > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS turns
  FROM f GROUP BY conv_id
), e AS (SELECT unnest(['D', 'K', 'R', 'ID', 'IK', 'IR', 'IID', 'IIK', 'IIR']) AS code),
p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS nr, '' AS place, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS out FROM s
  UNION ALL
  SELECT conv_id, nr, place, cost, audit, out FROM (
    SELECT q.conv_id, q.nr,
           CASE WHEN edit = 'D' THEN here WHEN edit = 'K' AND initial = 's' THEN 's' WHEN here = 'u' THEN 'a' ELSE 'u' END AS place,
           q.cost + 5 * (length(code) - 1) + CASE edit WHEN 'D' THEN 2 ELSE CASE WHEN edit = 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END AS cost,
           q.audit || code AS audit,
           q.out || inserted || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE CASE WHEN here = 'u' THEN 'assistant:' ELSE 'user:' END || text || chr(10) END AS out
    FROM (
      SELECT p.conv_id, f.nr, p.cost, p.audit, p.out, code, right(code, 1) AS edit, f.role, f.text, f.initial, f.fault, place,
             CASE length(code) WHEN 1 THEN place WHEN 2 THEN CASE WHEN place = 'u' THEN 'a' ELSE 'u' END ELSE CASE WHEN place = 'u' THEN 'u' ELSE 'a' END END AS here,
             CASE length(code) WHEN 1 THEN '' WHEN 2 THEN CASE WHEN place = 'u' THEN 'assistant:' || chr(10) ELSE 'user:' || chr(10) END
                  ELSE CASE WHEN place = 'u' THEN 'assistant:' || chr(10) || 'user:' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END END AS inserted
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.nr = p.nr + 1, e
    ) q
    WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR initial = CASE WHEN here = 'u' THEN 'a' ELSE 'u' END OR (initial = 's' AND here = '')))
    QUALIFY row_number() OVER (PARTITION BY q.conv_id, CASE WHEN edit = 'D' THEN here WHEN edit = 'K' AND initial = 's' THEN 's' WHEN here = 'u' THEN 'a' ELSE 'u' END ORDER BY
      q.cost + 5 * (length(code) - 1) + CASE edit WHEN 'D' THEN 2 ELSE CASE WHEN edit = 'R' THEN 1 ELSE 0 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END END, q.audit || code) = 1
  )
), z AS (
  SELECT p.conv_id, p.cost + CASE place WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END AS cost, p.audit || CASE place WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
         p.out || CASE place WHEN 's' THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 'u' THEN 'assistant:' || chr(10) ELSE '' END AS out
  FROM p JOIN s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.nr = s.turns
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + CASE place WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, p.audit || CASE place WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END) = 1
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(CASE WHEN coalesce(out, '') = '' THEN '' ELSE out[1:length(out) - 1] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""
