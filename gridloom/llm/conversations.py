"""Repair of the turn structure of conversations (operator 13).

A conversation should read as an optional system turn and then pairs of a user's
and an assistant's turn. The cheapest edits that make it so come from a recursive
DuckDB query inside hash-partitioned batches: each recursion advances one turn in
all conversations of the batch and keeps, for every state of the grammar, the
least cost and the least audit of that cost.

No conversation has to fit one task. It is cut into segments by turn, and a segment
into pieces where it is longer than a batch may be. A piece is walked from each
of the four states, so pieces are independent; a second recursion then advances
one piece at a time. The first turn that says a thing is found by grouping
digests, so a piece need not know those before it. The edits meet the turns again
in a last sorted pass, which streams the repaired turns into a hash and holds none of them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridloom.llm.common import small_batches

#: Turn numbers of one segment (a power of two), and rows of one batch that DuckDB gets; a segment of more rows is walked in pieces.
SEGMENT, BATCH_ROWS = 64, 16384

#: Costs of edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system turn, after a user's turn, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Where a kept turn of an initial leads; an edit or an insertion takes the next turn that the state asks for.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
CLEAN, BLANK, DUPLICATE, CUT_OFF = range(4)


def edits(state: int, initial: str, fault: int) -> dict[int, tuple[int, str]]:
    """The cheapest way of dealing with one turn for each state that it can lead to: cost and audit.

    Insertions may come before the turn; two of them lead round the pair of turns, so more are never cheaper.
    """
    found: dict[int, tuple[int, str]] = {}
    at = state
    for inserted in range(3):
        kept = TRUNCATED if fault == CUT_OFF else 0
        ways = [(at, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            ways += [(NEXT[at], REROLE + kept, "R")] + ([(KEPT[at, initial], kept, "K")] if (at, initial) in KEPT else [])
        for after, cost, letter in ways:
            way = (cost + INSERT * inserted, "I" * inserted + letter)
            found[after] = min(found.get(after, way), way)
        at = NEXT[at]
    return found


def moves() -> pa.Table:
    """``edits`` of every state, initial ('-' for any other) and fault as a table."""
    rows = [(q, i, f, after, *way) for q, i, f in itertools.product(STATES, "sua-", range(4)) for after, way in edits(q, i, f).items()]
    return pa.table(list(map(pa.array, zip(*rows, strict=True))), names=["state", "initial", "fault", "after", "cost", "letters"])


#: Turns (piece, n from 1, initial, fault) of a batch, walked from every state.
WALK_TURNS = """
WITH RECURSIVE walk AS (
    SELECT piece, 0 AS n, s.state AS origin, s.state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM sizes, states s
    UNION ALL
    SELECT walk.piece, walk.n + 1, walk.origin, m.after, min({'cost': walk.best.cost + m.cost, 'audit': walk.best.audit || m.letters})
    FROM walk JOIN turns t ON t.piece = walk.piece AND t.n = walk.n + 1 JOIN moves m ON m.state = walk.state AND m.initial = t.initial AND m.fault = t.fault
    GROUP BY walk.piece, walk.n, walk.origin, m.after)
SELECT piece, list({'origin': origin, 'state': state, 'cost': best.cost, 'audit': best.audit}) AS paths
FROM walk JOIN sizes USING (piece) WHERE walk.n = sizes.n GROUP BY piece
"""
#: Pieces (conv, n from 1, paths) of a batch, walked from nothing; at the end a turn that waits for its answer gets one.
WALK_PIECES = """
WITH RECURSIVE ways AS (SELECT conv, n, unnest(paths, recursive := true) FROM pieces),
walk AS (
    SELECT conv, 0 AS n, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM (SELECT DISTINCT conv FROM pieces)
    UNION ALL
    SELECT walk.conv, walk.n + 1, w.state, min({'cost': walk.best.cost + w.cost, 'audit': walk.best.audit || w.audit})
    FROM walk JOIN ways w ON w.conv = walk.conv AND w.n = walk.n + 1 AND w.origin = walk.state
    GROUP BY walk.conv, walk.n, w.state),
ended AS (
    SELECT conv, min({'cost': best.cost + e.cost, 'audit': best.audit || e.letters}) AS best
    FROM walk JOIN (SELECT conv, max(n) AS n FROM pieces GROUP BY conv) USING (conv, n) JOIN endings e USING (state) GROUP BY conv)
SELECT conv, best.cost AS cost, best.audit AS audit FROM ended
"""
ENDINGS = pa.table({"state": [START, SYSTEM, USER, ASSISTANT], "cost": [0, 2 * INSERT, INSERT, 0], "letters": ["", "II", "I", ""]})

PIECE = ("piece long, turns_at long, first_turn long, last_turn long, first_initial string, last_initial string, blank long, duplicate long, truncated long, illegal long, "
         "paths array<struct<origin:int,state:int,cost:long,audit:string>>")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after damage, and ``there``: false for a row that was dropped.

    Nulls of role and text are one space, and so is one in what is hashed. A
    dropped row stays as a mark of its conversation.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    changed = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    kept = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(role).alias("role"), changed.alias("text"), (hit != 0).alias("there"), hit.alias("hit"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    gone = ~F.col("there")
    return kept.select("conv_id", "turn", F.when(gone, "").otherwise(F.col("role")).alias("role"), F.when(gone, "").otherwise(F.col("text")).alias("text"), "there", F.explode(copies).alias("copy")).drop("copy")


def _segment() -> Column:
    """The segment of a turn; null turns, which come first, make one of their own."""
    return F.shiftright("turn", SEGMENT.bit_length() - 1)


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def said_before(rows: DataFrame) -> DataFrame:
    """conv_id, turn, digest of turns whose role and text an earlier turn number of the conversation holds.

    Digests are 128 bits of role and text. Equal rows of one turn stand side by side and are told apart there.
    """
    order = F.coalesce("turn", F.lit(-(2**63)))
    said = rows.where("there").select("conv_id", "turn", order.alias("place"), _digest().alias("digest"))
    first = said.groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last")
    same = first.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    met = said.join(same.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    return met.where("place > first").select("conv_id", "turn", "digest").distinct()


def _database(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    """A connection of one thread, as Spark runs one task for each core, that leaves no files."""
    db = duckdb.connect(config={"threads": 1, "memory_limit": "800MB", "temp_directory": ""})
    for name, table in tables.items():
        db.register(name, table)
    return db


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, list[tuple], list[int]]]:
    """Sorted batches put together to tables of whole groups, about ``most`` rows each.

    Each comes with its groups and the number of each row's group. Only a group of more than ``most`` rows goes on in the next table.
    """

    def numbered(table: pa.Table) -> tuple[list[tuple], list[int]]:
        ids: list[tuple] = []
        numbers = []
        for one in zip(*[table[k].to_pylist() for k in keys], strict=True):
            if not ids or one != ids[-1]:
                ids.append(one)
            numbers.append(len(ids) - 1)
        return ids, numbers

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < most:
            continue
        ids, numbers = numbered(held)
        # The last group may go on, so it waits, unless it is all there is.
        end = numbers.index(len(ids) - 1) or len(numbers)
        last = len(ids) - (end < len(numbers))
        yield held.slice(0, end), ids[:last], numbers[:end]
        held = held.slice(end)
    if held is not None and held.num_rows:
        yield held, *numbered(held)


#: Turns of a batch (k, g, turn, role, text, there, digest, note) with faults; notes name turns that were said before.
NOTED = """
CREATE OR REPLACE TABLE noted AS
WITH said AS (SELECT DISTINCT g, turn, digest FROM batch WHERE note),
faced AS (
    SELECT k, g, turn, left(role, 1) AS letter, digest, s.digest IS NOT NULL OR coalesce(lag(digest) OVER own = digest AND lag(turn) OVER own IS NOT DISTINCT FROM turn, false) AS again,
           NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut_off
    FROM (SELECT k, g, turn, role, text, digest FROM batch WHERE there) b LEFT JOIN said s USING (g, turn, digest)
    WINDOW own AS (PARTITION BY g ORDER BY k))
SELECT k, g, turn, letter, lag(letter) OVER own AS letter_before, lag(turn) OVER own AS turn_before, row_number() OVER own AS n,
       CASE WHEN letter IN ('s', 'u', 'a') THEN letter ELSE '-' END AS initial,
       CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN cut_off THEN 3 ELSE 0 END AS fault
FROM faced WINDOW own AS (PARTITION BY g ORDER BY k)
"""
#: Counts and ends of the pieces 0 to {pieces} - 1 of a batch, empty ones among them, with their paths.
SUMMED = f"""
WITH counted AS (
    SELECT g AS piece, count(*) FILTER (turn IS NOT NULL AND turn IS DISTINCT FROM turn_before) AS turns_at, min(turn) AS first_turn, max(turn) AS last_turn,
           first(letter ORDER BY k) AS first_initial, last(letter ORDER BY k) AS last_initial, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
           count(*) FILTER (fault = {CUT_OFF}) AS truncated, count(*) FILTER (n > 1 AND letter_before || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM noted GROUP BY g)
SELECT s.piece, coalesce(turns_at, 0), first_turn, last_turn, first_initial, last_initial, coalesce(blank, 0), coalesce(duplicate, 0), coalesce(truncated, 0), coalesce(illegal, 0), paths
FROM sizes s LEFT JOIN counted USING (piece) JOIN ({WALK_TURNS}) USING (piece) ORDER BY piece
"""


def _typed(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), schema, strict=True)], schema=schema)


def walked(rows: DataFrame) -> DataFrame:
    """Every piece of every segment: its counts, ends, and the cheapest paths from each state to each other."""
    nothing = [F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("there")]
    notes = said_before(rows).select("conv_id", _segment().alias("segment"), "turn", *nothing, "digest", F.lit(True).alias("note"))
    turns = rows.select("conv_id", _segment().alias("segment"), "turn", "role", "text", "there", _digest().alias("digest"), F.lit(False).alias("note"))
    keys = ["conv_id", "segment"]
    ordered = turns.unionByName(notes).repartition(*keys).sortWithinPartitions(*keys, "turn", F.desc("note"), "role", "text")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, segment long, {PIECE}"
    arrow = _typed(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(moves=moves(), states=pa.table({"state": list(STATES)}))
        last, piece, carried = None, 0, []
        for table, groups, numbers in grouped(batches, keys, BATCH_ROWS):
            own = table.select(["turn", "role", "text", "there", "digest", "note"])
            if groups[0] == last and carried:  # a piece that goes on with the last turn of the one before
                own = pa.concat_tables([pa.Table.from_pylist([{"turn": t, "role": "", "text": "", "there": False, "digest": d, "note": True} for t, d in carried], own.schema), own])
                numbers = [0] * len(carried) + numbers
            db.register("batch", own.append_column("k", pa.array(range(len(numbers)), pa.int64())).append_column("g", pa.array(numbers, pa.int64())))
            db.execute(NOTED)
            db.execute("CREATE OR REPLACE TABLE turns AS SELECT g AS piece, n, initial, fault FROM noted")
            db.execute(f"CREATE OR REPLACE TABLE sizes AS SELECT r.range AS piece, coalesce(max(n), 0) AS n FROM range({len(groups)}) r LEFT JOIN turns t ON t.piece = r.range GROUP BY r.range")
            made = []
            for number, *counts in db.execute(SUMMED).fetchall():
                piece = piece + 1 if groups[number] == last else 0
                last = groups[number]
                made.append((*last, piece, *counts))
            yield _batch_of(made, arrow)
            at = own["turn"][-1].as_py()
            carried = sorted({(r["turn"], r["digest"]) for r in own.filter(own["note"]).select(["turn", "digest"]).to_pylist() if r["turn"] == at} | {(at, own["digest"][-1].as_py())} if own["there"][-1].as_py() else [], key=repr)

    return small_batches(ordered).mapInArrow(run, schema)


#: Counts of whole conversations from those of their pieces (conv, n from 1).
SUM_PIECES = """
SELECT conv, sum(blank)::BIGINT AS blank, sum(duplicate)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated,
       sum(illegal + CASE WHEN ends || first_initial NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END)::BIGINT AS illegal,
       coalesce(max(last_turn)::HUGEINT - min(first_turn) + 1 - sum(turns_at - CASE WHEN first_turn = last_before THEN 1 ELSE 0 END), 0)::BIGINT AS gaps
FROM (SELECT *, lag(last_initial IGNORE NULLS) OVER (PARTITION BY conv ORDER BY n) AS ends, lag(last_turn IGNORE NULLS) OVER (PARTITION BY conv ORDER BY n) AS last_before FROM pieces)
GROUP BY conv
"""


def planned(pieces: DataFrame) -> DataFrame:
    """conv_id, the counts of a conversation, and its least cost and audit."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "piece")
    schema = f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, {REPORT}"
    arrow = _typed(schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple], list[int]]]:
        """All pieces of a conversation together: a piece is small beside its turns."""
        held = None
        for table, groups, numbers in grouped(batches, ["conv_id"], BATCH_ROWS // 8):
            if held and held[1][-1] != groups[0]:
                yield held
                held = None
            if held:
                first = len(held[1]) - 1
                table, groups, numbers = pa.concat_tables([held[0], table]), held[1] + groups[1:], held[2] + [first + k for k in numbers]
            held = table, groups, numbers
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database(endings=ENDINGS)
        for table, groups, numbers in whole(batches):
            places = itertools.chain.from_iterable(range(1, len(list(g)) + 1) for _, g in itertools.groupby(numbers))
            db.register("pieces", table.append_column("conv", pa.array(numbers, pa.int64())).append_column("n", pa.array(list(places), pa.int64())))
            out = db.execute(f"SELECT s.conv, gaps, blank, duplicate, truncated, illegal, cost, audit FROM ({SUM_PIECES}) s JOIN ({WALK_PIECES}) w USING (conv)").fetchall()
            yield _batch_of([(*groups[conv], *rest) for conv, *rest in out], arrow)

    return small_batches(ordered).mapInArrow(run, schema)


def repaired_turns(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """role and text of the repaired turns; ``audit`` is followed letter by letter."""
    state = START
    for letter in audit:
        role, text = next(turns) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = ROLES[state]
        yield role, text


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    ``rows`` (conv_id, turn, role, text) are damaged first. Turns are taken in
    order of turn, nulls first; those of one turn by role and text. A role that is
    not system, user or assistant by its first letter is never kept. A null
    conv_id is a conversation like others, repeated rows are turns that were
    said before, and an empty table gives no rows. Columns of other names are
    not read. Turn numbers should be whole numbers.
    """
    return _hashed(damaged(rows), None)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of every repaired turn of the conversations as they are, without damage."""
    whole = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(True).alias("there"))
    return _hashed(whole, "place long, role string, text string")


def _hashed(rows: DataFrame, out: str | None) -> DataFrame:
    """The plan of every conversation with the hash of its repaired turns; or, with ``out``, the repaired turns."""
    plans = planned(walked(rows))
    names = [f.name for f in plans.schema.fields[1:]]
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in plans.schema.fields[1:]]
    no_turn = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("turn", "role", "text")]
    both = plans.select("conv_id", F.lit(0).alias("kind"), *no_turn, *names).unionByName(rows.where("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", *absent))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {out or REPORT + ', repaired_sha256 string'}"
    arrow = _typed(schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # A plan comes before the turns of its conversation.
        for _, group in itertools.groupby(opened(batches), key=lambda r: r[0]):
            plan = next(group)
            turns = repaired_turns(plan[-1], ((row[3], row[4]) for row in group))
            if out:
                yield from ((plan[0], place, *turn) for place, turn in enumerate(turns))
                continue
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(turns):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield plan[0], *plan[5:], digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = made(batches)
        while some := list(itertools.islice(found, 2048)):
            yield _batch_of(some, arrow)

    return small_batches(ordered).mapInArrow(run, schema)


#: The same over whole conversations at once; the checksum, which that dialect lacks, is worked out byte by byte.
ORACLE_SQL = """
WITH RECURSIVE bits AS (SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT) AS bytes FROM conversations),
hit AS (SELECT * EXCLUDE (bytes, crc), xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM keyed, bits),
after AS (
    SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
           CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hit WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM after),
faced AS (
    SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS letter_before,
           CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault
    FROM placed),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
turns AS (SELECT c, f.* FROM ids JOIN faced f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id),
steps AS (SELECT * FROM (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) v(state, letter, after)),
kept AS (SELECT * FROM steps UNION ALL SELECT 0, 's', 1),
opened AS (SELECT state AS origin, state, '' AS letters, 0 AS cost FROM (SELECT unnest(range(4)) AS state)
           UNION ALL SELECT state, after, 'I', 3 FROM steps UNION ALL SELECT a.state, b.after, 'II', 6 FROM steps a JOIN steps b ON b.state = a.after),
walk AS (
    SELECT c, 0::BIGINT AS n, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM ids
    UNION ALL
    SELECT c, n, state, min({'cost': cost, 'audit': audit}) FROM (
        SELECT w.c, t.n, m.state, w.best.cost + o.cost + m.cost + CASE WHEN t.fault = 3 AND m.letter <> 'D' THEN 3 ELSE 0 END AS cost, w.best.audit || o.letters || m.letter AS audit
        FROM walk w JOIN turns t ON t.c = w.c AND t.n = w.n + 1 JOIN opened o ON o.origin = w.state
        JOIN (SELECT state AS before, after AS state, letter AS initial, 'K' AS letter, 0 AS cost FROM kept UNION ALL SELECT state, after, NULL, 'R', 3 FROM steps
              UNION ALL SELECT s, s, NULL, 'D', 4 FROM (SELECT unnest(range(4)) AS s)) m
          ON m.before = o.state AND (m.letter = 'D' OR t.fault NOT IN (1, 2)) AND (m.letter <> 'K' OR m.initial = t.letter)) x
    GROUP BY c, n, state),
counts AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (letter_before || letter NOT IN ('su', 'ua', 'au')) AS illegal
    FROM turns GROUP BY c),
ended AS (
    SELECT c, min({'cost': best.cost + o.cost, 'audit': best.audit || o.letters}) AS best
    FROM walk JOIN ids USING (c) LEFT JOIN counts USING (c) JOIN opened o ON o.origin = walk.state
    WHERE walk.n = coalesce(counts.n, 0) AND o.state IN (0, 3) GROUP BY c),
letters AS (SELECT c, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS at_ FROM ended WHERE best.audit <> ''),
spelt AS (SELECT c, letter, at_, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY at_) AS n FROM letters),
made AS (
    SELECT s.c, s.at_, s.letter, t.role, t.text,
           row_number() OVER (PARTITION BY s.c ORDER BY s.at_) - max(CASE WHEN s.letter = 'K' AND t.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS place
    FROM spelt s LEFT JOIN turns t ON t.c = s.c AND t.n = s.n AND s.letter <> 'I' WHERE s.letter <> 'D'),
joined AS (
    SELECT c, string_agg(CASE WHEN letter = 'K' THEN role ELSE CASE WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY at_) AS body
    FROM made GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       best.cost AS cost, best.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids JOIN ended USING (c) LEFT JOIN counts USING (c) LEFT JOIN joined USING (c)
""".replace("\\\\", "\\")
