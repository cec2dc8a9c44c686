"""Conversation structure repair: the cheapest edits that give each conversation its form.

A conversation has its form if the initials of its roles are ``(s?(ua)+)?``.
Edits of a turn: Keep, Rerole (to user or assistant), Delete; empty user and
assistant turns may be Inserted anywhere.

Method: rows are numbered in ranges of (conversation, turn), and what a
conversation has within ``SEGMENT`` consecutive numbers is a segment, so a
conversation of any length is spread and no recursion is deeper than that.
Segments are hash-partitioned, and in each batch of a partition a recursive
DuckDB query advances all of them by one turn a step.  It keeps, for each
state of the grammar that a segment may begin in and each that it may end in,
the least cost and the edits that have it.  Segments of one conversation are
then chained in order, cost by cost (the steps form a min-plus product), and
the audit of the best chain is cut back to the rows.

Comparing audits of equal cost by their first parts is safe: of two prefixes
that use up the same turns neither begins the other, as one would have more
insertions and so cost more.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import in_ranges, null_safe
from .common import Workspace, lean

#: Rows are cut into segments of at most 2 ** SEGMENT_BITS turns.
SEGMENT_BITS = 7
#: Rows of whole segments in one recursive query.
BATCH_ROWS = 20_000
SPACES = " \t\n\x0b\x0c\r"

#: States of the grammar: nothing yet, after s, after u, after a; a conversation may end in the first and the last.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def openings(costs: Costs) -> list[tuple]:
    """(state, state after, cost, audit) of up to two insertions; a third would only come back to a state that is cheaper to stay in."""
    found = [(s, s, 0, "") for s in range(4)]
    for s, t, cost, audit in found:
        if len(audit) < 2:
            found += [(s, STEPS[t, role], cost + costs.insert, audit + "I") for role in "ua" if (t, role) in STEPS]
    return found


def moves(costs: Costs) -> list[tuple]:
    """(state, initial, must go, truncated, state after, cost, audit) of each way to treat one turn and insert behind it."""
    found = []
    for state in range(4):
        for initial in "sua-":
            for gone in (False, True):
                for cut in (False, True):
                    ways = [(state, costs.delete, "D")]
                    if not gone:
                        fee = costs.truncated if cut else 0
                        if (state, initial) in STEPS:
                            ways.append((STEPS[state, initial], fee, "K"))
                        ways += [(STEPS[state, role], fee + costs.rerole, "R") for role in "ua" if (state, role) in STEPS]
                    best = {}
                    for after, cost, edit in ways:
                        for s, t, more, audit in openings(costs):
                            if s == after:
                                best[t] = min(best.get(t, (1 << 60, "")), (cost + more, edit + audit))
                    found += [(state, initial, gone, cut, t, *x) for t, x in best.items()]
    return found


WALK = """
WITH RECURSIVE walk AS (
  SELECT w.segment, 0::BIGINT AS i, o.state AS start, o.after AS state, {'cost': o.cost, 'audit': o.audit} AS best
  FROM (SELECT DISTINCT segment FROM turns) w, openings o
  UNION ALL
  SELECT w.segment, any_value(t.i), w.start, m.after, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.audit})
  FROM walk w
  JOIN turns t ON t.segment = w.segment AND t.i = w.i + 1
  JOIN moves m ON m.state = w.state AND m.initial = t.initial AND m.gone = t.gone AND m.cut = t.cut
  GROUP BY w.segment, w.start, m.after
)
SELECT w.segment, w.start, w.state, w.best.cost AS cost, w.best.audit AS audit
FROM walk w JOIN (SELECT segment, max(i) AS n FROM turns GROUP BY segment) e ON e.segment = w.segment AND e.n = w.i
"""


def walks(costs: Costs):
    """Batches ``conv_id, _segment, _at, initial, gone, cut`` of whole segments, sorted: one row a segment with its ``ways``."""
    opening, move = openings(costs), moves(costs)
    names = ["conv_id", "first_at", "kinds", "ways"]
    way = pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def solve(con, table):
        # Segments of the table, numbered in order of their first row.
        at, conv, segment = (table.column(c).to_pylist() for c in ("_at", "conv_id", "_segment"))
        number, place, firsts, n = [], [], [], 0
        for j in range(len(at)):
            if j == 0 or segment[j] != segment[j - 1] or conv[j] != conv[j - 1]:
                firsts.append(j)
                n = 0
            n += 1
            number.append(len(firsts) - 1)
            place.append(n)
        turns = pa.table({"segment": pa.array(number, pa.int64()), "i": pa.array(place, pa.int64()), **{c: table.column(c) for c in ("initial", "gone", "cut")}})
        con.register("turns", turns)
        found = [[] for _ in firsts]
        for s, *row in con.execute(WALK).fetchall():
            found[s].append(dict(zip(("start", "state", "cost", "audit"), row)))
        con.unregister("turns")
        kinds = table.column("initial").to_pylist()
        kinds = ["".join(kinds[j:e]) for j, e in zip(firsts, [*firsts[1:], len(at)])]
        cells = [[conv[j] for j in firsts], [at[j] for j in firsts], kinds, found]
        types = [table.schema.field("conv_id").type, pa.int64(), pa.string(), pa.list_(way)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    @lean
    def run(batches):
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        con.execute("CREATE TABLE openings (state INT, after INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO openings VALUES (?, ?, ?, ?)", opening)
        con.execute("CREATE TABLE moves (state INT, initial VARCHAR, gone BOOLEAN, cut BOOLEAN, after INT, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?, ?)", move)
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= BATCH_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                conv, segment = table.column("conv_id").to_pylist(), table.column("_segment").to_pylist()
                cut = len(conv) - 1
                while cut and conv[cut - 1] == conv[-1] and segment[cut - 1] == segment[-1]:
                    cut -= 1
                # A segment has few rows, so all but the last one here are whole.
                if cut:
                    yield solve(con, table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(conv) - cut
        if rows:
            yield solve(con, pa.Table.from_batches(held))
        con.close()

    return run


def common(audits: list[str]) -> int:
    """Letters that all begin with (least and most tell for all)."""
    least, most = min(audits), max(audits)
    return next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))


def dealt_back(audit: str, parts: list[tuple[int, str]]):
    """For each segment ``(first_at, kinds)`` its turns' steps.

    A step is one letter for each turn that it puts out: u, a inserted, K the
    kept turn, U, A the turn with a new role; D stands for none.
    """
    at, role = 0, None  # s can only be kept; then u and a take turns
    for k, (first, kinds) in enumerate(parts):
        steps = []
        for initial in kinds:
            step = ""
            while audit[at] == "I":
                role = "a" if role == "u" else "u"
                step, at = step + role, at + 1
            edit, at = audit[at], at + 1
            if edit == "K":
                role = initial
            elif edit == "R":
                role = "a" if role == "u" else "u"
            steps.append(step + (role.upper() if edit == "R" else edit))
        if k == len(parts) - 1:
            for _ in audit[at:]:
                role = "a" if role == "u" else "u"
                steps[-1] += role
        yield first, steps


@lean
def chained(batches):
    """Batches ``conv_id, first_at, kinds, ways``, the segments of a conversation in order: their steps, and with the last the conversation's cost and audit.

    Of the conversation at hand it holds the initials and what its states'
    audits have not in common; what they begin with alike is kept once.
    """
    legal = {"su", "ua", "au"}

    def ended():
        cost, rest = min(states[s] for s in ENDS if s in states)
        audit, kinds = "".join(settled) + rest, "".join(k for _, k in parts)
        illegal = sum(x + y not in legal for x, y in zip(kinds, kinds[1:]))
        found = [(now, first, steps, None, None, None) for first, steps in dealt_back(audit, parts)]
        return [*found[:-1], (*found[-1][:3], illegal, cost, audit)]

    now, parts, settled, states, kind = None, [], [], None, None
    types = lambda: [kind, pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    names = ["conv_id", "first_at", "steps", "illegal", "cost", "audit"]
    for batch in batches:
        kind, out = batch.schema.field("conv_id").type, []
        for row in batch.to_pylist():
            if states is None or row["conv_id"] != now:
                if states is not None:
                    out += ended()
                now, parts, settled, states = row["conv_id"], [], [], {0: (0, "")}
            parts.append((row["first_at"], row["kinds"]))
            after = {}
            for way in row["ways"]:
                if way["start"] in states:
                    cost, audit = states[way["start"]]
                    new = (cost + way["cost"], audit + way["audit"])
                    after[way["state"]] = min(after.get(way["state"], new), new)
            n = common([audit for _, audit in after.values()])
            settled.append(next(iter(after.values()))[1][:n])
            states = {s: (cost, audit[n:]) for s, (cost, audit) in after.items()}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types())], names=names)
    if states is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ended()), types())], names=names)


@dataclass
class Repair:
    """``report``: a row for each conversation.  ``turns``: the repaired turns in order of ``conv_id, at, place``."""

    report: DataFrame
    turns: DataFrame


def repair(spark: SparkSession, conversations: DataFrame, costs: Costs = Costs(), ws: Workspace | None = None) -> Repair:
    """Repairs ``conversations(conv_id, turn, role, text)``; other columns go.

    Turns stand in order of turn (nulls first), then role and text.  Faults,
    of which a turn's first counts: ``blank`` (white space only), ``duplicate``
    (role and text seen earlier), both of which must go, and ``truncated``
    (the last character that is no white space is none of ``. ! ?``), which
    costs more if it stays.  ``report``: conv_id, gaps (turns missing between
    the least and the greatest; nulls do not count), blank, duplicate,
    truncated, illegal (neighbours whose initials are not su, ua, au), cost,
    audit (the cheapest edits' initials; ties: least by ASCII).  ``turns``:
    conv_id, at, place, role, text.

    Null roles and texts count as empty; rows of a null conv_id are one
    conversation; repeated rows are duplicates; very long texts are never
    held together; an empty table gives empty results.  A conversation's
    audit is one value, so it must fit in a row.
    """
    ws = ws or Workspace(spark, "conversation-repair")
    plain = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    rows = in_ranges(plain, ["conv_id", "turn", "role", "text"], ws.save, "rows").withColumn("_segment", F.shiftright("_at", SEGMENT_BITS))

    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.left("role", F.lit(1))
    marks = rows.select(
        "conv_id", "turn", "_segment", "_at", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"), (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"), F.when(trimmed != "", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)).alias("said"),
    )
    firsts = marks.filter("not blank").groupBy("conv_id", "said").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("first"))
    duplicate = ~F.col("blank") & F.col("first").isNull()
    marks = marks.drop("said").join(firsts, "_at", "left").withColumn("duplicate", duplicate).drop("first")
    marks = marks.withColumn("gone", F.col("blank") | F.col("duplicate")).withColumn("cut", F.col("open") & ~F.col("gone")).drop("open")
    marks = ws.save(marks, "marks")

    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    facts = marks.groupBy("conv_id", "turn").agg(count("blank"), count("duplicate"), count("cut"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")
    facts = facts.groupBy("conv_id").agg(gaps, F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("cut").alias("truncated"))

    key = conversations.schema["conv_id"].dataType.simpleString()
    turns = marks.select("conv_id", "_segment", "_at", "initial", "gone", "cut").repartition("conv_id", "_segment").sortWithinPartitions("_at")
    ways = turns.mapInArrow(walks(costs), f"conv_id {key}, first_at long, kinds string, ways array<struct<start:int,state:int,cost:long,audit:string>>")
    plan = ws.save(ways, "ways").repartition("conv_id").sortWithinPartitions("conv_id", "first_at")
    plan = ws.save(plan.mapInArrow(chained, f"conv_id {key}, first_at long, steps array<string>, illegal long, cost long, audit string"), "plan")

    report = null_safe(facts, plan.filter("audit is not null").select("conv_id", "illegal", "cost", "audit"), ["conv_id"])
    report = report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = plan.select("conv_id", F.shiftright("first_at", SEGMENT_BITS).alias("_segment"), "first_at", "steps")
    edited = null_safe(rows, edits, ["conv_id", "_segment"])
    step = F.element_at("steps", (F.col("_at") - F.col("first_at") + 1).cast("int"))
    letters = F.filter(F.split(step, ""), lambda c: ~c.isin("", "D"))
    put = edited.select("conv_id", "role", "text", F.col("_at").alias("at"), F.posexplode(letters).alias("place", "letter"))
    new_role = F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant")
    text = F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("text"))
    return Repair(report, put.select("conv_id", "at", "place", new_role.alias("role"), text.alias("text")))
