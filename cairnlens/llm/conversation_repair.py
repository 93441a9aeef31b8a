"""Repair of damaged conversations by bidirectional Dijkstra over the edit lattice.

A sound conversation has role initials ``(s?(ua)+)?``. Node (i, q) of the lattice
stands for i rows read and state q of that pattern's automaton; Keep, Rerole and
Delete read a row, Insert reads none. A forward and a reverse heap advance from the
first row and from the accepted ends. They go on for as long as their smallest costs
together do not exceed the best meeting, so that every cheapest crossing is finished.
Forward nodes that lead to a crossing are marked, and the least audit (initials of the
edits, D < I < K < R) is read off from the start: each initial leads to one node, and
no cheapest audit is the beginning of another, so the least initial at each node gives
the least audit of all.

Rows are numbered per conversation over chunks of the turn, faults are found by
aggregates. A conversation enters the lattice as a string of two characters a row, the
size of its audit; its texts are never gathered: edits and rows meet in one sorted
stream, which gives the repaired rows or their digest with one row in memory.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens.functions.chunks import prefix_totals
from cairnlens.llm.common import written

SPAN = 1 << 16  # turns that one task numbers
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS = "\\x20\\x09-\\x0D"

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 are accepted.
ACCEPTED = (0, 3)
READS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FOLLOWS = (2, 2, 3, 2)  # the state after a row of the wanted role
WANTED = ("user", "user", "assistant", "user")


def steps(codes: str, i: int, q: int) -> list[tuple[str, int, int, int]]:
    """(initial, i, state, cost) of the edits at node (i, q), by initial.

    ``codes`` holds two characters a row: role initial (x: any but s, u, a) and fault
    (b blank, d duplicate, t truncated, - none).
    """
    out = [("I", i, FOLLOWS[q], INSERT)]
    if 2 * i < len(codes):
        initial, fault = codes[2 * i], codes[2 * i + 1]
        out.insert(0, ("D", i + 1, q, DELETE))
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            if (initial, q) in READS:
                out.append(("K", i + 1, READS[initial, q], KEEP + more))
            out.append(("R", i + 1, FOLLOWS[q], REROLE + more))
    return out


def steps_back(codes: str, i: int, q: int) -> list[tuple[int, int, int]]:
    """(i, state, cost) of the edits that lead to node (i, q)."""
    out = [(i, p, INSERT) for p in range(4) if FOLLOWS[p] == q]
    if i:
        out += [(i - 1, p, cost) for p in range(4) for _, j, t, cost in steps(codes, i - 1, p) if j == i and t == q]
    return out


def cheapest(codes: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones the least audit."""
    n, far = len(codes) // 2, 1 << 60
    ahead, back = {(0, 0): 0}, {(n, q): 0 for q in ACCEPTED}
    done_ahead, done_back = set(), set()
    # Within a cost, rows in reading order: an edit without cost reads a row.
    front, rear = [(0, 0, 0)], [(0, -n, q) for q in ACCEPTED]
    best = 0 if n == 0 else far
    while front and rear and front[0][0] + rear[0][0] <= best:
        if front[0][0] <= rear[0][0]:
            cost, i, q = heapq.heappop(front)
            if (i, q) in done_ahead:
                continue
            done_ahead.add((i, q))
            best = min(best, cost + back.get((i, q), far))
            for _, j, t, more in steps(codes, i, q):
                if cost + more < ahead.get((j, t), far):
                    ahead[j, t] = cost + more
                    heapq.heappush(front, (cost + more, j, t))
        else:
            cost, i, q = heapq.heappop(rear)
            i = -i
            if (i, q) in done_back:
                continue
            done_back.add((i, q))
            best = min(best, cost + ahead.get((i, q), far))
            for j, t, more in steps_back(codes, i, q):
                if cost + more < back.get((j, t), far):
                    back[j, t] = cost + more
                    heapq.heappush(rear, (cost + more, -j, t))

    done_back.update((n, q) for q in ACCEPTED)  # without cost, whether their turn came or not

    def crosses(i: int, q: int) -> bool:
        own = ahead[i, q]
        return ((i, q) in done_back and own + back[i, q] == best) or any(
            (j, t) in done_back and own + more + back[j, t] == best for _, j, t, more in steps(codes, i, q)
        )

    todo = [node for node in done_ahead if crosses(*node)]
    leads = set(todo)
    while todo:
        i, q = todo.pop()
        for j, t, more in steps_back(codes, i, q):
            if (j, t) in done_ahead and (j, t) not in leads and ahead[j, t] + more == ahead[i, q]:
                leads.add((j, t))
                todo.append((j, t))
    audit, i, q, spent = [], 0, 0, 0
    while not (i == n and q in ACCEPTED and spent == best):
        for initial, j, t, more in steps(codes, i, q):
            node, total = (j, t), spent + more
            if (node in done_back and total + back[node] == best) or (node in leads and total == ahead[node]):
                audit.append(initial)
                i, q, spent = j, t, total
                break
    return best, "".join(audit)


def edits(codes: str, audit: str) -> list[tuple[int, int, str, str | None]]:
    """(row it reads or stands before, number, initial, role given) of each edit."""
    out, i, q = [], 0, 0
    for number, initial in enumerate(audit):
        out.append((i, number, initial, WANTED[q] if initial in "IR" else None))
        if initial == "K":
            q = READS[codes[2 * i], q]
        elif initial in "IR":
            q = FOLLOWS[q]
        i += initial != "I"
    return out


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edit = pa.struct([("pos", pa.int64()), ("number", pa.int64()), ("initial", pa.string()), ("role", pa.string())])
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for codes in batch.column("codes").to_pylist():
            initials, faults = codes[::2], codes[1::2]
            cost, audit = cheapest(codes)
            found = edits(codes, audit)
            row = (
                faults.count("b"), faults.count("d"), faults.count("t"),
                sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                [dict(zip(("pos", "number", "initial", "role"), e)) for e in found],
            )
            for column, value in zip(out, row):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(edit)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), *(pa.array(c, k) for c, k in zip(out, kinds))],
            ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "edits"],
        )


def spaced(column: str) -> Column:
    """The column as text; null is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """key, turn, role, text: rows after damage by crc32(``conv_id:turn``) mod 20.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 gives it twice, 4 makes
    it the user's. ``key`` is conv_id as text. Nulls, but those of turn, are one space.
    """
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(
        spaced("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"),
        spaced("text").alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select(
        "key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")
    )


def diagnosed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, turn, role, text) with pos, their number in the conversation by turn
    (nulls first; rows of one turn by role and text), and code: role initial and fault."""
    placed = written(
        prefix_totals(rows.select("key", "turn", "role", "text"), ["key"], "turn", {"pos": F.lit(1)}, ["role", "text"], SPAN),
        "conversation-rows",
    )
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    told = placed.select("key", "pos", same.alias("same"))
    # The first of equal rows, by aggregates: a text that many rows share is no group.
    again = told.groupBy("key", "same").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = told.join(again, ["key", "same"]).where("pos > first").select("key", "pos", F.lit(True).alias("again"))
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), "b").when(F.col("again"), "d")
        .when(~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z"), "t").otherwise("-")
    )
    return placed.join(again, ["key", "pos"], "left").select(
        "key", "pos", "turn", "role", "text",
        F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("code"),
    )


def plans(rows: DataFrame) -> DataFrame:
    """key, blank, duplicate, truncated, illegal, cost, audit, edits: one row for each
    conversation of the diagnosed rows."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "code")))
    codes = rows.select("key", "pos", "code").groupBy("key").agg(F.array_join(F.transform(ordered, lambda r: r["code"]), "").alias("codes"))
    return codes.mapInArrow(
        _plans, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
        " edits array<struct<pos: long, number: long, initial: string, role: string>>",
    )


def _streamed(digest: bool):
    """Edits and rows of a sorted partition -> repaired rows, or one digest a conversation."""

    def repaired(batches):
        key = edit = None
        n = 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "kind", "initial", "role", "text"))
            for own, kind, initial, role, text in zip(*columns):
                if own != key:
                    key, n = own, 0
                if kind == 1:
                    edit = (initial, role)
                    continue
                if kind == 0:
                    yield key, n, role, "", "I"
                elif edit[0] != "D":
                    yield key, n, role if edit[0] == "K" else edit[1], text, edit[0]
                else:
                    continue
                n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not digest:
            part = []
            for row in repaired(batches):
                part.append(row)
                if len(part) == 10_000:
                    yield _batch(part)
                    part = []
            if part:
                yield _batch(part)
            return
        found: list[tuple[str, str]] = []
        key, total = None, None
        for own, n, role, text, _ in repaired(batches):
            if own != key:
                if key is not None:
                    found.append((key, total.hexdigest()))
                key, total = own, hashlib.sha256()
            total.update((("\n" if n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        if key is not None:
            found.append((key, total.hexdigest()))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], ["key", "repaired_sha256"])

    def _batch(part):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*part), kinds)], ["key", "n", "role", "text", "initial"]
        )

    return run


def repaired(rows: DataFrame, plan: DataFrame, digest: bool = False) -> DataFrame:
    """key, n, role, text, initial of the repaired conversations; with ``digest``, key and
    repaired_sha256 of ``role:text`` joined by newlines (conversations with a row left)."""
    edit = plan.select("key", F.explode("edits").alias("e")).select(
        "key", "e.pos", F.when(F.col("e.initial") == "I", 0).otherwise(1).alias("kind"), "e.number",
        "e.initial", "e.role", F.lit(None).cast("string").alias("text"),
    )
    text = rows.select("key", "pos", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("number"),
                       F.lit(None).cast("string").alias("initial"), "role", "text")
    stream = edit.unionByName(text).repartition("key").sortWithinPartitions("key", "pos", "kind", "number")
    schema = "key string, repaired_sha256 string" if digest else "key string, n long, role string, text string, initial string"
    return stream.mapInArrow(_streamed(digest), schema)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, n, role, text, initial: the repaired rows of conversations as they are given.

    Null conversation ids are one conversation; null roles and texts count as one
    space. Role initials other than s, u and a, and empty roles, can only be given a
    new role or deleted. Rows of one turn stand in the order of role and text, equal
    rows are duplicates; an empty table gives no rows. A conversation's texts may be
    of any size; of its rows two characters each are held at once, besides its part of
    the lattice. Further columns are not read.
    """
    rows = diagnosed(conversations.select(
        spaced("conv_id").alias("key"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")
    ))
    fixed = repaired(rows, plans(rows))
    ids = conversations.select("conv_id", spaced("conv_id").alias("key")).distinct()
    return ids.join(fixed, "key").drop("key")


def audited(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``, whose rows are damaged first:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turns that are missing between the smallest and the largest one, nulls
    ignored. A conversation without rows after damage has zeros, an empty audit and
    the digest of an empty text. Edge cases as in ``repair``.
    """
    rows = written(diagnosed(damaged(conversations)), "conversation-faults")
    plan = written(plans(rows), "conversation-plans")
    turns = rows.where("turn IS NOT NULL").select("key", "turn").distinct().groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    ids = conversations.select("conv_id", spaced("conv_id").alias("key")).distinct()
    every = ids.join(turns, "key", "left").join(plan.drop("edits"), "key", "left").join(repaired(rows, plan, digest=True), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
