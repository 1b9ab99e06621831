"""Repair of conversation structure as a lightest derivation (Knuth's generalisation of Dijkstra).

A conversation must read, by the initials of its roles, as `(s?(ua)+)?`: an
optional system turn, then user and assistant alternating, ending on an
assistant turn. Its rows are read in order, and an item is (rows consumed,
place in that pattern). Deductions turn an item into another by one edit:

* Keep a row whose role fits (cost 0, `K`);
* Rerole it to the user or assistant that fits (1, `R`);
* Delete it (2, `D`); blank and duplicate rows can only be deleted;
* Insert an empty user or assistant turn without consuming a row (5, `I`);

and a kept or rerolled truncated row costs 5 more. Every deduction maps the
value (cost, audit) of its one antecedent to (cost + w, audit + letter), a
superior function in the order of cost, then audit; so the agenda pops items
in order of their final values, and the goal item (all rows consumed, the
pattern complete) is final when it is popped. Between two paths of equal cost
into one item neither audit is a prefix of the other (that would take a
row-free suffix, which costs), so extending keeps their order and the least
audit is found exactly. Audits are nodes of a shared trie, so the agenda holds
no copies of long strings.

Spark's part: the damage of rows and the grouping by conversation; the search
runs per conversation in applyInPandas. A conversation is one task and one
output row whose audit and text grow with it, so its size bounds a task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the result contract: edit costs, the added cost of a truncated row, the damage cycle.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
DAMAGE_CYCLE = 20
ROLE = {"u": "user", "a": "assistant"}
# Places in (s?(ua)+)?: 0 start, 1 after s, 2 after u, 3 after a (complete).
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
COMPLETE = (0, 3)
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
ENDS = ".!?"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"


def damage_code(conv_id, turn) -> int:
    """crc32 of `conv_id:turn` (null: one space) modulo the cycle, as the damage rule reads it."""
    key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
    return zlib.crc32(key.encode()) % DAMAGE_CYCLE


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage, with `copies` 0 (dropped), 1 or 2; nulls in role and text read as one space.

    Code 0 drops the row (it stays with copies 0, so its conversation is still
    returned), 1 empties the text, 2 removes `.`, `!` and `?`, 3 repeats the
    row next to itself, 4 makes the role `user`. Other columns are not read.
    """
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    code = F.crc32(key) % DAMAGE_CYCLE
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(code == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(code == 1, F.lit("")).when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"),
    )


def fault(text: str, seen: bool) -> str:
    """The first fault of a row: blank, duplicate, truncated, or '' for none."""
    visible = VISIBLE.findall(text)
    if not visible:
        return "blank"
    if seen:
        return "duplicate"
    return "truncated" if visible[-1] not in ENDS else ""


class Audit:
    """A node of the audit trie: the letters from the root to here; compared as strings."""

    __slots__ = ("parent", "letter", "depth")

    def __init__(self, parent: Audit | None, letter: str) -> None:
        self.parent, self.letter = parent, letter
        self.depth = 0 if parent is None else parent.depth + 1

    def __lt__(self, other: Audit) -> bool:
        a, b = self, other
        if a is b:
            return False
        # Lift the deeper side; a prefix is less than its extensions.
        da, db = a.depth, b.depth
        while da > db:
            a, da = a.parent, da - 1
        while db > da:
            b, db = b.parent, db - 1
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = a.parent, b.parent
        return a.letter < b.letter

    def text(self) -> str:
        out, node = [], self
        while node.parent is not None:
            out.append(node.letter)
            node = node.parent
        return "".join(reversed(out))


def lightest_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """(cost, audit, repaired lines) of the cheapest repair of rows (role, text, fault), ties by least audit.

    The goal is deduced from any complete item with all rows consumed by the
    identity, so it is final as soon as the first such item is popped.
    """
    n = len(rows)
    root = Audit(None, "")
    best: dict = {(0, 0): (0, root)}
    back: dict = {}
    final: set = set()
    agenda = [(0, root, 0, (0, 0))]
    pushed = 1

    def derive(item, cost, audit, letter, source, edit) -> None:
        nonlocal pushed
        if item in final:
            return
        node = Audit(audit, letter)
        old = best.get(item)
        if old is not None and not (cost < old[0] or (cost == old[0] and node < old[1])):
            return
        best[item] = (cost, node)
        back[item] = (source, edit)
        heapq.heappush(agenda, (cost, node, pushed, item))
        pushed += 1

    goal = None
    while agenda:
        cost, audit, _, item = heapq.heappop(agenda)
        if item in final or best[item][1] is not audit:
            continue
        final.add(item)
        i, q = item
        if i == n and q in COMPLETE:
            goal = item
            break
        for r in "ua":
            if (q, r) in STEP:
                derive((i, STEP[q, r]), cost + INSERT, audit, "I", item, ("I", r))
        if i < n:
            role, _, why = rows[i]
            derive((i + 1, q), cost + DELETE, audit, "D", item, ("D", None))
            if why not in ("blank", "duplicate"):
                extra = TRUNCATED if why == "truncated" else 0
                if (q, role[:1]) in STEP:
                    derive((i + 1, STEP[q, role[:1]]), cost + KEEP + extra, audit, "K", item, ("K", None))
                for r in "ua":
                    if (q, r) in STEP and r != role[:1]:
                        derive((i + 1, STEP[q, r]), cost + REROLE + extra, audit, "R", item, ("R", r))
    # Deleting every row always completes the pattern, so the goal is reached.
    cost, audit = best[goal]
    edits, item = [], goal
    while item in back:
        source, edit = back[item]
        edits.append((source, edit))
        item = source
    lines = []
    for (i, _), (letter, r) in reversed(edits):
        if letter == "I":
            lines.append(f"{ROLE[r]}:")
        elif letter == "K":
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        elif letter == "R":
            lines.append(f"{ROLE[r]}:{rows[i][1]}")
    return cost, audit.text(), lines


def _ordered(frame: pd.DataFrame) -> list[tuple]:
    """Rows after damage in conversation order: turn (nulls first), role, text, then the copy."""
    out = []
    for row in frame.itertuples(index=False):
        out.extend([(row.turn, row.role, row.text)] * int(row.copies))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1], r[2]))


def repaired_conversation(conv_id, frame: pd.DataFrame) -> dict:
    """The result row of one conversation; no rows after damage give zeros, an empty audit and sha256('')."""
    rows = _ordered(frame)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faulted, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        why = fault(text, (role, text) in seen)
        seen.add((role, text))
        faulted.append((role, text, why))
        if why:
            counts[why] += 1
    initials = [role[:1] for role, _, _ in faulted]
    illegal = sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b not in ("su", "ua", "au"))
    cost, audit, lines = lightest_repair(faulted)
    return {
        "conv_id": conv_id,
        "gaps": int(gaps),
        **counts,
        "illegal": illegal,
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        "n_rows": len(rows),
    }


def _repair(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    conv_id = key[0]
    frame = frame.astype(object).where(frame.notna(), None)
    row = repaired_conversation(None if conv_id is None or pd.isna(conv_id) else int(conv_id), frame)
    return pd.DataFrame([row]).astype({"conv_id": "Int64"})


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conversation id of the input (null id: one group), after damage and the cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs),
    audit, repaired_sha256, n_rows (rows after damage). Empty input: no rows.
    """
    return damaged(conversations).groupBy("conv_id").applyInPandas(_repair, RESULT)
