from __future__ import annotations

import hashlib
import itertools
import random

import pytest

from shotmetrics.llm import repair

STEP, COMPLETE = repair.STEP, repair.COMPLETE


def brute(rows):
    """Least (cost, audit, lines) over every edit sequence with at most two inserts in a row."""
    best = None

    def go(i, q, cost, audit, lines, run):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and q in COMPLETE:
            cand = (cost, audit, lines)
            if best is None or cand[:2] < best[:2]:
                best = cand
        if run < 2:
            for r in "ua":
                if (q, r) in STEP:
                    go(i, STEP[q, r], cost + 5, audit + "I", [*lines, f"{repair.ROLE[r]}:"], run + 1)
        if i < len(rows):
            role, text, why = rows[i]
            go(i + 1, q, cost + 2, audit + "D", lines, 0)
            if why in ("blank", "duplicate"):
                return
            extra = 5 if why == "truncated" else 0
            if (q, role[:1]) in STEP:
                go(i + 1, STEP[q, role[:1]], cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0)
            for r in "ua":
                if (q, r) in STEP and r != role[:1]:
                    go(i + 1, STEP[q, r], cost + 1 + extra, audit + "R", [*lines, f"{repair.ROLE[r]}:{text}"], 0)

    go(0, 0, 0, "", [], 0)
    return best


ROLES = ["user", "assistant", "system", " ", "tool"]
TEXTS = ["Hi.", "ok", "", "  ", "Why?", "Hi."]


def test_search_equals_brute_force_on_random_conversations():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randint(0, 6)
        rows, seen = [], set()
        for _ in range(n):
            role, text = rng.choice(ROLES), rng.choice(TEXTS)
            rows.append((role, text, repair.fault(text, (role, text) in seen)))
            seen.add((role, text))
        assert repair.lightest_repair(rows) == brute(rows), rows


def test_faults_come_in_order():
    assert repair.fault(" \t", True) == "blank"
    assert repair.fault("Same.", True) == "duplicate"
    assert repair.fault("no end  ", False) == "truncated"
    assert repair.fault("done!  \n", False) == ""


def test_empty_and_already_legal():
    assert repair.lightest_repair([]) == (0, "", [])
    rows = [("system", "Be kind.", ""), ("user", "Hi.", ""), ("assistant", "Hello.", "")]
    assert repair.lightest_repair(rows) == (0, "KKK", ["system:Be kind.", "user:Hi.", "assistant:Hello."])


def _conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string, audit string")


def test_query_rows_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 0, "user", "Hi.", "x", "y"), (1, 1, "assistant", "Hello.", None, None), (1, 1, "assistant", "Hello.", None, None)]
    rows += [(2, None, None, None, None, None), (2, 5, "user", "Where", None, None), (None, 3, "user", "Q?", None, None)]
    rows += [(3, 7, "assistant", "A.", None, None)]
    got = {r.conv_id: r for r in repair.repaired(_conversations(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = [x for x in rows if x[0] == conv]
        kept = []
        for c, t, role, text, *_ in mine:
            code = repair.damage_code(c, t)
            role, text = role if role is not None else " ", text if text is not None else " "
            if code == 0:
                continue
            text = "" if code == 1 else text.translate(str.maketrans("", "", ".!?")) if code == 2 else text
            role = "user" if code == 4 else role
            kept += [(t, role, text)] * (2 if code == 3 else 1)
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faulted = set(), []
        for _, role, text in kept:
            faulted.append((role, text, repair.fault(text, (role, text) in seen)))
            seen.add((role, text))
        cost, audit, lines = brute(faulted)
        assert (r.cost, r.audit, r.n_rows) == (cost, audit, len(kept))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        turns = {t for t, *_ in kept if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_no_rows_after_damage(spark):
    dropped = next((c, t) for c, t in itertools.product(range(50), range(50)) if repair.damage_code(c, t) == 0)
    got = repair.repaired(_conversations(spark, [(*dropped, "user", "Hi.", None, None)])).collect()
    assert [(r.cost, r.audit, r.n_rows, r.gaps, r.repaired_sha256) for r in got] == [(0, "", 0, 0, hashlib.sha256(b"").hexdigest())]
    assert repair.repaired(_conversations(spark, [])).count() == 0


@pytest.mark.parametrize("n", [2000])
def test_long_conversation_finishes(n):
    rows = [("user" if i % 3 else "assistant", f"t{i}", "truncated") for i in range(n)]
    cost, audit, lines = repair.lightest_repair(rows)
    assert len(audit) >= n and cost > 0
