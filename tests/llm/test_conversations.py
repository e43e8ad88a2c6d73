"""Conversation repair against a brute force over all edits, whole and in chunks."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from marketloom.llm import conversations as C
from marketloom.llm import queries

SMALL = "/root/testdata/sf0.001"
WANT = re.compile(r"(s?(ua)+)?")


def first_faults(rows):
    """(role, text) -> first fault of each row."""
    seen, out = [], []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
        seen.append((role, text))
    return out


def brute_repair(rows):
    """Every choice of edits, up to one insert in each gap: (cost, audit, lines) that is least."""
    found, best = first_faults(rows), None
    gaps = [("", "user", "assistant")] * (len(rows) + 1)
    edits = [["D"] if f in ("b", "d") else ["D", "K", "Ruser", "Rassistant"] for f in found]
    for inserted in product(*gaps):
        if sum(map(bool, inserted)) > 2:
            continue
        for chosen in product(*edits):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(rows) + 1):
                if inserted[k]:
                    cost, audit, roles = cost + 5, audit + "I", roles + inserted[k][0]
                    lines.append(inserted[k] + ":")
                if k < len(rows):
                    (role, text), e = rows[k], chosen[k]
                    audit += e[0]
                    cost += {"D": 2, "K": 0, "R": 1}[e[0]] + (5 if e != "D" and found[k] == "t" else 0)
                    if e != "D":
                        role = role if e == "K" else e[1:]
                        roles += role[:1] or "?"
                        lines.append(f"{role}:{text}")
            if WANT.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def by_plain_dp(rows):
    """(cost, audit, lines) as a tuple minimum over (cost, letters), one state at a time from the end; one insert a gap."""
    role_of, after = ["user", "user", "assistant", "user"], [2, 2, 3, 2]
    found = first_faults(rows)

    def inserted(best):
        return [min([b for b in (best[s], best[after[s]] and (best[after[s]][0] + 5, "I" + best[after[s]][1], [role_of[s] + ":", *best[after[s]][2]])) if b], default=None) for s in range(4)]

    best = inserted([(0, "", []), None, None, (0, "", [])])
    for (role, text), fault in zip(rows[::-1], found[::-1]):
        now = []
        for s in range(4):
            options = []
            add = lambda b, cost, letter, line: b and options.append((b[0] + cost, letter + b[1], line + b[2]))
            add(best[s], 2, "D", [])
            if fault not in ("b", "d"):
                extra = 5 if fault == "t" else 0
                if role[:1] == role_of[s][0]:
                    add(best[after[s]], extra, "K", [f"{role}:{text}"])
                if role[:1] == "s" and s == 0:
                    add(best[1], extra, "K", [f"{role}:{text}"])
                add(best[after[s]], 1 + extra, "R", [f"{role_of[s]}:{text}"])
            now.append(min(options, default=None))
        best = inserted(now)
    return best[0]


def expected(rows, repair=by_plain_dp):
    """(turn, role, text) in order -> the contract's columns after conv_id."""
    pairs = [(r, t) for _, r, t in rows]
    found, turns = first_faults(pairs), {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    cost, audit, lines = repair(pairs)
    return gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows):
    """conv -> rows after damage in order, by plain Python; a tie of turns goes by role."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for c, r in out.items()}


def values(r):
    return (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)


def test_small_conversations_by_all_edits():
    rnd = random.Random(5)
    for _ in range(120):
        rows = [(k, rnd.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]), rnd.choice(["a.", "b?", "c", "", "d!"])) for k in range(rnd.randint(0, 4))]
        own = C.solved(rows)
        assert own[5:7] == brute_repair([r[1:] for r in rows])[:2] == by_plain_dp([r[1:] for r in rows])[:2], rows
        assert own[:7] + own[8:] == expected(rows), rows


def test_integer_weights_order_as_cost_then_letters():
    w = C._Weights(6)
    paths = {}
    for cost, audit in [(3, "KD"), (3, "K"), (2, "RRRR"), (3, "KI"), (2, "RRRRD")]:
        weight = 0
        for k, letter in enumerate(reversed(audit)):
            found = {}
            w.put(found, {k: weight}, letter, cost if k == len(audit) - 1 else 0)
            weight = found[k + 1]
        paths[cost, audit] = weight
        assert w.read(weight) == (cost, audit)
    assert sorted(paths, key=paths.get) == sorted(paths)


@pytest.mark.parametrize("chunk", [1024, 3])
def test_damaged_table_against_plain_python(spark, chunk, monkeypatch):
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    got = {r.conv_id: values(r) for r in queries.op12_conversation_repair(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert {c: expected(r) for c, r in want.items()} == got
    assert any(g[0] for g in got.values()) and any("R" in g[6] for g in got.values())


def test_odd_rows_and_a_hot_conversation(spark, monkeypatch):
    rnd = random.Random(9)
    hot = [(7, k // 2, rnd.choice(["user", "assistant", "system"]), rnd.choice(["yes.", "no", f"row {k}.", " "])) for k in range(600)]
    odd = [
        (1, None, None, None), (1, None, "user", "x."), (1, 3, "assistant", "y."), (2, 0, "", "no role."), (2, 1, "user", "q?"), (2, 1, "user", "q?"),
        (None, 0, "user", "null id."), (None, 1, "assistant", "null id!"), (3, 5, "system", "alone."), (4, 0, "user", "w " * 50_000), (4, 1, "assistant", "　."),
    ]
    table = spark.createDataFrame([(*r, 1, "z") for r in odd + hot], "conv_id long, turn long, role string, text string, seq int, Rows string").repartition(5)
    rows = {}
    for r in table.collect():
        own = (r.turn, " " if r.role is None else r.role, " " if r.text is None else r.text)
        rows.setdefault(r.conv_id, []).append(own)
    for chunk in (1024, 16, 1):
        monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
        got = {r.conv_id: r for r in C.repair(table).collect()}
        assert got.keys() == rows.keys()
        for conv, own in rows.items():
            if conv == 7:  # ties of a turn go by role, then by a hash; take the order from the table itself
                marks = {(r.turn, r.role, r.text): r.m for r in table.where("conv_id = 7").selectExpr("turn", "role", "text", "xxhash64(text) m").collect()}
                own = sorted(own, key=lambda x: (x[0], x[1], marks[x]))
            else:
                own = sorted(own, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
            assert values(got[conv]) == expected(own), (conv, chunk)
            assert hashlib.sha256(got[conv].repaired.encode()).hexdigest() == got[conv].repaired_sha256
    assert C.repair(table.where("false")).count() == 0
    gone = C.repair(spark.createDataFrame([(9, 1, "user", "x.", True)], "conv_id long, turn long, role string, text string, gone boolean"), absent_col="gone").collect()
    assert values(gone[0]) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
