"""Conversation repair against a plain search over all edits, and its edge cases."""

import hashlib
import heapq
import re
import zlib

import pytest

from kinloom.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def plain(rows):
    """The contract's result of one conversation's rows, by uniform-cost search over audit strings."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for r, _ in rows]
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, path, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", path):
            break
        # The grammar's future depends only on whether something was said, and on the last initial.
        if (i, path[-1:]) in done:
            continue
        done.add((i, path[-1:]))

        def go(more, letter, step, role=None, text=""):
            new = path + (role[:1] if role else "")
            if not role or re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + more, audit + letter, i + step, new, (*out, f"{role}:{text}") if role else out))

        for role in ("user", "assistant"):
            go(5, "I", 0, role)
        if i < len(rows):
            role, text = rows[i]
            go(2, "D", 1)
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role:
                    go(more, "K", 1, role, text)
                for new in ("user", "assistant"):
                    go(1 + more, "R", 1, new, text)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def contract(table):
    """(conv_id, turn, role, text) rows to the query's rows."""
    convs = {}
    for conv, turn, role, text in table:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in rows if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *plain([r[1:] for r in rows]))
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def run(spark, table, tmp_path, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(table, schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    rows = cr.query(spark, str(tmp_path)).collect()
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = cr.query(spark, d).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == contract(table)


def test_edges(spark, tmp_path):
    long = "word " * 200_000 + "end."
    table = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."),
        (1, None, "system", "S."), (1, 0, "user", "A?"), (1, 0, "user", "A?"), (1, 9, "assistant", long), (1, 9, "assistant", ""),
        (2, 5, "", "No role."), (2, 6, "tool", "x"), (2, 7, "user", "no end"), (2, 8, "assistant", "Fine! \t"),
        (3, 1, None, "Only."), (4, None, "user", "U."), (4, None, "user", "U."),
    ] + [(5, t, "user" if t % 2 == 0 else "assistant", f"Text {t % 7}.") for t in range(300)]
    for k in range(6, 60):  # some of these lose all their rows
        table.append((k, 1, "assistant", "Alone."))
    assert run(spark, table, tmp_path) == contract(table)
    assert any(v[6] == "" and v[7] == hashlib.sha256(b"").hexdigest() for v in contract(table).values())


def test_random(spark, tmp_path):
    import random

    rng = random.Random(5)
    texts = ["Yes.", "No!", "cut", "", " \n", "Why?", "a.b"]
    table = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(texts)) for c in range(200) for _ in range(rng.randrange(1, 9))]
    assert run(spark, table, tmp_path) == contract(table)


def test_empty_and_clashing(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 5, 6), (1, 2, "assistant", "Ho.", 5, 6)], "conv_id long, turn long, role string, text string, at int, CONV int")
    audits, messages = cr.repair(rows)
    assert audits.first()["audit"] == "KK"
    assert sorted(tuple(r) for r in messages.collect()) == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]


def test_one_conversation_in_many_runs(spark, monkeypatch):
    """A conversation of more messages than one run holds has the audit of its rows in order."""
    n = 3 * cr.RUN + 17
    rows = spark.range(n).selectExpr("'x' as conv_id", "id as turn", "case when id % 3 = 0 then 'user' else 'assistant' end as role", "concat('m', id, case when id % 5 = 0 then '' else '.' end) as text")
    audits, messages = cr.repair(rows)
    row = audits.first()
    codes = bytes(4 * (1 if i % 3 == 0 else 2) + (cr.CUT if i % 5 == 0 else cr.SOUND) for i in range(n))
    assert (row["cost"], row["audit"]) == cr.audit(codes)
    assert messages.count() == len(row["audit"]) - row["audit"].count("D")


@pytest.mark.parametrize("codes, want", [(b"", (0, "")), (bytes([4, 8]), (0, "KK")), (bytes([8]), (2, "D")), (bytes([4, 4]), (1, "KR")), (bytes([0]), (2, "D")), (bytes([0, 4, 8]), (0, "KKK"))])
def test_small(codes, want):
    assert cr.audit(codes) == want
