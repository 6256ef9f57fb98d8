import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import types as T

from detframe.llm import conversations as talk

ROWS = T.StructType([T.StructField("audit", T.StringType()), T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])
GRAMMAR = re.compile(r"(s?(ua)+)?")
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def best_edits(rows, start=""):
    """Cheapest first, then least letters: every sequence of edits in that order until one gives legal roles."""
    heap = [(0, "", 0, ())]
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in made)
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)
        if made and not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, made))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, (*made, (new, text))))


def brute(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        named = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(":".join(named).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = {r[0] for r in rows if r[0] is not None}
        marked = faults([r[1:] for r in rows])
        kinds = [f for _, _, f in marked]
        initials = [r[1][:1] for r in rows]
        cost, audit, text = best_edits(marked)
        out[conv] = (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, SHA(text))
    return out


def test_cheapest_edits_match_search():
    rng = random.Random(4)
    for _ in range(250):
        rows = [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), str(rng.randrange(3)), rng.choice(["", "", "", "blank", "truncated"]))
                for _ in range(rng.randrange(8))]
        codes = bytes(talk.INITIALS.get(r[:1], 0) + {"": 0, "blank": talk.MUST_GO, "truncated": talk.CUT_OFF}[f] for r, _, f in rows)
        expected = best_edits(rows)[:2]
        assert talk.cheapest(codes) == expected
        small, talk.BLOCK_ROWS = talk.BLOCK_ROWS, rng.randrange(1, 4)
        assert talk.cheapest(codes) == expected, "blocks change nothing"
        talk.BLOCK_ROWS = small


def test_inserts_are_taken_where_they_are_cheap(monkeypatch):
    monkeypatch.setattr(talk, "INSERT", 1)
    monkeypatch.setattr(talk, "DELETE", 3)
    monkeypatch.setattr(talk, "REROLE", 4)
    talk._block.cache_clear()
    for size in (1, 2, 64):
        monkeypatch.setattr(talk, "BLOCK_ROWS", size)
        assert talk.cheapest(bytes([2])) == (1, "KI") and talk.cheapest(bytes([3])) == (1, "IK") and talk.cheapest(bytes([1])) == (2, "KII")
        assert talk.cheapest(bytes([2, 2, 3])) == (1, "KIKK")
    talk._block.cache_clear()


def test_long_conversations_stay_linear():
    codes = bytes([2, 3, 3, 0, 2 + talk.CUT_OFF] * 60_000)
    cost, audit = talk.cheapest(codes)
    assert len(audit) == 300_000 and cost == talk.cheapest(codes[:50])[0] * 6000


def run(spark, table):
    frame = spark.createDataFrame([("x", c, t, r, x, "y") for c, t, r, x in table], ROWS)
    return {r.conv_id: tuple(r) for r in talk.repaired(frame).collect()}


def expected(table):
    found = brute(table)
    return {c: found.get(c) or (c, 0, 0, 0, 0, 0, 0, "", SHA("")) for c in {r[0] for r in table}}


def test_random_conversations_match_brute_force(spark):
    rng = random.Random(8)
    table = [(c, rng.choice([None, *range(9)]) if c % 3 == 0 else t, rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"]),
              rng.choice(["Yes.", "No!", "no end", " ", None, "é", "Fine.\n", "a\x0b"])) for c in range(300) for t in range(rng.randrange(1, 6))]
    table += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 2, "assistant", "Ho.")] + [(7, 3, "user", "Yes.")] * 3
    got, want = run(spark, table), expected(table)
    wrong = [(got.get(c), want[c]) for c in want if got.get(c) != want[c]]
    assert not wrong, "\n".join(f"{a}\n{b}" for a, b in wrong[:4])
    assert len(got) == len(want)


def test_given_conversations_match_brute_force(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = run(spark, table)
    assert got == expected(table) and len(got) > 90


def test_empty_hot_and_long(spark):
    assert run(spark, []) == {}
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")])[gone] == (gone, 0, 0, 0, 0, 0, 0, "", SHA(""))
    copies = [(5, 1, "user", "Hi.")] * 3000 + [(5, 2, "assistant", "x" * 2_000_000 + ".")]
    row = run(spark, copies)[5]
    n = len(row[7])
    assert row[3] == n - row[7].count("K") - row[7].count("R") - row[4] * row[7].endswith("D") and set(row[7]) <= set("DKR") and n > 2000
