import hashlib
import heapq
import itertools
import random
import re
import zlib

from barograph.llm import conversation_repair as cr

NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
BLANKS = " \t\n\x0b\f\r"


def cheapest(signs):
    """(cost, labels, kept (row or None, new initial)) by a plain search over whole label strings."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, labels, i, q, kept = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(signs) and q in (0, 3):
            return cost, labels, kept
        for c, to in NEXT[q].items():
            if c != "s":
                heapq.heappush(heap, (cost + 2, labels + "I", i, to, (*kept, (-1, c))))
        if i < len(signs):
            heapq.heappush(heap, (cost + 3, labels + "D", i + 1, q, kept))
            if signs[i][0] != "x":
                more = signs[i][0] == "t"
                for c, to in NEXT[q].items():
                    if signs[i][1:] == c:
                        heapq.heappush(heap, (cost + more, labels + "K", i + 1, to, (*kept, (i, ""))))
                    if c != "s":
                        heapq.heappush(heap, (cost + 2 + more, labels + "R", i + 1, to, (*kept, (i, c))))


def judged(rows):
    """Columns of op12 from the rows (turn, role, text) of a conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    n, signs, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], set()
    for _, role, text in rows:
        bare = text.rstrip(BLANKS)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        signs.append(("x" if fault in ("blank", "duplicate") else "t" if fault else "-") + role[:1])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1:] + b[1:] not in ("su", "ua", "au") for a, b in zip(signs, signs[1:], strict=False))
    cost, audit, kept = cheapest(signs)
    said = [f"{ {'u': 'user', 'a': 'assistant', '': rows[i][1]}[c] }:{rows[i][2] if i >= 0 else ''}" for i, c in kept]
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def want_of(rows):
    by = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows):
        by[conv].append(tuple(rest))
    return {conv: judged(x) for conv, x in by.items()}


def written(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in cr.op12_conversation_repair(spark, sf).collect()]
    assert {r[0]: r[1:] for r in got} == want_of(rows) and len(got) == len({r[0] for r in rows})


def test_long_conversations_over_several_parts(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for conv, n in ((7, 1500), (None, 400), (8, 3), (9, 700), (10, 1)):
        for _ in range(n):
            text = draw.choice(["Yes.", "no", "", None, "A!\n", "x? ", f"Number {draw.randrange(400)}.", f"open {draw.randrange(400)}"])
            rows.append((conv, draw.choice([None, *range(900)]), draw.choice(["user", "assistant", "system", "tool", None, ""]), text))
    got = written(spark, tmp_path, rows)
    assert got == want_of(rows) and len(got[7][6]) > 1400
    parts = cr.in_order(cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "conv_id", "turn", "role", "text")
    assert parts.where("conv = 7").select("part").distinct().count() > 1


def test_edge_cases(spark, tmp_path):
    draw = random.Random(4)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), draw.choice(["Hi.", "so", "Well?"])) for c in range(300) for t in range(draw.randint(1, 5))]
    rows += [(None, None, None, None), (None, 1, "user", "Same."), (None, 1, "user", "Same."), (1000, 5, "User", "x" * 200_000 + "."), (1001, None, "user", " ")]
    got = written(spark, tmp_path, rows)
    want = want_of(rows)
    assert got == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()  # nothing is left after damage
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(empty).count() == 0
    other = spark.createDataFrame([("c", 1, "user", "Hi.", 5, "z")], "conv string, turn int, role string, text string, at int, fault string")
    assert [(r.conv, r.edit, r.role, r.text) for r in cr.repair(other, conv_col="conv").orderBy("at", "nth").collect()] == [("c", "K", "user", "Hi."), ("c", "I", "assistant", "")]


def test_every_short_sequence():
    signs = ["-s", "-u", "-a", "-t", "ts", "tu", "ta", "xu", "x"]
    for n in range(5):
        for seq in itertools.product(signs, repeat=n) if n < 4 else random.Random(1).sample(list(itertools.product(signs, repeat=4)), 2000):
            if n:
                assert "".join(x for x, _ in cr.walk(seq, None, 0)[0]) == cheapest(seq)[1], seq
