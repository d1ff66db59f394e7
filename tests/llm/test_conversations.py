"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopgroups.llm.conversations import Repair, damaged, op12_conversations, repair_conversations, repaired_turns, walk

GOAL = re.compile(r"(s?(ua)+)?\Z")
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults_of(rows):
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows): edits in order of (cost, audit), until the roles are right."""
    faults = faults_of(rows)
    heap, done, n = [(0, "", 0, ())], set(), 0
    while heap:
        cost, audit, i, kept = heapq.heappop(heap)
        roles = "".join(r[:1] if r[:1] in "sua" and r else "?" for r, _ in kept)
        # what matters of the rows so far is the last role and whether there is any
        key = (i, roles[-1:], len(kept) > 0, bool(re.fullmatch(r"(s?(ua)*u?)?", roles)))
        if not key[3]:
            continue
        if i == len(rows) and GOAL.match(roles):
            return cost, audit, kept
        if key in done:
            continue
        done.add(key)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", i, kept + ((role, ""),)))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, kept))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, kept + ((role, text),)))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, kept + ((new, text),)))
        n += 1


def by_hand(conv, rows):
    """rows: (turn, role, text) in order."""
    faults = faults_of(rows)
    cost, audit, kept = cheapest(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256(text.encode()).hexdigest()), kept


ROLE = st.sampled_from(["user", "assistant", "system", "tool", "", "usher", "User"])
TEXT = st.sampled_from(["Yes.", "no", "Why? ", " ", "", "\t\n", "a.b", "Ha!", "Well. ", "end."])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=9))
def test_streamed_states_match_the_search(rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    repair = Repair()
    for (turn, role, text), fault in zip(rows, faults_of(rows)):
        repair.add(turn, role, text, fault)
    done = repair.end()
    want, _ = by_hand(1, rows)
    letters, state = walk(repair.back, done["state"])
    assert state == 0
    got = (1, *(done[n] for n in NAMES[1:7]), letters + done["tail"], done["repaired_sha256"])
    assert got == want


def table(spark, rows):
    """(conv_id, turn, role, text) and columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows],
                                 "conv_id long, turn long, role string, text string, conv string, copies int, seen int, audit int")


def conversations():
    """A third of all rows in one conversation, ids and turns that are null, repeated rows and turns, long texts."""
    rows = [(1, t, ["user", "assistant"][(t + t // 9) % 2], f"Line {t % 37}{'.' if t % 5 else ''}") for t in range(150)]
    rows += [(2 + c, t * 3, ["system", "user", "assistant"][(t + c) % 3], f"Say {c} {t}.") for c in range(20) for t in range(c % 8)]
    rows += [(None, None, "user", "Hello."), (None, 3, None, "Hm."), (None, None, "assistant", None), (None, 3, "user", "A.")]
    rows += [(90, 1, "user", "Same."), (90, 1, "user", "Same."), (90, 1, "assistant", "B."), (90, 1, "assistant", "B."), (91, None, "tool", "")]
    rows += [(92, 5, "user", "long words. " * 20_000), (92, 6, "assistant", "x" * 200_000)]
    return rows


def expected(rows):
    by, out, kept = {}, [], []
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        row, lines = by_hand(conv, own)
        out.append(row)
        kept += [(conv, n, r, t) for n, (r, t) in enumerate(lines)]
    return out, kept


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("piece_rows", [7, 65_536])
def test_repair_matches_the_search(spark, piece_rows):
    rows = conversations()
    df = table(spark, rows)
    got = repair_conversations(df, piece_rows=piece_rows)
    assert got.columns == NAMES
    want, kept = expected(rows)
    assert ordered(map(tuple, got.collect())) == ordered(want)
    turns = repaired_turns(df, got)
    assert ordered((r.conv_id, r.position, r.role, r.text) for r in turns.collect()) == ordered(kept)


def test_small_arrow_batches_carry_the_state(spark):
    rows = conversations()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = [tuple(r) for r in repair_conversations(table(spark, rows), piece_rows=10).collect()]
    finally:
        spark.conf.set(name, before)
    assert ordered(got) == ordered(expected(rows)[0])


def test_empty_table_and_conversations_without_rows(spark):
    assert repair_conversations(table(spark, [])).count() == 0
    gone = table(spark, [(1, 2, "user", "Hi."), (None, None, None, None)]).withColumn("copies", __import__("pyspark.sql.functions").sql.functions.lit(0))
    got = repair_conversations(gone, copies_col="copies").collect()
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert ordered(map(tuple, got)) == ordered([(1, *nothing), (None, *nothing)])


def test_one_exchange_of_the_texts(spark):
    df = repair_conversations.__globals__["sorted_rows"](table(spark, conversations()), "conv_id", "turn", "role", "text", None)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def test_registered_query_matches_the_search(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want, _ = expected(damage_by_hand(rows))
    have = {w[0] for w in want}
    want += [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - have]
    got = op12_conversations(spark, "/root/testdata/sf0.01")
    assert got.columns == NAMES
    assert ordered(map(tuple, got.collect())) == ordered(want)


def test_damage(spark):
    rows = conversations()
    got = damaged(table(spark, rows)).collect()
    assert ordered((r.conv_id, r.turn, r.role, r.text) for r in got for _ in range(r.copies)) == ordered(damage_by_hand(rows))
