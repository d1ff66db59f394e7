"""Repair of the structure of conversations by secondary-sorted streaming.

The rows are dealt out by conversation and sorted by turn inside a task, which
``mapInPandas`` reads as a stream. What is carried from row to row, across Arrow
batches, is four states (nothing yet, after a system row, after a user row,
after an assistant row): the cheapest cost that leads to each, the order of
their audits, and a running hash of the repaired rows. A byte per state and row
says how it was reached. These backpointers stay in memory for usual
conversations; those of giant ones are written out in pieces as rows of a table
and walked from the end in a second stream. No task holds the texts of a
conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopgroups.sources.tables import read_table

from .common import python_ready, stored, work_folder

#: Characters that make no text, and those that end a sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")
#: Costs of the edits; a truncated row that stays adds CUT.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows whose backpointers a task holds; those of longer conversations are written in pieces of as many.
PIECE_ROWS = 65_536

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the next row of a repaired conversation, its role, and the states it may end in with what they still need.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LETTERS = "DKR"
_FAR, _NONE = 1 << 40, 255


@lru_cache(maxsize=None)
def _moves(initial: str, must_go: bool, extra: int) -> list:
    """For each state after a row, the ways to it: (cost, state before, letters, byte)."""
    ways = [[] for _ in range(4)]

    def add(target, cost, source, inserts, letter):
        ways[target].append((cost, source, "I" * inserts + letter, source | inserts << 2 | LETTERS.index(letter) << 3))

    for source in range(4):
        add(source, DELETE, source, 0, "D")
        if must_go:
            continue
        if initial == "s" and source == START:
            add(SYSTEM, extra, source, 0, "K")
        for target, role in ROLES.items():
            # one inserted row lets the other role follow; more are never cheaper
            inserts = 0 if NEXT[source] == target else 1
            same = initial == role[0]
            add(target, inserts * INSERT + extra + (0 if same else REROLE), source, inserts, "K" if same else "R")
    return ways


@lru_cache(maxsize=1 << 16)
def _advance(costs: tuple, ranks: tuple, initial: str, must_go: bool, extra: int) -> tuple:
    """(least cost, costs above it, ranks, four bytes) after one more row.

    Of equally cheap audits the ASCII-least stays. Audits of different states that end with the same
    row are never one the beginning of the other, so that their order, ``ranks``, decides.
    """
    best = []
    for ways in _moves(initial, must_go, extra):
        keys = [(costs[source] + cost, ranks[source], letters, source, byte) for cost, source, letters, byte in ways if costs[source] < _FAR]
        best.append(min(keys) if keys else (_FAR, 0, "", 0, _NONE))
    least = min(b[0] for b in best)
    order = sorted((b[1], b[2], state) for state, b in enumerate(best) if b[0] < _FAR)
    place = {state: i for i, (_, _, state) in enumerate(order)}
    return (least, tuple(b[0] - least if b[0] < _FAR else _FAR for b in best), tuple(place.get(s, 0) for s in range(4)),
            bytes(b[4] for b in best))


def _line(state: int, role: str, text: str) -> bytes:
    """A repaired row that follows ``state``."""
    return (("" if state == START else "\n") + role + ":" + text).encode()


class Repair:
    """The state of one conversation between its rows."""

    def __init__(self):
        self.cost, self.costs, self.ranks = 0, (0, _FAR, _FAR, _FAR), (0, 0, 0, 0)
        self.hashes = [hashlib.sha256(), None, None, None]
        self.back = bytearray()
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal, self.last, self.turns, self.first_turn, self.last_turn = 0, None, 0, None, None

    def add(self, turn, role: str, text: str, fault: str) -> None:
        """One more row; ``fault`` is a key of ``faults`` or empty."""
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        if fault:
            self.faults[fault] += 1
        known = initial if initial in ("s", "u", "a") else ""
        must_go = fault in ("blank", "duplicate")
        shift, self.costs, self.ranks, byte = _advance(self.costs, self.ranks, known, must_go, CUT if fault == "truncated" else 0)
        self.cost += shift
        self.back += byte
        if not must_go:
            self.hashes = [self._hash(state, b, role, text) for state, b in enumerate(byte)]

    def _hash(self, state: int, byte: int, role: str, text: str):
        if byte == _NONE:
            return None
        source, inserts, letter = byte & 3, byte >> 2 & 1, LETTERS[byte >> 3]
        if letter == "D":
            return self.hashes[source]
        new = self.hashes[source].copy()
        if inserts:
            source, before = NEXT[source], source
            new.update(_line(before, ROLES[source], ""))
        new.update(_line(source, ROLES[state] if letter == "R" else role, text))
        return new

    def end(self) -> dict:
        """All but the audit; ``state`` and ``tail`` tell where the backpointers start and what is inserted at the end."""
        cost, _, tail, state = min((self.costs[s] + INSERT * len(t), self.ranks[s], t, s) for s, t in ENDINGS.items() if self.costs[s] < _FAR)
        digest, at = self.hashes[state].copy(), state
        for _ in tail:
            digest.update(_line(at, ROLES[NEXT[at]], ""))
            at = NEXT[at]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return {"gaps": gaps, **self.faults, "illegal": self.illegal, "cost": self.cost + cost, "repaired_sha256": digest.hexdigest(),
                "state": state, "tail": tail}


def walk(back: bytes, state: int) -> tuple[str, int]:
    """(audit of the rows, state before them) from the state after them."""
    letters = []
    for i in range(len(back) - 4, -4, -4):
        byte = back[i + state]
        letters.append("I" * (byte >> 2 & 1) + LETTERS[byte >> 3])
        state = byte & 3
    return "".join(reversed(letters)), state


_REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"
_FORWARD = _REPORT + ", audit string, piece long, state int, tail string, back binary"
_NAMES = [f.split()[0] for f in _FORWARD.split(", ")]
_INTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "piece", "state")


def _frame(rows: list[dict]) -> pd.DataFrame:
    """The rows with None for what they lack; integers stay integers beside it."""
    return pd.DataFrame([[r.get(n) for n in _NAMES] for r in rows], columns=_NAMES).astype({c: "Int64" for c in _INTS})


def _stream(piece_rows: int):
    def run(batches):
        now, repair, pieces, out = None, None, 0, []

        def close():
            done = repair.end()
            row = {"conv": now[0], **done, "piece": pieces}
            if pieces:
                row["back"] = bytes(repair.back)
            else:
                row["audit"] = walk(repair.back, done["state"])[0] + done["tail"]
            out.append(row)

        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("conv", "turn", "role", "text", "copies", "blank", "cut", "seen")]
            for conv, turn, role, text, copies, blank, cut, seen in zip(*columns):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, repair, pieces = (conv,), Repair(), 0
                for copy in range(copies):
                    fault = "blank" if blank else "duplicate" if seen or copy else "truncated" if cut else ""
                    repair.add(None if turn is None else int(turn), role, text, fault)
                    if len(repair.back) == 4 * piece_rows:
                        out.append({"conv": conv, "piece": pieces, "back": bytes(repair.back)})
                        pieces += 1
                        repair.back.clear()
            yield _frame(out)
            out = []
        if now is not None:
            close()
        yield _frame(out)

    return run


def _walk_pieces(batches):
    """(conv, piece, audit) of the pieces, which come from the last one of a conversation to its first."""
    now, state = None, 0
    for pdf in batches:
        out = []
        for conv, piece, back, start, tail in zip(*(pdf[c].tolist() for c in ("conv", "piece", "back", "state", "tail"))):
            if now is None or now[0] != conv:
                now, state = (conv,), int(start)
            letters, state = walk(back, state)
            out.append((conv, piece, letters + (tail or "")))
        yield pd.DataFrame(out, columns=["conv", "piece", "audit"])


def sorted_rows(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies_col: str | None) -> DataFrame:
    """The rows with their faults, all rows of a conversation in one partition, sorted by turn."""
    # ids and turns as texts: pandas would turn numbers beside nulls into floats
    rows = df.select(F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("at"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
                     (F.coalesce(F.col(copies_col).cast("int"), F.lit(1)) if copies_col else F.lit(1)).alias("copies"))
    gone = F.col("copies") < 1
    rows = rows.withColumns({"text": F.when(gone, F.lit("")).otherwise(F.col("text")),
                             "same": F.when(~gone, F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))})
    bare = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumns({"blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(*ENDS)}).repartition("conv")
    # the same exchange serves the window, whose rows are sorted outside memory
    nth = F.row_number().over(Window.partitionBy("conv", "same").orderBy("at"))
    return rows.withColumn("seen", F.col("same").isNotNull() & (nth > 1)).sortWithinPartitions("conv", "at", "role", "text").select(
        "conv", F.col("at").cast("string").alias("turn"), "role", "text", "copies", "blank", "cut", "seen")


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                         copies_col: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """A report per conversation: the faults of its rows, the cheapest edits that make it an optional system row
    followed by pairs of a user and an assistant row, and the hash of the rows after them.

    Columns: the id, gaps, blank, duplicate, truncated, illegal, cost, audit (K keep, R rerole, D delete, I insert)
    and repaired_sha256; ``repaired_turns`` has the rows themselves.

    Rows are taken by turn, those without one first, rows of one turn by role and text. Null roles and texts are one
    space; a null id is a conversation of its own. Repeated rows are duplicates. ``copies_col`` tells how many times a
    row is there; a conversation with no row left has zeros, an empty audit and the hash of an empty text. Empty table:
    no rows. Other columns are ignored. Ids must be integers or texts; an empty text is no null.
    """
    spark = df.sparkSession
    python_ready(spark)
    folder = work_folder(spark, "conversations")
    kind = df.schema[conv_col].dataType
    rows = sorted_rows(df, conv_col, turn_col, role_col, text_col, copies_col)
    found = stored(rows.mapInPandas(_stream(piece_rows), _FORWARD), folder, "forward")
    usual = found.filter("audit is not null")
    # what giant conversations wrote, from the last piece to the first one
    giant = found.filter("back is not null").repartition("conv").sortWithinPartitions("conv", F.desc("piece"))
    audits = giant.select("conv", "piece", "back", "state", "tail").mapInPandas(_walk_pieces, "conv string, piece long, audit string")
    audits = audits.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    # the last piece of a conversation has its report
    report = found.filter("back is not null and cost is not null").drop("audit").alias("r").join(
        audits.alias("a"), F.col("r.conv").eqNullSafe(F.col("a.conv"))).select("r.*", "a.audit")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return usual.select("conv", *names).unionByName(report.select("conv", *names)).select(F.col("conv").cast(kind).alias(conv_col), *names)


def _replay(batches):
    """The repaired rows of conversations whose audit comes before their rows."""
    now, letters, place, state, position = None, "", 0, START, 0

    def item(turn, edit, role, text):
        nonlocal position
        position += 1
        out.append((now[0], position - 1, turn, edit, role, text))

    def inserted():
        nonlocal place, state
        while letters[place:place + 1] == "I":
            place, state = place + 1, NEXT[state]
            item(None, "I", ROLES[state], "")

    for pdf in batches:
        out = []
        for conv, audit, turn, role, text, copies in zip(*(pdf[c].tolist() for c in ("conv", "audit", "turn", "role", "text", "copies"))):
            if audit is not None:
                if now is not None:
                    inserted()
                now, letters, place, state, position = (conv,), audit, 0, START, 0
                continue
            for _ in range(int(copies)):
                inserted()
                letter, place = letters[place], place + 1
                if letter != "D":
                    state = SYSTEM if letter == "K" and role[:1] == "s" else NEXT[state]
                    item(turn, letter, ROLES[state] if letter == "R" else role, text)
        yield pd.DataFrame(out, columns=["conv", "position", "turn", "edit", "role", "text"])
    out = []
    if now is not None:
        inserted()
    yield pd.DataFrame(out, columns=["conv", "position", "turn", "edit", "role", "text"])


def repaired_turns(df: DataFrame, report: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """(id, position, turn, edit, role, text): the rows after the edits of ``repair_conversations(df, ...)``.

    Inserted rows have no turn and an empty text. Nulls, repeated rows and the empty table as there.
    """
    kind = df.schema[conv_col].dataType
    rows = sorted_rows(df, conv_col, turn_col, role_col, text_col, copies_col)
    rows = rows.select("conv", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    first = report.select(F.col(conv_col).cast("string").alias("conv"), "audit", F.lit(None).cast("string").alias("turn"),
                          F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("copies"))
    both = rows.unionByName(first).repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.col("turn").cast("long"), "role", "text")
    return both.mapInPandas(_replay, "conv string, position long, turn string, edit string, role string, text string").select(
        F.col("conv").cast(kind).alias(conv_col), "position", F.col("turn").cast("long").alias("turn"), "edit", "role", "text")


def damaged(df: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with planted faults, chosen by the checksum of ``conv_id:turn``."""
    def name(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))), F.lit(20))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(name("text"), "[.!?]", "")).otherwise(name("text"))
    return df.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(name("role")).alias("role"), text.alias("text"),
                     F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"))


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and hash of the repaired rows of every damaged conversation of ``conversations``."""
    return repair_conversations(damaged(read_table(spark, sf_dir, "conversations")), copies_col="copies")
