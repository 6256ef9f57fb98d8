"""Repair of conversations by cheapest edits.

A conversation's rows are kept, given another role, deleted, or joined by inserted rows, so that the roles read
``(s?(ua)+)?``. Edits have costs, and of equally cheap edits the one whose letters come first in ASCII order is taken. Both
wishes are one whole number: the high digits carry the cost, below them stands a fixed width of digits with one
letter each from the left, filled with zeros behind the last letter. The least number over a directed acyclic graph of
(row, role state) decides everything.

The graph is worked from the last row to the first, in blocks of rows. The edits that are open in one state differ in their
letter, so among equally cheap ones the first letter decides and letters of later blocks need not be carried in the number;
its width is that of one block and the work is linear in the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import WORD, land, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Letters of edits and their digits; the order of the digits is that of the letters, and 0 is no letter.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = {d: letter for letter, d in DIGITS.items()}
DIGIT_BITS = 3
BLOCK_ROWS = 64

START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
INITIALS = {"s": 1, "u": 2, "a": 3}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = frozenset({(1, 2), (2, 3), (3, 2)})
_STEP = {(START, 1): SYSTEM, (START, 2): USER, (SYSTEM, 2): USER, (USER, 3): ASSISTANT, (ASSISTANT, 2): USER}
_NEEDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}

#: A row as one small number: its initial's number, plus these.
MUST_GO, CUT_OFF = 4, 8


@lru_cache(maxsize=1 << 14)
def _block(codes: bytes, ends: tuple[int | None, ...]) -> tuple[tuple[tuple[int, str, int] | None, ...], ...]:
    """Per state before a block of rows: the cost from there to the end of the conversation, the letters inside the block
    and the state behind it. ``ends``: cost to the end from each state behind the block (None: no way)."""
    width = DIGIT_BITS * (3 * len(codes) + 2)
    top = width - DIGIT_BITS

    def edit(cost: int, letter: str, rest: tuple[int, int]) -> tuple[int, int]:
        weight, last = rest
        high, low = weight >> width, weight & ((1 << width) - 1)
        return ((high + cost) << width) + (DIGITS[letter] << top) + (low >> DIGIT_BITS), last

    def with_inserts(values: list) -> list:
        for _ in range(2):  # a third insert in a row comes back to the state it started from
            more = [edit(INSERT, "I", values[_NEEDED[s]]) if values[_NEEDED[s]] else None for s in range(4)]
            values = [min((x for x in pair if x), default=None) for pair in zip(values, more)]
        return values

    values = with_inserts([None if c is None else (c << width, s) for s, c in enumerate(ends)])
    for code in reversed(codes):
        initial, extra = code & 3, TRUNCATED if code & CUT_OFF else 0
        now = []
        for s in range(4):
            choices = [edit(DELETE, "D", values[s])] if values[s] else []
            if not code & MUST_GO:
                if values[_NEEDED[s]]:
                    choices.append(edit(REROLE + extra, "R", values[_NEEDED[s]]))
                kept = _STEP.get((s, initial))
                if kept is not None and values[kept]:
                    choices.append(edit(KEEP + extra, "K", values[kept]))
            now.append(min(choices, default=None))
        values = with_inserts(now)
    out = []
    for value in values:
        if value is None:
            out.append(None)
            continue
        low, letters = value[0] & ((1 << width) - 1), []
        while low:
            letters.append(LETTERS[low >> top])
            low = (low << DIGIT_BITS) & ((1 << width) - 1)
        out.append((value[0] >> width, "".join(letters), value[1]))
    return tuple(out)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of rows given as numbers (initial, MUST_GO, CUT_OFF)."""
    ends: tuple[int | None, ...] = tuple(0 if s in ENDS else None for s in range(4))
    blocks, cost = [], 0
    # The first block of rows is the short one, so that all others have one length.
    for stop in range(len(codes), 0, -BLOCK_ROWS) or (0,):
        blocks.append(_block(codes[max(0, stop - BLOCK_ROWS):stop], ends))
        totals = [None if way is None else way[0] for way in blocks[-1]]
        # What all states owe is set aside, so that equal blocks of long conversations are worked out once.
        least = min(c for c in totals if c is not None)
        cost += least
        ends = tuple(None if c is None else c - least for c in totals)
    state, letters = START, []
    for block in reversed(blocks):
        _, inside, state = block[state]
        letters.append(inside)
    return cost + ends[START], "".join(letters)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n`` of every distinct row behind the damage, and in how many copies.

    crc32(``conv_id:turn``) mod 20 drops a row (0), empties its text (1), takes its ``.!?`` (2), repeats it (3) or makes
    its role ``user`` (4). A null field is one blank in all of this.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"),
                                (F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                           F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("n"))


def _last_character() -> Column:
    return F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))


def _rows(conversations: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, a digest of the text and its faults; copies meet before the shuffle."""
    made = damaged(conversations).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = made.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("text").alias("text"))
    return rows.withColumn("blank", ~F.col("text").rlike(WORD)).withColumn("open_end", ~F.col("blank") & ~_last_character().isin(".", "!", "?"))


def _coded(rows: DataFrame) -> DataFrame:
    """Per distinct row, without its text: order columns, copies, and whether its role and text stood earlier."""
    narrow = rows.select("conv_id", "turn", "role", "digest", "n", "blank", "open_end")
    again = (narrow.groupBy("conv_id", "role", "digest").agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
             .where("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("first_turn"), F.lit(True).alias("seen")))
    joined = narrow.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.left("role", F.lit(1))
    number = F.lit(0)
    for letter, k in INITIALS.items():
        number = F.when(initial == letter, k).otherwise(number)
    earlier = F.coalesce(F.col("seen") & ~F.col("turn").eqNullSafe(F.col("first_turn")), F.lit(False))
    return joined.select("conv_id", "turn", "role", "digest", "n", "blank", (~F.col("blank") & earlier).alias("dup"),
                         (~F.col("blank") & ~earlier & F.col("open_end")).alias("cut"), number.cast("int").alias("initial"))


_FACTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from sorted rows; of a row that is read one byte stays until its conversation ends."""
    done: list[tuple] = []
    key, open_ = None, False
    codes, last = bytearray(), None
    blank = duplicate = truncated = illegal = turns = 0
    low = high = None

    def finish() -> None:
        cost, audit = cheapest(bytes(codes))
        gaps = high - low + 1 - turns if turns else 0
        done.append((key, gaps, blank, duplicate, truncated, illegal, cost, audit))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())],
                                          [f.split()[0] for f in _FACTS.split(", ")])

    for batch in batches:
        for conv, turn, n, is_blank, is_dup, is_cut, initial in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if not open_ or conv != key:
                if open_:
                    finish()
                key, open_ = conv, True
                codes, last = bytearray(), None
                blank = duplicate = truncated = illegal = turns = 0
                low = high = None
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            if last is not None and (last, initial) not in LEGAL:
                illegal += 1
            illegal += n - 1
            last = initial
            if is_blank:
                blank += n
            else:
                duplicate += n if is_dup else n - 1
                truncated += is_cut
            codes.append(initial + (MUST_GO if is_blank or is_dup else 0) + (CUT_OFF if is_cut else 0))
            codes.extend(bytes([initial + MUST_GO]) * (n - 1))
            if len(done) >= 1000:
                yield flush()
    if open_:
        finish()
    if done:
        yield flush()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text's hash per conversation: its letters come first, then its rows in order, hashed as they pass."""
    done: list[tuple] = []
    key, open_ = None, False
    audit, at, state, first, digest = "", 0, START, True, hashlib.sha256()

    def put(role: str, text: str) -> None:
        nonlocal first
        digest.update((("" if first else "\n") + f"{role}:{text}").encode())
        first = False

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _NEEDED[state]
            put(ROLES[state], "")
            at += 1

    def flush() -> pa.RecordBatch:
        ids, values = zip(*done)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.string())], ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, n, role, text, letters in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if letters is not None:
                if open_:
                    inserts()
                    done.append((key, digest.hexdigest()))
                key, open_, audit, at, state, first, digest = conv, True, letters, 0, START, True, hashlib.sha256()
                if len(done) >= 1000:
                    yield flush()
                continue
            for _ in range(n):
                inserts()
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = _STEP[state, INITIALS[role[0]]]
                    put(role, text)
                elif letter == "R":
                    state = _NEEDED[state]
                    put(ROLES[state], text)
    if open_:
        inserts()
        done.append((key, digest.hexdigest()))
    if done:
        yield flush()


def repaired(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the table: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are damaged first (``damaged``) and then stand by turn (nulls first), role and text. A row's first fault counts: blank,
    duplicate (its role and text stood earlier), truncated (its last character is none of ``.!?``). ``audit`` has one letter
    per edit (D, I, K, R); ``repaired_sha256`` is over ``role:text`` of what is left, joined by line ends.

    Null conv_ids are one conversation; null fields are one blank; equal rows are copies, of which all but the first are
    duplicates and must go; roles count by their first letter, and an empty
    role has no place in the pattern. A conversation without rows behind
    the damage has zeros, an empty audit and the hash of nothing. Other columns are not read; an empty table gives an empty result.

    Equal rows are counted before any shuffle. Letters are found from rows without their texts, then the texts pass once, in
    order, through their conversation's hash. That hash is sequential by definition, so a conversation is one stream in one task, whatever
    its length; the task holds a byte per row and the letters, never the rows.
    """
    rows = land(_rows(small_batches(conversations)))
    coded = land(_coded(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")
                 .select("conv_id", "turn", "n", "blank", "dup", "cut", "initial").mapInArrow(_summaries, _FACTS))
    letters = coded.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
                           F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("text"), "audit")
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "n", "text", F.lit(None).cast("string").alias("audit"))
    stream = (letters.unionByName(texts).repartition("conv_id")
              .sortWithinPartitions(F.asc_nulls_first("conv_id"), "kind", F.asc_nulls_first("turn"), "role", "digest"))
    hashes = stream.select("conv_id", "n", "role", "text", "audit").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    facts = coded.join(hashes.withColumnRenamed("conv_id", "h"), F.col("conv_id").eqNullSafe(F.col("h"))).drop("h")
    none = hashlib.sha256().hexdigest()
    out = everyone.join(facts.withColumnRenamed("conv_id", "f"), F.col("conv_id").eqNullSafe(F.col("f")), "left").drop("f")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
