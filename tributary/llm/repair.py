r"""Operator 12: conversations with broken turns, repaired at the least cost.

A conversation is sound if its roles spell ``(s?(ua)+)?``, by their initials. Repairing keeps a turn (0), gives it the role
that fits (Rerole, 3), deletes it (4, required for blank and duplicate turns) or inserts an empty one (3); a truncated turn
that stays costs 3 more.

For each cost 0, 1, 2, ... a layer holds, for each turn, the bit set of grammar states from which the rest of the
conversation can be repaired at exactly that cost and no less. A layer follows from the layers that lie one edit's cost
below; the first in which the start state stands at the first turn gives the cost. From there the audit is read off bit
by bit: of the edits whose target bit stands in the layer that is left, the ASCII-least is taken. The grammar admits one
role in each state, so an audit says all. Layers are made for blocks of BLOCK turns from the last to the first, each on
the costs that the next block leaves at its border, so work is proportional to a conversation's length.

A conversation's rows are sorted by Spark and stream through a task twice, from one shuffle: first a few bytes for each
turn, from which edits are found, then the texts, which are digested one at a time. Duplicates are found by windows
over digests. What a task holds of a conversation is some bytes for each turn, never its texts.

Edge cases: a null role or text reads as one space, as do a null id and turn in the hash that picks the damage; rows
with one turn number go by role and text; rows with no id are one conversation; a turn whose
role begins with none of s, u and a cannot be kept as it is; all rows lost: zeros, an empty audit and the digest of nothing; repeated rows are duplicates; an empty
table gives an empty result; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACES, small_batches, tidy

#: Costs of edits; TRUNCATED comes on top for a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 64
#: Grammar states as bits: nothing yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ALL, ACCEPT = 15, START | ASSISTANT
#: A turn's kind is the number of its initial, and four times its fault: none, to be deleted, truncated.
INITIALS = "-sua"
SOUND, LOST, CUT = 0, 4, 8
#: States from which a turn with this initial leads into a set of states, and the state that it leads to.
_INTO = [[0] * 16, [START * bool(t & SYSTEM) for t in range(16)], [(START | SYSTEM | ASSISTANT) * bool(t & USER) for t in range(16)], [USER * bool(t & ASSISTANT) for t in range(16)]]
_EITHER = [u | a for u, a in zip(*_INTO[2:], strict=True)]
#: For each state: the state after the only user or assistant turn that it admits, and after a turn of each initial (0: none).
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEPT = {(s, k): next((t for t in (SYSTEM, USER, ASSISTANT) if _INTO[k][t] & s), 0) for s in _NEXT for k in range(4)}
ROLES = {USER: "user", ASSISTANT: "assistant"}


def layers(kinds: bytes, border: dict[int, int], first: bool) -> list[bytearray]:
    """Layers of one block; ``border``: the states that the next one's first turn has at each cost. The first block ends at START."""
    n, goal, c = len(kinds), START if first else ALL, 0
    seen, out = bytearray(n + 1), []
    none = bytearray(n + 1)

    def at(cost: int) -> bytearray:
        return out[cost] if cost >= 0 else none

    while True:
        layer, inserted, deleted, twice = bytearray(n + 1), at(c - INSERT), at(c - DELETE), at(c - REROLE - TRUNCATED)
        cut, given = at(c - TRUNCATED), at(c - REROLE)
        layer[n] = (border.get(c, 0) | _EITHER[inserted[n]]) & ~seen[n]
        seen[n] |= layer[n]
        for i in range(n - 1, -1, -1):
            kind, j = kinds[i], i + 1
            reached = _EITHER[inserted[i]] | deleted[j]
            if kind < LOST:
                reached |= _INTO[kind][layer[j]] | _EITHER[given[j]]
            elif kind >= CUT:
                reached |= _INTO[kind - CUT][cut[j]] | _EITHER[twice[j]]
            layer[i] = reached & ~seen[i]
            seen[i] |= reached
        out.append(layer)
        if seen[0] & goal == goal:
            return out
        c += 1


def repair(kinds: bytes, block: int = BLOCK) -> tuple[int, list[str], str]:
    """(cost, each turn's edits with the insertions before it, insertions at the end) of the least audit."""
    starts = list(range(0, max(1, len(kinds)), block))
    border, base, borders = {0: ACCEPT}, 0, {}
    for a in reversed(starts):
        borders[a] = border, base
        made = layers(kinds[a : a + block], border, not a)
        if a:
            least = next(c for c, layer in enumerate(made) if layer[0])
            border, base = {c - least: layer[0] for c, layer in enumerate(made) if layer[0]}, base + least
    left = len(made) - 1  # the first layer with the start state
    cost, state, edits, end = base + left, START, [], ""
    for a in starts:
        part = kinds[a : a + block]
        border, below = borders[a]
        if a:
            left += base - below
            made = layers(part, border, False)
        base = below
        for i, kind in enumerate(part):
            done, j = "", i + 1
            more = TRUNCATED if kind >= CUT else 0
            while not done.endswith(("D", "K", "R")):
                keep = _KEPT[state, kind & 3]
                if left >= DELETE and made[left - DELETE][j] & state:
                    done, left = done + "D", left - DELETE
                elif left >= INSERT and made[left - INSERT][i] & _NEXT[state]:
                    done, left, state = done + "I", left - INSERT, _NEXT[state]
                elif kind & LOST == 0 and left >= more and keep and made[left - more][j] & keep:
                    done, left, state = done + "K", left - more, keep
                else:
                    done, left, state = done + "R", left - more - REROLE, _NEXT[state]
            edits.append(done)
    while left:
        end, left, state = end + "I", left - INSERT, _NEXT[state]
    return cost, edits, end


class _Repaired:
    """The roles and texts that are left, digested as they come."""

    def __init__(self):
        self.digest, self.state, self.some = hashlib.sha256(), START, False

    def add(self, said: str) -> None:
        self.digest.update((f"\n{said}" if self.some else said).encode())
        self.some = True

    def edited(self, edits: str, kind: int, role: str, text: str) -> None:
        for e in edits:
            if e == "D":
                return
            self.state = _KEPT[self.state, kind & 3] if e == "K" else _NEXT[self.state]
            self.add(f"{role}:{text}" if e == "K" else f"{ROLES[self.state]}:{text if e == 'R' else ''}")


class Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.turns = conv_id, bytearray(), []
        self.blank = self.duplicate = self.distinct = 0
        self.out: _Repaired | None = None

    def turn(self, turn: int | None, kind: int, blank: bool) -> None:
        self.kinds.append(kind)
        if kind & LOST:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns, self.distinct = [self.turns[0] if self.turns else turn, turn], self.distinct + 1

    def solved(self) -> None:
        self.cost, self.edits, self.end = repair(bytes(self.kinds))
        self.out, self.place = _Repaired(), 0

    def text(self, role: str, text: str) -> None:
        if self.out is None:
            self.solved()
        self.out.edited(self.edits[self.place], self.kinds[self.place], role, text)
        self.place += 1

    def row(self) -> tuple:
        if self.out is None:
            self.solved()
        self.out.edited(self.end, 0, "", "")
        initials = bytes(k & 3 for k in self.kinds)
        legal = sum(pair in _ADJACENT for pair in zip(initials, initials[1:]))
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        illegal = max(0, len(initials) - 1) - legal
        truncated = sum(k >= CUT for k in self.kinds)
        return self.conv_id, gaps, self.blank, self.duplicate, truncated, illegal, self.cost, "".join(self.edits) + self.end, self.out.digest.hexdigest()


#: Pairs of initials that may stand side by side: su, ua, au.
_ADJACENT = {(1, 2), (2, 3), (3, 2)}
_COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kept) with every row's damage by a hash of its id and turn; a row that is lost stays once with kept false."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("harm", (F.crc32(key.cast("binary")) % 20).cast("int"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("harm") != 0).alias("kept"), copies.alias("copy"))


def repaired(turns: DataFrame) -> DataFrame:
    """Query op12 on (conv_id, turn, role, text, kept): each conversation's faults, cost, audit and the digest of what is left."""
    small_batches(turns.sparkSession)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("kept", F.asc_nulls_first("turn"), "role", "text")).alias("place")
    rows = turns.select("*", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), place)
    again = F.row_number().over(Window.partitionBy("conv_id", "kept", "digest").orderBy("place")) > 1
    bare = F.rtrim("text", F.lit(SPACES))
    initial = F.coalesce(F.expr(f"nullif(instr('{INITIALS[1:]}', nullif(left(role, 1), '')), 0)"), F.lit(0))
    rows = rows.select("conv_id", "turn", "role", "text", "kept", "place", initial.alias("initial"), (bare == "").alias("blank"), again.alias("again"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank") | F.col("again"), LOST).when(F.col("cut"), CUT).otherwise(SOUND)
    kind = F.when(F.col("kept"), F.col("initial") + fault)
    names = ("pass", "turn", "kind", "blank", "role", "text")

    def sent(*values: Column) -> Column:
        return F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))

    none = {kind: F.lit(None).cast(kind) for kind in ("long", "int", "boolean", "string")}
    first = sent(F.lit(0), F.col("turn"), kind.cast("int"), F.col("blank"), none["string"], none["string"])
    second = sent(F.lit(1), none["long"], none["int"], none["boolean"], F.col("role"), F.col("text"))
    both = rows.select("conv_id", "place", F.inline(F.when(F.col("kept"), F.array(first, second)).otherwise(F.array(first))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _COLUMNS.split(", ")])

        for batch in batches:
            for conv_id, which, turn, kind, blank, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv_id)
                if which:
                    now.text(role, text)
                elif kind is not None:
                    now.turn(turn, kind, blank)
            if done:
                yield batch_of(done)
                done = []
        if now is not None:
            yield batch_of([now.row()])

    stream = both.sortWithinPartitions("conv_id", "pass", "place").select("conv_id", *names)
    return stream.mapInArrow(tidy(run), _COLUMNS)


def digests(df: DataFrame) -> DataFrame:
    return repaired(damaged(df))
