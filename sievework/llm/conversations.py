"""Repair of conversation structure by dynamic programming over time-major tensors.

`damaged` breaks conversations in a known way, `repair` mends them. Rows of a conversation are read in the order of their
turns (nulls first; of equal turns by role and a hash of the text; a repeated row follows its twin). A row's first
fault counts: blank, duplicate (role and text as in an earlier row), truncated (the last character but white space ends no
sentence). The edits that cost least make the roles read (s?(ua)+)?: Keep 0, Rerole 1, Delete 2, Insert 5, and 5 for each
truncated row that stays; blank and duplicate rows must go. Of equally cheap edits the least string of initials is taken.

What is output so far matters in four states only: nothing, a system row, a user row, an assistant row. The tensor of costs
is [turn, conversation, state, end state]. Conversations are put into buckets by length (powers of two, padded with turns
that change nothing), and each step of the backward pass updates all conversations of a bucket at once; the costs of all
turns are stored. The forward pass traces the edits of all of them turn by turn.

Scale: rows are range-partitioned by conversation and turn, so a conversation of any size is dealt out over tasks, and its
text moves once. A task cuts its sorted rows into segments: whole conversations, and segments (of SEGMENT_ROWS rows and
SEGMENT_BYTES at most) of those that may go on in another task or are long. Whole ones are repaired on the spot. Of the
others

1. messages of one segment that stand in an earlier one are found by a join of hashes, a row a segment and message;
2. each segment gives its costs from each state to each end state: a 4 x 4 matrix over (min, +);
3. the matrices are folded from the conversation's end, in a stream, which gives each segment the costs after its end;
4. with these each segment is traced for each of the four states it could be entered in;
5. a stream from the start picks the state of each segment, adds up, and continues the hash of the repaired text (a hash
   is sequential; the stream holds one segment at a time).

Edge cases: null roles and texts are one blank, in the hashed key also null ids and turns; null turns come first and don't
count for gaps; null ids are one conversation; a role's initial is its first character, whatever the role (an empty role has
none); a conversation without rows after damage is returned with zeros, an empty audit and the hash of the empty
string; repeated rows are duplicates; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sievework.llm.common import stored

#: Bounds of a segment, and rows and bytes that a task gathers before it repairs them.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 2 << 20
BATCH_ROWS, BATCH_BYTES = 16_384, 32 << 20
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the output, the state after the one role that each may be followed by, and what is missing at the end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
CLOSING = np.array([0, 2 * INSERT, INSERT, 0])
NEVER = 1 << 40
SPACES = " \t\n\x0b\x0c\r"

OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "open boolean, part long, seq long, turns array<long>, roles array<string>, texts array<string>, blanks array<boolean>, cuts array<boolean>, hashes array<binary>"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped, 2: repeated) of each row, by the CRC32 of `conv:turn` modulo 20."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named(conv_col), F.lit(":"), named(turn_col)).cast("binary")) % 20
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col(role_col), F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# --- the dynamic programme ---


def backward(first: np.ndarray, gone: np.ndarray, extra: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs [turn, conversation, state, end state] from before each turn to the end.

    first: initials as states (START for any other); gone: rows that must go; extra: cost of keeping; here: turns that are
    not padding; all [turn, conversation]. after: costs at the end, [conversation, state, end state]."""
    turns, n = first.shape
    costs = np.empty((turns + 1, *after.shape), np.int64)
    costs[turns] = after
    for t in range(turns - 1, -1, -1):
        then = costs[t + 1]
        kept = _kept(then, first[t]) + extra[t][:, None, None]
        moved = then[:, NEXT] + (REROLE + extra[t])[:, None, None]
        stay = np.where(gone[t][:, None, None], NEVER, np.minimum(kept, moved))
        base = np.minimum(then + DELETE, stay)
        now = base.copy()
        now[:, USER] = np.minimum(base[:, USER], base[:, ASSISTANT] + INSERT)
        now[:, ASSISTANT] = np.minimum(base[:, ASSISTANT], base[:, USER] + INSERT)
        now[:, :USER] = np.minimum(base[:, :USER], now[:, USER : USER + 1] + INSERT)
        costs[t] = np.where(here[t][:, None, None], np.minimum(now, NEVER), then)
    return costs


def _kept(then: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Costs after a row is kept, by state before it."""
    out = np.full_like(then, NEVER)
    s, u, a = (first == x for x in (SYSTEM, USER, ASSISTANT))
    out[s, START] = then[s, SYSTEM]
    for state in (START, SYSTEM, ASSISTANT):
        out[u, state] = then[u, USER]
    out[a, USER] = then[a, ASSISTANT]
    return out


def trace(costs: np.ndarray, first: np.ndarray, gone: np.ndarray, extra: np.ndarray, here: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits, least initials first, from a state [conversation] to the end state 0 of the tensor: letters
    [turn, 3, conversation] (0: none) and the states at the end. At most two rows are inserted before a turn."""
    turns, n = first.shape
    at = np.arange(n)
    letters = np.zeros((turns, 3, n), np.uint8)
    state = state.copy()
    for t in range(turns):
        then, now, real = costs[t + 1, :, :, 0], costs[t, :, :, 0], here[t]
        for k in range(2):
            must = real & (now[at, state] != then[at, state] + DELETE) & (now[at, state] == now[at, NEXT[state]] + INSERT)
            letters[t, k, must] = ord("I")
            state = np.where(must, NEXT[state], state)
        left = now[at, state]
        delete = real & (left == then[at, state] + DELETE)
        keep = real & ~delete & ~gone[t] & (left == _kept(then[:, :, None], first[t])[at, state, 0] + extra[t])
        letters[t, 2] = np.where(delete, ord("D"), np.where(keep, ord("K"), np.where(real, ord("R"), 0)))
        state = np.where(keep, first[t], np.where(real & ~delete, NEXT[state], state))
    return letters, state


class Segment:
    """Some rows of a conversation, in order."""

    __slots__ = ("blanks", "conv", "cuts", "dups", "edge", "known", "part", "roles", "seq", "size", "texts", "turns")

    def __init__(self, conv: object, part: int, seq: int, edge: bool):
        self.conv, self.part, self.seq, self.edge, self.size = conv, part, seq, edge, 0
        self.turns, self.roles, self.texts, self.blanks, self.cuts, self.dups = [], [], [], [], [], []
        self.known: set[tuple[str, str]] = set()

    def add(self, turn: int | None, role: str, text: str, blank: bool, cut: bool) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.blanks.append(blank)
        self.cuts.append(cut)
        dup = not blank and (role, text) in self.known
        self.dups.append(dup)
        if not blank:
            self.known.add((role, text))
        self.size += len(role) + len(text)

    def hashes(self) -> list[bytes]:
        return sorted(message_hash(*m) for m in self.known)


def message_hash(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def buckets(segments: list[Segment]) -> Iterator[tuple[list[Segment], tuple[np.ndarray, ...]]]:
    """Segments by length, with their tensors first, gone, extra, here: [turn, conversation]."""
    by_length = defaultdict(list)
    for s in segments:
        by_length[max(4, 1 << (len(s.turns) - 1).bit_length()) if s.turns else 0].append(s)
    for length, members in sorted(by_length.items()):
        first, gone, extra, here = (np.zeros((length, len(members)), kind) for kind in (np.int64, bool, np.int64, bool))
        for i, s in enumerate(members):
            n = len(s.turns)
            first[:n, i] = [_INITIALS.get(role[:1], START) for role in s.roles]
            blank, dup = np.array(s.blanks, bool), np.array(s.dups, bool)
            gone[:n, i] = blank | dup
            extra[:n, i] = np.where(np.array(s.cuts, bool) & ~blank & ~dup, TRUNCATED, 0)
            here[:n, i] = True
        yield members, (first, gone, extra, here)


def edited(s: Segment, audit: str, state: int) -> list[str]:
    """role:text of the rows that the edits leave, from a state."""
    out, i = [], 0
    for e in audit:
        if e == "D":
            i += 1
            continue
        if e == "K":
            role = s.roles[i]
            state = _INITIALS[role[:1]]
        else:
            state = int(NEXT[state])
            role = "user" if state == USER else "assistant"
        out.append(f"{role}:{'' if e == 'I' else s.texts[i]}")
        i += e != "I"
    return out


def counted(s: Segment) -> dict[str, int]:
    """blank, duplicate, truncated and illegal of a segment by itself."""
    pairs = zip(s.roles, s.roles[1:], strict=False)
    return {
        "blank": sum(s.blanks),
        "duplicate": sum(s.dups),
        "truncated": sum(c and not b and not d for c, b, d in zip(s.cuts, s.blanks, s.dups, strict=True)),
        "illegal": sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs),
    }


def _text(letters: np.ndarray, i: int) -> str:
    mine = letters[:, :, i].ravel()
    return mine[mine > 0].tobytes().decode()


def _gaps(turns: list[int]) -> int:
    return turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0


def solved(segments: list[Segment]) -> Iterator[dict]:
    """The results of whole conversations."""
    for members, tensors in buckets(segments):
        n = len(members)
        costs = backward(*tensors, np.broadcast_to(CLOSING[None, :, None], (n, 4, 1)))
        letters, ends = trace(costs, *tensors, np.full(n, START))
        for i, s in enumerate(members):
            audit = _text(letters, i) + "I" * int(CLOSING[ends[i]] // INSERT)
            repaired = "\n".join(edited(s, audit, START))
            known = [t for t in s.turns if t is not None]
            yield {
                "conv_id": s.conv, **counted(s), "gaps": _gaps(known), "cost": int(costs[0, i, START, 0]),
                "audit": audit, "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest(), "open": False,
            }


# --- tasks ---


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1024) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= most or "texts" in row:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            yield from batch.slice(i, 64).to_pylist()


def cut(rows: Iterator[dict], part: int) -> Iterator[Segment]:
    """The segments of a task's sorted rows. edge: the conversation may have rows elsewhere."""
    now, seq = None, 0
    for r in rows:
        if now is None or r["conv_id"] != now.conv:
            if now is not None:
                yield now
            now = Segment(r["conv_id"], part, seq, edge=now is None)
            seq += 1
        for _ in range(r["copies"]):
            now.add(r["turn"], r["role"], r["text"], r["blank"], r["cut"])
        if len(now.turns) >= SEGMENT_ROWS or now.size >= SEGMENT_BYTES:
            now.edge = True
            yield now
            now = Segment(r["conv_id"], part, seq, edge=True)
            seq += 1
    if now is not None:
        now.edge = True
        yield now


def first_pass(rows: Iterator[dict], part: int) -> Iterator[dict]:
    """Results of whole conversations, and the segments of the others."""
    held, n, size = [], 0, 0
    for s in cut(rows, part):
        if s.edge:
            yield {"conv_id": s.conv, "open": True, "part": part, "seq": s.seq, "turns": s.turns, "roles": s.roles, "texts": s.texts, "blanks": s.blanks, "cuts": s.cuts, "hashes": s.hashes()}
            continue
        held.append(s)
        n, size = n + len(s.turns), size + s.size
        if n >= BATCH_ROWS or size >= BATCH_BYTES:
            yield from solved(held)
            held, n, size = [], 0, 0
    yield from solved(held)


def _again(r: dict) -> Segment:
    """A stored segment, with its duplicates of earlier segments."""
    s = Segment(r["conv_id"], r["part"], r["seq"], True)
    for row in zip(r["turns"], r["roles"], r["texts"], r["blanks"], r["cuts"], strict=True):
        s.add(*row)
    earlier = set(r["earlier"] or ())
    if earlier:
        s.dups = [d or (not b and message_hash(role, text) in earlier) for d, b, role, text in zip(s.dups, s.blanks, s.roles, s.texts, strict=True)]
    return s


def _bounded(rows: Iterator[dict]) -> Iterator[list[dict]]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r["turns"])
        if n >= BATCH_ROWS or len(held) >= 32:
            yield held
            held, n = [], 0
    if held:
        yield held


#: Costs at the end of a segment if it is to end in a given state.
_ENDS = np.where(np.eye(4, dtype=bool), 0, NEVER)


def matrices(rows: Iterator[dict]) -> Iterator[dict]:
    """conv_id, part, seq, m: costs from each state (rows) to each end state."""
    for held in _bounded(rows):
        for members, tensors in buckets([_again(r) for r in held]):
            costs = backward(*tensors, np.broadcast_to(_ENDS, (len(members), 4, 4)))
            for i, s in enumerate(members):
                yield {"conv_id": s.conv, "part": s.part, "seq": s.seq, "m": costs[0, i].ravel().tolist()}


def folded(rows: Iterator[dict]) -> Iterator[dict]:
    """conv, part, seq, after: the costs after the end of each segment; rows: the last segment of a conversation first."""
    conv, after = object(), CLOSING
    for r in rows:
        if r["_c"] != conv:
            conv, after = r["_c"], CLOSING
        yield {"_c": conv, "part": r["part"], "seq": r["seq"], "after": after.tolist()}
        after = np.minimum((np.array(r["m"]).reshape(4, 4) + after[None, :]).min(axis=1), NEVER)


def traced(rows: Iterator[dict]) -> Iterator[dict]:
    """Each segment with its edits and end state for each state it may be entered in, and its own counts."""
    for held in _bounded(rows):
        segments = [_again(r) for r in held]
        of = {id(s): r for s, r in zip(segments, held, strict=True)}
        for members, tensors in buckets(segments):
            n = len(members)
            after = np.array([of[id(s)]["after"] for s in members]).reshape(n, 4, 1)
            costs = backward(*tensors, after)
            by_state = [trace(costs, *tensors, np.full(n, state)) for state in range(4)]
            for i, s in enumerate(members):
                r = of[id(s)]
                yield {
                    "conv_id": s.conv, "_c": r["_c"], "part": s.part, "seq": s.seq, "turns": s.turns, "roles": s.roles, "texts": s.texts, **counted(s),
                    "costs": costs[0, i, :, 0].tolist(), "audits": [_text(letters, i) for letters, _ in by_state], "ends": [int(ends[i]) for _, ends in by_state],
                }


def joined(rows: Iterator[dict]) -> Iterator[dict]:
    """The results of conversations whose segments come in order."""
    now: dict | None = None

    def done() -> dict:
        closing = int(CLOSING[now["state"]] // INSERT)
        for k in range(closing):
            say("user:" if closing - k == 2 else "assistant:")
        return {k: now[k] for k in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "".join(now["audit"]) + "I" * closing, "repaired_sha256": now["sha"].hexdigest()}

    def say(line: str) -> None:
        now["sha"].update((("\n" if now["any"] else "") + line).encode())
        now["any"] = True

    for r in rows:
        if now is None or r["_c"] != now["_c"]:
            if now:
                yield done()
            now = {"_c": r["_c"], "conv_id": r["conv_id"], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": r["costs"][START], "state": START, "audit": [], "sha": hashlib.sha256(), "any": False, "turn": None, "role": None}
        s = Segment(r["conv_id"], 0, 0, True)
        s.roles, s.texts = r["roles"], r["texts"]
        audit = r["audits"][now["state"]]
        for line in edited(s, audit, now["state"]):
            say(line)
        now["audit"].append(audit)
        now["state"] = r["ends"][now["state"]]
        for k in ("blank", "duplicate", "truncated", "illegal"):
            now[k] += r[k]
        if r["roles"]:
            if now["role"] is not None:
                now["illegal"] += now["role"][:1] + r["roles"][0][:1] not in ("su", "ua", "au")
            now["role"] = r["roles"][-1]
        known = [t for t in r["turns"] if t is not None]
        if known:
            # what is missing between the segments, and within this one
            now["gaps"] += (max(0, known[0] - now["turn"] - 1) if now["turn"] is not None else 0) + _gaps(known)
            now["turn"] = known[-1]
    if now:
        yield done()


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256. The counts are of the rows before the repair."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    bare = F.rtrim("text", F.lit(SPACES))
    marked = rows.withColumns({"blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?")})
    keys: list[Column] = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text"), F.col("_tie")]
    ordered = marked.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    first = stored(_mapped(ordered, lambda x: first_pass(x, TaskContext.get().partitionId()), f"conv_id {kind}, {OUT}, {OPEN}"), "conversations")
    columns = ["conv_id", *(x.split()[0] for x in OUT.split(", "))]
    whole = first.where("not open").select(*columns)

    parts = first.where("open").select("conv_id", F.to_json(F.struct("conv_id")).alias("_c"), "part", "seq", "turns", "roles", "texts", "blanks", "cuts", "hashes")
    place = ["_c", "part", "seq"]
    met = parts.select(*place, F.explode("hashes").alias("h"))
    again = met.groupBy("_c", "h").agg(F.min(F.struct("part", "seq")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_c", "h", "first")
    earlier = met.join(again, ["_c", "h"]).where(F.struct("part", "seq") > F.col("first")).groupBy(*place).agg(F.collect_list("h").alias("earlier"))
    parts = stored(parts.drop("hashes").join(earlier, place, "left"), "segments")
    m = _mapped(parts, lambda x: matrices(x), f"conv_id {kind}, part long, seq long, m array<long>").withColumn("_c", F.to_json(F.struct("conv_id")))
    backwards = m.repartition("_c").sortWithinPartitions("_c", F.desc("part"), F.desc("seq"))
    after = _mapped(backwards, folded, "_c string, part long, seq long, after array<long>")
    own = "conv_id {}, _c string, part long, seq long, turns array<long>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>, ends array<int>"
    edits = _mapped(parts.join(after, place), traced, own.format(kind))
    forwards = edits.repartition("_c").sortWithinPartitions("_c", "part", "seq")
    return whole.unionByName(_mapped(forwards, joined, f"conv_id {kind}, {OUT}"))


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """df through a generator of dicts, batch by batch."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), arrow), schema)
