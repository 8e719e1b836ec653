"""Repair of conversation structure with a suffix-shared automaton (DAWG).

Every turn is one symbol of its conversation's signature: the class of its role (system, user,
assistant, other), whether it is truncated, or ``x`` if it has to go (blank, or seen before). The
cheapest edits of a conversation depend on its signature alone, and from any turn on only on the rest
of the signature and the state of the role grammar. So the signatures of all conversations are merged
from their ends into one automaton whose nodes are the distinct suffixes, and the cost to go and the
best edit are computed once per node and grammar state.

* Distinct signatures are dealt to tasks by their last ``SHARED`` symbols, so a suffix that is longer
  lies in one task alone (shorter ones, a bounded number, once per task at most). In a task they come
  sorted from the end: the nodes of one signature are a stack, and the next signature pops what it does
  not share. Memory follows the longest signature, not the number of nodes.
* Turns go through the tasks in order, streamed: a conversation's turns are never held together.
  Sorting and digests are per conversation, so a conversation of any length is one task's work in time,
  with a byte per turn and 16 bytes per distinct turn in memory.
* Signatures that a 1,024th of the conversations share (at most 1,024 of them) are joined by
  broadcast, the others by a shuffle: no signature is a hot key.

Grammar of the role initials: ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or assistant 3, Delete 4,
Insert a user or assistant turn without text 3; a truncated turn that is not deleted adds 3. Of equal
costs the edit initials (D, I, K, R) that come first in ASCII order win.

Defined results: null roles and texts are one space; null ids are one conversation, null turns come
first; ties of turn are ordered by role, then text; a role that is empty or starts with another
letter than s, u, a is never kept; equal rows are duplicates; a conversation without (present) turns
has zeros, an empty audit and the digest of the empty text; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Last symbols that decide the task of a signature.
SHARED = 8
#: Grammar states: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by state; others are not allowed.
NEXT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
#: The state after an inserted or reroled turn: the user or assistant the grammar asks for.
ASKED = [USER, USER, ASSISTANT, USER]
ROLES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long"


def _best(options):
    """The cheapest (cost, edit, next state), ties to the first edit in ASCII order."""
    return min(options, key=lambda o: o[:2])


def _inserts(base: list) -> tuple:
    """Adds insertions, which stay at the node and change the state; two in a row from user or
    assistant lead back at a higher cost, so one round from those and one from the others is enough."""
    out = list(base)
    for s in (USER, ASSISTANT):
        out[s] = _best([o for o in (base[s], (INSERT + base[ASKED[s]][0], "I", ASKED[s])) if o])
    for s in (START, SYSTEM):
        out[s] = _best([o for o in (base[s], (INSERT + out[ASKED[s]][0], "I", ASKED[s])) if o])
    return tuple(out)


_NEVER = (float("inf"), "~", START)
#: The node of the empty suffix: the grammar accepts at the start and after an assistant.
END = _inserts([(0, "", START), _NEVER, _NEVER, (0, "", ASSISTANT)])


def node(symbol: str, rest: tuple) -> tuple:
    """(cost to go, best edit, next state) in every grammar state, for ``symbol`` before the suffix of ``rest``."""
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out = []
    for s in range(4):
        options = [(DELETE + rest[s][0], "D", s)]
        if symbol != "x":
            options.append((REROLE + extra + rest[ASKED[s]][0], "R", ASKED[s]))
            if initial in NEXT[s]:
                options.append((KEEP + extra + rest[NEXT[s][initial]][0], "K", NEXT[s][initial]))
        out.append(_best(options))
    return _inserts(out)


def audit(stack: list[tuple]) -> str:
    """The best edits of a whole signature, read off its nodes (``stack[k]``: its last k symbols)."""
    out, depth, state = [], len(stack) - 1, START
    while True:
        _, edit, after = stack[depth][state]
        if not edit:
            return "".join(out)
        out.append(edit)
        depth -= edit != "I"
        state = after


def _automaton(batches):
    """Signatures sorted from the end → their costs and audits."""
    stack, last = [END], ""
    for batch in batches:
        signatures, n, cost, edits = batch.column(0).to_pylist(), batch.column(1), [], []
        for signature in signatures:
            shared, back = 0, signature[::-1]
            while shared < min(len(back), len(last)) and back[shared] == last[shared]:
                shared += 1
            del stack[shared + 1:]
            for symbol in back[shared:]:
                stack.append(node(symbol, stack[-1]))
            last = back
            cost.append(stack[-1][START][0])
            edits.append(audit(stack))
        yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(cost, pa.int64()), pa.array(edits, pa.string())],
                                         names=["signature", "n", "cost", "audit"])


def best_edits(signatures: DataFrame) -> DataFrame:
    """(signature, n, cost, audit) of every distinct signature; ``n`` says how often it occurs."""
    parts = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = signatures.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.repartition(parts, F.expr(f"right(signature, {SHARED})")).sortWithinPartitions(F.reverse("signature"))
    return dealt.mapInArrow(_automaton, "signature string, n long, cost long, audit string")


def _turns(turns: DataFrame, conv_col, turn_col, role_col, text_col, present: Column | None) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(" "))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(" "))
    return turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"),
                        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "conv").sortWithinPartitions("conv", *first, F.col("turn").asc_nulls_first(), "role", "text")


class _Faults:
    """Faults and signature of one conversation, turn by turn."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last_turn = self.initial = None
        self.seen, self.signature = set(), []

    def add(self, turn, initial, digest, blank, cut):
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        again = digest in self.seen
        self.seen.add(digest)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        symbol = initial if initial in ("s", "u", "a") else "o"
        self.signature.append("x" if blank or again else symbol.upper() if cut else symbol)

    def row(self):
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.signature)


def _signatures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature) per conversation."""
    bare = F.expr(r"regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')")
    narrow = _in_order(rows).select(
        "conv", "turn", "present", F.substring("role", 1, 1).alias("initial"),
        F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))).alias("digest"),
        (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    conv_type = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", conv_type), *T._parse_datatype_string(f"{COUNTS}, signature string").fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        state = key = None

        def packed(done):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), arrow)], schema=arrow)

        for batch in batches:
            done = []
            for conv, turn, present, initial, digest, blank, cut in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, *state.row()))
                    state, key = _Faults(), conv
                if present:
                    state.add(turn, initial, digest, blank, cut)
            if done:
                yield packed(done)
        if state is not None:
            yield packed([(key, *state.row())])

    return narrow.mapInArrow(run, schema)


def _walk(edits: str | None, at: int, state: int):
    """Insertions that stand before the next turn, as roles; the place behind them and the state."""
    out = []
    while at < len(edits) and edits[at] == "I":
        state = ASKED[state]
        out.append(ROLES[state])
        at += 1
    return out, at, state


def _edited(rows: DataFrame, audits: DataFrame, fields: str, start, add, finish) -> DataFrame:
    """Streams every conversation's audit and turns through ``start()``, ``add(state, role, text,
    edit)`` and ``finish(conv, state)``, which returns the rows of the result."""
    header = audits.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                           F.col("audit").alias("text"))
    body = rows.where("present").select("conv", F.lit(1).alias("kind"), "turn", "role", "text")
    ordered = _in_order(header.unionByName(body), "kind")
    schema = T.StructType([T.StructField("conv", rows.schema["conv"].dataType), *T._parse_datatype_string(fields).fields])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        key = edits = held = None
        at = state = 0

        def close(out):
            for role in _walk(edits, at, state)[0]:
                add(held, out, key, role, "", "I")
            finish(held, out, key)

        for batch in batches:
            out = []
            for conv, kind, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    if edits is not None:
                        close(out)
                    key, edits, at, state, held = conv, text, 0, START, start()
                    continue
                inserted, at, state = _walk(edits, at, state)
                for r in inserted:
                    add(held, out, key, r, "", "I")
                edit, at = edits[at], at + 1
                if edit == "R":
                    state = ASKED[state]
                    add(held, out, key, ROLES[state], text, "R")
                elif edit == "K":
                    state = NEXT[state][role[:1]]
                    add(held, out, key, role, text, "K")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)
        if edits is not None:
            out = []
            close(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    return ordered.mapInArrow(run, schema)


class _Text:
    def __init__(self):
        self.sha, self.n = hashlib.sha256(), 0


def _digest_turn(held, out, conv, role, text, edit):
    held.sha.update((("\n" if held.n else "") + f"{role}:{text}").encode())
    held.n += 1


def _digest_end(held, out, conv):
    out.append((conv, held.sha.hexdigest()))


def _emit_turn(held, out, conv, role, text, edit):
    out.append((conv, held.n, role, text, edit))
    held.n += 1


def audits(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
           present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The turns in the operator's own columns, and per conversation ``conv``, the fault counts,
    ``signature``, ``cost`` and ``audit`` (a stored table). Turns for which ``present`` is not true only
    name their conversation."""
    rows = _turns(turns, conv_col, turn_col, role_col, text_col, present)
    convs = stored(_signatures(rows), "signatures")
    edits = stored(best_edits(convs), "edits")
    most = convs.count() // 1024 + 1
    hot = F.broadcast(edits.where(F.col("n") >= most).drop("n"))
    rest = convs.join(hot.select("signature"), "signature", "left_anti").join(edits.where(F.col("n") < most).drop("n"), "signature")
    return rows, stored(convs.join(hot, "signature").unionByName(rest), "audits")


def repaired_turns(turns: DataFrame, **columns) -> DataFrame:
    """(conv, place, role, text, edit): the turns after repair; ``edit`` is K, R or I."""
    rows, found = audits(turns, **columns)
    return _edited(rows, found, "place long, role string, text string, edit string", _Text, _emit_turn, lambda held, out, conv: None)


def repair_digests(turns: DataFrame, **columns) -> DataFrame:
    """One row per conversation: ``conv``, fault counts, ``cost``, ``audit`` and ``repaired_sha256``."""
    rows, found = audits(turns, **columns)
    sha = _edited(rows, found, "repaired_sha256 string", _Text, _digest_turn, _digest_end)
    return found.drop("signature").join(sha, found["conv"].eqNullSafe(sha["conv"])).drop(sha["conv"])


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the query's damage, by crc32 of ``conv_id:turn`` modulo 20; dropped rows
    stay with ``present`` false."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"),
                        (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
