"""Chat formatting: minimum-cost role repair by dynamic programming over an automaton of legal turns, then rendering.

A legal conversation is at most one system turn, then user and assistant in turn, ending with the assistant. For each given
turn the repair may keep it, merge it into the message before it, relabel it (then keep or merge it), or put an empty
message of another role before it; empty messages may also close a conversation. The cheapest sequence of such edits is the
shortest path through the automaton's states, and its costs compose: a stretch of turns is a small matrix of least costs
from each state before it to each state after it.

So a conversation may be of any length. Turns are dealt out in ranges of (conversation, turn), each task reads its range in
order, and only the conversations at a range's two ends can go on in another task. Their matrices, at most two per task, are
composed on the driver, which tells each task in which states its first and last conversation begin and end.

A mark inside a text can't open or close a message: it gets a backslash after its first character, and one that has
backslashes there already gets one more, so nothing is lost and ``unescape`` gives the text back.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import materialised

# The roles, other names for them, and the marks of a rendered message.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "question": "user", "bot": "assistant", "gpt": "assistant",
           "model": "assistant", "ai": "assistant", "answer": "assistant", "instruction": "system", "developer": "system"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"<(\\*)(\|im_(?:start|end)\|>)")

# Costs of the edits. A relabelled and merged turn costs both.
MERGE, RELABEL, INSERT = 1, 2, 3

# States: nothing yet, or the role of the last message. LEGAL: the roles that may follow.
START = 3
STATES = (0, 1, 2, START)  # after system, user, assistant; start
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
INF = 1 << 40


def role_of(name: str | None) -> int:
    """The role's number, or -1 for a role that isn't one."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def edits(state: int, role: int) -> list[tuple[int, int, str, int, tuple[int, ...]]]:
    """(cost, next state, action, new role, roles of empty messages before it) of all edits, preferred ones first."""
    out = []
    if role in LEGAL[state]:
        out.append((0, role, "keep", role, ()))
    if state == role:
        out.append((MERGE, state, "merge", role, ()))
    out += [(RELABEL, r, "relabel", r, ()) for r in LEGAL[state] if r != role]
    if state != START and state != role:
        out.append((RELABEL + MERGE, state, "relabel_merge", state, ()))
    out += [(INSERT, role, "insert", role, (r,)) for r in LEGAL[state] if role in LEGAL[r]]
    return out


# The cheapest edit from state to state for each role; of equal ones the first.
BEST: dict[int, dict[tuple[int, int], tuple[int, int, str, int, tuple[int, ...]]]] = {}
for _role in (-1, 0, 1, 2):
    BEST[_role] = {}
    for _state in STATES:
        for _edit in edits(_state, _role):
            _had = BEST[_role].get((_state, _edit[1]))
            if _had is None or _edit[0] < _had[0]:
                BEST[_role][_state, _edit[1]] = _edit
# What closes a conversation in each state: empty messages up to an assistant's.
CLOSING = {2: (), 1: (2,), 0: (1, 2), START: ()}


def forward(costs: list[int], role: int) -> tuple[list[int], list[int]]:
    """Least costs of the states after one more turn, and the states that they come from (of equal ones the first)."""
    after, back = [INF] * 4, [-1] * 4
    for (state, to), edit in BEST[role].items():
        cost = costs[state] + edit[0]
        if cost < after[to] or (cost == after[to] and cost < INF and state < back[to]):
            after[to], back[to] = cost, state
    return after, back


def entry(state: int) -> list[int]:
    return [0 if s == state else INF for s in STATES]


def closing_state(costs: list[int]) -> int:
    """The state in which it is cheapest to end (of equal ones the later role)."""
    return min((costs[s] + INSERT * len(CLOSING[s]), -s, s) for s in STATES)[2]


def repair(roles: list[int], begin: int = START, end: int | None = None) -> list[tuple[str, int, tuple[int, ...]]]:
    """(action, new role, empty messages before it) of each turn on the cheapest path from ``begin`` (to ``end``)."""
    costs, backs = entry(begin), []
    for role in roles:
        costs, back = forward(costs, role)
        backs.append(back)
    state = closing_state(costs) if end is None else end
    out = []
    for role, back in zip(reversed(roles), reversed(backs)):
        edit = BEST[role][back[state], state]
        out.append(edit[2:])
        state = back[state]
    return out[::-1]


def matrix(roles: list[int]) -> list[list[int]]:
    """Least costs from every state before the turns to every state after them."""
    rows = []
    for state in STATES:
        costs = entry(state)
        for role in roles:
            costs, _ = forward(costs, role)
        rows.append(costs)
    return rows


def link(ends: list[dict]) -> dict[int, dict]:
    """For the end conversations of each part, in order: where they begin and end, from their matrices.

    ``ends`` rows: part, conv, first (it opens its part), matrix. A conversation over several parts is one chain of rows.
    """
    out: dict[int, dict] = defaultdict(dict)
    for _, chain in groupby(ends, key=itemgetter("conv")):
        chain = list(chain)
        costs, seen = entry(START), []
        for row in chain:
            pairs = [min((costs[s] + row["matrix"][s][t], s) for s in STATES) for t in STATES]
            seen.append([s for _, s in pairs])
            costs = [min(c, INF) for c, _ in pairs]
        state = closing_state(costs)
        for k in range(len(chain) - 1, -1, -1):
            before = seen[k][state]
            where = {"begin": before, "end": state, "opens": k == 0, "closes": k == len(chain) - 1}
            for side in chain[k]["sides"]:
                out[chain[k]["part"]][side] = where
            state = before
    return dict(out)


def escape(text: str) -> str:
    """The text with one backslash more in each mark. As backslashes are only ever added, no new mark can arise."""
    return _MARK.sub(r"<\1\\\2", text)


def unescape(text: str) -> str:
    """The text before ``escape``."""
    return re.sub(r"<\\(\\*\|im_(?:start|end)\|>)", r"<\1", text)


def message(role: int, text: str) -> str:
    return f"{OPEN}{ROLES[role]}\n{text}"


def pieces(roles: list[int], texts: list[str | None], where: dict | None = None) -> list[tuple[str, str, list[str], str]]:
    """(action, new role, inserted roles, rendered piece) of a run of turns; the pieces joined are the rendered text.

    The last turn's inserted roles include those that close the conversation.
    """
    where = where or {"begin": START, "end": None, "opens": True, "closes": True}
    out, is_open, state = [], not where["opens"], where["begin"]
    for (action, role, before), text in zip(repair(roles, where["begin"], where["end"]), texts):
        clean = escape(text or "")
        if action in ("merge", "relabel_merge"):
            piece = "\n" + clean
        else:
            piece = (CLOSE + "\n" if is_open else "") + "".join(f"{message(r, '')}{CLOSE}\n" for r in before) + message(role, clean)
        is_open, state = True, role
        out.append([action, ROLES[role], [ROLES[r] for r in before], piece])
    if out and where["closes"]:
        out[-1][2] = out[-1][2] + [ROLES[r] for r in CLOSING[state]]
        out[-1][3] += f"{CLOSE}\n" + "".join(f"{message(r, '')}{CLOSE}\n" for r in CLOSING[state])
    return [tuple(x) for x in out]


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", tasks: int | None = None) -> DataFrame:
    """A row per turn: ``conv_id, turn, role``, ``new_role``, ``action``, ``inserted`` roles and the ``rendered`` piece.

    A conversation's rendering is its pieces joined in order of turn. Turns with equal numbers are taken in order of role,
    then of a hash of the text; null numbers come first. Ids that are neither integers nor text come out as text. An unknown or null role has to be relabelled, a null text is
    empty, rows with a null conversation id form one conversation, and repeated rows are turns of their own. An empty table
    gives an empty result; other columns are ignored.
    """
    order = ["conv_id", "turn", "role", "_text_hash", "_row"]
    known_kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    conv = F.col(f"`{conv_col}`")
    if turns.select(conv).schema[0].dataType.simpleString() not in known_kinds:
        conv = conv.cast("string")
    own = turns.select(conv.alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
                       F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keyed = own.withColumns({"_text_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(tasks, *order) if tasks else keyed.repartitionByRange(*order)
    held = materialised(dealt.sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
        """Each conversation's rows of this part, in order."""
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for conv, group in groupby(rows, key=itemgetter(0)):
            yield conv, list(group)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for at, (_, group) in enumerate(runs(batches)):
            last = (at, group)
            first = first or last
        found = [first] if first and first[0] == last[0] else [first, last] if first else []
        cells = [[c for row in matrix([role_of(g[1]) for g in group]) for c in row] for _, group in found]
        names = ["part", "conv_id", "at", "cells"]
        sides = [["first", "last"]] if len(found) == 1 else [["first"], ["last"]][:len(found)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0][2] for _, g in found], pa.int32()), pa.array([g[0][0] for _, g in found], conv_type),
             pa.array(sides, pa.list_(pa.string())), pa.array(cells, pa.list_(pa.int64()))], names=names)

    conv_kind = held.schema["conv_id"].dataType.simpleString()
    conv_type = known_kinds[conv_kind]
    rows = held.select("conv_id", "role", "part").mapInArrow(
        ends, f"part int, conv_id {conv_kind}, at array<string>, cells array<long>").collect()
    placed = sorted(rows, key=lambda r: (r["part"], "first" not in r["at"]))
    known = link([{"part": r["part"], "conv": (r["conv_id"],), "sides": r["at"],
                   "matrix": [r["cells"][k:k + 4] for k in range(0, 16, 4)]} for r in placed])
    shared = turns.sparkSession.sparkContext.broadcast(known)
    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "rendered"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, seen = None, 0

        def out(group: list[tuple], side: str | None) -> pa.RecordBatch:
            where = shared.value.get(group[0][4], {}).get(side)
            made = pieces([role_of(g[2]) for g in group], [g[3] for g in group], where)
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in group], conv_type), pa.array([g[1] for g in group], pa.int64()),
                 pa.array([g[2] for g in group], pa.string()), pa.array([m[1] for m in made], pa.string()),
                 pa.array([m[0] for m in made], pa.string()), pa.array([m[2] for m in made], pa.list_(pa.string())),
                 pa.array([m[3] for m in made], pa.string())], names=names)

        small: list[pa.RecordBatch] = []
        for _, group in runs(batches):
            if waiting:
                small.append(out(waiting, "first" if seen == 1 else None))
            waiting, seen = group, seen + 1
            if len(small) >= 500:
                yield from pa.Table.from_batches(small).combine_chunks().to_batches()
                small = []
        if waiting:
            small.append(out(waiting, "last"))
            yield from pa.Table.from_batches(small).combine_chunks().to_batches()

    return held.withColumn("turn", F.col("turn").cast("long")).select("conv_id", "turn", "role", "text", "part").mapInArrow(
        render, f"conv_id {conv_kind}, turn long, role string, new_role string, action string, inserted array<string>, rendered string")
