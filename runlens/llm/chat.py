"""Chat formatting (7): minimum-cost role repair over an automaton of legal turns, then rendering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole_runs
from .common import lean, materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Which role may open a new message after which.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ALIASES = {"human": USER, "prompter": USER, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: Turns of a conversation that are repaired together; longer ones are joined by way of their ends.
BLOCK = 1024


@dataclass(frozen=True)
class Costs:
    """Price of each repair. A merge joins a turn to the message before; an insertion adds an empty message."""

    merge: int = 1
    relabel: int = 3
    insert: int = 2


def role_of(name: str | None) -> int:
    """Code of a role name without regard to case and outer white space; START if it is unknown or null."""
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else ALIASES.get(name, START)


def options(role: int, costs: Costs) -> list[tuple[int, int, int, bool, int]]:
    """All (from, to, cost, merged, inserted role or START) for a turn of this role, cheapest repairs first."""
    out = []
    for new in (SYSTEM, USER, ASSISTANT):
        change = costs.relabel * (new != role)
        for last in range(4):
            if new in LEGAL[last]:
                out.append((last, new, change, False, START))
            if last == new:
                out.append((last, new, change + costs.merge, True, START))
            for extra in LEGAL[last]:
                if new in LEGAL[extra]:
                    out.append((last, new, change + costs.insert, False, extra))
    return sorted(out, key=lambda x: (x[2], x[3], x[4], x[1]))


def end_cost(last: int, costs: Costs) -> int | None:
    """Price of ending after this message: a conversation ends with an assistant message or is given an empty one."""
    return {ASSISTANT: 0, USER: costs.insert}.get(last)


_FAR = 1 << 60


def step_tables(costs: Costs) -> tuple[np.ndarray, dict[int, dict[tuple[int, int], tuple[int, int, int, bool, int]]]]:
    """Min-plus matrix (role, from, to) of one turn, and the option that has each entry's cost."""
    matrix = np.full((4, 4, 4), _FAR, dtype=np.int64)
    best: dict[int, dict] = {}
    for role in range(4):
        for o in options(role, costs):
            if o[2] < matrix[role, o[0], o[1]]:
                matrix[role, o[0], o[1]] = o[2]
                best.setdefault(role, {})[o[0], o[1]] = o
    return matrix, best


def transfer(roles: list[int], matrix: np.ndarray) -> np.ndarray:
    """Lowest cost from each state before the turns to each state after them."""
    out = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for r in roles:
        out = np.minimum((out[:, :, None] + matrix[r][None, :, :]).min(axis=1), _FAR)
    return out


def path(roles: list[int], entry: int, leave: int | None, matrix: np.ndarray, best: dict, costs: Costs) -> list[tuple[int, int, int, bool, int]]:
    """Option of each turn on a cheapest way from ``entry`` to ``leave`` (or to any end, its price counted)."""
    reach = [[_FAR] * 4]
    reach[0][entry] = 0
    steps = matrix.tolist()
    for r in roles:
        before, table = reach[-1], steps[r]
        reach.append([min(before[a] + table[a][b] for a in range(4)) for b in range(4)])
    if leave is None:
        ends = [(reach[-1][s] + e, s) for s in range(4) if (e := end_cost(s, costs)) is not None]
        leave = min(ends)[1]
    out = []
    for i in range(len(roles), 0, -1):
        r = roles[i - 1]
        last = next(a for a in range(4) if reach[i - 1][a] + steps[r][a][leave] == reach[i][leave])
        out.append(best[r][last, leave])
        leave = last
    return out[::-1]


def _message(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


END = "<|end|>\n"


def render(text: str, option: tuple[int, int, int, bool, int], first: bool, last: bool) -> str:
    """What a turn adds to the rendered conversation; the pieces of all its turns, joined, are the whole."""
    before, role, _, merged, extra = option
    if merged:
        out = "\n" + text
    else:
        out = ("" if first else END) + (_message(extra) + END if extra else "") + _message(role) + text
    if last:
        out += END + (_message(ASSISTANT) + END if role == USER else "")
    return out


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:  # noqa: B008
    """One row per turn: the conversation repaired at minimum cost, and its rendered pieces.

    Columns: ``conv_col``, ``position`` (from 0), ``turn_col``, ``role_col``, ``new_role``,
    ``action`` (keep, relabel, merge, relabel+merge), ``inserted`` (role of the empty message
    put before, or null), ``closed`` (an empty assistant message ends it), ``cost`` of the turn
    and ``rendered``; the pieces by ``position`` make up the conversation. Legal: system at most
    once and first, then user and assistant in turn, assistant last. Turns are ordered by turn
    (null first), role and text, so ties have one order. Unknown and null roles are relabelled;
    null texts are empty; rows of a null conversation form one. Extra columns are dropped.

    Rows are range-sorted, so a long conversation lies in many tasks. Each block of ``block``
    turns is a min-plus matrix between automaton states; only those are brought together per
    conversation, and then every block is repaired on its own between its two known states.
    """
    matrix, best = step_tables(costs)
    conv_type, turn_type = (conversations.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text", F.monotonically_increasing_id()))
    placed = rows.repartitionByRange("conv", "turn", "role", "text", "tie").sortWithinPartitions("conv", "turn", "role", "text").drop("tie")

    @lean
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        at, blk, inside, conv, roles = 0, 0, 0, None, []

        def cell(rs: list[int]) -> bytes:
            return transfer(rs, matrix).astype("<i8").tobytes()

        held: list = []
        for batch in batches:
            convs, names = batch.column("conv").to_pylist(), batch.column("role").to_pylist()
            blocks, cells = [], []
            pending = list(held)
            held = []
            for c, r in zip(convs, names, strict=True):
                if at and (c != conv or inside == block):
                    cells.append(cell(roles))
                    blk, inside, roles = blk + 1, 0, []
                elif at:
                    cells.append(None)
                conv = c
                roles.append(role_of(r))
                blocks.append(part + blk)
                inside, at = inside + 1, at + 1
            # cells run one row behind: they belong to the row before the one just read
            rows_here = [*pending, pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "turn", "role", "text")), pa.array(blocks, pa.int64()), pa.array(range(at - len(blocks), at), pa.int64())], names=["conv", "turn", "role", "text", "blk", "seq"])]
            t = pa.Table.from_batches(rows_here).combine_chunks()
            ready = len(cells)
            if ready:
                for b in t.slice(0, ready).append_column("cell", pa.array(cells, pa.binary())).combine_chunks().to_batches():
                    yield b
            held = t.slice(ready).to_batches()
        if held:
            t = pa.Table.from_batches(held)
            yield t.append_column("cell", pa.array([*[None] * (t.num_rows - 1), cell(roles)], pa.binary())).combine_chunks().to_batches()[0]

    numbered = materialize(placed.mapInArrow(number, f"conv {conv_type}, turn {turn_type}, role string, text string, blk long, seq long, cell binary"), "turns")
    ends = numbered.where("cell is not null").select("conv", "blk", "cell", "seq")
    sizes = numbered.groupBy("blk").agg(F.count("*").alias("n"))
    ends = ends.join(sizes, "blk").withColumn("key", F.xxhash64("conv"))

    @lean
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, ["key"]):
            cells = np.frombuffer(b"".join(t.column("cell").to_pylist()), "<i8").reshape(-1, 4, 4)
            size, conv = t.column("n").to_pylist(), t.column("conv").to_pylist()
            entry, leave, before = [0] * t.num_rows, [None] * t.num_rows, [0] * t.num_rows
            bounds = [*starts.tolist(), t.num_rows]
            groups = [[i for i in range(a, b) if conv[i] == c] for a, b in zip(bounds, bounds[1:], strict=False) for c in dict.fromkeys(conv[a:b])]
            for g in groups:
                reach = [np.array([0, _FAR, _FAR, _FAR], dtype=np.int64)]
                for i in g:
                    reach.append(np.minimum((reach[-1][:, None] + cells[i]).min(axis=0), _FAR))
                state = min((int(reach[-1][s]) + e, s) for s in range(4) if (e := end_cost(s, costs)) is not None)[1]
                for n in range(len(g) - 1, -1, -1):
                    i = g[n]
                    leave[i] = state if n < len(g) - 1 else -1
                    state = int((reach[n] + cells[i][:, state]).argmin()) if n < len(g) - 1 or len(g) > 1 else START
                    entry[i] = state
                total = 0
                for i in g:
                    before[i] = total
                    total += size[i]
            yield pa.RecordBatch.from_arrays([t.column("blk").combine_chunks(), pa.array(entry, pa.int32()), pa.array(leave, pa.int32()), pa.array(before, pa.int64())], names=["blk", "entry", "leave", "before"])

    known = ends.repartition("key").sortWithinPartitions("key", "blk").select("key", "conv", "blk", "cell", "n").mapInArrow(chain, "blk long, entry int, leave int, before long")
    joined = numbered.drop("cell").join(known, "blk").repartition("blk").sortWithinPartitions("blk", "seq")

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_runs(batches, ["blk"], 4096):
            names, texts = t.column("role").to_pylist(), t.column("text").to_pylist()
            entry, leave, before = (t.column(c).to_pylist() for c in ("entry", "leave", "before"))
            out: dict[str, list] = {c: [] for c in ("position", "new_role", "action", "inserted", "closed", "cost", "rendered")}
            bounds = [*starts.tolist(), t.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                roles = [role_of(r) for r in names[a:b]]
                end = None if leave[a] < 0 else leave[a]
                for k, o in enumerate(path(roles, entry[a], end, matrix, best, costs)):
                    last = end is None and k == b - a - 1
                    closed = last and o[1] == USER
                    out["position"].append(before[a] + k)
                    out["new_role"].append(ROLES[o[1]])
                    out["action"].append("+".join([*["relabel"] * (o[1] != roles[k]), *["merge"] * o[3]]) or "keep")
                    out["inserted"].append(ROLES[o[4]] or None)
                    out["closed"].append(closed)
                    out["cost"].append(o[2] + costs.insert * closed)
                    out["rendered"].append(render(texts[a + k] or "", o, before[a] + k == 0, last))
            kinds = {"position": pa.int64(), "closed": pa.bool_(), "cost": pa.int32()}
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("conv", "turn", "role")), *(pa.array(v, kinds.get(c, pa.string())) for c, v in out.items())], names=["conv", "turn", "role", *out])

    schema = f"conv {conv_type}, turn {turn_type}, role string, position long, new_role string, action string, inserted string, closed boolean, cost int, rendered string"
    done = joined.select("conv", "turn", "role", "text", "blk", "entry", "leave", "before").mapInArrow(finish, schema)
    return done.select(F.col("conv").alias(conv_col), "position", F.col("turn").alias(turn_col), F.col("role").alias(role_col), "new_role", "action", "inserted", "closed", "cost", "rendered")
