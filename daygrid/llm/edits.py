"""Cheapest edits of a sequence of turns, by tables over blocks of symbols.

A conversation's roles have to read `(s?(ua)+)?`. Costs of being in one of four states after each turn are a small vector;
less their minimum, and without states that others beat whatever follows, there are only a few dozen different ones, so that
what a block of turns does to each of them is looked up. Only vectors at block borders are kept; to read the edits, blocks are expanded again from the last to the first.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Nothing yet, after the system turn, after a user turn, after an assistant turn; sequences may end in the outer two.
STATES, ENDS = 4, (0, 3)
#: First letters of roles: system, user, assistant, any other, none.
SYSTEM, USER, ASSISTANT, OTHER, NAMELESS = range(5)
#: Faults of a turn, the first that holds.
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Where a role leads from each state (-1: it may not stand there), and the role that a state waits for.
STEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1], [0, 1, 2, 3]])
AWAITS, THEN = np.array([USER, USER, ASSISTANT, USER]), np.array([2, 2, 3, 2])
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Turns of a block of the table.
BLOCK = 4
#: Symbols: role and whether the turn is cut off; a turn that has to go; no turn.
GONE, NONE = 10, 11
SYMBOLS = 12
FAR = 10**15
#: Letters of the instructions: keep, delete, make it a user's or an assistant's turn, insert one of them.
KEEP, DROP, AS_USER, AS_ASSISTANT, NEW_USER, NEW_ASSISTANT, PASS = b"KDUAijP"


def symbol_of(codes: np.ndarray) -> np.ndarray:
    """Symbols of turns given as 4 * role + fault."""
    role, fault = codes // 4, codes % 4
    return np.where(fault >= BLANK, GONE, role * 2 + fault)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Costs of going by a, then by b."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), FAR)


def inserting() -> np.ndarray:
    one = np.full((STATES, STATES), FAR)
    one[range(STATES), range(STATES)] = 0
    one[range(STATES), THEN] = INSERT
    return product(one, one)


def normal(vector: np.ndarray) -> tuple:
    """Costs above the least one, and FAR for states that can't be on a cheapest way.

    All that follows the first state also follows the last but for one kept system turn, which costs 2 to delete; all
    that follows the second follows the last. So a state that costs more than that is beaten, however it goes on.
    """
    v = np.where(vector >= FAR // 2, FAR, vector - vector.min())
    v[:2] = np.where(v[:2] > v[3] + np.array([DELETE, 0]), FAR, v[:2])
    return tuple(v.tolist())


def costs() -> tuple[np.ndarray, np.ndarray]:
    """Cost of keeping and of changing the role of a symbol's turn; FAR where there is no such edit."""
    keep, change = np.full(SYMBOLS, FAR), np.full(SYMBOLS, FAR)
    for role in range(5):
        for fault in (CLEAN, TRUNCATED):
            keep[role * 2 + fault], change[role * 2 + fault] = fault * CUT_OFF, REROLE + fault * CUT_OFF
    return keep, change


def one_symbol(symbol: int) -> np.ndarray:
    """Cheapest way from state to state over one turn and whatever is inserted after it."""
    keep, change = costs()
    m = np.full((STATES, STATES), FAR)
    for q in range(STATES):
        m[q, q] = 0 if symbol == NONE else DELETE
        if symbol < GONE:
            m[q, THEN[q]] = min(m[q, THEN[q]], change[symbol])
            to = STEP[symbol // 2][q]
            if to >= 0:
                m[q, to] = min(m[q, to], keep[symbol])
    return product(m, inserting())


class Tables:
    """All cost vectors (least entry 0) that can arise, and what every symbol and every block of symbols makes of them."""

    def __init__(self):
        matrices = [one_symbol(s) for s in range(SYMBOLS)]
        known: dict[tuple, int] = {}
        rows, queue = [], [tuple(r) for r in inserting()]
        self.starts = queue[:]
        following = []
        for v in queue:
            if v in known:
                continue
            known[v] = len(rows)
            rows.append(v)
            made = [product(np.array(v), m) for m in matrices]
            least = [int(x.min()) for x in made]
            norm = [normal(x) for x in made]
            following.append((norm, least))
            queue.extend(norm)
        self.known, self.vectors = known, np.array(rows, np.int64)
        self.next = np.array([[known[n] for n in norm] for norm, _ in following], np.int32)
        self.add = np.array([least for _, least in following], np.int32)
        block, more = self.next, self.add
        for _ in range(BLOCK - 1):
            more = (more[:, :, None] + self.add[block]).reshape(len(rows), -1)
            block = self.next[block].reshape(len(rows), -1)
        self.block_next, self.block_add = block, more

    def vector(self, row: tuple) -> int:
        return self.known[tuple(int(x) for x in row)]


@cache
def tables() -> Tables:
    return Tables()


class Segments:
    """Several runs of turns, each with at least one empty place after it and filled up to whole blocks."""

    def __init__(self, codes: list[bytes]):
        sizes = np.array([len(c) for c in codes], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.blocks = self.sizes // BLOCK + 1
        self.first = np.cumsum(self.blocks) - self.blocks
        symbols = np.full((int(self.blocks.sum()), BLOCK), NONE, np.int64)
        flat = symbols.reshape(-1)
        rows = np.repeat(self.first * BLOCK, self.sizes) + np.arange(self.sizes.sum()) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        flat[rows] = symbol_of(np.frombuffer(b"".join(codes[i] for i in self.order), np.uint8).astype(np.int64))
        self.symbols = symbols
        self.codes = (symbols * SYMBOLS ** np.arange(BLOCK - 1, -1, -1)).sum(axis=1)
        self.deepest = int(self.blocks.max(initial=0))

    def active(self, step: int) -> int:
        """Runs (they go from long to short) that have a block of this number."""
        return int(np.searchsorted(-self.blocks, -step, side="left"))

    def back(self, values: np.ndarray) -> np.ndarray:
        """Values by run, in the order they were given."""
        out = np.empty_like(values)
        out[self.order] = values
        return out

    def forward(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors at the beginning of every block, those at each run's end, and what was taken off on the way."""
        t, at, off = tables(), start[self.order].copy(), np.zeros(len(self.sizes), np.int64)
        borders = np.empty(len(self.codes), np.int32)
        for k in range(self.deepest):
            m = self.active(k)
            here = self.first[:m] + k
            borders[here] = at[:m]
            off[:m] += t.block_add[at[:m], self.codes[here]]
            at[:m] = t.block_next[at[:m], self.codes[here]]
        return borders, self.back(at), self.back(off)

    def choices(self, borders: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For every turn and state on a cheapest way the first edit in ASCII order that stays on one; 0 off these ways.

        Blocks are expanded from the last to the first: `live` says which states at a run's end are on a cheapest way.
        """
        t, live = tables(), live[self.order].copy()
        keep_cost, change_cost = costs()
        out = np.zeros((len(self.codes), BLOCK, STATES), np.uint8)
        states = np.arange(STATES)
        for k in range(self.deepest - 1, -1, -1):
            m = self.active(k)
            here = self.first[:m] + k
            symbols = self.symbols[here]
            inner, added = [borders[here]], []
            for j in range(BLOCK):
                added.append(t.add[inner[j], symbols[:, j]])
                inner.append(t.next[inner[j], symbols[:, j]])
            after = live[:m]
            for j in range(BLOCK - 1, -1, -1):
                s = symbols[:, j]
                now, then = t.vectors[inner[j]], t.vectors[inner[j + 1]] + added[j][:, None]
                real = now < FAR // 2
                to = STEP[np.minimum(s // 2, 4)]
                kept = real & after[np.arange(m)[:, None], to] & (to >= 0) & (now + keep_cost[s][:, None] == then[np.arange(m)[:, None], to])
                changed = real & after[:, THEN] & (now + change_cost[s][:, None] == then[:, THEN])
                dropped = real & after & (now + DELETE == then) & (s < NONE)[:, None]
                passed = real & after & (now == then) & (s == NONE)[:, None]
                before = kept | changed | dropped | passed
                added_turn = np.zeros_like(before)
                for _ in range(2):
                    added_turn = real & before[:, THEN] & (now + INSERT == now[:, THEN])
                    before = before | added_turn
                names = np.where(AWAITS[states] == USER, NEW_USER, NEW_ASSISTANT), np.where(AWAITS[states] == USER, AS_USER, AS_ASSISTANT)
                out[here, j] = np.select([passed, dropped, added_turn, kept, changed], [PASS, DROP, names[0], KEEP, names[1]], 0)
                after = before
            live[:m] = after
        return out.reshape(-1, STATES)

    def follow(self, choices: np.ndarray, enter: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Instructions of every run from its first state, and the state it ends in."""
        state = enter[self.order].copy()
        taken = np.zeros(len(choices), np.uint8)
        extra: dict[int, list[tuple[int, int]]] = {}
        flat = self.symbols.reshape(-1)
        for p in range(self.deepest * BLOCK):
            m = self.active(p // BLOCK)
            at = self.first[:m] * BLOCK + p
            for _ in range(2):
                op = choices[at, state[:m]]
                for run in np.flatnonzero((op == NEW_USER) | (op == NEW_ASSISTANT)):
                    extra.setdefault(int(run), []).append((min(p, int(self.sizes[run])), int(op[run])))
                    state[run] = THEN[state[run]]
            op, s = choices[at, state[:m]], flat[at]
            taken[at] = op
            kept = STEP[np.minimum(s // 2, 4), state[:m]]
            state[:m] = np.where(op == KEEP, kept, np.where((op == AS_USER) | (op == AS_ASSISTANT), THEN[state[:m]], state[:m]))
        found = []
        for run, (a, n) in enumerate(zip(self.first * BLOCK, self.sizes, strict=True)):
            ops = taken[a : a + n].tobytes()
            for place, op in reversed(extra.get(run, [])):
                ops = ops[:place] + bytes([op]) + ops[place:]
            found.append(ops)
        out: list[bytes] = [b""] * len(found)
        for i, ops in zip(self.order, found, strict=True):
            out[i] = ops
        return out, self.back(state)


def opening(n: int) -> np.ndarray:
    """The vector before any turn, n times."""
    t = tables()
    return np.full(n, t.vector(t.starts[0]), np.int32)


def closing(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States in which a sequence with this last vector may end at the least cost, and that cost above the vector's 0."""
    allowed = np.full(STATES, FAR)
    allowed[list(ENDS)] = 0
    last = tables().vectors[vectors] + allowed
    least = last.min(axis=1)
    return last == least[:, None], least


def transfer(segments: Segments, n: int) -> np.ndarray:
    """Costs from every state before a run to every state after it."""
    t = tables()
    rows = []
    for q in range(STATES):
        _, end, off = segments.forward(np.full(n, t.vector(t.starts[q]), np.int32))
        rows.append(np.minimum(t.vectors[end] + off[:, None], FAR))
    return np.stack(rows, axis=1)


def borders(matrices: list[np.ndarray]) -> tuple[list[tuple], list[list[bool]], int]:
    """For a sequence cut into runs: the vector before each, the states after each that are on a cheapest way, the cost."""
    t = tables()
    before = [np.array(t.starts[0])]
    for m in matrices:
        before.append(product(before[-1], m))
    allowed = np.full(STATES, FAR)
    allowed[list(ENDS)] = 0
    total = int((before[-1] + allowed).min())
    ahead, live = product(inserting(), allowed[:, None])[:, 0], [(before[-1] + allowed == total).tolist()]
    for k in range(len(matrices) - 1, 0, -1):
        ahead = product(matrices[k], ahead[:, None])[:, 0]
        live.append((before[k] + ahead == total).tolist())
    return [normal(v) for v in before[:-1]], live[::-1], total
