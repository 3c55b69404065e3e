"""The cheapest audit of a row of turns: a dynamic program whose states share their edit prefixes."""

from __future__ import annotations

from collections.abc import Sequence

# What has been written of (s?(ua)+)?: nothing, the system turn, a user turn, an assistant turn.
STATES = 4
INFINITE = 1 << 60
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
# state after writing a role's initial
WRITES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# inserted turns that lead from a state to an end, by state
CLOSING = (0, 2, 1, 0)
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Prefix:
    """An edit string as a linked node: its last edit, its length, a rolling hash, and its ancestors 1, 2, 4, ... edits back."""

    __slots__ = ("edit", "length", "hash", "back")

    def __init__(self, parent: Prefix | None, edit: str = "", modulus: int = MODULUS):
        self.edit = edit
        if parent is None:
            self.length, self.hash, self.back = 0, 0, ()
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * BASE + ord(edit)) % modulus
        back, k = [parent], 0
        while len(back[k].back) > k:
            back.append(back[k].back[k])
            k += 1
        self.back = tuple(back)

    def cut(self, length: int) -> Prefix:
        """The prefix of this string with the given length."""
        node = self
        while node.length > length:
            node = node.back[min(len(node.back), (node.length - length).bit_length()) - 1]
        return node

    def text(self) -> str:
        edits, node = [], self
        while node.length:
            edits.append(node.edit)
            node = node.back[0]
        return "".join(reversed(edits))


def before(a: Prefix, b: Prefix) -> bool:
    """Whether string a sorts before string b (a proper prefix sorts first).

    The longest common prefix is searched over ancestors: equal hashes mean equal prefixes,
    which is verified in the end: equal strings of one audit are one node. If they
    aren't, two strings have met in one hash and are compared edit by edit.
    """
    if a is b:
        return False
    short = min(a.length, b.length)
    x, y = a.cut(short), b.cut(short)
    if x is y:
        return a.length < b.length
    if x.hash == y.hash:
        return a.text() < b.text()
    k = len(x.back)
    while k:
        k -= 1
        if k < len(x.back) and x.back[k].hash != y.back[k].hash:
            x, y = x.back[k], y.back[k]
    if x.back[0] is not y.back[0]:
        return a.text() < b.text()
    return x.edit < y.edit


def _moves() -> dict[tuple[str, bool, bool], list[tuple[int, int, str, int, int]]]:
    """(initial, must go, truncated) -> (state, turns inserted before, edit, next state, cost)."""
    moves = {}
    for initial in ("s", "u", "a", ""):
        for gone in (False, True):
            for cut in (False, True):
                found = []
                for start in range(STATES):
                    state = start
                    for inserted in range(3):
                        if inserted:
                            state = 3 if state == 2 else 2
                        paid = inserted * INSERT
                        found.append((start, inserted, "D", state, paid + DELETE))
                        if gone:
                            continue
                        paid += TRUNCATED * cut
                        for to, edit, cost in ((initial, "K", KEEP), ("u", "R", REROLE), ("a", "R", REROLE)):
                            if to in WRITES[state]:
                                found.append((start, inserted, edit, WRITES[state][to], paid + cost))
                moves[initial, gone, cut] = found
    return moves


MOVES = _moves()
BLANK, DUPLICATE, CUT = 1, 2, 3


class Audit:
    """All cheapest audits of consecutive turns that begin in one state: for every end state its cost and edits.

    Inserted turns stand before an edited turn, so the audits to two end states
    are never prefixes of each other, and audits of blocks can be joined.
    """

    def __init__(self, initials: Sequence[str], faults: Sequence[int], start: int, modulus: int = MODULUS):
        cells: list = [None] * STATES
        cells[start] = (0, [Prefix(None)])
        for initial, fault in zip(initials, faults):
            best: list = [None] * STATES
            key = (initial if initial in "sua" else "", fault in (BLANK, DUPLICATE), fault == CUT)
            made: dict = {}
            for state, inserted, edit, to, cost in MOVES[key]:
                if cells[state] is None:
                    continue
                paid, nodes = cells[state]
                paid += cost
                old = best[to]
                if old is not None and paid > old[0]:
                    continue
                move = (state, inserted, edit)
                if old is None or paid < old[0]:
                    best[to] = (paid, move)
                elif before(self._grown(move, nodes, made, modulus), self._grown(old[1], cells[old[1][0]][1], made, modulus)):
                    best[to] = (paid, move)
            cells = [
                None if b is None else (b[0], [self._grown(b[1], cells[b[1][0]][1], made, modulus)]) for b in best
            ]
        self.costs = [INFINITE if c is None else c[0] for c in cells]
        self.ends = [None if c is None else c[1][0] for c in cells]

    @staticmethod
    def _grown(move: tuple, nodes: list, made: dict, modulus: int) -> Prefix:
        """The prefix after a move; a state's inserted turns and edits are made once."""
        state, inserted, edit = move
        if move not in made:
            while len(nodes) <= inserted:  # nodes[i]: the state's prefix with i inserted turns
                nodes.append(Prefix(nodes[-1], "I", modulus))
            made[move] = Prefix(nodes[inserted], edit, modulus)
        return made[move]

    def ranks(self) -> list[int]:
        """Position of each end state's edits in ASCII order."""
        order: list[int] = []
        for state, node in enumerate(self.ends):
            if node is not None:
                at = sum(before(self.ends[o], node) for o in order)
                order.insert(at, state)
        return [order.index(s) if self.ends[s] is not None else STATES for s in range(STATES)]


def chain(costs: Sequence[Sequence[int]], ranks: Sequence[Sequence[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost and (entry, exit) state of every block, from their costs and ranks (16 each: entry x exit)."""
    ahead = [[n * INSERT for n in CLOSING]]
    for block in reversed(costs):
        ahead.append([min(block[p * STATES + q] + ahead[-1][q] for q in range(STATES)) for p in range(STATES)])
    ahead.reverse()
    state, path = 0, []
    for i, (block, rank) in enumerate(zip(costs, ranks)):
        at = state * STATES
        out = min(range(STATES), key=lambda q: (block[at + q] + ahead[i + 1][q], rank[at + q]))
        path.append((state, out))
        state = out
    return ahead[0][0], path


def apply(edits: str, rows: Sequence[tuple], start: int) -> list[tuple[str, str | None, str | None]]:
    """(edit, role, text) for every edit; role and text are null where the turn goes."""
    out, state, at = [], start, 0
    for edit in edits:
        if edit == "I":
            role, text = ("assistant" if state == 2 else "user"), ""
        else:
            role, text = rows[at]
            at += 1
            if edit == "R":
                role = "assistant" if state == 2 else "user"
        if edit == "D":
            out.append((edit, None, None))
        else:
            out.append((edit, role, text))
            state = WRITES[state][role[0]]
    return out
