"""Error-correcting Earley parsing of roles by a weighted grammar.

The grammar is left-linear: a state is what has been accepted so far.  ``Begin``
is nothing, ``AfterSystem`` an opening system turn, ``AfterUser`` an open pair,
``AfterPair`` whole pairs; ``Begin`` and ``AfterPair`` are accepted, which is
``(s?(ua)+)?``.  Edits are productions with a cost and a letter: a turn is kept
(K), gets the other role (R), is deleted (D), or an empty one is inserted (I).

A chart item (rule, dot, origin) holds its least (cost, audit), the audit being
the letters since its origin.  Two derivations of one item with equal costs
never have one audit as the beginning of the other, as what would follow it
adds an insertion's cost; so the least of each part makes the least whole, and
also rows may be parsed in parts: from each state that can hold before a part
to each that can hold after it.
"""

from __future__ import annotations

from functools import lru_cache

STATES = ("Begin", "AfterSystem", "AfterUser", "AfterPair")
ACCEPTED = ("Begin", "AfterPair")
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
#: (left side, right side, cost, letter).  Small words are terminals.
RULES = (
    ("AfterSystem", ("Begin", "System"), 0, ""),
    ("AfterUser", ("Begin", "User"), 0, ""),
    ("AfterUser", ("AfterSystem", "User"), 0, ""),
    ("AfterUser", ("AfterPair", "User"), 0, ""),
    ("AfterPair", ("AfterUser", "Assistant"), 0, ""),
    *((s, (s, "Gone"), 0, "") for s in STATES),
    ("System", ("s",), 0, "K"),
    ("User", ("u",), 0, "K"),
    ("User", ("any",), REROLE_COST, "R"),
    ("User", (), INSERT_COST, "I"),
    ("Assistant", ("a",), 0, "K"),
    ("Assistant", ("any",), REROLE_COST, "R"),
    ("Assistant", (), INSERT_COST, "I"),
    ("Gone", ("deleted",), DELETE_COST, "D"),
)
OF: dict[str, list[int]] = {}
for _i, _r in enumerate(RULES):
    OF.setdefault(_r[0], []).append(_i)
Best = tuple[int, str]


def terminal_cost(symbol: str, terminal: str) -> int | None:
    """What reading ``symbol`` as ``terminal`` costs, None: it can't.  A symbol
    is a role's initial (``.``: any other), a capital (``!``) where the turn is
    truncated, ``x`` where it has to be deleted."""
    if terminal == "deleted":
        return 0
    if symbol == "x":
        return None
    cut = symbol.isupper() or symbol == "!"
    return (TRUNCATED_COST if cut else 0) if terminal == "any" or symbol.lower() == terminal else None


def parse(symbols: str, entry: str = "Begin") -> dict[str, Best]:
    """The least (cost, audit) from state ``entry`` to each state after
    ``symbols``."""
    columns: list[dict[tuple[int, int, int], Best]] = []
    waiting: list[dict[str, list[tuple[int, int, int]]]] = []
    ended: dict[tuple[str, int], Best] = {}
    seeds: list[tuple[tuple[int, int, int], Best]] = []
    for j in range(len(symbols) + 1):
        items: dict[tuple[int, int, int], Best] = {}
        wait: dict[str, list[tuple[int, int, int]]] = {}
        ended, agenda, predicted = {}, [], set()
        columns.append(items)
        waiting.append(wait)

        def put(item: tuple[int, int, int], value: Best) -> None:
            if item not in items or value < items[item]:
                items[item] = value
                agenda.append(item)

        def complete(name: str, origin: int, value: Best) -> None:
            if (name, origin) in ended and ended[name, origin] <= value:
                return
            ended[name, origin] = value
            for r, d, o in waiting[origin].get(name, ()):
                c, a = columns[origin][r, d, o]
                put((r, d + 1, o), (c + value[0], a + value[1]))

        def predict(name: str) -> None:
            if name not in predicted:
                predicted.add(name)
                for r in OF[name]:
                    put((r, 0, j), (0, ""))

        if j == 0:
            for s in STATES:
                predict(s)
            complete(entry, 0, (0, ""))  # the axiom: nothing of this part, in the state before it
        for item, value in seeds:
            put(item, value)
        while agenda:
            item = agenda.pop()
            r, d, o = item
            left, right, cost, letter = RULES[r]
            c, a = items[item]
            if d == len(right):
                complete(left, o, (c + cost, a + letter))
            elif right[d] in OF:
                name = right[d]
                if item not in wait.setdefault(name, []):
                    wait[name].append(item)
                predict(name)
                if (name, j) in ended:
                    v = ended[name, j]
                    put((r, d + 1, o), (c + v[0], a + v[1]))
        seeds = []
        if j < len(symbols):
            for (r, d, o), (c, a) in items.items():
                right = RULES[r][1]
                if d < len(right) and right[d] not in OF:
                    more = terminal_cost(symbols[j], right[d])
                    if more is not None:
                        seeds.append(((r, d + 1, o), (c + more, a)))
        if j > 1:  # only the first column and the last have items that later ones need
            columns[j - 1], waiting[j - 1] = {}, {}
    return {s: ended[s, 0] for s in STATES if (s, 0) in ended}


@lru_cache(maxsize=50_000)
def parse_short(symbols: str, entry: str = "Begin") -> tuple[tuple[str, Best], ...]:
    return tuple(parse(symbols, entry).items())


def transfers(symbols: str, entry: str = "Begin") -> dict[str, Best]:
    """``parse``, remembered for short runs, which repeat a lot."""
    return dict(parse_short(symbols, entry)) if len(symbols) <= 32 else parse(symbols, entry)


def accepted(ways: dict[str, Best]) -> Best:
    """The cheapest way to an accepted state: the completed chart's repair."""
    return min(ways[s] for s in ACCEPTED if s in ways)


def edits(symbols: str, audit: str, entry: str = "Begin") -> list[tuple[int, str]]:
    """(row, what) of each turn that the audit leaves: ``k`` as it is, ``u`` or
    ``a`` with that role, ``U`` or ``A`` an inserted one before that row."""
    out, state, i = [], entry, 0
    for x in audit:
        if x == "D":
            i += 1
            continue
        user = state != "AfterUser"
        if x == "I":
            out.append((i, "U" if user else "A"))
        else:
            opening = x == "K" and symbols[i].lower() == "s"
            out.append((i, "k" if x == "K" else "u" if user else "a"))
            i += 1
            if opening:
                state = "AfterSystem"
                continue
        state = "AfterUser" if user else "AfterPair"
    return out
