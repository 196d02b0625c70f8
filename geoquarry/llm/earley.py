"""Error-correcting Earley parsing under a weighted grammar.

A production has a cost and a letter for the audit.  Deletion, change of role and
insertion are productions like others: a deletion derives a token that the
sentence doesn't need, a change derives another token, an insertion derives
nothing.  Chart items hold the least (cost, audit) of their span; when a better
one is found, the item is taken up again, so a completed item is the cheapest
derivation, and of equally cheap ones the one whose audit is first in ASCII.

Least audits compose: two audits of one span and one cost never begin one with
the other, as what the longer one has besides would be insertions, which cost.
"""

from __future__ import annotations

from collections import defaultdict, deque
from functools import lru_cache
from typing import NamedTuple

KEEP, REROLE, DELETE, INSERT, FLAW = 0, 2, 3, 2, 1
#: Tokens: role initials (x: any other), upper case for a flawed text; d must go.
PLAIN, FLAWED, GO = "suax", "SUAX", "d"


class Production(NamedTuple):
    of: str
    #: Nonterminals by name, terminals as ``=`` and the tokens they match.
    body: tuple[str, ...]
    cost: int = 0
    letter: str = ""


def _says(name: str, initial: str) -> list[Production]:
    """A message of one role: kept, made of another role's, or inserted."""
    return [
        Production(name, (f"={initial}",), KEEP, "K"),
        Production(name, (f"={initial.upper()}",), KEEP + FLAW, "K"),
        Production(name, (f"={PLAIN}",), REROLE, "R"),
        Production(name, (f"={FLAWED}",), REROLE + FLAW, "R"),
        Production(name, (), INSERT, "I"),
    ]


#: What a prefix of a conversation can be, by the message that is due next.
OPEN, SYSTEM, ASKED, PAIRS = "open", "system", "asked", "pairs"
STATES, COMPLETE = (OPEN, SYSTEM, ASKED, PAIRS), (OPEN, PAIRS)

#: An optional system message and one or more pairs of user and assistant, or nothing; left-recursive, so a chart is linear in the tokens.
GRAMMAR = [
    Production(SYSTEM, (OPEN, "Instruct")),
    *(Production(ASKED, (before, "Ask")) for before in (OPEN, SYSTEM, PAIRS)),
    Production(PAIRS, (ASKED, "Answer")),
    *(Production(s, (s, "Drop")) for s in STATES),
    Production("Instruct", ("=s",), KEEP, "K"),
    Production("Instruct", ("=S",), KEEP + FLAW, "K"),
    *_says("Ask", "u"),
    *_says("Answer", "a"),
    Production("Drop", (f"={PLAIN}{FLAWED}{GO}",), DELETE, "D"),
]

_BY_NAME: dict[str, list[int]] = defaultdict(list)
for _i, _p in enumerate(GRAMMAR):
    _BY_NAME[_p.of].append(_i)

Least = tuple[int, str]
#: Conversations of up to so many rows are remembered, as their tokens recur.
SHORT = 24


def parse(tokens: str, start: str = OPEN) -> dict[str, Least]:
    """The least (cost, audit) with which ``tokens`` lead from the prefix ``start`` to each of STATES that can be reached."""
    return _known(tokens, start) if len(tokens) <= SHORT else _parse(tokens, start)


def _parse(tokens: str, start: str) -> dict[str, Least]:
    chart: list[dict[tuple[int, int, int], Least]] = [{} for _ in range(len(tokens) + 1)]
    waiting: list[dict[str, set]] = [defaultdict(set) for _ in chart]
    found: dict[str, Least] = {}
    for k, column in enumerate(chart):
        whole: dict[tuple[str, int], Least] = {}
        agenda = deque(column)

        def offer(item: tuple[int, int, int], value: Least, column=column, agenda=agenda) -> None:
            if item not in column or value < column[item]:
                column[item] = value
                agenda.append(item)

        def complete(name: str, origin: int, value: Least, whole=whole, offer=offer) -> None:
            if (name, origin) in whole and whole[name, origin] <= value:
                return
            whole[name, origin] = value
            for p, dot, begun in list(waiting[origin][name]):
                cost, audit = chart[origin][p, dot, begun]
                offer((p, dot + 1, begun), (cost + value[0], audit + value[1]))

        if k == 0:
            for s in STATES:
                for p in _BY_NAME[s]:
                    offer((p, 0, 0), (0, ""))
            whole[start, 0] = (0, "")
        while agenda:
            item = agenda.popleft()
            p, dot, origin = item
            rule, (cost, audit) = GRAMMAR[p], column[item]
            if dot == len(rule.body):
                complete(rule.of, origin, (cost + rule.cost, audit + rule.letter))
                continue
            due = rule.body[dot]
            if due[0] == "=":
                if k < len(tokens) and tokens[k] in due[1:]:
                    chart[k + 1][p, dot + 1, origin] = (cost, audit)
                continue
            waiting[k][due].add(item)
            for q in _BY_NAME[due]:
                if due not in STATES:
                    offer((q, 0, k), (0, ""))
            if (due, k) in whole:
                c, a = whole[due, k]
                offer((p, dot + 1, origin), (cost + c, audit + a))
        found = {s: whole[s, 0] for s in STATES if (s, 0) in whole}
    return found


_known = lru_cache(maxsize=20_000)(_parse)
