"""Weighted finite-state transducers over clauses: states, arcs and weights as data, composed by states' pairs.

A clause is a row of word classes. Four transducers rewrite it one after the other: the target machine marks insults and
threats of clauses that name a target, the negation machine those that a negation reaches, the report machine those of
clauses that report what was said, and the pattern machine turns marked symbols into kinds of matches with the weight of
their marks. `MACHINE` is their composition. A lexicon stands before it as a transducer of one state that reads words and
writes classes with weights; it is composed on the fly, as its alphabet is open. Weights add along a path (tropical
semiring), and the heaviest path of a clause is its reading.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = CLASSES = ("other", "target", "negation", "report", "threat", "insult")
HITS = (INSULT, THREAT)
#: Marks that machines put behind a hit.
AT, NOT, SAID = "@", "~", '"'
#: Words that a negation reaches over.
REACH = 3
#: What a mark adds to a hit's weight.
MARK_WEIGHT = {AT: 0.5, NOT: -2.0, SAID: -1.5}
#: Kinds of matches by what counts most: reported, negated, at a target, plain.
KINDS = tuple(f"{h}:{k}" for h in HITS for k in ("plain", "aimed", "negated", "reported"))
SKIP = ""


@dataclass
class Transducer:
    """arcs[state][symbol read] = [(symbol written, weight, next state)]; final states with their weights."""

    start: int = 0
    final: dict[int, float] = field(default_factory=dict)
    arcs: dict[int, dict[str, list[tuple[str, float, int]]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))

    def arc(self, source: int, read: str, write: str, target: int, weight: float = 0.0) -> None:
        self.arcs[source][read].append((write, weight, target))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what first reads and writes what second writes of first's output; states that reach no final one are left out."""
    out = Transducer()
    number = {(first.start, second.start): 0}
    todo = [(first.start, second.start)]
    while todo:
        p, q = pair = todo.pop()
        if p in first.final and q in second.final:
            out.final[number[pair]] = first.final[p] + second.final[q]
        for read, arcs in first.arcs[p].items():
            for between, u, p2 in arcs:
                for write, v, q2 in second.arcs[q].get(between, ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = len(number)
                        todo.append((p2, q2))
                    out.arc(number[pair], read, write, number[p2, q2], u + v)
    alive = set(out.final)
    while True:
        more = {s for s, by in out.arcs.items() if s not in alive and any(t in alive for arcs in by.values() for _, _, t in arcs)}
        if not more:
            break
        alive |= more
    trimmed = Transducer(final=out.final)
    for s, by in out.arcs.items():
        for read, arcs in by.items():
            for write, w, t in arcs:
                if s in alive and t in alive:
                    trimmed.arc(s, read, write, t, w)
    return trimmed


def _mentions(word: str, mark: str, symbols: tuple[str, ...]) -> Transducer:
    """Marks hits where `word` stands anywhere in the clause: the machine guesses at the start and must be right at the end."""
    t = Transducer(final={0: 0.0, 2: 0.0, 3: 0.0})
    without, awaited, seen = 2, 1, 3
    for source, free, bound in ((0, without, awaited), (without, without, None), (awaited, None, awaited), (seen, None, seen)):
        for s in symbols:
            hit = s.startswith(HITS)
            if s == word:
                if source != without:
                    t.arc(source, s, OTHER, seen)
                continue
            if free is not None:
                t.arc(source, s, s, free)
            if bound is not None:
                t.arc(source, s, s + mark if hit else s, bound)
    return t


def _negations(symbols: tuple[str, ...]) -> Transducer:
    """Marks hits among the REACH words after a negation."""
    t = Transducer(final={s: 0.0 for s in range(REACH + 1)})
    for left in range(REACH + 1):
        for s in symbols:
            if s == NEGATION:
                t.arc(left, s, OTHER, REACH)
            else:
                t.arc(left, s, s + NOT if left and s.startswith(HITS) else s, max(0, left - 1))
    return t


def _patterns(symbols: tuple[str, ...]) -> Transducer:
    """One state: marked hits to kinds of matches, all else to nothing."""
    t = Transducer(final={0: 0.0})
    for s in symbols:
        if s.startswith(HITS):
            hit, marks = s.rstrip(AT + NOT + SAID), s.lstrip("abcdefghijklmnopqrstuvwxyz")
            kind = "reported" if SAID in marks else "negated" if NOT in marks else "aimed" if AT in marks else "plain"
            t.arc(0, s, f"{hit}:{kind}", 0, sum(MARK_WEIGHT[m] for m in marks))
        else:
            t.arc(0, s, SKIP, 0)
    return t


def _marked(symbols: tuple[str, ...], mark: str, drop: str) -> tuple[str, ...]:
    """What a machine may write: the symbols, hits with a mark too, without the class that it uses up."""
    return tuple(s for s in symbols if s != drop) + tuple(s + mark for s in symbols if s.startswith(HITS))


def stages() -> list[Transducer]:
    """The clause machines in the order in which they are composed."""
    after_target = _marked(CLASSES, AT, TARGET)
    after_negation = _marked(after_target, NOT, NEGATION)
    after_report = _marked(after_negation, SAID, REPORT)
    return [_mentions(TARGET, AT, CLASSES), _negations(after_target), _mentions(REPORT, SAID, after_negation), _patterns(after_report)]


def composed() -> Transducer:
    out, *rest = stages()
    for t in rest:
        out = compose(out, t)
    return out


MACHINE = composed()


def read_clause(words: list[tuple[int, str]], lexicon: Callable[[str], list[tuple[str, float]]], machine: Transducer = MACHINE) -> tuple[float, list[tuple[str, float, str]]]:
    """Weight and matches (kind, weight, word) of a clause's heaviest path; ties go to the path found first.

    words: (others before it, word) of every word that the lexicon gives a class; the lexicon has weighted classes of a word,
    `other` with 0 among them or not. Others change no state any more once REACH of them have passed.
    """
    best: dict[int, tuple[float, tuple]] = {machine.start: (0.0, ())}

    def step(options: list[tuple[str, float]], word: str) -> None:
        nonlocal best
        now: dict[int, tuple[float, tuple]] = {}
        for state, (total, back) in best.items():
            by = machine.arcs.get(state)
            for symbol, weight in options if by else ():
                for write, more, target in by.get(symbol, ()):
                    value = total + (weight + more if write else weight)
                    if target not in now or value > now[target][0]:
                        now[target] = (value, (back, write, weight + more, word) if write else back)
        best = now

    other = [(OTHER, 0.0)]
    for before, word in words:
        for _ in range(min(before, REACH + 1)):
            step(other, "")
        step(lexicon(word), word)
    ends = [(total + machine.final[s], back) for s, (total, back) in best.items() if s in machine.final]
    total, back = max(ends, key=lambda x: x[0])
    matches = []
    while back:
        back, kind, weight, word = back
        matches.append((kind, weight, word))
    return total, matches[::-1]
