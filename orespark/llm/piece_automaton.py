"""A byte-pair tokenizer compiled into a deterministic transducer whose transitions carry token counts.

Greedy merging has two properties that make it finite-state. The tokens of a text's beginning that end at a boundary of its
tokens don't change with what follows, and a row of tokens is the tokenizer's own if each two neighbours are. So the last
token of every beginning is the one token that ends there and agrees with the last token of the beginning before it. Which
that is depends only on the longest suffix that begins a vocabulary entry and on the last tokens at the boundaries inside
it: that is a state. A transition reads one character and carries the change in the number of tokens, so the count of a
text is the sum along its path. States are made when a text first needs them.

A chunk of a text is a map from states to states with counts, and it is known for the start state as soon as the chunk is
read. From any other state the path runs into that of the start state: at the latest where white space follows something else,
for no entry holds that inside, mostly after a few characters. So another state's value is found by following both paths
until they meet. Such maps compose, and composition is associative; chunks may be read in any order and anywhere.
"""

from __future__ import annotations

import heapq
import re

from .common import Kept

SPACE = "▁"
#: States after which the tables are dropped and made anew.
MOST_STATES = 250_000
NEVER = float("-inf")


def merged(symbols: list[str], score: dict[str, float]) -> list[str]:
    """Merge neighbours whose concatenation is an entry, best score first, then leftmost."""
    if len(symbols) <= 24:  # quicker than a heap
        part = list(symbols)
        while len(part) > 1:
            best, at = max(((score.get(part[i] + part[i + 1], NEVER), -i) for i in range(len(part) - 1)))
            if best == NEVER:
                break
            part[-at : 2 - at] = [part[-at] + part[1 - at]]
        return part
    left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    part: list[str | None] = list(symbols)
    heap = [(-score[part[i] + part[i + 1]], i, part[i] + part[i + 1]) for i in range(len(part) - 1) if part[i] + part[i + 1] in score]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = right[i] if part[i] is not None else -1
        if j < 0 or part[i] + part[j] != whole:
            continue
        part[i], part[j] = whole, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b >= 0 and (both := part[a] + part[b]) in score:
                heapq.heappush(heap, (-score[both], a, both))
    return [p for p in part if p is not None]


class State(dict):
    """Transitions by character: (next state, change of the count). suffix: what may still grow into an entry; last: for
    each boundary inside it, from its start, the last token there and the count relative to the count here; None where no
    entry can start."""

    __slots__ = ("suffix", "last")


class PieceAutomaton:
    def __init__(self, score: dict[str, float]):
        """score: of each entry that text can become; characters outside it take a token for each of their bytes."""
        self.score = score
        self.begins = {p[:i] for p in score for i in range(1, len(p) + 1)}
        # where equal scores leave the order of merges to the place, neighbours don't decide: such entries hold only spaces
        self.whole: dict[str, bool] = {}
        self.agree: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("", (("", 0),))

    def state(self, suffix: str, last: tuple) -> State:
        found = self.states.get((suffix, last))
        if found is None:
            found = State()
            found.suffix, found.last = suffix, last
            self.states[suffix, last] = found
        return found

    def token(self, piece: str) -> bool:
        if piece not in self.whole:
            self.whole[piece] = piece in self.score and (len(piece) == 1 or merged(list(piece), self.score) == [piece])
        return self.whole[piece]

    def neighbours(self, a: str, b: str) -> bool:
        if (a, b) not in self.agree:
            if len(self.agree) > 1_000_000:
                self.agree.clear()
            self.agree[a, b] = merged(list(a + b), self.score) == [a, b]
        return self.agree[a, b]

    def step(self, state: State, ch: str) -> tuple[State, int]:
        """The transition of ``state`` on ``ch``, made and kept."""
        if ch not in self.score:
            out = (self.start, len(ch.encode()))
            state[ch] = out
            return out
        text, last = state.suffix + ch, state.last
        for at in range(len(text)):  # longest first: at most one agrees
            piece = text[at:]
            if piece in self.score and last[at] and self.token(piece) and (not last[at][0] or self.neighbours(last[at][0], piece)):
                break
        else:
            raise ValueError("these entries and scores are not those of a byte-pair tokenizer")
        change = last[at][1] + 1
        cut = next((k for k in range(len(text)) if text[k:] in self.begins), len(text))
        window = [(w[0], w[1] - change) if text[k:] in self.begins else None for k, w in enumerate(last[cut:], cut)]
        out = (self.state(text[cut:], (*window, (piece, 0))), change)
        state[ch] = out
        return out

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for ch in text:
            state, n = state.get(ch) or self.step(state, ch)
            total += n
        return state, total


class ChunkMap:
    """What a chunk does to a state. ``head`` is what it holds before its first meeting place (``met``: it has one), all of it if
    it has none; the start state leads to ``exit`` with ``count`` tokens."""

    def __init__(self, auto: PieceAutomaton, head: str, met: bool, exit: State, count: int):
        self.auto, self.head, self.met, self.exit, self.count = auto, head, met, exit, count

    def __call__(self, state: State) -> tuple[State, int]:
        known, step = self.auto.start, self.auto.step
        if state is known:
            return self.exit, self.count
        total = beside = 0
        for ch in self.head:
            state, n = state.get(ch) or step(state, ch)
            known, m = known.get(ch) or step(known, ch)
            total, beside = total + n, beside + m
            if state is known:
                return self.exit, total + self.count - beside
        return (self.exit, total + self.count - beside) if self.met else (state, total)


class Composed:
    """First one map, then another."""

    def __init__(self, first, second):
        self.first, self.second = first, second
        self.exit, n = second(first.exit)
        self.count = first.count + n

    def __call__(self, state: State) -> tuple[State, int]:
        state, n = self.first(state)
        if state is self.first.exit:
            return self.exit, n + self.count - self.first.count
        state, m = self.second(state)
        return state, n + m


def scan(maps: list):
    """The composition of maps in a row, by pairs: each round halves their number."""
    while len(maps) > 1:
        maps = [Composed(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


class Words(Kept):
    """Tokens of a word that the start state meets, a space before it."""

    def __init__(self, auto: PieceAutomaton):
        super().__init__()
        self.auto = auto

    def make(self, word: str) -> int:
        return self.auto.run(self.auto.start, SPACE + word)[1]


class Counter:
    """Tokens of texts, by maps of their chunks."""

    MEET = re.compile(f"(?<!{SPACE})(?={SPACE})")

    def __init__(self, score: dict[str, float]):
        self.auto = PieceAutomaton(score)
        self.words = Words(self.auto)

    def spelt(self, text: str, begins: bool = True) -> str:
        """The text as entries spell it; ``begins`` tells whether it is the beginning of one."""
        return SPACE * begins + text.replace(" ", SPACE)

    def chunk(self, text: str) -> ChunkMap:
        """text: as entries spell it."""
        auto = self.auto
        meet = self.MEET.search(text, 1) if text else None
        if not meet:
            return ChunkMap(auto, text, False, *auto.run(auto.start, text))
        head, body = text[: meet.start()], text[meet.start() :]
        parts = self.MEET.split(body)[1:] if SPACE * 2 in body else None
        if parts is None:
            parts = body.split(SPACE)
            tail = SPACE + parts.pop()
            count = sum(map(self.words.__getitem__, parts[1:]))
        else:
            tail = parts.pop()
            count = sum(auto.run(auto.start, p)[1] for p in parts)
        state, n = auto.run(auto.start, tail)
        first = self.words[head[1:]] if head[0] == SPACE and SPACE not in head[1:] else auto.run(auto.start, head)[1]
        return ChunkMap(auto, head, True, state, first + count + n)

    def read(self, text: str, chunk: int) -> ChunkMap:
        """The map of a text that entries spell like this, of any length, read chunk by chunk."""
        whole = scan([self.chunk(text[i : i + chunk]) for i in range(0, max(1, len(text)), chunk)])
        if isinstance(whole, ChunkMap):
            return whole
        meet = self.MEET.search(text, 1)
        return ChunkMap(self.auto, text[: meet.start()] if meet else text, bool(meet), whole.exit, whole.count)

    def rest(self) -> None:
        """Drop the states if there are too many. Maps made before don't go with those made after."""
        if len(self.auto.states) > MOST_STATES:
            self.auto.reset()

    def count(self, text: str, chunk: int) -> int:
        if not text:
            return 0
        self.rest()
        return self.read(self.spelt(text), chunk).count
