"""A minimal acyclic transducer from words to token ids, in flat arrays that are memory-mapped.

Built from words in order: each new word's output is pushed as far to the front as the words before allow, and states that
can't change any more are replaced by an equal one if there is one, so endings are shared. An arc holds a byte, a target and
a piece of output; a state may hold output to add where a word ends. The arcs of a state stand together, by byte.
"""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np


class _Node:
    __slots__ = ("arcs", "final", "out")

    def __init__(self):
        self.arcs: dict[int, list] = {}  # byte -> [node or its number, output]
        self.final, self.out = False, ()


def _common(a: tuple, b: tuple) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """entries: distinct non-empty words, sorted, each with its ids."""
    made: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(node: _Node) -> int:
        key = (node.final, node.out, tuple((b, *arc) for b, arc in node.arcs.items()))
        if key not in made:
            made[key] = len(frozen)
            frozen.append(key)
        return made[key]

    path, before = [_Node()], b""
    for word, ids in entries:
        shared = 0
        while shared < min(len(word), len(before)) and word[shared] == before[shared]:
            shared += 1
        while len(path) > shared + 1:  # what hangs below can't change any more
            node = path.pop()
            path[-1].arcs[before[len(path) - 1]][0] = freeze(node)
        for byte in word[shared:]:
            node = _Node()
            path[-1].arcs[byte] = [node, ()]
            path.append(node)
        path[-1].final = True
        rest = tuple(ids)
        for i in range(shared):  # what the arc can't keep goes on to what follows it
            arc, node = path[i].arcs[word[i]], path[i + 1]
            n = _common(arc[1], rest)
            push, arc[1] = arc[1][n:], arc[1][:n]
            if push:
                for later in node.arcs.values():
                    later[1] = push + later[1]
                if node.final:
                    node.out = push + node.out
            rest = rest[n:]
        if shared < len(word):
            path[shared].arcs[word[shared]][1] = rest
        else:
            path[shared].out = rest
        before = word
    while len(path) > 1:
        node = path.pop()
        path[-1].arcs[before[len(path) - 1]][0] = freeze(node)
    root = freeze(path[0])

    first, final, byte, target, arc_out, outs, place = [0], [], [], [], [], [], {}

    def output(ids: tuple) -> int:
        if ids not in place:
            place[ids] = len(outs)
            outs.extend((len(ids), *ids))
        return place[ids]

    output(())
    for is_final, out, arcs in frozen:
        final.append(output(out) if is_final else -1)
        for b, to, ids in arcs:
            byte.append(b), target.append(to), arc_out.append(output(ids))
        first.append(len(byte))
    parts = [np.array(x, np.int32) for x in (first, final, target, arc_out, outs)]
    head = np.array([root, *map(len, parts)], np.int32)
    return b"".join([x.tobytes() for x in (head, *parts)] + [bytes(byte)])


class Lexicon:
    """Look-up in a compiled lexicon. Its bytes are mapped from a file without a name in the executor's own temporary
    folder, a cache of the broadcast that is gone with the process."""

    def __init__(self, blob: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(blob)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, prot=mmap.PROT_READ)
        sizes = memoryview(self.map)[:24].cast("i")
        self.root, parts, at = sizes[0], [], 24
        for n in sizes[1:]:
            parts.append(memoryview(self.map)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.final, self.target, self.arc_out, self.outs = parts
        self.bytes_at = at
        self.arc_keys = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(np.frombuffer(self.first, np.int32))) * 256 + np.frombuffer(self.map, np.uint8, offset=at)

    def holds(self, words: list[bytes]) -> np.ndarray:
        """Which of the words are in the lexicon, all read at once, byte by byte."""
        if not len(self.arc_keys):
            return np.zeros(len(words), bool)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        target, final = np.frombuffer(self.target, np.int32), np.frombuffer(self.final, np.int32)
        state, left, at = np.full(len(words), self.root, np.int64), np.flatnonzero(lengths > 0), 0
        found = np.zeros(len(words), bool)
        while len(left):
            key = state[left] * 256 + flat[starts[left] + at]
            arc = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            known = self.arc_keys[arc] == key
            left, arc = left[known], arc[known]
            state[left] = target[arc]
            at += 1
            ends = lengths[left] == at
            found[left[ends]] = final[state[left[ends]]] >= 0
            left = left[~ends]
        return found

    def get(self, word: bytes) -> list[int] | None:
        """The ids of a word, None if it isn't in the lexicon."""
        state, ids = self.root, []
        first, find, base, target, arc_out, outs = self.first, self.map.find, self.bytes_at, self.target, self.arc_out, self.outs
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            if o := arc_out[arc]:
                ids += outs[o + 1 : o + 1 + outs[o]]
            state = target[arc]
        o = self.final[state]
        if o < 0:
            return None
        if o:
            ids += outs[o + 1 : o + 1 + outs[o]]
        return ids
