"""Minimal acyclic transducers: sorted byte strings to lexicographic ordinals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """Arrays of a minimal deterministic acyclic automaton whose outputs add up to a term's ordinal.

    State 0 is the root.  ``keys``: state * 256 + byte of every arc, ascending;
    ``target`` and ``output`` (accepted strings that sort before the arc, from
    its state) follow it; ``final`` marks accepting states.
    """

    FIELDS = ("keys", "target", "output", "final")

    def __init__(self, keys: np.ndarray, target: np.ndarray, output: np.ndarray, final: np.ndarray):
        self.keys, self.target, self.output, self.final = keys, target, output, final

    def to_bytes(self) -> bytes:
        parts = [self.keys.astype("<i8").tobytes(), self.target.astype("<i8").tobytes(), self.output.astype("<i8").tobytes(), self.final.astype("u1").tobytes()]
        return np.array([len(self.keys), len(self.final)], "<i8").tobytes() + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        arcs, states = np.frombuffer(data, "<i8", 2)
        a = np.frombuffer(data, "<i8", 3 * arcs, 16)
        return cls(a[:arcs], a[arcs:2 * arcs], a[2 * arcs:], np.frombuffer(data, "u1", states, 16 + 24 * arcs).astype(bool))


def build(terms: Iterable[bytes]) -> Transducer:
    """Build from strictly ascending byte strings, keeping only the last term's path unfrozen.

    When a term leaves the path of the one before, the states it leaves are
    final in shape: each is replaced by an equal registered state (same
    finality, same arcs) or registered, so the automaton is minimal at all times.
    """
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []  # (final, ((byte, state), ...), accepted strings)

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        shape = (final, tuple(arcs))
        at = register.get(shape)
        if at is None:
            at = register[shape] = len(frozen)
            frozen.append((*shape, final + sum(frozen[s][2] for _, s in arcs)))
        return at

    path: list[list] = [[False, []]]  # open states of the last term's path: finality, frozen arcs
    last = b""
    for n, term in enumerate(terms):
        if n and term <= last:
            raise ValueError("terms must ascend")
        shared = 0
        for x, y in zip(last, term):
            if x != y:
                break
            shared += 1
        for depth in range(len(last), shared, -1):
            done = path.pop()
            path[-1][1].append((last[depth - 1], freeze(*done)))
        path += [[False, []] for _ in range(len(term) - shared)]
        path[-1][0] = True
        last = term
    for depth in range(len(last), 0, -1):
        done = path.pop()
        path[-1][1].append((last[depth - 1], freeze(*done)))
    root_final, root_arcs = path[0]
    # the root comes first, the others keep their registration order
    keys, target, output, final = [], [], [], [root_final]
    for number, (is_final, arcs) in enumerate([(root_final, tuple(root_arcs)), *((f, a) for f, a, _ in frozen)]):
        before = int(is_final)
        for byte, s in arcs:
            keys.append(number * 256 + byte)
            target.append(s + 1)
            output.append(before)
            before += frozen[s][2]
        if number:
            final.append(is_final)
    return Transducer(np.array(keys, np.int64), np.array(target, np.int64), np.array(output, np.int64), np.array(final, bool))


class Vocabulary:
    """Transducers of consecutive term ranges of each language, walked by many terms at once."""

    def __init__(self, shards: list[tuple[str, int, int, bytes, bytes]]):
        """``shards``: (language, ordinal of the first term, number of terms, first term, transducer bytes), consecutive in each language."""
        self.langs: dict[str, tuple] = {}
        self.spans: dict[str, range] = {}
        for lang in {s[0] for s in shards}:
            mine = sorted(s[1:] for s in shards if s[0] == lang)
            self.spans[lang] = range(mine[0][0], mine[-1][0] + mine[-1][1])
            each = [Transducer.from_bytes(data) for *_, data in mine]
            roots = np.cumsum([0] + [len(t.final) for t in each])
            self.langs[lang] = (
                [first for _, _, first, _ in mine], np.array([base for base, *_ in mine], np.int64), roots[:-1],
                np.concatenate([t.keys + r * 256 for t, r in zip(each, roots)]), np.concatenate([t.target + r for t, r in zip(each, roots)]),
                np.concatenate([t.output for t in each]), np.concatenate([t.final for t in each]))

    def ordinals(self, lang: str, terms: list[bytes]) -> np.ndarray:
        """Ordinal of each term in its language; -1 for terms outside this vocabulary."""
        out = np.full(len(terms), -1, np.int64)
        if lang not in self.langs or not terms:
            return out
        firsts, bases, roots, keys, target, output, final = self.langs[lang]
        shard = np.searchsorted(np.array(firsts, dtype=object), np.array(terms, dtype=object), side="right") - 1
        size = np.array([len(t) for t in terms], np.int64)
        start = np.cumsum(size) - size
        text = np.frombuffer(b"".join(terms), np.uint8).astype(np.int64)
        at = np.flatnonzero(shard >= 0)
        state, total = roots[shard[at]], bases[shard[at]]
        i = 0
        while len(at):
            ended = size[at] == i
            good = ended & final[state]
            out[at[good]] = total[good]
            at, state, total = at[~ended], state[~ended], total[~ended]
            if not len(at) or not len(keys):
                break
            want = state * 256 + text[start[at] + i]
            arc = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            found = keys[arc] == want
            at, arc = at[found], arc[found]
            state, total = target[arc], total[found] + output[arc]
            i += 1
        return out

    def term(self, lang: str, ordinal: int) -> bytes | None:
        """The term of an ordinal (the last arc whose output does not pass it, state by state); None outside this vocabulary."""
        if ordinal not in self.spans.get(lang, ()):
            return None
        _, bases, roots, keys, target, output, final = self.langs[lang]
        s = int(np.searchsorted(bases, ordinal, side="right")) - 1
        state, left, out = int(roots[s]), ordinal - int(bases[s]), bytearray()
        while left > 0 or not final[state]:
            a, b = np.searchsorted(keys, [state * 256, state * 256 + 256])
            arc = a + int(np.searchsorted(output[a:b], left, side="right")) - 1
            left -= int(output[arc])
            out.append(int(keys[arc]) & 255)
            state = int(target[arc])
        return bytes(out)
