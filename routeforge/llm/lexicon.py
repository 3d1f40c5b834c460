"""A minimal acyclic transducer: frequent words to id runs, as flat arrays that are mapped from a file.

Words are added in order of their bytes. States with equal futures are one state (suffixes are shared), every arc
carries the number of words that sort before those behind it, and the sum along a word's path is its place in
the table of id runs. Lookups take a step for all words of a batch at once.
"""

from __future__ import annotations

import json

import numpy as np

_MAGIC = b"RFLX\x01"


class _State:
    __slots__ = ("arcs", "final", "number", "words")

    def __init__(self) -> None:
        self.arcs: dict[int, _State] = {}
        self.final = False
        self.number = -1
        self.words = 0


def _minimal(words: list[bytes]) -> tuple[_State, list[_State]]:
    """The root and all states, made from distinct words in byte order."""
    root, register, states = _State(), {}, []
    path: list[tuple[_State, int, _State]] = []  # the last word's states, not yet shared

    def settle(down_to: int) -> None:
        while len(path) > down_to:
            parent, label, child = path.pop()
            key = (child.final, *((b, s.number) for b, s in child.arcs.items()))
            known = register.get(key)
            if known is None:
                child.number = len(states)
                child.words = child.final + sum(s.words for s in child.arcs.values())
                register[key] = child
                states.append(child)
            else:
                parent.arcs[label] = known

    last = b""
    for word in words:
        common = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            common += 1
        settle(common)
        state = path[-1][2] if path else root
        for label in word[common:]:
            state.arcs[label] = child = _State()
            path.append((state, label, child))
            state = child
        state.final = True
        last = word
    settle(0)
    root.number = len(states)
    states.append(root)
    return root, states


def compile_lexicon(runs: dict[bytes, list[int]]) -> bytes:
    """The transducer of ``runs`` (word to ids) as the content of a file."""
    words = sorted(runs)
    root, states = _minimal(words)
    keys, targets, outputs = [], [], []
    final = np.zeros(len(states), np.uint8)
    for state in states:
        final[state.number] = state.final
        before = int(state.final)
        for label, target in sorted(state.arcs.items()):
            keys.append(state.number * 256 + label)
            targets.append(target.number)
            outputs.append(before)
            before += target.words
    sizes = np.array([len(runs[w]) for w in words], np.int64)
    parts = {
        "keys": np.array(keys, "<i8"),
        "targets": np.array(targets, "<i4"),
        "outputs": np.array(outputs, "<i4"),
        "final": final,
        "sizes": sizes.astype("<i4"),
        "ids": np.array([i for w in words for i in runs[w]], "<u4"),
    }
    out, at, table = [], 0, []
    for name, a in parts.items():
        pad = -at % 8
        out.append(b"\x00" * pad + a.tobytes())
        table.append([name, a.dtype.str, len(a), at + pad])
        at += pad + a.nbytes
    head = json.dumps({"root": root.number, "arrays": table}).encode()
    head += b" " * (-(len(head) + 9) % 8)
    return _MAGIC + len(head).to_bytes(4, "little") + head + b"".join(out)


class Lexicon:
    """A compiled lexicon. Opened from a file, its arrays are mapped: workers of a machine share the pages."""

    def __init__(self, data):
        if bytes(data[:5]) != _MAGIC:
            raise ValueError("not a lexicon file of this format")
        base = 9 + int.from_bytes(bytes(data[5:9]), "little")
        head = json.loads(bytes(data[9:base]))
        self.root = head["root"]
        for name, kind, n, at in head["arrays"]:
            setattr(self, name, np.frombuffer(data, kind, n, base + at))
        self.sizes = self.sizes.astype(np.int64)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, np.uint8, "r"))

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the table of runs, -1 for words it does not have."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        open_ = np.arange(len(words))
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(open_):
            ends = lengths[open_] == step
            done = open_[ends]
            out[done] = np.where(self.final[state[done]] == 1, total[done], -1)
            open_ = open_[~ends]
            keys = state[open_] * 256 + data[starts[open_] + step]
            arc = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[arc] == keys
            open_, arc = open_[there], arc[there]
            state[open_] = self.targets[arc]
            total[open_] += self.outputs[arc]
            step += 1
        return out
