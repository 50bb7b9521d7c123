"""A byte-pair tokenizer as a deterministic automaton over tokens.

Compilation starts from the automaton with one state per byte, every byte following every byte. Merge number
``m`` of ``(a, b)`` into ``c`` adds a gadget: a state ``c`` whose arcs in are those of ``a``, whose arcs out are
those of ``b``, and which takes the arc ``a -> b`` away, since from then on that path is spelled by ``c``. After
the last gadget an arc ``u -> t`` exists exactly if a tokenizer that applies the merges by rank, leftmost first,
can leave ``u`` beside ``t``; for each byte string one path is left, its tokenization.

The arc table of 50,000 states would be dense, so it is held as its gadgets: two arrays of parts and one table of
merges. An arc is looked up by undoing gadgets, latest first, and then kept in a table.

A pre-split word is encoded in one pass over its bytes, without going back: a byte takes a table of transitions from
one node to the next, a node being the longest end of what was read that begins some label, and a node names the
labels that end there, the longest first. The first of these that has an arc from the state of the prefix before it
is the state of the prefix it ends; a prefix has only one path, so no other could follow. Decoding emits the labels of
the arcs.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import regex

SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that the tables of words, arcs and transitions may hold before they start anew, and bytes of all words kept.
WORDS_KEPT, WORD_BYTES_KEPT = 400_000, 48 << 20
ARCS_KEPT = STEPS_KEPT = 500_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    letters.update({chr(256 + i): b for i, b in enumerate(rest)})
    return letters


class _Words(dict):
    """Packed ids of words, encoded when first asked for; a special token stands for itself."""

    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton, self.held = automaton, 0

    def __missing__(self, word: str | int) -> bytes:
        ids = [word] if isinstance(word, int) else self.automaton.encode_bytes(word.encode("utf-8"))
        packed = self[word] = array("i", ids).tobytes()
        self.held += len(packed) + (0 if isinstance(word, int) else len(word))
        return packed


class MergeAutomaton:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        spell = lambda token: bytes(letters[ch] for ch in token)
        vocab = model["vocab"]
        # States are numbered by time: bytes first, then one for each merge.
        self.ids = array("i", [0] * 256)
        self.state_of: dict[bytes, int] = {}
        for letter, byte in letters.items():
            self.ids[byte] = vocab[letter]
            self.state_of[bytes([byte])] = byte
        self.left, self.right = array("i", [-1] * 256), array("i", [-1] * 256)
        self._spelled = [bytes([b]) for b in range(256)]
        self.merge: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        known = {letter: byte for letter, byte in letters.items()}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(known[a], known[b], vocab[a + b], spell(a + b))
            known[a + b] = len(self.ids) - 1
        self._tables()
        self._spelled = []
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.labels[i] = spell(token)
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._split = regex.compile(SPLIT)
        self._words = _Words(self)

    def _gadget(self, a: int, b: int, token: int, label: bytes) -> None:
        c = len(self.ids)
        alive = self.state_of.get(self._spelled[a]) == a and self.state_of.get(self._spelled[b]) == b and self._path(a, b, c)
        self.ids.append(token)
        self.left.append(a)
        self.right.append(b)
        self.merge.setdefault(a << 20 | b, c)
        if alive:  # else no path is left that this gadget could shorten: the token can't occur
            self.state_of[label] = c
        self._spelled.append(label)

    def _path(self, u: int, t: int, limit: int) -> bool:
        """Does the arc u -> t exist among the gadgets before ``limit``? Undoes the later of both gadgets in turn."""
        merge, left, right = self.merge, self.left, self.right
        while True:
            c = merge.get(u << 20 | t)
            if c is not None and c < limit:
                return False
            if u > t:
                if u < 256:
                    return True
                limit, u = u, right[u]
            else:
                if t < 256:
                    return True
                limit, t = t + 1, left[t]

    def arc(self, u: int, t: int) -> bool:
        key = u << 20 | t
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            found = self.arcs[key] = self._path(u, t, 1 << 30)
        return found

    def _tables(self) -> None:
        """Transitions by bytes between the beginnings of labels, each one's longest proper end that is one too, and
        for each label the next shorter label that ends it."""
        edges: dict[int, int] = {}
        token_at, order = [-1], [(0, 0)]
        self.size, self.shorter = array("i", [0]) * len(self.ids), array("i", [-1]) * len(self.ids)
        for label, state in self.state_of.items():
            node = 0
            for byte in label:
                key = node << 8 | byte
                node = edges.get(key, 0)
                if not node:
                    node = edges[key] = len(token_at)
                    token_at.append(-1)
                    order.append((key >> 8, byte))
            token_at[node], self.size[state] = state, len(label)
        depth = [0] * len(token_at)
        for node in range(1, len(token_at)):
            depth[node] = depth[order[node][0]] + 1
        fail, ends = array("i", [0]) * len(token_at), array("i", [-1]) * len(token_at)
        for node in sorted(range(1, len(token_at)), key=depth.__getitem__):
            above, byte = order[node]
            back = fail[above]
            while above and back and (back << 8 | byte) not in edges:
                back = fail[back]
            fail[node] = edges.get(back << 8 | byte, 0) if above else 0
            ends[node] = ends[fail[node]]
            if token_at[node] >= 0:
                self.shorter[token_at[node]] = ends[fail[node]]
                ends[node] = token_at[node]
        self.edges, self.fail, self.ends, self.steps = edges, fail, ends, dict(edges)

    def _step(self, node: int, byte: int) -> int:
        """The node after a byte that continues no label from ``node``; kept in the table of transitions."""
        key, edges = node << 8 | byte, self.edges
        while node and (node << 8 | byte) not in edges:
            node = self.fail[node]
        if len(self.steps) >= len(edges) + STEPS_KEPT:
            self.steps = dict(edges)
        found = self.steps[key] = edges.get(node << 8 | byte, 0)
        return found

    def encode_bytes(self, word: bytes) -> list[int]:
        """Token ids of one pre-split word: the only path of the automaton that spells it."""
        whole = self.state_of.get(word)
        if whole is not None:
            return [self.ids[whole]]
        steps, ends, size, shorter, arcs, arc = self.steps, self.ends, self.size, self.shorter, self.arcs, self.arc
        states, node = [-1], 0
        for end, byte in enumerate(word, 1):
            following = steps.get(node << 8 | byte)
            if following is None:
                following = self._step(node, byte)
                steps = self.steps
            node = following
            t = ends[node]
            while True:
                before = states[end - size[t]]
                if before < 0:
                    break
                ok = arcs.get(before << 20 | t)
                if ok or (ok is None and arc(before, t)):
                    break
                t = shorter[t]
            states.append(t)
        out, end, ids = [], len(word), self.ids
        while end:
            t = states[end]
            out.append(ids[t])
            end -= size[t]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[str | int]:
        """Pre-split words of a text, and special tokens as their ids."""
        if self._special is None or "<|" not in text:
            return self._split.findall(text)
        out: list[str | int] = []
        for part in self._special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._split.findall(part)
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as native 32-bit integers; empty for null."""
        if not text:
            return b""
        if len(self._words) > WORDS_KEPT or self._words.held > WORD_BYTES_KEPT:
            self._words = _Words(self)
        return b"".join(map(self._words.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        """Labels of the arcs, one after another; bytes that aren't UTF-8 become the replacement character."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(path: str) -> MergeAutomaton:
    """The automaton of a vocabulary file, compiled once in each Python worker."""
    return MergeAutomaton(path)
