"""BPE as an automaton over tokens, built from the merges one gadget at a time.

The automaton accepts a sequence of tokens exactly if BPE can produce it. It starts with one
state whose arcs are the single characters. The merge gadget of rule t, (a, b) -> c, does
three things:

- the state behind every arc a is replaced by a copy that has no arc b, as a followed by b
  would have been merged;
- every state that has an arc a, and an arc b behind it, gets an arc c to where that b led;
- so c is missing wherever a was missing up to then, and what is missing behind c is what was
  missing behind b when the rule was added (later gadgets on b don't reach it).

Hence a state is a token with a time: "b as it was before rule t", plus the arcs that rules
(c, x) after t took away. The gadgets are kept in that form, as three tables with one row a
rule. Whether a state has an arc is read off them, and remembered; the automaton is
deterministic, and every prefix of a word has one path at most.

Encoding walks the arcs whose labels spell the word, longest first. A place of the word from
which the end can't be reached is never tried twice, as only one path leads to it, so a word
costs time in proportion to its length. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from palisade.llm.pieces import Encoder, byte_letters, cut_words

FOREVER = 1 << 60
# Arcs remembered.
ARCS = 200_000


class MergeAutomaton:
    """Built from a vocabulary (token -> id), its merges in order, and the mark of a word's end."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        size = max(vocabulary.values(), default=-1) + 1
        self.labels = [""] * size
        for token, i in vocabulary.items():
            self.labels[i] = token
        # Of every token: its halves, the rule that makes it, and the arcs taken away behind it.
        self.left = [-1] * size
        self.right = [-1] * size
        self.made = [-1] * size
        self.taken: dict[int, int] = {}
        self.size = size
        self.arcs: dict[int, bool] = {}
        for rule, (a, b) in enumerate(merges):
            self._gadget(rule, vocabulary[a], vocabulary[b], vocabulary[a + b])
        self._spell(vocabulary)

    def _gadget(self, rule: int, a: int, b: int, c: int) -> None:
        if self.made[c] >= 0:
            raise ValueError(f"two merges make {self.labels[c]!r}")
        if not self._has(a, b):
            return  # No state has an arc b behind a: the rule never applies.
        self.left[c], self.right[c], self.made[c] = a, b, rule
        self.taken[a * self.size + b] = rule

    def _has(self, state: int, token: int) -> bool:
        """Whether the state behind ``state`` has an arc ``token``, by the gadgets so far."""
        u, until = state, FOREVER
        while u >= 0:
            v, by = token, FOREVER
            while v >= 0:
                rule = self.taken.get(u * self.size + v, FOREVER)
                if rule < until and rule <= by and rule < FOREVER:
                    return False
                by = self.made[v]
                v = self.left[v]
            until = self.made[u]
            u = self.right[u]
        return True

    def has(self, state: int, token: int) -> bool:
        key = state * self.size + token
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) > ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._has(state, token)
        return found

    def _spell(self, vocabulary: dict[str, int]) -> None:
        """The table that spells labels: (node, symbol) -> node, and each node's token."""
        self.letters = {letter: i for i, letter in enumerate(byte_letters())}
        self.next: dict[int, int] = {}
        self.token = [-1]
        ends = len(self.suffix)
        for token, i in vocabulary.items():
            # Tokens that no rule makes and that are not single symbols have no arc.
            last = bool(ends) and token.endswith(self.suffix) and len(token) > ends
            body = token[:-ends] if last else token
            if self.made[i] < 0 and len(body) != 1 or any(x not in self.letters for x in body):
                continue
            node = 0
            for k, x in enumerate(body):
                symbol = self.letters[x] + (256 if last and k == len(body) - 1 else 0)
                key = node * 512 + symbol
                step = self.next.get(key)
                if step is None:
                    step = self.next[key] = len(self.token)
                    self.token.append(-1)
                node = step
            self.token[node] = i

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-split word. Bytes without a token of their own are skipped, as
        the library does when it has no token for the unknown."""
        symbols = list(word.encode())
        if not symbols:
            return []
        if self.suffix:
            symbols[-1] += 256
        step, token, n = self.next.get, self.token, len(symbols)
        dead: set[int] = set()
        path: list[int] = []
        places = [0]
        open_arcs: list[list[tuple[int, int]]] = []
        while True:
            at = places[-1]
            if at == n:
                return path
            if len(open_arcs) < len(places):
                node, arcs = 0, []
                for k in range(at, n):
                    node = step(node * 512 + symbols[k])
                    if node is None:
                        break
                    if token[node] >= 0:
                        arcs.append((k + 1, token[node]))
                open_arcs.append(arcs)
            arcs = open_arcs[-1]
            while arcs:
                end, t = arcs.pop()
                if end not in dead and (not path or self.has(path[-1], t)):
                    path.append(t)
                    places.append(end)
                    break
            else:
                dead.add(at)
                open_arcs.pop()
                places.pop()
                if not places:
                    return self._skip(symbols)
                path.pop()

    def _skip(self, symbols: list[int]) -> list[int]:
        known = bytes(s & 255 for s in symbols if s in self.next)
        if len(known) == len(symbols):
            raise ValueError("the merges do not spell this word")
        return self.encode(known.decode("latin-1")) if known.isascii() else []

    def decode(self, ids: list[int]) -> str:
        """The labels, joined as the library does for a vocabulary without a decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


@cache
def load(path: str) -> tuple[MergeAutomaton, Encoder]:
    """The automaton of a tokenizer file with word ends, and an encoder of whole texts."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    for text, i in special.items():
        automaton.labels.extend([""] * (i + 1 - len(automaton.labels)))
        automaton.labels[i] = text

    def normalise(text: str) -> str:
        # Lower case character by character: no final sigma.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    return automaton, Encoder(cut_words, automaton.encode, special, normalise)
