"""A trie in two arrays, built and walked in NumPy.

A state is a slot; its child by the symbol c is the slot base[state] + c if
check of that slot names the state.  Symbols are the ranks of the tokens that
occur in the trie, found by an open hash table.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ROOT, _FREE = -2, -1


class Alphabet:
    """Ranks from 1 of the tokens of a trie, 0 for all others.  Token 0 is none."""

    def __init__(self, tokens: np.ndarray):
        size = 16
        while size < 4 * len(tokens):
            size *= 2
        self.mask, self.slots, self.ranks = U64(size - 1), np.zeros(size, dtype=U64), np.zeros(size, dtype=np.int32)
        at, open_ = tokens & self.mask, np.arange(len(tokens))
        while len(open_):
            free = open_[self.slots[at[open_]] == 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.slots[at[placed]], self.ranks[at[placed]] = tokens[placed], placed + 1
            open_ = np.setdiff1d(open_, placed, assume_unique=True)
            at[open_] = (at[open_] + U64(1)) & self.mask

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        out, at, open_ = np.zeros(len(tokens), dtype=np.int32), tokens & self.mask, np.flatnonzero(tokens)
        while len(open_):
            place = at[open_]
            slot = self.slots[place]
            hit = slot == tokens[open_]
            out[open_[hit]] = self.ranks[place[hit]]
            open_ = open_[~hit & (slot != 0)]
            at[open_] = (at[open_] + U64(1)) & self.mask
        return out


class DoubleArray:
    """Keys of equal length: one row of tokens a key, all rows distinct."""

    def __init__(self, keys: np.ndarray):
        tokens = np.unique(keys)
        self.alphabet = Alphabet(tokens)
        codes = np.searchsorted(tokens, keys).astype(np.int64) + 1
        order = np.lexsort(codes.T[::-1])
        self.keys, codes = keys[order], codes[order]
        n, depth = codes.shape
        # Symbols can point this far before or behind the slots in use.
        self._margin = len(tokens) + 1
        self.base, self.check = np.zeros(2 * self._margin, dtype=np.int64), np.full(2 * self._margin, _FREE, dtype=np.int64)
        self.accept = np.full(2 * self._margin, -1, dtype=np.int64)
        self._seek = self._margin
        parent = np.full(n, _ROOT, dtype=np.int64)
        changed = np.zeros(n, dtype=bool)
        if n:
            changed[0] = True
        for d in range(depth):
            begins = np.flatnonzero(changed)  # of the nodes of this depth
            changed = changed.copy()
            changed[1:] |= codes[1:, d] != codes[:-1, d]
            edges = np.flatnonzero(changed)
            slots = self._place(parent[edges], codes[edges, d], np.searchsorted(edges, begins))
            if d == depth - 1:
                self.accept[slots] = edges
            parent = np.repeat(slots, np.diff(np.append(edges, n)))

        self.base, self.check, self.accept = (x.astype(np.int32) for x in (self.base, self.check, self.accept))

    def _place(self, parents: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Slots of the children given by parent, nodes' children beginning at `starts`;
        nodes with many children choose first."""
        slots = np.empty(len(codes), dtype=np.int64)
        ends = np.append(starts[1:], len(codes))
        many = ends - starts
        class_ = 0
        for node in np.argsort(-many, kind="stable")[: int((many > 1).sum())]:
            own = codes[starts[node] : ends[node]]
            if class_ != (class_ := int(many[node]).bit_length()):
                self._seek = self._margin  # fewer symbols fit into gaps that more did not
            base = self._fit(own)
            slots[starts[node] : ends[node]] = at = base + own
            self.check[at] = parents[starts[node]]
            self._base(parents[starts[node]], base)
        single = starts[many == 1]
        if len(single):
            inner = self.check[self._margin : len(self.check) - self._margin]
            self._grow(len(self.check) + max(0, len(single) - int((inner == _FREE).sum())))
            at = self._margin + np.flatnonzero(self.check[self._margin : len(self.check) - self._margin] == _FREE)[: len(single)]
            slots[single], self.check[at] = at, parents[single]
            self._base(parents[single], at - codes[single])
        return slots

    def _base(self, parents: np.ndarray, base: np.ndarray) -> None:
        if np.ndim(parents) == 0 and parents == _ROOT or np.ndim(parents) and len(parents) and parents[0] == _ROOT:
            self.root = int(np.max(base))
        else:
            self.base[parents] = base

    def _grow(self, slots: int) -> None:
        """At least so many slots."""
        need = slots - len(self.check)
        if need > 0:
            need = max(need, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(need, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(need, _FREE, dtype=np.int64)])
            self.accept = np.concatenate([self.accept, np.full(need, -1, dtype=np.int64)])

    def _fit(self, own: np.ndarray, window: int = 512) -> int:
        """The next base that puts all symbols on free slots, from where the last one was found."""
        offsets = own - own[0]
        while True:
            at = self._seek
            self._grow(at + int(offsets[-1]) + window + self._margin)
            free = at + np.flatnonzero(self.check[at : at + window] == _FREE)
            for k in range(0, len(free), 64):
                start = free[k : k + 64]
                good = (self.check[start[:, None] + offsets] == _FREE).all(axis=1)
                if good.any():
                    self._seek = int(start[np.argmax(good)])
                    return self._seek - int(own[0])
            self._seek = at + window

    def count(self, tokens: np.ndarray) -> np.ndarray:
        """How often each key occurs in a row of tokens, all positions at once."""
        n, depth = self.keys.shape
        code = self.alphabet(tokens)
        at = np.flatnonzero(code[: max(0, len(code) - depth + 1)])
        state = self.root + code[at] if n else at
        for d in range(depth):
            if d:
                step = code[at + d]
                to = self.base[state] + step
                ok = (step > 0) & (self.check[to] == state)
            else:
                to, ok = state, self.check[state] == _ROOT
            at, state = at[ok], to[ok]
        return np.bincount(self.accept[state], minlength=n)

    def find(self, phrases: np.ndarray) -> np.ndarray:
        """The number of the key that each phrase, a row of tokens, is; -1 where it is none."""
        code = self.alphabet(phrases.ravel()).reshape(phrases.shape)
        out, at = np.full(len(phrases), -1, dtype=np.int64), np.flatnonzero(code.all(axis=1))
        state = self.root + code[at, 0]
        ok = self.check[state] == _ROOT
        for d in range(1, phrases.shape[1]):
            at, state = at[ok], state[ok]
            to = self.base[state] + code[at, d]
            ok, state = self.check[to] == state, to
        out[at[ok]] = self.accept[state[ok]]
        return out
