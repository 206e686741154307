"""Merge-based tokenizers compiled to deterministic transducers, run over whole batches at once.

Two machines are used.

* ``Boundaries`` finds where pre-tokens begin.  It has a dozen states over character classes.  The
  characters of a batch are cut into chunks; each chunk yields its *state map* (exit state for every
  entry state), the maps compose by a parallel prefix scan, and a second pass from the then known
  entry states writes the boundaries.

* ``MergeTransducer`` reads the bytes of a segment and keeps, as its state, what the longest
  live vocabulary prefix can still need: for each open piece start the last piece before it and the
  number of pieces up to it.  A piece may follow another one only if merging their joined bytes
  gives back these two pieces; under that constraint each prefix of an input has exactly one
  segmentation, which is the one that ranked merging yields.  So the constrained lattice has one path
  of finite weight and the transition into each position names its last piece.  Transitions
  carry the change in the number of emitted pieces, and a state holds no absolute count, so chunks of a long segment
  have state maps too: see run().  States are made when first met and kept for the life of the Python worker, within ``MAX_STATES``.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections import deque
from functools import lru_cache

import numpy as np

#: When a worker holds more states than this, it drops them before the next batch and begins anew.
MAX_STATES = 300_000
CHUNK = 256
#: Bytes of a chunk of a long segment.
LANE = 512

# --------------------------------------------------------------------------- boundaries

#: Character classes: other, letter, number, white space but for U+0020, U+0020, apostrophe,
#: the letters of contractions, end of a text.
O, L, N, W, SP, AP, C_SDMT, C_L, C_V, C_R, C_E, END = range(12)
#: States: fresh, in letters, in numbers, in others, apostrophe that begins a pre-token, the same and
#: l, v or r, one space, one other white space, two or more white spaces of which the last is a space or not.
(FRESH, IN_L, IN_N, IN_O, AP1, AP_L, AP_V, AP_R, ONE_SP, ONE_W, MANY_SP, MANY_W) = range(12)
BEFORE, BEFORE_LAST = 1, 2
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = L
        elif kind == "N":
            out[c] = N
    out[list(WHITE_SPACE)] = W
    out[ord(" ")] = SP
    out[ord("'")] = AP
    for c, kind in zip("sdmtlvre", (C_SDMT,) * 4 + (C_L, C_V, C_R, C_E), strict=True):
        out[ord(c)] = kind
    return out


def _boundary_step(state: int, c: int) -> tuple[int, int]:
    """Next state and where a pre-token begins: BEFORE this character, BEFORE_LAST one."""
    letter = c in (L, C_SDMT, C_L, C_V, C_R, C_E)
    run = IN_L if letter else {N: IN_N, O: IN_O, AP: IN_O}.get(c)
    if state == AP1:
        if c == C_SDMT:
            return FRESH, 0
        if c in (C_L, C_V, C_R):
            return {C_L: AP_L, C_V: AP_V, C_R: AP_R}[c], 0
        state = IN_O
    elif state in (AP_L, AP_V, AP_R):
        if c == (C_L if state == AP_L else C_E):
            return FRESH, 0
        after, begins = _boundary_step(IN_L, c)
        return after, begins | BEFORE_LAST
    if c == END:
        return FRESH, BEFORE
    if c in (SP, W):
        if state in (ONE_SP, ONE_W, MANY_SP, MANY_W):
            return (MANY_SP if c == SP else MANY_W), 0
        return (ONE_SP if c == SP else ONE_W), BEFORE
    if state == ONE_SP:
        return run, 0
    if state == MANY_SP:
        return run, BEFORE_LAST
    fresh = AP1 if c == AP else run
    if state == MANY_W:
        return fresh, BEFORE | BEFORE_LAST
    if state == run:
        return run, 0
    return fresh, BEFORE


_NEXT, _BEGINS = (np.array([[_boundary_step(s, c)[k] for c in range(12)] for s in range(12)], np.uint8) for k in (0, 1))


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps, one a row: ``first`` followed by ``then``."""
    return np.take_along_axis(then, first, axis=1)


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps in log2(rows) rounds, each of them data-parallel."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = compose(maps[:-step], maps[step:])
        step *= 2
    return maps


def pretoken_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which a pre-token or an END begins, in a stream of classes whose last is END."""
    n = len(classes)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    flat_next, flat_begins = _NEXT.ravel(), _BEGINS.ravel()
    state = np.repeat(np.arange(12, dtype=np.uint8)[:, None], rows, axis=1)
    for column in grid:
        state = flat_next[state * np.uint8(12) + column]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = scan(state.T.astype(np.intp))[:-1, FRESH]
    begins = np.empty((chunk, rows), np.uint8)
    for k, column in enumerate(grid):
        at = entry * np.uint8(12) + column
        begins[k] = flat_begins[at]
        entry = flat_next[at]
    begins = begins.T.ravel()[:n]
    mark = (begins & BEFORE) > 0
    mark[:-1] |= (begins[1:] & BEFORE_LAST) > 0
    return np.flatnonzero(mark)


# --------------------------------------------------------------------------- merging

UNKNOWN = -1
_NONE = -2


class MergeTransducer:
    """See the module's text.

    ``pieces``: bytes to id, each of them made of whole symbols.  ``rank(a, b)``: (rank, id) of
    the merge of two pieces or None.  ``utf8``: symbols are characters rather than bytes; one that no piece
    spells is UNKNOWN and emits a piece for each of its bytes.
    """

    def __init__(self, pieces: dict[bytes, int], rank, utf8: bool):
        self.rank, self.utf8 = rank, utf8
        self.spelt = {i: p for p, i in pieces.items()}
        self.single = pieces
        self.fits: dict[int, bool] = {}
        self._compile({p: i for p, i in pieces.items() if self.merged(p) == [i]})
        self.reset()

    # -- ranked merging of a short string, only used to test which pieces may be neighbours
    def symbols(self, text: bytes) -> list[bytes]:
        return [c.encode() for c in text.decode()] if self.utf8 else [bytes([c]) for c in text]

    def merged(self, text: bytes) -> list[int]:
        ids = [self.single.get(s, UNKNOWN) for s in self.symbols(text)]
        while len(ids) > 1:
            ranked = [(r[0], k, r[1]) for k in range(len(ids) - 1) if (r := self.rank(ids[k], ids[k + 1]))]
            if not ranked:
                break
            _, k, joined = min(ranked)
            ids[k : k + 2] = [joined]
        return ids

    def may_follow(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.merged(self.spelt[a] + self.spelt[b]) == [a, b]
        return known

    def _compile(self, pieces: dict[bytes, int]) -> None:
        """The trie of all pieces with the links to the longest proper suffix that is also in it."""
        child, piece, depth = {}, [_NONE], [0]
        for text, i in pieces.items():
            node = 0
            for c in text:
                to = child.get(node << 8 | c)
                if to is None:
                    to = child[node << 8 | c] = len(piece)
                    piece.append(_NONE)
                    depth.append(depth[node] + 1)
                node = to
            piece[node] = i
        below: dict[int, list] = {}
        for key, to in child.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        suffix, queue = [0] * len(piece), deque([0])
        while queue:
            node = queue.popleft()
            for c, to in below.get(node, ()):
                if node:
                    at = suffix[node]
                    while at and at << 8 | c not in child:
                        at = suffix[at]
                    suffix[to] = child.get(at << 8 | c, 0)
                queue.append(to)
        self.child, self.piece, self.depth, self.suffix, self.open = child, piece, depth, suffix, set(below)

    def reset(self) -> None:
        """Forget all states but the start.  A state: trie node, bytes read of a split symbol and bytes to come, then (distance, last piece, pieces less those of now) for each open start."""
        self.info: list[bytes] = []  # packed: there are many
        self.ids: dict[bytes, int] = {}
        self._intern((0, 0, 0, 0, _NONE, 0))
        self.count = 0
        self._table(1 << 16)

    def _intern(self, state: tuple) -> int:
        packed = array("i", state).tobytes()
        i = self.ids.get(packed)
        if i is None:
            i = self.ids[packed] = len(self.info)
            self.info.append(packed)
        return i

    def _step(self, state: int, c: int) -> tuple[int, int, int]:
        """Next state, change of the number of pieces, last piece (_NONE within a symbol)."""
        s = array("i", self.info[state])
        node, read, todo = s[:3]
        window = {s[k]: (s[k + 1], s[k + 2]) for k in range(3, len(s), 3)}
        child, suffix, depth = self.child, self.suffix, self.depth
        while node and node << 8 | c not in child:
            node = suffix[node]
        node = child.get(node << 8 | c, 0)
        if self.utf8:
            todo = todo - 1 if todo else 0 if c < 0xC0 else 1 if c < 0xE0 else 2 if c < 0xF0 else 3
            read += 1
        ends = not todo
        last, change = _NONE, 0
        if ends:
            at = node
            while at:
                if (i := self.piece[at]) >= 0:
                    before, pieces = window[depth[at] - 1]
                    if self.may_follow(before, i):
                        last, change = i, pieces + 1
                        break
                at = suffix[at]
            else:
                if not self.utf8:
                    raise ValueError("the pieces don't spell every byte")
                last, change, node = UNKNOWN, window[read - 1][1] + read, 0
            read = 0
        at, fresh, live = node, [], 0
        while at:
            if at in self.open:
                live = live or at
                if (k := depth[at] - 1) in window:
                    fresh += (k + 1, window[k][0], window[k][1] - change)
            at = suffix[at]
        if not ends and read not in fresh[::3]:  # the start of a split symbol counts it when it is unknown
            fresh += (read, *window[read - 1][:1], window[read - 1][1] - change)
        if ends:
            fresh += (0, last, 0)
        return self._intern((live, read, todo, *fresh)), change, last

    # -- transitions in a hash table of numpy arrays, so that a whole batch can look up at once
    def _table(self, size: int) -> None:
        self.size = size
        self.keys = np.full(size, -1, np.int64)
        self.to, self.change, self.last = np.zeros(size, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or of the free place where it belongs."""
        mask = self.size - 1
        at = ((keys * 0x9E3779B97F4A7C1) >> 20) & mask
        wrong = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            found = self.keys[at[wrong]]
            wrong = wrong[(found != keys[wrong]) & (found != -1)]
        return at

    def _add(self, keys: np.ndarray) -> None:
        made = [self._step(int(k >> 8), int(k & 255)) for k in keys]
        if (self.count + len(keys)) * 2 > self.size:
            old = self.keys >= 0
            held = [x[old] for x in (self.keys, self.to, self.change, self.last)]
            size = self.size
            while (self.count + len(keys)) * 2 > size:
                size *= 2
            self._table(size * 2)
            self._put(*held)
        self._put(keys, *(np.array(x, np.int32) for x in zip(*made, strict=True)))
        self.count += len(keys)

    def _put(self, keys, to, change, last) -> None:
        left = np.arange(len(keys))
        while len(left):
            at = self._slots(keys[left])
            _, first = np.unique(at, return_index=True)
            done, at = left[first], at[first]
            self.keys[at], self.to[at], self.change[at], self.last[at] = keys[done], to[done], change[done], last[done]
            left = np.delete(left, first)

    def run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, last: np.ndarray | None = None, lane: int = LANE) -> np.ndarray:
        """Number of pieces of each segment of ``data``; ``last`` gets the last piece at each byte.

        A long segment is cut to chunks.  A chunk's state map is known for the states it can be entered in: the start, as a first
        guess, and every state in which the chunk before it can end.  The machine forgets quickly, so there are few; all chunks
        are run for all new ones at once until none is left, the maps are followed from the start of each segment, and the last pass runs from the then known states.
        """
        if len(self.info) > MAX_STATES:
            self.reset()
        long = np.flatnonzero(lengths > 2 * lane)
        if not len(long):
            return self._run(data, starts, lengths, np.zeros(len(starts), np.int64), last)[0]
        begin, size, owner, first = [], [], [], []
        for i in long.tolist():
            cuts = np.arange(starts[i], starts[i] + lengths[i], lane)
            for _ in range(3):  # a chunk begins with a symbol
                cuts[1:] += (data[cuts[1:]] & 0xC0) == 0x80
            cuts = cuts[cuts < starts[i] + lengths[i]]
            first.append(len(owner))
            begin += cuts.tolist()
            size += np.diff(np.append(cuts, starts[i] + lengths[i])).tolist()
            owner += [i] * len(cuts)
        begin, size, owner = np.array(begin), np.array(size), np.array(owner)
        maps: list[dict[int, int]] = [{} for _ in owner]
        new = [(c, 0) for c in range(len(owner))]
        while new:
            at, entry = (np.array(x) for x in zip(*new, strict=True))
            leave = self._run(data, begin[at], size[at], entry, None)[1]
            for c, i, o in zip(at.tolist(), entry.tolist(), leave.tolist(), strict=True):
                maps[c][i] = o
            follow = {(c + 1, o) for c, o in zip(at.tolist(), leave.tolist(), strict=True) if c + 1 < len(owner) and owner[c + 1] == owner[c]}
            new = [x for x in sorted(follow) if x[1] not in maps[x[0]]]
        entry, state, heads = [], 0, set(first)
        for c in range(len(owner)):
            state = 0 if c in heads else state
            entry.append(state)
            state = maps[c][state]
        short = np.delete(np.arange(len(starts)), long)
        entry = np.concatenate((np.zeros(len(short), np.int64), entry)).astype(np.int64)
        pieces = self._run(data, np.concatenate((starts[short], begin)), np.concatenate((lengths[short], size)), entry, last)[0]
        return np.bincount(np.concatenate((short, owner)), weights=pieces, minlength=len(starts)).astype(np.int64)

    def _run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Change of the number of pieces over each stretch from its entry state, and the state at its end; all stretches side by side, a byte at a time."""
        order = np.argsort(-lengths, kind="stable")
        begin, longest = starts[order], lengths[order]
        state, pieces = entry[order], np.zeros(len(order), np.int32)
        live = len(order)
        for k in range(int(longest[0]) if len(order) else 0):
            if longest[live - 1] <= k:
                live = int(np.searchsorted(-longest[:live], -k, side="left"))
            at = begin[:live] + k
            keys = (state[:live] << 8) | data[at]
            slots = self._slots(keys)
            missing = self.keys[slots] != keys
            if missing.any():
                self._add(np.unique(keys[missing]))
                slots = self._slots(keys)
            state[:live] = self.to[slots]
            pieces[:live] += self.change[slots]
            if last is not None:
                last[at] = self.last[slots]
        out, leave = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        out[order], leave[order] = pieces, state
        return out, leave
