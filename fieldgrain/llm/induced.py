"""Suffix order and common prefixes of a text by induced sorting, with queues that move to disk.

Suffixes are small (S) or large (L) against their right neighbour. The S suffixes that follow an L one are ordered
first: their stretches up to the next such suffix are sorted by one induction and named, and the text of names is
ordered, recursively if few names occur, else by doubling ranks. From their order a scan upwards induces all L
suffixes, and a scan downwards all S suffixes. A queue for each character holds tuples of a suffix and the length of
the prefix it shares with the one before it in the queue; since the smallest character's queue is emptied first, the
queues together are a priority queue by (character, arrival). A common prefix is one more than the least of those
scanned since the queue's last arrival. Lengths are cut at ``cap``.

All tuples of a scan are handled a queue at a time with array operations. Beyond ``memory`` bytes the queues go to one
anonymous file of the task, which holds nothing that another task reads and ends with it.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Queues:
    """One queue of (position, common prefix) for each character."""

    def __init__(self, characters: int, memory: int):
        self.parts: list[list] = [[] for _ in range(characters)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, c: int, position: np.ndarray, shared: np.ndarray) -> None:
        both = np.stack([position.astype(np.int32), shared.astype(np.int32)])
        self.parts[c].append(both)
        self.held += both.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts:
            for i, part in enumerate(parts):
                if isinstance(part, np.ndarray):
                    parts[i] = (self.file.tell(), part.shape[1])
                    self.file.write(part.tobytes())
        self.held = 0

    def _read(self, part) -> np.ndarray:
        if isinstance(part, np.ndarray):
            return part
        at, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int32).reshape(2, n)

    def read(self, c: int, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries of a queue from its part ``start`` on, and the number of its parts."""
        parts = self.parts[c][start:]
        both = np.concatenate([self._read(p) for p in parts], axis=1) if parts else np.zeros((2, 0), np.int32)
        return both[0], both[1], start + len(parts)


class Scan:
    """Pushes the predecessors of scanned suffixes, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.least = np.full(len(queues.parts), -1, np.int32)  # shared since a queue's last arrival; -1: none yet

    def __call__(self, position: np.ndarray, shared: np.ndarray) -> None:
        if not len(position):
            return
        before = position - 1
        sends = np.flatnonzero((before >= 0) & self.wanted[before])
        to = self.text[before[sends]]
        by = np.argsort(to, kind="stable")
        sends, to = sends[by], to[by]
        down = np.minimum.accumulate(shared)
        up = np.minimum.accumulate(shared[::-1])[::-1]
        kept = self.least
        self.least = np.minimum(kept, down[-1])
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(to)]):
            c, at = int(to[a]), sends[a:b]
            low = np.empty(b - a, np.int32)
            low[0] = min(kept[c], down[at[0]])
            if b - a > 1:
                low[1:] = np.minimum.reduceat(shared[: at[-1] + 1], at[:-1] + 1)
            self.queues.push(c, before[at], np.minimum(low + 1, self.cap))
            self.least[c] = up[at[-1] + 1] if at[-1] + 1 < len(shared) else self.cap


def _induce(text: np.ndarray, small: np.ndarray, runs: np.ndarray, stars: np.ndarray, star_shared: np.ndarray, characters: int, cap: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes and common prefixes from the starting ones (``stars``, ordered at least by first character)."""
    n = len(text)
    large, little = Queues(characters, memory), Queues(characters, memory)
    cuts = np.searchsorted(text[stars], np.arange(characters + 1))
    seam = lambda a, b: min(int(runs[a]), int(runs[b]), cap)
    scan = Scan(text, ~small, large, cap)
    for c in range(characters):
        done, last = 0, -1
        while done < len(large.parts[c]):
            position, shared, done = large.read(c, done)
            scan(position, shared)
            last = int(position[-1])
        mine, shared = stars[cuts[c] : cuts[c + 1]], star_shared[cuts[c] : cuts[c + 1]].copy()
        if len(mine):
            shared[0] = seam(last, mine[0]) if last >= 0 else 0
            scan(mine, shared)
    order, common = np.empty(n, np.int32), np.empty(n, np.int32)
    stop = n
    little.push(0, np.array([n - 1]), np.array([0]))
    scan = Scan(text, small, little, cap)
    for c in range(characters - 1, -1, -1):
        done = 0
        while done < len(little.parts[c]):
            position, shared, done = little.read(c, done)
            scan(position, shared)
        down, down_shared, _ = little.read(c)
        rising, rising_shared, _ = large.read(c)
        middle = seam(rising[-1], down[-1]) if len(down) and len(rising) else 0
        if len(rising):
            scan(rising[::-1], np.concatenate([[middle], rising_shared[:0:-1]]).astype(np.int32))
        if len(down):
            order[stop - len(down) : stop] = down[::-1]
            common[stop - len(down) : stop] = np.concatenate([down_shared[1:], [middle]])[::-1]
            stop -= len(down)
        if len(rising):
            order[stop - len(rising) : stop] = rising
            common[stop - len(rising) : stop] = np.concatenate([[0], rising_shared[1:]])
            stop -= len(rising)
    return order, common


def _shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and at b, at most ``cap``: four characters at a time, then one."""
    padded = np.concatenate([text.astype(np.uint64), np.zeros(cap + 8, np.uint64)])
    n = len(padded) - 3
    four = padded[:n] | (padded[1 : n + 1] << np.uint64(16)) | (padded[2 : n + 2] << np.uint64(32)) | (padded[3 : n + 3] << np.uint64(48))
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    while len(live):
        same = (four[a[live] + out[live]] == four[b[live] + out[live]]) & (out[live] < cap)
        live = live[same]
        out[live] += 4
    for _ in range(3):
        out += padded[a + out] == padded[b + out]
    return np.minimum(out, cap)


def suffix_order(text: np.ndarray, cap: int, memory: int = 64 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and, for each, the prefix it shares with the one before, at most ``cap``.

    ``text``: numbers below 2^16; the last must be 0 and occur nowhere else. Suffixes equal in the first ``cap``
    characters may stand in any order.
    """
    text = text.astype(np.int64)
    n, characters = len(text), int(text.max()) + 1
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    step = np.append(np.sign(np.diff(text)), 1)
    place = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(place[::-1])[::-1]
    small = step[after] > 0
    runs = after - np.arange(n) + 1
    star = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    rough = star[np.argsort(text[star], kind="stable")]
    if len(star) > 1:
        # order of the stretches between stars, then names
        order, _ = _induce(text, small, runs, rough, np.zeros(len(rough), np.int32), characters, cap, memory)
        is_star = np.zeros(n, bool)
        is_star[star] = True
        by = order[is_star[order]]
        rank_in_text = np.cumsum(is_star) - 1
        following = np.append(star[1:], n - 1)
        length = np.minimum(following[rank_in_text[by]] - by + 1, cap)
        new = np.ones(len(by), bool)
        same_length = length[1:] == length[:-1]
        at = np.flatnonzero(same_length)
        new[1:][at] = _shared(text, by[at], by[at + 1], cap) < length[at]
        name = np.empty(len(star), np.int64)
        name[rank_in_text[by]] = np.cumsum(new) - 1
        names = int(name.max()) + 1
        if names == len(star):
            ordered = by
        elif names <= 1024 and len(star) > 4096:
            ordered = star[suffix_order(name, cap, memory)[0]]
        else:
            ordered = star[_doubled(name, cap)]
        shared = np.zeros(len(ordered), np.int32)
        shared[1:] = _shared(text, ordered[:-1], ordered[1:], cap)
    else:
        ordered, shared = star, np.zeros(len(star), np.int32)
    return _induce(text, small, runs, ordered, shared, characters, cap, memory)


def _doubled(name: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of many names, by their first ``depth`` names at least."""
    rank, width = name.astype(np.int64), 1
    by = np.argsort(rank, kind="stable")
    while width < depth:
        next_rank = np.zeros(len(rank), np.int64)
        next_rank[:-width] = rank[width:] + 1
        key = rank * (len(rank) + 2) + next_rank
        by = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[by][1:] != key[by][:-1])])
        rank = np.empty_like(rank)
        rank[by] = new
        width *= 2
        if new[-1] == len(rank) - 1 or width >= len(rank):
            break
    return by


def repeated_starts(pieces: list[bytes], length: int, memory: int = 64 << 20, owners: list[int | None] | None = None) -> list[np.ndarray]:
    """For each piece, whether the string of ``length`` bytes at each place that has so many also stands elsewhere.

    With ``owners``, elsewhere means in a piece of another owner; a piece of owner None has several of its own.
    """
    sizes = np.array([len(p) for p in pieces])
    text = np.zeros(int((sizes + 1).sum()) + 1, np.uint16)
    text[:-1] = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    text[:-1] += 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    order, common = suffix_order(text, length, memory)
    long = common >= length
    hit = long.copy()
    hit[:-1] |= long[1:]
    if owners is not None:
        number = {o: i for i, o in enumerate(dict.fromkeys(owners))}
        piece = np.searchsorted(ends, np.minimum(order, ends[-1]))
        owner = np.array([number[o] for o in owners])[piece]
        several = np.array([o is None for o in owners])[piece]
        # suffixes that share a prefix of ``length`` are neighbours: a run of them has several owners or one
        first = np.flatnonzero(~long)
        apart = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | np.maximum.reduceat(several, first)
        hit &= np.repeat(apart, np.diff(np.append(first, len(order))))
    flag = np.zeros(len(text), bool)
    flag[order[hit]] = True
    return [flag[e - s : e - s + max(0, s - length + 1)] for e, s in zip(ends.tolist(), sizes.tolist())]
