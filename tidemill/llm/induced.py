"""Induced sorting of suffixes with common-prefix values, over priority queues that go to disk (operator 4).

A shard's texts are laid end to end, each with a mark of its own behind it. Its suffixes are sorted from those that begin an
ascent after a descent (S*): their substrings are sorted and named, and where names repeat the string of names is sorted the
same way (recursion on at most half as many symbols). From the S*-suffixes a queue induces the descending suffixes (L) in
order, and from these another one, from the largest on, the ascending ones (S). A queue's tuples carry symbol, order,
place, and the common prefix with the suffix induced before in the same bucket: one more than the least common prefix met in
between, which a stack of minima of at most `cap` entries gives. Symbols lie in a mapped file, queues beyond `limit` tuples
in sorted runs on disk, so memory does not grow with the shard. Files are a task's own scratch and are unlinked as they are
made: what a lost executor had of them goes with its task.
"""

from __future__ import annotations

import mmap
import pickle
import tempfile
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

RUN = 4096


class Queue:
    """A priority queue of tuples, the least first, that holds up to `limit` of them in memory."""

    def __init__(self, limit: int):
        self.limit, self.heap, self.heads, self.runs = limit, [], [], []

    def push(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        items = sorted(self.heap)
        for at in range(0, len(items), RUN):
            pickle.dump(items[at : at + RUN], file, 5)
        file.seek(0)
        self.heap = []
        self.runs.append(self._read(file))
        self._next(len(self.runs) - 1)

    @staticmethod
    def _read(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: int) -> None:
        if (item := next(self.runs[run], None)) is not None:
            heappush(self.heads, (item, run))

    def __bool__(self) -> bool:
        return bool(self.heap or self.heads)

    def pop(self) -> tuple:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            item, run = heappop(self.heads)
            self._next(run)
            return item
        return heappop(self.heap)


class Store:
    """Integers on disk: appended, then read by place."""

    def __init__(self):
        self.file, self.held, self.size = tempfile.TemporaryFile(), array("q"), 0

    def append(self, value: int) -> None:
        self.held.append(value)
        self.size += 1
        if len(self.held) == 1 << 16:
            self.held.tofile(self.file)
            self.held = array("q")

    def view(self) -> memoryview:
        self.held.tofile(self.file)
        self.held = array("q")
        self.file.flush()
        if not self.size:
            return memoryview(array("q"))
        return memoryview(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)).cast("q")


class Minima:
    """The least value since a place in a sequence, where values are bounded: a stack of the minima from the end on."""

    def __init__(self):
        self.places, self.values = [], []

    def add(self, place: int, value: int) -> None:
        while self.values and self.values[-1] >= value:
            self.places.pop(), self.values.pop()
        self.places.append(place), self.values.append(value)

    def since(self, place: int) -> int:
        return self.values[bisect_right(self.places, place)]


def descents(text: memoryview) -> Iterator[tuple[int, tuple]]:
    """(place, key) of every S*-suffix from the last to the first; the key is its substring up to the next one, with types."""
    n, rising, keys, last = len(text), False, [], True
    for i in range(n - 1, -1, -1):
        now = i < n - 1 and (text[i] < text[i + 1] or (text[i] == text[i + 1] and rising))
        if rising and not now:
            yield i + 1, tuple(reversed(keys)) + (() if not last else (-1,))
            keys, last = [2 * text[i + 1] + 1], False
        keys.append(2 * text[i] + now)
        rising = now


def starred(text: memoryview, limit: int) -> Store:
    """Places of the S*-suffixes in their order."""
    substrings, places = Queue(limit), Store()
    count = 0
    for place, key in descents(text):
        substrings.push((key, -count, place))
        places.append(place)
        count += 1
    names, before, name, unique = Queue(limit), None, -1, True
    order = Store()
    while substrings:
        key, back, place = substrings.pop()
        if key != before:
            name, before = name + 1, key
        else:
            unique = False
        names.push((count - 1 + back, name))
        order.append(place)
    if unique:
        return order
    reduced = Store()
    while names:
        reduced.append(names.pop()[1])
    by_place, order, found = places.view(), Store(), Store()
    for at, _ in suffixes(reduced.view(), limit):
        found.append(at)
    view = found.view()
    for k in range(len(view) - 1, -1, -1):
        order.append(by_place[count - 1 - view[k]])
    return order


def suffixes(text: memoryview, limit: int, cap: int = 0, common=None) -> Iterator[tuple[int, int]]:
    """(place, common prefix with the suffix before, up to cap) of every suffix from the largest to the smallest.

    `common` gives the common prefix of two suffixes by their text; it is asked for neighbours of different kinds only, and
    for S*-suffixes. Without it, the values are 0.
    """
    n = len(text)
    if not n:
        return
    ask = common or (lambda i, j: 0)
    queue, low, last = Queue(limit), Minima(), {text[n - 1]: -1}
    queue.push((text[n - 1], 0, -1, n - 1, 0))  # the last suffix, by the empty one
    stars = starred(text, limit).view()
    for rank in range(len(stars)):
        queue.push((text[stars[rank]], 1, rank, stars[rank], 0))
    places, prefixes = Store(), Store()
    k, before = 0, (None, 1, -1)
    while queue:
        symbol, rising, _, i, held = queue.pop()
        if symbol != before[0]:
            held = 0
        elif rising:
            held = min(cap, ask(before[2], i)) if common else 0
        low.add(k, held)
        if not rising:
            places.append(i)
            prefixes.append(held)
        if i and (above := text[i - 1]) >= symbol:
            queue.push((above, 0, k, i - 1, min(cap, 1 + low.since(last[above])) if above in last and common else 0))
            last[above] = k
        before, k = (symbol, rising, i), k + 1

    falling, values = places.view(), prefixes.view()
    queue, low, last = Queue(limit), Minima(), {}
    at, k, before, given = len(falling) - 1, 0, (None, False, -1), 0
    while queue or at >= 0:
        top = queue.heap[0] if queue.heap else None
        if queue.heads and (top is None or queue.heads[0][0] < top):
            top = queue.heads[0][0]
        if top is not None and (at < 0 or -top[0] >= text[falling[at]]):
            symbol, _, _, i, held = queue.pop()
            symbol, rising = -symbol, True
            if symbol != before[0]:
                held = 0
        else:
            i, rising = falling[at], False
            symbol = text[i]
            held = 0 if symbol != before[0] else given if not before[1] else (min(cap, ask(before[2], i)) if common else 0)
            given = values[at]
            at -= 1
        low.add(k, held)
        yield i, held
        if i and ((under := text[i - 1]) < symbol or (under == symbol and rising)):
            queue.push((-under, 0, k, i - 1, min(cap, 1 + low.since(last[under])) if under in last and common else 0))
            last[under] = k
        before, k = (symbol, rising, i), k + 1


def repeats(texts: Iterator[bytes], cap: int, limit: int = 1 << 16) -> Iterator[list[tuple[int, int]]]:
    """Runs of (text, place) of all suffixes that share their first `cap` bytes, two or more to a run; no match leaves its text."""
    symbols, starts, data = Store(), array("q"), tempfile.TemporaryFile()
    for number, text in enumerate(texts):
        starts.append(symbols.size)
        data.write(text + b"\0")
        for byte in text:
            symbols.append(byte)
        symbols.append(256 + number)
    if not starts:
        return
    data.flush()
    held, size = mmap.mmap(data.fileno(), 0, access=mmap.ACCESS_READ), symbols.size

    def of(i: int) -> tuple[int, int]:
        """The text a place is in, and where that ends."""
        number = bisect_right(starts, i) - 1
        return number, (starts[number + 1] if number + 1 < len(starts) else size) - 1

    def common(i: int, j: int) -> int:
        n = min(of(i)[1] - i, of(j)[1] - j, cap)
        differ = int.from_bytes(held[i : i + n], "big") ^ int.from_bytes(held[j : j + n], "big")
        return n - (differ.bit_length() + 7) // 8

    run: list[tuple[int, int]] = []
    for i, shared in suffixes(symbols.view(), limit, cap, common):
        if shared < cap:
            if len(run) > 1:
                yield run
            run = []
        number = of(i)[0]
        run.append((number, i - starts[number]))
    if len(run) > 1:
        yield run
