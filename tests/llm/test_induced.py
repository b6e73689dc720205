import random
from array import array

import pytest

from tidemill.llm.induced import Queue, repeats, suffixes


def test_queue_goes_to_disk_and_back():
    rng = random.Random(1)
    items = [(rng.randrange(50), i) for i in range(2000)]
    queue = Queue(37)
    for item in items:
        queue.push(item)
    assert [queue.pop() for _ in items] == sorted(items) and not queue and len(queue.runs) > 40


@pytest.mark.parametrize("limit", [5, 1 << 18])
def test_suffixes_and_common_prefixes_equal_brute_force(limit):
    rng = random.Random(2)
    texts = ["", "a", "ab", "ba", "aaaa", "banana", "mississippi", "abababab", "abcabcacab"]
    texts += ["".join(rng.choice("ab" if k % 2 else "abcd") for _ in range(rng.randrange(1, 60))) for k in range(150)]
    for text in texts:
        def shared(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
        found = list(suffixes(memoryview(array("q", map(ord, text))), limit, 7, shared))
        assert [i for i, _ in found] == want
        assert [h for _, h in found] == [0] * bool(text) + [min(7, shared(a, b)) for a, b in zip(want, want[1:])]


@pytest.mark.parametrize("limit", [50, 1 << 18])
def test_repeats_equal_brute_force(limit):
    rng = random.Random(3)
    for _ in range(20):
        base = [bytes(rng.choice(b"abc") for _ in range(30)) for _ in range(3)]
        texts = [b"".join(rng.choice(base)[: rng.randrange(5, 30)] for _ in range(rng.randrange(4))) for _ in range(8)]
        groups = {}
        for t, text in enumerate(texts):
            for i in range(len(text) - 9):
                groups.setdefault(text[i : i + 10], []).append((t, i))
        want = sorted(sorted(g) for g in groups.values() if len(g) > 1)
        assert sorted(sorted(run) for run in repeats(iter(texts), 10, limit)) == want
