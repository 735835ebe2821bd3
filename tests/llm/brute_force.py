"""Models by all pairs that several tests compare with."""

from __future__ import annotations

import re


def slow_set(text, size=5):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))) if words else frozenset()


def slow_kept(texts, likeness=0.8):
    """texts: id to text. The least ids of the groups that all pairs join."""
    sets = {i: slow_set(t) for i, t in texts.items()}
    holders, root = {}, {i: i for i in texts}
    for i, s in sets.items():
        for x in s or [None]:
            holders.setdefault(x, []).append(i)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in {j for x in sets[i] or [None] for j in holders[x] if j < i}:
            common = len(sets[i] & sets[j])
            if sets[i] == sets[j] or common >= likeness * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in texts}
