"""Plain single-machine forms of what the operators compute."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_shingles(text, width=5):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def union(items, linked):
    """The smallest item of each item's component."""
    at = {x: x for x in items}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    items = sorted(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if root(a) != root(b) and linked(a, b):
                x, y = sorted((root(a), root(b)))
                at[y] = x
    return {x: root(x) for x in items}


def near_components(rows, percent):
    sets = {k: word_shingles(t) for k, t in rows}

    def linked(a, b):
        x, y = sets[a], sets[b]
        return bool(x) and bool(y) and 100 * len(x & y) >= percent * len(x | y)

    return union(list(sets), linked)


def line_shingles(line, width=8):
    norm = line.strip(" \t\n\x0b\x0c\r").lower()
    return {norm[i : i + width] for i in range(len(norm) - width + 1)}
