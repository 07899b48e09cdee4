"""Texts and plain versions of the definitions for the tests."""

import random
import re

WORD = re.compile(r"[^\W_]+")


def triples(text, least=12):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= least else set()


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def corpus(seed=1, base=60):
    """(id, text): random texts, edits, copies, containments, a form with filled slots, and odd cases."""
    rng = random.Random(seed)
    out = [sentence(rng, rng.randrange(8, 90)) for _ in range(base)]
    for t in list(out):
        w = t.split()
        for cut in (1, 2, 5):
            v = list(w)
            for _ in range(cut):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9)}"
            out.append(" ".join(v))
        out.append(t.upper() + "!")
        out.append(sentence(rng, 15) + " " + t)
    form = sentence(rng, 60).split()
    for _ in range(25):
        v = list(form)
        for i in range(3, 60, 7):
            v[i] = f"s{rng.randrange(1000)} s{rng.randrange(1000)}"
        out.append(" ".join(v))
    out += [None, "", "  ", "one two three", "a b c d e f g h i j k l", "a a a a a a a a a a a a a a", "é " * 20, "漢字 " * 15, "x" * 5000 + " " + sentence(rng, 3000)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


def jaccard_pairs(rows, least):
    sets = [(i, triples(t)) for i, t in rows]
    return {(i, j) for i, a in sets for j, b in sets if i < j and a and b and len(a & b) >= least * len(a | b) - 1e-9}


def groups(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    out = {}
    for x in up:
        out.setdefault(root(x), set()).add(x)
    return out
