"""A tiny model of annotated relations in plain Python, to compare Spark against.

A relation is {tuple: polynomial}; a polynomial is {monomial: coefficient}; a
monomial is a sorted tuple of variable names with repeats. The other semirings
are images of the polynomials.
"""

from __future__ import annotations

from collections import Counter


def var(name):
    return Counter({(name,): 1})


def one():
    return Counter({(): 1})


def add(p, q):
    return Counter(p) + Counter(q)


def mul(p, q):
    out = Counter()
    for m, c in p.items():
        for n, d in q.items():
            out[tuple(sorted(m + n))] += c * d
    return out


def project(rel, positions):
    out = {}
    for row, p in rel.items():
        key = tuple(row[i] for i in positions)
        out[key] = add(out.get(key, Counter()), p)
    return out


def cross(a, b):
    return {r + s: mul(p, q) for r, p in a.items() for s, q in b.items()}


def select(rel, test):
    return {r: p for r, p in rel.items() if test(r)}


def msum(a, b):
    return {r: add(a.get(r, Counter()), b.get(r, Counter())) for r in set(a) | set(b)}


def exists(rel):
    return {r: one() for r in rel}


def count(p):
    return sum(p.values())


def absorbed(clauses):
    sets = {frozenset(c) for c in clauses}
    return {c for c in sets if not any(d < c for d in sets)}


def clause_text(p):
    parts = ["(" + " ∧ ".join(sorted(c)) + ")" if c else "True" for c in absorbed(p)]
    return " ∨ ".join(sorted(parts))


def monomial_text(m):
    if not m:
        return "1"
    return "·".join(f"{v}^{e}" if e > 1 else v for v, e in sorted(Counter(m).items()))


def poly_text(p):
    out = []
    for text, c in sorted((monomial_text(m), c) for m, c in p.items()):
        out.append(str(c) if text == "1" else text if c == 1 else f"{c}·{text}")
    return " + ".join(out)


def image(rel, semiring):
    """What a rendered result of that semiring should hold."""
    if semiring == "B":
        return {r: True for r in rel}
    if semiring == "N":
        return {r: count(p) for r, p in rel.items()}
    return {r: (clause_text if semiring == "B[X]" else poly_text)(p) for r, p in rel.items()}
