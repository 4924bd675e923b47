"""Similarity flooding over two schema graphs (names, types and nesting), in numpy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

Leaf = tuple[tuple[str, ...], str]


#: Trigrams and likeness of the names met so far; few names make up all schemas. Emptied when it grows.
_grams: dict[str, frozenset[str]] = {}
_alike: dict[tuple[str, str], float] = {}


def trigrams(name: str) -> frozenset[str]:
    """Letter trigrams of a name in lower case, separators left out, padded at both ends."""
    got = _grams.get(name)
    if got is None:
        if len(_grams) > 100_000:
            _grams.clear()
        s = "".join(c for c in name.lower() if c.isalnum())
        got = _grams[name] = frozenset((f"##{s}##")[i : i + 3] for i in range(len(s) + 2)) if s else frozenset()
    return got


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the two names' trigrams."""
    got = _alike.get((a, b))
    if got is None:
        if len(_alike) > 500_000:
            _alike.clear()
        x, y = trigrams(a), trigrams(b)
        got = _alike[a, b] = 2 * len(x & y) / (len(x) + len(y)) if x and y else float(a == b)
    return got


class SchemaGraph:
    """Elements (every prefix of every leaf path), each with a name, a type and a parent."""

    def __init__(self, leaves: Sequence[Leaf]):
        kinds: dict[tuple[str, ...], set[str]] = {(): {"object"}}
        for path, kind in leaves:
            for i in range(1, len(path)):
                kinds.setdefault(path[:i], set()).add("object")
            kinds.setdefault(path, set()).add(kind)
        self.paths = sorted(kinds)
        self.kinds = [frozenset(kinds[p]) for p in self.paths]
        self.leaf = np.array([bool(k - {"object"}) for k in self.kinds])
        at = {p: i for i, p in enumerate(self.paths)}
        self.child = np.zeros((len(at), len(at)))
        for p in self.paths[1:]:
            self.child[at[p[:-1]], at[p]] = 1


def flood(a: SchemaGraph, b: SchemaGraph, seed: Mapping[tuple, float] = {}, rounds: int = 60, eps: float = 1e-4) -> np.ndarray:
    """Match scores of all element pairs at convergence.

    The pairwise connectivity graph has an edge between two pairs whose elements are joined by the
    same relation (child, name, type) in both schemas; along it a pair hands its score on, shared
    evenly among its neighbours, in both directions. ``seed`` overrides first scores of path pairs.
    """
    names_a, names_b = ([p[-1] if p else "" for p in g.paths] for g in (a, b))
    words_a, words_b = sorted(set(names_a)), sorted(set(names_b))
    kinds_a, kinds_b = (sorted(set().union(*g.kinds)) for g in (a, b))
    has = lambda rows, cols, test: np.array([[float(test(r, c)) for c in cols] for r in rows])
    name_a, name_b = has(names_a, words_a, str.__eq__), has(names_b, words_b, str.__eq__)
    kind_a, kind_b = has(a.kinds, kinds_a, lambda k, c: c in k), has(b.kinds, kinds_b, lambda k, c: c in k)
    first = [np.zeros((len(a.paths), len(b.paths))), has(words_a, words_b, name_similarity), has(kinds_a, kinds_b, str.__eq__)]
    first[0] = name_a @ first[1] @ name_b.T
    at_a, at_b = ({p: i for i, p in enumerate(g.paths)} for g in (a, b))
    for (p, q), score in seed.items():
        if p in at_a and q in at_b:
            first[0][at_a[p], at_b[q]] = score
    share = lambda m: m / np.maximum(m.sum(1, keepdims=True), 1)
    down = share(a.child), share(b.child)
    # what hands scores on, by relation: to the shared node, and back
    links = [(share(x).T, share(y), share(x.T).T, share(y.T)) for x, y in ((name_a, name_b), (kind_a, kind_b))]
    now = [x.copy() for x in first]
    for _ in range(rounds):
        base = [f + s for f, s in zip(first, now)]
        grown = [x.copy() for x in base]
        grown[0] += down[0].T @ base[0] @ down[1] + a.child @ base[0] @ b.child.T
        for k, (up_a, up_b, back_a, back_b) in enumerate(links, 1):
            grown[k] += up_a @ base[0] @ up_b
            grown[0] += back_a @ base[k] @ back_b
        top = max(x.max(initial=0) for x in grown) or 1.0
        grown = [x / top for x in grown]
        moved = max(np.abs(x - y).max(initial=0) for x, y in zip(grown, now))
        now = grown
        if moved < eps:
            break
    return now[0]


def correspondences(a: SchemaGraph, b: SchemaGraph, scores: np.ndarray, relative: float = 0.6, floor: float = 0.1, many: bool = False) -> list[tuple[tuple, tuple, float]]:
    """Consistent leaf correspondences: one to one, best score first, each at least ``relative`` of either side's best.

    With ``many`` every leaf of ``a`` takes each leaf of ``b`` whose score is at least ``relative`` of its best
    and above its score with ``b``'s root, which stands for no counterpart (not for paths that hold objects too,
    which are like any root); ``floor`` is then not asked for.
    """
    s = np.where(np.outer(a.leaf, b.leaf), scores, 0.0)
    best_a, best_b = s.max(1, initial=0), s.max(0, initial=0)
    if many:
        nothing = np.where(a.child.any(1), 0.0, scores[:, b.paths.index(())])
        good = np.argwhere((s > 0) & (s >= relative * best_a[:, None]) & (s > nothing[:, None]))
        return [(a.paths[i], b.paths[j], float(s[i, j])) for i, j in good]
    good = np.argwhere((s >= floor) & (s >= relative * best_a[:, None]) & (s >= relative * best_b[None, :]))
    taken_a, taken_b, out = set(), set(), []
    for i, j in sorted(map(tuple, good), key=lambda ij: (-s[ij], a.paths[ij[0]] != b.paths[ij[1]], ij)):
        if i not in taken_a and j not in taken_b:
            taken_a.add(i)
            taken_b.add(j)
            out.append((a.paths[i], b.paths[j], float(s[i, j])))
    return out
