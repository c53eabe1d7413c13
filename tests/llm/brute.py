"""Plain re-computations that the operators are held against."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text: str | None, width: int) -> set:
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def near_components(rows: list[tuple[int, str | None]], width: int, threshold: int) -> dict[int, tuple[int, int]]:
    """key -> (set size, smallest key reachable)."""
    sets = {k: shingles(t, width) for k, t in rows}
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    where: dict = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    pairs = {p for ks in where.values() if len(ks) > 1 for p in combinations(sorted(set(ks)), 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


FIELDS = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+|(?<![0-9a-z])(?=[a-f]*[0-9])[0-9a-f]{8,}(?![0-9a-z])|[0-9][0-9.,:/-]*", re.ASCII)


def deduped_lines(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int, int]]:
    """key -> (text left, recurring lines, dropped lines): all templates of all lines, one by one."""
    low = lambda s: "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
    having: dict = {}
    own: dict = {}
    for k, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            tokens = tuple(FIELDS.sub("<*>", w) for w in re.findall(r"[^ \t\n\x0b\f\r]+", low(line)))
            if not any(w != "<*>" for w in tokens):
                continue
            n = len(tokens)
            names = [(tokens, None, None)]
            for width in (1, 2):
                for p in range(n - width + 1) if 10 * width <= 3 * n else ():
                    rest = tokens[:p] + tokens[p + width :]
                    if 10 * sum(w != "<*>" for w in rest) >= 7 * n:
                        names.append((rest, p, width))
            own[k, i] = names
            for name in names:
                having.setdefault(name, set()).add(k)
    out = {}
    for k, t in rows:
        parts = (t or "").split("\n")
        again = {i for i in range(len(parts)) if any(len(having[x]) > 1 for x in own.get((k, i), ()))}
        gone = {i for i in again if any(min(having[x]) < k for x in own[k, i] if len(having[x]) > 1)}
        out[k] = ("\n".join(x for i, x in enumerate(parts) if i not in gone), len(again), len(gone))
    return out
