"""Brute-force versions of the operators, over lists of (doc_id, text) or plain values."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np

from sievecraft.llm.quality import BOILERPLATE, NAVIGATION
from sievecraft.llm.secrets import RULES
from sievecraft.llm.simhash import simhashes

SPACES = re.compile(r"[^ \t\n\r\f\v]+")


def components(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    """Least member of each one's group."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def strip(line: str) -> str:
    return line.strip(" \t\r")


def shingles(s: str, size: int) -> set[str]:
    return {s[i : i + size] for i in range(max(1, len(s) - size + 1))}


def line_pairs(lines: list[str], threshold: float = 0.8) -> list[tuple[int, int]]:
    """All pairs of near lines: by shingles of 8 characters, or by those of 4 if both have at most 128 characters."""
    out = set()
    for size in (8, 4):
        sets = [shingles(x, size) for x in lines]
        order = sorted((i for i, x in enumerate(lines) if size == 8 or len(x) <= 128), key=lambda i: len(sets[i]))
        for at, i in enumerate(order):
            for j in reversed(order[:at]):
                if len(sets[j]) < threshold * len(sets[i]):
                    break
                if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    out.add((max(i, j), min(i, j)))
    return sorted(out)


def line_groups(lines: list[str]) -> dict[str, int]:
    """Groups by all near pairs, found without any hash."""
    return dict(zip(lines, components(len(lines), line_pairs(lines))))


def dedup_lines(docs: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Documents with distinct ids, in the order of id."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = sorted({strip(x) for _, t in docs if t for x in t.split("\n")} - {""})
    group, seen, out = line_groups(lines), set(), []
    for i, t in docs:
        if not t or not t.strip(" \t\r\n"):
            out.append((i, t))
            continue
        kept, some = [], False
        for x in t.split("\n"):
            s = strip(x)
            if s and group[s] in seen:
                continue
            if s:
                seen.add(group[s])
                some = True
            kept.append(x)
        if some:
            out.append((i, "\n".join(kept)))
    return out


def near_groups(docs: list[tuple[int, str]], budget: int = 16) -> dict[int, int]:
    """Kept doc_id for each doc_id in a group of two or more."""
    h, some = simhashes([t for _, t in docs])
    order = [i for i in sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0)) if some[i]]
    pairs = [(a, b) for a in range(len(order)) for b in range(a) if np.bitwise_count(h[order[a]] ^ h[order[b]]).sum() <= budget]
    root = components(len(order), pairs)
    size = Counter(root)
    return {docs[order[i]][0]: docs[order[r]][0] for i, r in enumerate(root) if size[r] > 1}


def repeated_spans(docs: list[tuple[int, str]], width: int) -> list[tuple[int, int, int]]:
    words = [(i, SPACES.findall(t or "")) for i, t in docs]
    n = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        at = [k for k in range(len(w) - width + 1) if n[tuple(w[k : k + width])] > 1]
        span = None
        for k in at:
            if span and k <= span[1]:
                span[1] = k + width
            else:
                span = [k, k + width]
                out.append((i, span))
    return sorted(((i, a, b) for i, (a, b) in out), key=repr)


def secrets(docs: list[tuple[int, str]]) -> Counter:
    return Counter((i, r.name, m) for i, t in set(docs) if t is not None for r in RULES for m in re.findall(r.pattern, t))


def redacted(t: str) -> str:
    for r in RULES:
        t = re.sub(r.pattern, f"[{r.name}]", t)
    return t


def line_fails(s: str) -> bool:
    low, words = s.lower(), s.split(" ")
    marks = sum(c in "!?#$%&*|<>{}~^=_@/" for c in s)
    unended = s[-1] not in ".!?:;…\"'”’»)" and ". " not in s
    return (
        unended
        or (marks >= 4 and marks > 0.12 * len(s))
        or len(s) - len(s.replace(" | ", "  ")) >= 3
        or any(p in low for p in NAVIGATION + BOILERPLATE)
        or (len(words) >= 8 and len(set(words)) < 0.3 * len(words))
    )


def quality(docs: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out = []
    for i, t in docs:
        if t is None:
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or not line_fails(x.strip(" "))]
        n, k = (sum(len(x.strip(" ")) for x in y) for y in (lines, kept))
        if k and n - k <= 0.5 * n:
            out.append((i, "\n".join(kept)))
    return out


def pack(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Contents of the bins, by the rules of the rounds, with a search in place of the sweep."""
    pieces = [p for n in sizes for p in [capacity] * (n // capacity) + [n % capacity] * bool(n % capacity)]
    bins = [[p] for p in pieces if p == capacity]
    todo = sorted((p for p in pieces if p < capacity), reverse=True)
    while todo:
        room = {k: capacity - sum(b) for k, b in enumerate(bins) if sum(b) < capacity}
        widest = max(room.values(), default=0)
        big = [p for p in todo if p > widest]
        opened = big[: -(-sum(big) // capacity)]
        taken: set[int] = set()
        rest, last = todo[len(opened) :], None
        later = []
        for p in rest:
            if last and last[0] == p and room[last[1]] >= p:
                k = last[1]
            else:
                fit = [(r, k) for k, r in room.items() if r >= p and k not in taken]
                if not fit:
                    later.append(p)
                    continue
                k = min(fit)[1]
                taken.add(k)
                last = (p, k)
            bins[k].append(p)
            room[k] -= p
        bins += [[p] for p in opened]
        todo = later
    return sorted(tuple(sorted(b)) for b in bins)


def words(t: str | None) -> set[str]:
    """Terms: runs of bytes other than ASCII marks, in lower case."""
    return set(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").lower().encode()))


def band_terms(docs: list[tuple[int, str]], band: tuple[float, float]) -> list[set[str]]:
    sets = [words(t) for _, t in docs]
    df, n = Counter(w for s in sets for w in s), len(docs)
    inside = {w for w, k in df.items() if band[0] - 1e-9 <= math.log(n / k) / math.log(n) <= band[1] + 1e-9}
    return [s & inside for s in sets]


def by_bin(rows) -> list[tuple[int, ...]]:
    out = defaultdict(list)
    for r in rows:
        out[r["bin"]].append(r["n_tokens"])
    return sorted(tuple(sorted(b)) for b in out.values())
