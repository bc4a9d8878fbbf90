"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def lower(text: str | None) -> str:
    return (text or "").translate(_UPPER)


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = SPACED.findall(lower(text))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(nodes, links) -> dict:
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(docs: list[tuple[int, str | None]]) -> list[tuple]:
    sets = {i: shingles(t) for i, t in docs}
    lists = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            lists[x].add(i)
    shared = Counter()
    for ids in lists.values():
        ids = sorted(ids)
        shared.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    links = [
        (a, b)
        for (a, b), n in shared.items()
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)
    ]
    found = components(sets, links)
    return sorted((i, len(sets[i]), found[i]) for i, _ in docs)


def decontaminate(docs, items) -> list[tuple]:
    windows: dict[tuple, set[int]] = defaultdict(set)
    for item, text in items:
        words = LETTERS.findall(lower(text))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = LETTERS.findall(lower(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def quality(text: str | None, shares: dict[int, float], line_share: float, line_chars: float):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), []
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    for line in lines:
        if line in seen:
            dup.append(line)
        seen.add(line)

    def inside(n: int, first_too: bool) -> list[int]:
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, before, hit = Counter(windows), set(), set()
        for i, w in enumerate(windows):
            if (count[w] > 1) if first_too else (w in before):
                hit.update(range(i, i + n))
            before.add(w)
        return sorted(hit)

    chars = sum(map(len, words))
    n_repeat = len(inside(5, True))
    failed = len(words) < 10 or 100 * n_repeat > 20 * len(words)
    line_words = sum(len(w) for x in dup for w in SPACED.findall(x))
    repeat = [sum(len(words[i]) for i in inside(n, False)) for n in shares]
    kept = (
        not failed
        and len(dup) <= line_share * len(lines)
        and line_words <= line_chars * chars
        and all(r <= s * chars for r, s in zip(repeat, shares.values(), strict=True))
    )
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), chars, symbols, len(dup), n_repeat, failed, kept
