"""Plain readings of the operators' contracts, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None) -> frozenset:
    found = words((text or "").translate(LOWER))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def components(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """``(doc_id, n_shingles, component_id)`` by comparing all sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders: dict = defaultdict(list)
    for i, s in enumerate(sets):
        shared: Counter = Counter()
        for g in s:
            shared.update(holders[g])
            holders[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def base_statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``"""
    text = text or ""
    found = words(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + k for i in range(len(found) - 2) if windows[tuple(found[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(found), sum(map(len, found)), symbols, dup, len(covered)


def without_repeats(rows: list[tuple[int, str | None]], window: int = 50) -> list[tuple[int, int, int, str]]:
    """``(doc_id, n_words, n_removed, kept_sha256)``"""
    owner: dict = {}
    texts = [(d, words(t)) for d, t in rows]
    for d, found in texts:
        for i in range(len(found) - window + 1):
            key = tuple(found[i : i + window])
            owner[key] = min(owner.get(key, d), d)
    out = []
    for d, found in texts:
        gone = [False] * len(found)
        for i in range(len(found) - window + 1):
            if owner[tuple(found[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, g in zip(found, gone, strict=True) if not g)
        out.append((d, len(found), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def encoded(rows: list[tuple[int, str | None]], tokenizer, end_id: int = 2) -> list[tuple[int, int, int, int]]:
    """``(doc_id, start, n_tokens, ids_crc32)``; ids must be distinct."""
    import numpy as np

    at, out = 0, []
    for d, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def archived(rows: list[tuple[int, str | None]], least: int = 1000) -> list[tuple]:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``"""
    last: dict = {}
    for d, h in rows:
        data = (h or "").encode()
        last[data] = max(last.get(data, d), d)
    out = []
    for d, h in rows:
        data = (h or "").encode()
        shared = len(data) >= least and last[data] != d
        out.append((d, len(data), hashlib.sha1(data).hexdigest(), "revisit" if shared else "response", last[data] if shared else None))
    return out


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Water filling with weights 1, 2, 3 in order and a cap of 3 sizes, one step at a time."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total = sum(sizes.values())
    capped: set = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped.update(over)


def main_text(html: str) -> str:
    """The text of ``article`` in pages of the fixture's kind, where all else is outside it."""
    import html as references

    body = re.search(r"<article>(.*?)(?:</article>|\Z)", html, re.DOTALL)
    text = re.sub(r"</?(?:p|h1|br|article)\b[^>]*(?:>|\Z)", " ", body.group(1) if body else "")
    text = re.sub(r"</?[a-z][^>]*(?:>|\Z)", "", text)
    return " ".join(references.unescape(text).split())
