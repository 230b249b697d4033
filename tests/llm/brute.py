"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, k: int) -> frozenset:
    words = _WORDS.findall((text or "").translate(_FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def least_reachable(n: int, links: list[tuple[int, int]], ids: list) -> list:
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[root(a)] = root(b)
    least: dict = {}
    for i in range(n):
        if ids[i] is not None:
            r = root(i)
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(root(i)) for i in range(n)]


def jaccard_components(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    """(doc_id, n, component) for (doc_id, text)."""
    sets = [shingles(text, k) for _, text in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    found = least_reachable(len(rows), links, [d for d, _ in rows])
    return [(d, len(s), c) for (d, _), s, c in zip(rows, sets, found, strict=True)]


def repeated_paragraphs(rows: list[tuple], percent: int = 80, least: int = 20) -> list[tuple]:
    """(doc_id, n_lines, removed lines) for (doc_id, text) with different doc_ids."""
    places, counts = [], {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        if len(lines) > 1 and lines[-1] == "":
            lines.pop()
        counts[doc] = len(lines)
        for i, line in enumerate(lines):
            words = _WORDS.findall(line.translate(_FOLD))
            if len(words) >= least:
                places.append((doc, i, shingles(line, 5)))
    links = []
    for i, a in enumerate(places):
        for j in range(i):
            b = places[j]
            if 100 * len(a[2] & b[2]) >= percent * len(a[2] | b[2]):
                links.append((i, j))
    keep = least_reachable(len(places), links, [p[:2] for p in places])
    gone: dict = {doc: [] for doc, _ in rows}
    for (doc, line, _), k in zip(places, keep, strict=True):
        if (doc, line) != k:
            gone[doc].append(line)
    return [(doc, counts[doc], tuple(gone[doc])) for doc, _ in rows]


def repeated_bytes(rows: list[tuple], length: int = 50) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, sha256) for (doc_id, text)."""
    smallest: dict = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            smallest[s] = min(smallest.get(s, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if smallest[raw[i : i + length]] < doc:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
