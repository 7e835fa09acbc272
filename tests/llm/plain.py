"""The contracts of the numbered queries in plain Python, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

_WORD = re.compile("[^ \\t-\\r]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def words(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def coding(rows, tokenizer) -> dict:
    out = {}
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        out[doc] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    return out


def pieces(rows, tokenizer, limit: int = 2048) -> dict:
    """(doc, start) -> (length, crc32), with the shorter piece first."""
    out = {}
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % limit or limit if len(ids) > limit else len(ids)
        stops = [first, *range(first + limit, len(ids) + 1, limit)]
        for piece, (a, b) in enumerate(zip([0, *stops], stops)):
            out[doc, piece] = (a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))
    return out


_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) with kinds 0: assign, 1: access, 2: hex."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    seen, copies = set(), 0
    for line in lines:
        copies += line in seen
        seen.add(line)
    places = defaultdict(list)
    for k in range(len(w) - 2):
        places[tuple(w[k : k + 3])].append(k)
    covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), n < 50 or 100 * len(covered) > 50 * n


def shingles(text: str | None, size: int = 4) -> frozenset:
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def near_copies(rows, size: int = 4) -> dict:
    """doc -> (size of its set, component, kept), from every pair that shares a shingle of ``size`` words."""
    sets = {doc: shingles(text, size) for doc, text in rows}
    having = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            having[x].append(doc)
    common = defaultdict(int)
    for docs in having.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                common[a, b] += 1
    head = {doc: doc for doc in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            head[b] = a
    return {doc: (len(s), root(doc), root(doc) == doc) for doc, s in sets.items()}


def without_repeats(rows, window: int = 13) -> dict:
    """doc -> (words, words removed, digest of the rest)."""
    split = {doc: words(text) for doc, text in rows}
    least: dict = {}
    for doc, w in split.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, doc), doc)
    out = {}
    for doc, w in split.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < doc:
                gone |= set(range(k, k + window))
        rest = [x for k, x in enumerate(w) if k not in gone]
        out[doc] = (len(w), len(gone), sha(" ".join(rest)))
    return out


def conversations(rows) -> dict:
    """conv -> (turns, digest of turns, loss characters, digest of assistant texts), from (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out
