"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(docs, window=20):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def byte_repeats(docs, window=400):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = {i: (t or "").encode() for i, t in docs.items()}
    times = Counter(b[p : p + window] for b in raw.values() for p in range(len(b) - window + 1))
    out = {}
    for i, b in raw.items():
        gone, end = bytearray(len(b)), 0
        for p in range(len(b) - window + 1):
            if times[b[p : p + window]] > 1:
                gone[max(p, end) : p + window] = b"\1" * (p + window - max(p, end))
                end = p + window
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(docs, k=4, percent=80):
    """doc_id -> (n_shingles, component_id, kept), by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    parent, holders = {i: i for i in sets}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sorted(sets.items()):
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    times = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
    again = [False] * len(w)
    for p in range(len(w) - 7):
        if times[tuple(w[p : p + 8])] > 1:
            again[p : p + 8] = [True] * 8
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(again),
            len(w) < 20 or 100 * sum(again) > 30 * len(w))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def lines(docs, edits=2, least=32):
    """doc_id -> (n_lines, n_removed, kept_sha256); lines below ``least`` characters only equal ones, blank lines none."""
    first = {}
    for i, t in sorted(docs.items()):
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= least or x.strip(" \t\n\r\x0b\x0c"):
                first.setdefault(x, (i, k))
    long = [x for x in first if len(x) >= least]
    near, count = set(), {x: Counter(x) for x in long}
    by_length = defaultdict(list)
    for x in long:
        by_length[len(x)].append(x)
    for x in long:
        for size in range(len(x), len(x) + edits + 1):
            for y in by_length.get(size, ()):
                if x != y and (count[x] - count[y]).total() <= edits and (count[y] - count[x]).total() <= edits:
                    if distance(x, y) <= edits:
                        near.add(max(x, y, key=first.get))
    out = {}
    for i, t in docs.items():
        rows = (t or "").split("\n")
        keep = [x for k, x in enumerate(rows) if x not in first or (x not in near and first[x] == (i, k))]
        out[i] = (len(rows), len(rows) - len(keep), sha("\n".join(keep)))
    return out


def conversations(rows):
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256)."""
    out, grouped = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in grouped.items():
        turns.sort()
        learnt = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(learnt), sha(learnt))
    return out


def archive(pages):
    """page_id -> (payload_bytes, payload_digest, record_type, refers_to)."""
    raw, first = {i: (h or "").encode() for i, h in pages.items()}, {}
    for i in sorted(raw):
        first.setdefault(raw[i], i)
    return {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit",
                None if first[b] == i else first[b]) for i, b in raw.items()}


def best_score(word, score, unknown):
    """Highest total score of any segmentation of a word."""
    best = [0.0] + [-float("inf")] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(end):
            if word[begin:end] in score:
                best[end] = max(best[end], best[begin] + score[word[begin:end]][0])
        if word[end - 1] not in score:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def hard_negatives(rows, every=50, positives=5, negatives=3):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), by all inner products."""
    kept = set()
    for i, v, label in rows:
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
            kept.add((i, label, tuple(math.floor(256 * float(c)) for c in v)))
    out = []
    for i, label, x in kept:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), j is None, j, other == label) for j, other, y in kept if j != i]
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        for p in [r for r in scored if r[3]][:positives]:
            fit = [r for r in scored if not r[3] and 50 * -p[0] <= 100 * -r[0] <= 95 * -p[0]]
            out += [(i, p[2], k, r[2], -p[0], -r[0]) for k, r in enumerate(fit[:negatives], 1)]
    return out
