"""Plain versions of the operators, row by row, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def folded_words(text):
    return words((text or "").translate(FOLD))


def shingles(text, size=5):
    found = folded_words(text)
    return {tuple(found[k: k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def components(texts):
    """Smallest linked id and number of shingles, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def base_secrets(text):
    text, spans = text or "", []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans += [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def lines(text):
    found = []
    for part in (text or "").split("\n"):
        line = []
        for word in words(part):
            line.append(word)
            if word[-1] in ".!?":
                found.append(tuple(line))
                line = []
        if line:
            found.append(tuple(line))
    return found


def removed_lines(rows, least_words=10):
    """Lines and removed lines of each ``(id, text)``, in order of the id."""
    seen, result = set(), {}
    for i, text in sorted(rows):
        own, gone = lines(text), set()
        for k in range(len(own) - 2):
            window = tuple(own[k: k + 3])
            if sum(map(len, window)) >= least_words:
                if window in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(window)
        result[i] = (len(own), len(gone))
    return result


def rule_counts(text):
    found = words(text)
    windows = [tuple(found[k: k + 8]) for k in range(len(found) - 7)]
    counts, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if counts[window] > 1:
            covered |= set(range(k, k + 8))
    full = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(full) - len(set(full)), len(covered))


def base_licenses(text, phrases):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = sorted((k, label) for phrase, label in phrases for k in range(len(found))
                    if found[k: k + len(phrase.split())] == phrase.split())
    return (len(found), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({label for _, label in places})))


def leaks(docs, items, size=10):
    """Documents that hold ``size`` consecutive words of an item."""
    grams = defaultdict(set)
    for item, text in items:
        found = folded_words(text)
        for k in range(len(found) - size + 1):
            grams[tuple(found[k: k + size])].add(item)
    return {(i, item) for i, text in docs for found in [folded_words(text)] for k in range(len(found) - size + 1)
            for item in grams.get(tuple(found[k: k + size]), ())}
