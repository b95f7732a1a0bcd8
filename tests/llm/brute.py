"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_sets(texts, n):
    out = []
    for t in texts:
        w = SPACE.findall(lower(t or "").encode())
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def components(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs, n=4, percent=80):
    sets = dict(zip((d for d, _ in docs), shingle_sets([t for _, t in docs], n)))
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter()
    for same in holders.values():
        for i, a in enumerate(same):
            for b in same[:i]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), k in shared.items() if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k)]
    found = components(list(sets), links)
    return {d: (len(s), found[d], d == found[d]) for d, s in sets.items()}


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        left = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def benchmark_hits(text, items, window=10):
    """(n_words, n_hit, item ids) of a text."""
    words = WORD.findall(lower(text or ""))
    hit, names = set(), set()
    for item, t in items:
        w = WORD.findall(lower(t or ""))
        n = min(window, len(w))
        if not n:
            continue
        for k in range(len(w) - n + 1):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 24]
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def edits(a, b):
    """Edit distance of two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def repeated_lines(docs, percent=80):
    """{doc_id: places of lines that go}, and the number of linked pairs of unlike lines."""
    places = defaultdict(list)
    for d, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            if w := tuple(x for x in re.split(r"[\W_]+", line.lower()) if x):
                places[w].append((d, i))
    forms = sorted(places, key=lambda w: min(places[w]))
    links = []
    for i, a in enumerate(forms):
        for j in range(i):
            longest = max(len(a), len(forms[j]))
            if 100 * (longest - min(len(a), len(forms[j]))) <= (100 - percent) * longest and 100 * edits(a, forms[j]) <= (100 - percent) * longest:
                links.append((i, j))
    group = components(range(len(forms)), links)
    held = defaultdict(list)
    for i, w in enumerate(forms):
        held[group[i]] += places[w]
    out = defaultdict(set)
    for same in held.values():
        for d, i in sorted(same)[1:]:
            out[d].add(i)
    return dict(out), len(links)
