"""Plain Python versions of the operators, written from their contracts, for comparison."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def repeated_words(w):
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)})


def base_measures(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(w),
        sum(map(len, w)),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated_words(w),
    )


def base_failed(text):
    n, _, _, _, repeated = base_measures(text)
    return n < 50 or 100 * repeated > 50 * n


def removed_lines(docs, percent=80):
    """{doc_id: numbers of lines with an earlier line of at least that similarity}, docs as (doc_id, text)."""
    seen, out = [], {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            w = frozenset(words(line))
            if not w:
                continue
            if any((100 + percent) * len(w & x) >= percent * (len(w) + len(x)) for x in seen):
                gone.append(i)
            seen.append(w)
        if gone:
            out[doc_id] = gone
    return out


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else (tuple(w[i : i + width]) for i in range(len(w) - width + 1)))


def components(docs, percent=85):
    """{doc_id: (size of the set, smallest linked doc_id)}, docs as (doc_id, text)."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def targets(sizes, weights=(1, 2, 3), limit=3.0):
    """{source: target}: shares by weight, the excess above the limit shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_names = float(sum(sizes.values())), list(names)
    while open_names and left > 1e-9:
        total = sum(weight[s] for s in open_names)
        full = [s for s in open_names if left * weight[s] / total >= limit * sizes[s]]
        if not full:
            for s in open_names:
                target[s] = left * weight[s] / total
            break
        for s in full:
            target[s] = limit * sizes[s]
            left -= target[s]
            open_names.remove(s)
    return target
