"""Plain versions of operators, for small fixtures."""

import re

FIXTURE = "/root/testdata/sf0.001"


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^ \t\n\r\x0b\x0c]+", folded)


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_classes(texts, least=0.8):
    """{id: smallest id of its class} by comparing all pairs."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if (texts[a] or "") == (texts[b] or "") or (both and both >= least * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def grams(texts, k):
    """k words in a row, with the ids that have them."""
    out = {}
    for i, t in texts.items():
        w = words(t or "")
        for j in range(len(w) - k + 1):
            out.setdefault(tuple(w[j : j + k]), set()).add(i)
    return out
