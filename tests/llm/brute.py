"""Brute-force versions that the tests compare with."""

from leafmill.llm import shingles


def groups(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return [find(i) for i in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_classes(texts):
    words = [shingles.plain(t or "").split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    return groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if words[i] and words[j] and jaccard(sets[i], sets[j]) >= 0.8])
