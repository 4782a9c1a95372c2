"""Slow, independent answers for small inputs."""

from functools import lru_cache


def word_ratio(domain, words):
    """Best disjoint cover by trying every way to cut the string."""

    @lru_cache(maxsize=None)
    def best(rest):
        if not rest:
            return 0
        skip = best(rest[1:])
        return max([skip] + [len(w) + best(rest[len(w):]) for w in words if w and rest.startswith(w)])

    return best(domain) / len(domain) if domain else 0.0


def longest_word(domain, words):
    return max([len(w) for w in words if w in domain] or [0]) / len(domain) if domain else 0.0


def pronounceability(domain, grams):
    if len(domain) < 3:
        return 0.0
    ps = [grams.get(domain[i:i + 3], 1e-10) for i in range(len(domain) - 2)]
    return sum(ps) / len(ps)


def edit_distance(a, b):
    @lru_cache(maxsize=None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    return float(d(len(a), len(b)))


def features(domains, words, grams):
    out = []
    for i, d in enumerate(domains):
        digits = sum(c.isdigit() for c in d) / len(d) if d else 0.0
        previous = domains[i - 1] if i else d
        out.append((
            float(len(d)), digits, word_ratio(d, words), pronounceability(d, grams),
            longest_word(d, words), edit_distance(d, previous),
        ))
    return out
