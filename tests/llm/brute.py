"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter
from itertools import combinations

FOLD = {c: c + 32 for c in range(65, 91)}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def quality(text):
    words, grams = spaced(text), []
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def kept_by_rules(text, dup_percent):
    n, chars, symbols, dup, repeat = quality(text)
    upper = sum(1 for c in text or "" if __import__("unicodedata").category(c) == "Lu")
    lines = len((text or "").split("\n"))
    return not (n < 10 or 100 * repeat > 20 * n or symbols * 100 > n * 30 or lines * dup_percent < dup * 100 or upper * 100 > chars * 40 or chars < n * 2 or chars > n * 25)


def shingle_set(text, n):
    words = spaced((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def components(docs, percent, n):
    """(place in docs) -> (size of the set, smallest doc_id of the component)."""
    sets = [shingle_set(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    pairs = {p for held in where.values() if len(held) < 3000 for p in combinations(held, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def benchmark_hits(text, items, n=10):
    words = alnum(text)
    hit, found = set(), set()
    for key, item in items:
        own = alnum(item)
        size = min(n, len(own))
        for k in range(len(own) - size + 1) if size else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(key))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, expression in BASE:
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out
