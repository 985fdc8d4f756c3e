"""Plain Python versions of the text operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def strange(rows):
    """Rows with the difficult cases of every table: nulls, empty texts, ties, repeated rows."""
    return [*rows, (None, "no id here"), (None, None), (900, None), (901, ""), (902, " \n\t "), rows[0], rows[0]]


def repeats(texts, length):
    """(bytes, removed, runs, digest) of every text."""
    seen = Counter()
    for t in texts:
        d = (t or "").encode()
        seen.update(hashlib.md5(d[i : i + length]).digest() for i in range(len(d) - length + 1))
    out = []
    for t in texts:
        d = (t or "").encode()
        gone, end = [False] * len(d), 0
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i : i + length]).digest()] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = True
                end = i + length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def passages(rows, length):
    """For each (id, text) the maximal runs of words in passages that a row of another id or text has too."""
    words = [(t or "").encode().split() for _, t in rows]
    having = defaultdict(set)
    for (i, t), w in zip(rows, words):
        for k in range(len(w) - length + 1):
            having[tuple(w[k : k + length])].add((i, t))
    out = []
    for w in words:
        runs = []
        for k in range(len(w) - length + 1):
            if len(having[tuple(w[k : k + length])]) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + length
                else:
                    runs.append([k, k + length])
        out.append([tuple(r) for r in runs])
    return out


def shingle_set(text, words=5):
    w = (text or "").split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def near_groups(texts, similar=0.8):
    """The number of the class of every text, by comparing all pairs that share a shingle."""
    number, sets = {}, []
    for t in texts:
        if (t or "") not in number:
            number[t or ""] = len(sets)
            sets.append(shingle_set(t))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in having[x]).items():
            if n / (len(s) + len(sets[j]) - n) >= similar:
                root[find(i)] = find(j)
        for x in s:
            having[x].append(i)
    return [find(number[t or ""]) for t in texts]


def counted(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    grams = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall("[#*$%&|<>]", t)),
        len(lines) - len(set(lines)),
        len(inside),
    )
