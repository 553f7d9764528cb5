"""Plain versions of the operators' results, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def roots(nodes, links):
    """The smallest node reachable from each."""
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {n: top(n) for n in nodes}


def substring(docs, width=20):
    """doc_id -> (n_words, n_removed, sha256 of what is kept) of (doc_id, text) rows."""
    first = {}
    split = {d: words(t) for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (d, i))
    out = {}
    for d, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (d, i):
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {d: (len(sets[d]), root[d]) for d in ids}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if runs[tuple(w[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len({*lines}), sum(hit)


def cosine_links(rows, threshold=0.93):
    """vec_id -> (n_links, component_id) of (vec_id, vector, label) rows."""

    def usable(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    good = [(i, v, y) for i, v, y in rows if y is not None and usable(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= threshold]
    n = Counter(x for pair in links for x in pair)
    root = roots([r[0] for r in rows], links)
    return {i: (n[i], root[i]) for i in root}


def token_ids(texts, path, end=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def patience(a, b):
    """Matched (place in a, place in b): equal ends first, then the longest rising run of words unique on both sides, then its gaps."""

    def within(lo, hi, left, right):
        if lo < hi and left < right and a[lo] == b[left]:
            return [(lo, left), *within(lo + 1, hi, left + 1, right)]
        if lo < hi and left < right and a[hi - 1] == b[right - 1]:
            return [*within(lo, hi - 1, left, right - 1), (hi - 1, right - 1)]
        mine, other = a[lo:hi], b[left:right]
        anchors = [(i, left + other.index(w)) for i, w in enumerate(mine, lo) if mine.count(w) == other.count(w) == 1]
        chains = []  # the longest chain that ends at each anchor; of equal ones that with the smallest end goes on
        for i, j in anchors:
            longest = max((c for c in chains if c[-1][1] < j), key=lambda c: (len(c), -c[-1][1]), default=[])
            chains.append([*longest, (i, j)])
        if not chains:
            return []
        best = max(chains, key=lambda c: (len(c), -c[-1][1]))
        out, (p, q) = [], (lo, left)
        for i, j in best:
            out += [*within(p, i, q, j), (i, j)]
            p, q = i + 1, j + 1
        return out + within(p, hi, q, right)

    return within(0, len(a), 0, len(b))


def in_runs(matched, least=2):
    places = {*matched}
    length = lambda i, j, step: 0 if (i, j) not in places else 1 + length(i + step, j + step, step)
    return [(i, j) for i, j in matched if length(i, j, 1) + length(i, j, -1) - 1 >= least]


def licenses(text, templates, coverage=0.8):
    """Names of the templates that the text or some stretch of it covers enough of."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    have, out = split(text), set()
    for name, template in templates.items():
        t = split(template)
        width, slack = len(t), len(t) // 4 + 1
        if (Counter(have) & Counter(t)).total() / width < coverage:
            continue
        parts = [have] + [have[max(0, i) : max(0, i) + width + 2 * slack] for i in range(-slack, len(have))]
        if any(len(in_runs(patience(p, t))) / width >= coverage for p in parts):
            out.add(name)
    return out
