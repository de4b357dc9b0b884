"""Plain Python answers for small tables of rows (doc_id, text, ...)."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return (t or "").translate(LOW)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def contamination(docs, benchmark):
    windows = defaultdict(set)
    for item, text in benchmark:
        w = WORDS.findall(low(text))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k:k + n])].add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, items = WORDS.findall(low(text)), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    items |= windows[tuple(w[k:k + n])]
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def license_base(docs):
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    out = []
    for i, text in docs:
        w = WORDS.findall(low(text))
        hits = [(k, label) for p, label in phrases.items() for k in range(len(w)) if tuple(w[k:k + len(p)]) == p]
        out.append((i, len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None),
                    ",".join(sorted({x for _, x in hits}))))
    return out


def dedup(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for i, text in docs:
        if i is not None:
            for x in (text or "").split("\n"):
                if len(key(x)) >= 20:
                    holders[key(x)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
                    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def quality(docs):
    out = []
    for i, text in docs:
        text = text or ""
        w, seen, dup, lines = SPACED.findall(text), set(), 0, 0
        for x in text.split("\n"):
            if SPACED.search(x):
                lines += 1
                dup += x in seen
                seen.add(x)
        grams = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        hit = set()
        for k in range(len(w) - 7):
            if grams[tuple(w[k:k + 8])] >= 2:
                hit.update(range(k, k + 8))
        symbols, chars = len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, w))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        kept = not (failed or chars < 2 * len(w) or chars > 20 * len(w) or symbols > len(w) or 100 * dup > 50 * lines)
        out.append((i, len(w), chars, symbols, dup, len(hit), failed, kept))
    return out


def shingles(text, k=4):
    w = SPACED.findall(low(text))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_classes(docs):
    """(doc_id, n_shingles, component, links) per row."""
    sets = [shingles(t) for _, t in docs]
    distinct = sorted({s for s in sets if s}, key=sorted)
    number = {s: n for n, s in enumerate(distinct)}
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(distinct)):
        for b in range(a):
            n = len(distinct[a] & distinct[b])
            if 100 * n >= 85 * (len(distinct[a]) + len(distinct[b]) - n):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    smallest = {}
    for (i, _), s in zip(docs, sets):
        if s and i is not None:
            r = find(number[s])
            smallest[r] = min(i, smallest.get(r, i))
    return [(i, len(s), smallest.get(find(number[s])) if s else i, links[number[s]] if s else 0) for (i, _), s in zip(docs, sets)]
