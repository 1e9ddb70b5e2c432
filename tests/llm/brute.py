"""Plain restatements of the operators for small tables."""

import collections
import copy
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def kept_words(rows, window=20):
    """{id: (kept words, all)} for rows of distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for at in range(len(w) - window + 1):
            key = tuple(w[at:at + window])
            if key in seen:
                gone[at:at + window] = [True] * window
            seen.add(key)
        out[i] = ([x for x, g in zip(w, gone) if not g], w)
    return out


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(keys, pairs):
    """{key: smallest key reachable}."""
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


class Katz:
    """Bigram Katz model of token lists."""

    def __init__(self, texts, top=5):
        self.c = collections.Counter(t for x in texts for t in x)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.bi = collections.Counter(p for x in texts for p in zip(["<s>", *x], x))
        self.ctx = collections.Counter()
        for (a, _), n in self.bi.items():
            self.ctx[a] += n
        self.d1, self.d2 = self._discounts(self.c.values(), top), self._discounts(self.bi.values(), top)
        kept = sum(n * self.d1.get(n, 1) for n in self.c.values())
        self.free = max(1 - kept / self.n, 0.5 / (self.n + 1)) if self.n else 1.0
        self.share = (1 - self.free) / kept if kept else 0
        self.seen, self.below = collections.Counter(), collections.Counter()
        for (a, b), n in self.bi.items():
            self.seen[a] += n * self.d2.get(n, 1) / self.ctx[a]
            self.below[a] += self.p1(b)

    @staticmethod
    def _discounts(counts, k):
        n = collections.Counter(counts)
        tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        out = {}
        for r in range(1, k + 1):
            if n[r] and tail < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
                if 0 < x <= 1:
                    out[r] = x
        return out

    def p1(self, w):
        return self.c[w] * self.d1.get(self.c[w], 1) * self.share if self.c[w] else self.free

    def p(self, v, w):
        if v not in self.seen:
            return self.p1(w)
        s = min(1, (1 - 1 / (self.ctx[v] + 1)) / self.seen[v])
        if (v, w) in self.bi:
            return s * self.bi[v, w] * self.d2.get(self.bi[v, w], 1) / self.ctx[v]
        return (1 - s * self.seen[v]) / (1 - self.below[v]) * self.p1(w)

    def score(self, tokens):
        return sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *tokens], tokens))


class KneserNey:
    """Interpolated modified Kneser-Ney bigram model of token lists."""

    def __init__(self, texts):
        self.bi = collections.Counter(p for x in texts for p in zip(["<s>", *x], x))
        self.ctx, self.ones, self.cont = (collections.Counter() for _ in range(3))
        self.kinds = collections.defaultdict(lambda: [0, 0, 0])
        for (a, b), n in self.bi.items():
            self.ctx[a] += n
            self.cont[b] += 1
            self.kinds[a][min(n, 3) - 1] += 1
        self.d, self.low = self._d(self.bi.values()), self._d(self.cont.values())
        self.types, self.words = len(self.bi), len(self.cont)
        n = collections.Counter(min(c, 3) for c in self.cont.values())
        self.rest = sum(self.low[i] * n[i] for i in (1, 2, 3)) / self.types if self.types else 1.0

    @staticmethod
    def _d(counts):
        n = collections.Counter(counts)
        d = [0, 0.5, 0.75, 1.0]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d[1] = 1 - 2 * y * n[2] / n[1]
            if n[3]:
                d[2] = 2 - 3 * y * n[3] / n[2]
                if n[4]:
                    d[3] = 3 - 4 * y * n[4] / n[3]
        return [min(max(x, 0), m) for x, m in zip(d, (0, 0.999, 1.999, 2.999))]

    def p_low(self, w):
        c = self.cont[w]
        return max(c - self.low[min(c, 3)], 0) / max(1, self.types) + self.rest / (self.words + 1)

    def p(self, v, w):
        if not self.ctx[v]:
            return self.p_low(w)
        c = self.bi[v, w]
        free = sum(d * n for d, n in zip(self.d[1:], self.kinds[v]))
        return (max(c - self.d[min(c, 3)], 0) + free * self.p_low(w)) / self.ctx[v]

    def perplexity(self, tokens):
        return math.exp(-sum(math.log(self.p(a, b)) for a, b in zip(["<s>", *tokens], tokens)) / len(tokens))

    def perplexity_without(self, tokens):
        """Under the same discounts and number of types, after the text's own pairs are taken off all counts."""
        m = copy.copy(self)
        m.bi, m.ctx, m.cont = self.bi.copy(), collections.Counter(), collections.Counter()
        m.bi.subtract(zip(["<s>", *tokens], tokens))
        m.kinds = collections.defaultdict(lambda: [0, 0, 0])
        for (a, b), n in m.bi.items():
            if n > 0:
                m.ctx[a] += n
                m.cont[b] += 1
                m.kinds[a][min(n, 3) - 1] += 1
        m.words = len(self.cont)
        return m.perplexity(tokens)


SYMBOLS = set("#*$%&|<>")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")


def text_signals(text):
    """Counts of one text by their definitions."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if words(x)]
    found = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if found[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}

    def ascii_in(x, a, b):
        return sum(a <= c <= b for c in x)

    upper, lower = ascii_in(text, "A", "Z"), ascii_in(text, "a", "z")
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in SYMBOLS for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines),
            "n_letters": upper + lower, "n_upper": upper, "n_loud": text.count("!"),
            "n_alpha_words": sum(any(c.isascii() and c.isalpha() or c > "\x7f" for c in x) for x in w),
            "n_same": sum(a == b for a, b in zip(w, w[1:])), "n_ends": sum(x[-1] in ".!?" for x in w),
            "n_tails": sum(x[-1] in SYMBOLS for x in w)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def search(docs, items, k):
    """{item: [(doc, score)]} by scoring every document."""
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    df = collections.Counter(x for _, c in held for x in c)
    n, length = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    weight = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for x, d in df.items()}
    out = {}
    for item, text in items:
        rows = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // max(1, length)
            s = sum(weight[x] * (10**9 * c[x] // (1000 * c[x] + 12 * m)) for x in terms(text) if x in c)
            if s > 0:
                rows.append((-s, i))
        out[item] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


def collocations(rows, most=3, least=10, inside=50, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] for (text, lang) rows."""
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    good = {p: a for p, a in f.items() if a >= least}
    scored = []
    for (lang, p), a in good.items():
        if len(p) < 2:
            continue
        s, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        if not any(g == lang and len(q) > len(p) and 100 * b >= inside * a
                   and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in good.items()):
            scored.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out = []
    for lang in {x[0] for x in scored}:
        for rank, (_, s, a, p, le, r) in enumerate(sorted(x for x in scored if x[0] == lang)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)
