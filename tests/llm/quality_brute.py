"""The quality classifier in plain Python, from its definition: dictionaries of counts, one document at a time."""

import math
from collections import Counter, defaultdict

SPACES = " \t\n\x0b\x0c\r"


def symbol(b):
    return 10 if b in (10, 13) else 32 if b in (9, 11, 12) else b


def discounts(counts):
    n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return [0, 0.75, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    return [0] + [min(max(x, 0.05), top) for x, top in ((1 - 2 * y * n2 / n1, 1), (2 - 3 * y * n3 / n2, 2), (3 - 4 * y * n4 / n3, 3))]


class Symbols:
    """Order 3 over bytes; costs in steps of 1/1000 bit."""

    def __init__(self, texts):
        grams = Counter()
        for t in texts:
            s = [10] * 2 + [symbol(b) for b in t.encode()]
            grams.update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
        self.levels = [grams]
        while len(next(iter(self.levels[-1]))) > 1:
            self.levels.append(Counter(g[1:] for g in self.levels[-1]))
        self.levels = self.levels[::-1]
        self.d = [discounts(x.values()) for x in self.levels]
        self.follow = [defaultdict(list) for _ in self.levels]
        for x, f in zip(self.levels, self.follow):
            for g, n in x.items():
                f[g[:-1]].append(n)
        self.held, self.costs = {}, {}

    def p(self, gram):
        if not gram:
            return 1 / 256
        if gram not in self.held:
            k, lower = len(gram) - 1, self.p(gram[1:])
            seen, d = self.follow[k].get(gram[:-1]), self.d[k]
            n = self.levels[k].get(gram, 0)
            self.held[gram] = (n - d[min(n, 3)] + sum(d[min(x, 3)] for x in seen) * lower) / sum(seen) if seen else lower
        return self.held[gram]

    def cost(self, context, data):
        s = context + [symbol(b) for b in data]
        return sum(round(-1000 * math.log2(self.p(tuple(s[i - 2 : i + 1])))) for i in range(2, len(s)))

    def text(self, text):
        return self.cost([10] * 2, text.encode()) / 1000

    def word(self, w):
        if w not in self.costs:
            self.costs[w] = self.cost([32] * 2, (w + " ").encode()) / 1000
        return self.costs[w]


def path(text):
    w = [x for x in "".join(" " if c in SPACES else c for c in text).split(" ") if x]
    return list(zip(["<"] + w, w + [">"])) if w else []


class Words:
    """Word pairs, then continuation counts, then the spelling."""

    def __init__(self, texts, symbols):
        self.symbols, self.pairs = symbols, Counter(x for t in texts for x in path(t))
        self.words = Counter(w for _, w in self.pairs)
        self.d, self.dw = discounts(self.pairs.values()), discounts(self.words.values())
        self.all, self.free = Counter(), Counter()
        for (v, _), n in self.pairs.items():
            self.all[v] += n
            self.free[v] += self.d[min(n, 3)]
        self.total = sum(self.words.values())
        self.escape = sum(self.dw[min(n, 3)] for n in self.words.values()) / self.total

    def p(self, v, w):
        n = self.words.get(w, 0)
        low = (n - self.dw[min(n, 3)]) / self.total + self.escape * 2.0 ** -self.symbols.word("" if w == ">" else w)
        if v not in self.all:
            return low
        n = self.pairs.get((v, w), 0)
        return (n - self.d[min(n, 3)] + self.free[v] * low) / self.all[v]

    def text(self, text):
        return sum(-math.log2(self.p(v, w)) for v, w in path(text))


def perplexities(docs, good, held, quantile=0.999, margin=0.05, prior=100.0):
    """docs: (doc_id, text, lang); ``good``: trusted ids, ``held`` those held out. Per row: id, four figures, keep."""
    train = [t or "" for d, t, _ in docs if d in good and d not in held]
    symbols = Symbols(train)
    models = [Words(train, symbols), symbols]
    bits = [[m.text(t or "") for m in models] for _, t, _ in docs]
    size = [len((t or "").encode()) for _, t, _ in docs]

    def marks(k, some):
        """Mean cost and threshold, in bits a byte."""
        mine = [i for i in some if docs[i][0] in good and size[i]]
        mine = [i for i in mine if docs[i][0] in held] or mine
        if not mine:
            return None
        mean = sum(bits[i][k] for i in mine) / sum(size[i] for i in mine)
        cost = sorted(math.floor((bits[i][k] + prior * mean) / (size[i] + prior) * 20000) for i in mine)
        return mean, (next(c for j, c in enumerate(cost, 1) if j >= quantile * len(cost)) + 1) / 20000 + margin

    out = []
    for i, (d, _, lang) in enumerate(docs):
        figures, keep = [], True
        for k in range(2):
            mean, limit = marks(k, [j for j in range(len(docs)) if (docs[j][2] or "") == (lang or "")]) or marks(k, range(len(docs)))
            shrunk = (bits[i][k] + prior * mean) / (size[i] + prior)
            figures += [2**shrunk if size[i] else None, 2**limit]
            keep = keep and (not size[i] or shrunk <= limit)
        out.append((d, *figures, keep))
    return out
