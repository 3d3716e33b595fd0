"""Documents and brute-force versions that several tests use."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=5):
    """Copies, near copies, shared passages, repeated lines, nulls, empty and long texts."""
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["ção", "Ünï", "the", "of", "12", "a.b,"]
    make = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passage, base, rows = make(40), make(90), []
    for i in range(n):
        kind = i % 9
        if kind == 0:
            w = base[:]
        elif kind == 1:
            w = base[:]
            w[rnd.randrange(len(w))] = "edit%d" % i
        elif kind == 2:
            w = make(rnd.randint(5, 50)) + passage + make(10)
        elif kind == 3:
            w = make(3) * rnd.randint(1, 12)
        else:
            w = make(rnd.randint(0, 120))
        text = " ".join(w)
        if kind == 4:
            text = text.replace(" ", "\n", 4) + "\nBoiler plate line number %d\nlast words %d here" % (i, i)
        rows.append((i, text, "s%d" % (i % 4)))
    rows += [(n, None, "s0"), (n + 1, "", None), (n + 2, " \t\n", "s1"), (n + 3, "one", None), (n + 4, " ".join(make(6000)), "s0"), (n + 5, "One", "s2")]
    return rows


def brute_components(rows, k=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    par = {i: i for i in sets}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                par[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        t = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if t[s] > most * sizes[s] + 1e-9]
        if not over:
            return fixed | t
        fixed |= {s: most * sizes[s] for s in over}
