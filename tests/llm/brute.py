"""Plain versions of the operators for small inputs."""

import random
import re
from collections import Counter, defaultdict

GAP = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(ws, width=5):
    if len(ws) < width:
        return [tuple(ws)] if ws else []
    return [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)]


def groups(rows):
    """(id, size, smallest linked id) for every (id, text)."""
    sets = [set(shingles(words(ascii_lower(t)))) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return [(d, len(sets[i]), min(ids[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def leaks(docs, items):
    """(doc, item) -> greatest weighted similarity of an item-sized window, from 0.75."""
    out = {}
    for d, t in docs:
        ws = words((t or "").lower())
        for i, u in items:
            ref = words((u or "").lower())
            if len(ws) < 5 or len(ref) < 5:
                continue
            b = Counter(shingles(ref))
            n = min(len(ref), len(ws))
            best = 0
            for s in range(len(ws) - n + 1):
                a = Counter(shingles(ws[s : s + n]))
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.75:
                out[d, i] = best
    return out


def general(line):
    return re.sub(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", "<*>", line)


def dedupe(docs, least=3, fixed=0.5):
    """{(id, text): text without recurring template lines}; ids not null."""
    docs = sorted(set(docs))
    leaf = defaultdict(lambda: defaultdict(set))
    for d in docs:
        for line in (d[1] or "").split("\n"):
            w = words(general(line))
            if len(w) >= 5:
                leaf[len(w), *w[:3]][tuple(w)].add(d)
    template = {}
    for key, forms in leaf.items():
        if len(forms) == 1 or sum(map(len, forms.values())) < least:
            template |= {f: (key, f) for f in forms}
            continue
        count = Counter((i, x) for f, ds in forms.items() for i, x in enumerate(f) for _ in ds)
        for f in forms:
            keep = tuple((i, x) for i, x in enumerate(f) if count[i, x] >= least)
            template[f] = (key, keep if len(keep) >= fixed * len(f) else f)
    owners = defaultdict(set)
    for forms in leaf.values():
        for f, ds in forms.items():
            owners[template[f]] |= ds
    out = {}
    for d in docs:
        if d[1] is None:
            out[d] = None
            continue
        kept = []
        for line in d[1].split("\n"):
            w = tuple(words(general(line)))
            o = owners[template[w]] if w in template else set()
            if len(o) < least or min(o) == d:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to"]) for _ in range(n))


def edited(rng, text, share):
    ws = text.split(" ")
    for _ in range(max(1, int(share * len(ws)))):
        k, i = rng.randrange(3), rng.randrange(len(ws))
        if k == 0:
            ws[i] = "changed"
        elif k == 1:
            ws.insert(i, "added")
        elif len(ws) > 6:
            del ws[i]
    return " ".join(ws)


def corpus(seed=1, n=60):
    """Documents with copies, near copies, a common passage, and odd cases; ids from 0."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    out = [prose(rng, rng.choice([3, 12, 60, 150])) for _ in range(n)]
    base = prose(rng, 120)
    out += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03])) for _ in range(40)]
    out += [out[3]] * 5 + [f"{passage} {prose(rng, rng.choice([0, 5, 20, 60]))}".strip() for _ in range(25)]
    out += [edited(rng, out[i], 0.01) for i in range(0, 30)]
    out += ["", None, "one", "one", " \t\n", "One two three four", "one TWO three four", "É a b c d e f", "é a b c d e f"]
    rng.shuffle(out)
    return list(enumerate(out))
