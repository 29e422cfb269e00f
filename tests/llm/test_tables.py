"""Mixing, URL filters, toxicity and the pipeline against plain versions."""

import datetime as dt
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from brute import corpus, dedupe, groups, leaks, prose, words

from rillwork.llm import mixing, toxicity, url_filters
from rillwork.llm.common import stow

# ---------------------------------------------------------------- mixing


def naive_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {s: most * sizes[s] for s in names}, sum(sizes.values())
    capped = set()
    while True:
        rest = total - sum(full[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: Fraction(rest * w[s], sum(w[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > full[s]}
        if not over:
            return {**{s: Fraction(full[s]) for s in capped}, **share}
        capped |= over


def naive_mix(rows):
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target, out = naive_targets(sizes), []
    for s in sizes:
        key = lambda r: (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16), r[0] is not None, r[0] or 0, len(words(r[2])))
        budget, before = int(target[s]), 0
        for d, _, t in sorted((r for r in rows if r[1] == s), key=key):
            n = len(words(t))
            e, rest = divmod(budget, sizes[s]) if sizes[s] else (0, 0)
            out.append((d, s, n, sizes[s], round(float(target[s]), 6), e * n + max(0, min(n, rest - before))))
            before += n
    return out


def test_mix_matches_plain_sums(spark):
    rng = random.Random(1)
    rows = [(d, rng.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"][: 7 + (d % 40 == 0)]), prose(rng, rng.randrange(0, 60)) if d % 9 else None) for d in range(300)]
    rows += [(None, "a", "x y z"), (None, "a", "x y"), (5, "a", "again here"), (900, "void", ""), (901, "void", None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, source string, text string, size int, key string").repartition(3)
    got = mixing.mix_sources(df).collect()
    assert sorted((tuple(r)[:4] + (round(r.target, 6), r.taken) for r in got), key=str) == sorted(naive_mix(rows), key=str)
    totals = {}
    for r in got:
        totals[r.source] = totals.get(r.source, 0) + r.taken
        assert r.taken <= 3 * r.size
    assert all(abs(totals[r.source] - r.target) < 1 for r in got)
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixture_repeats_epochs(spark):
    rows = [(d, "a" if d < 40 else "b", f"w{d} " * (d % 7)) for d in range(44)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(df).collect()}
    got = mixing.mixture(df).collect()
    for d in taken:
        mine = sorted((r.epoch, r.epoch_words) for r in got if r.doc_id == d)
        assert sum(n for _, n in mine) == taken[d] and [e for e, _ in mine] == list(range(1, len(mine) + 1))


def test_mixture_of_null_and_repeated_ids(spark):
    rows = [(None if d < 6 else d // 4, "ab"[d % 2], f"w{d // 2} " * (1 + d % 5)) for d in range(40)] + [(3, "a", "same row")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = mixing.mix_sources(df).collect()
    got = mixing.mixture(df).collect()
    for s in "ab":
        assert sum(r.epoch_words for r in got if r.source == s) == sum(r.taken for r in taken if r.source == s) == int(taken[[r.source for r in taken].index(s)].target)
    assert sum(r.epoch == 1 for r in got) == sum(r.taken > 0 for r in taken) and any(r.doc_id is None for r in got)


# ---------------------------------------------------------------- URL filters

ENTRIES = [
    ("block", "evil.com", 10, "add"), ("block", "evil.com", 10, "add"), ("block", "evil.com", 40, "remove"), ("block", "evil.com", 90, "add"),
    ("allow", "good.evil.com", 20, "add"), ("block", "a.good.evil.com", 30, "add"), ("allow", "a.good.evil.com", 30, "add"), ("block", "Shop.org", 5, "add"),
    ("block", "shop.org", 5, "remove"), ("block", "late.net", 5000, "add"), ("block", "odd.net", 7, "pause"), ("block", None, 7, "add"), ("block", "early.net", 3, "remove"),
]


def naive_verdict(host, day):
    best = None
    for lst, dom in {(e[0], e[1].lower()) for e in ENTRIES if e[1]}:
        if host is None or not (host == dom or host.endswith("." + dom)):
            continue
        acts = {}
        for e in ENTRIES:
            if e[0] == lst and e[1] and e[1].lower() == dom and e[3] in ("add", "remove") and e[2] <= day:
                acts[e[2]] = max(acts.get(e[2], ""), e[3])
        if acts and acts[max(acts)] == "add":
            best = max(best or (0, False), (len(dom), lst == "allow"))
    return "drop" if best and not best[1] else "keep"


def test_verdicts_match_plain_lists(spark):
    zero = dt.date(2023, 1, 1)
    hosts = ["evil.com", "x.evil.com", "good.evil.com", "b.a.good.evil.com", "shop.org", "notevil.com", "late.net", "odd.net", "early.net"]
    pages = [(i, f"https://u@{h.upper() if i % 2 else h}:80/p?q#f", zero + dt.timedelta(days=d), "c") for i, (h, d) in enumerate((h, d) for h in hosts for d in (1, 10, 15, 39, 40, 60, 95, 200))]
    odd = [(900, None, zero, "c"), (901, "no url", zero, "c"), (902, "http://evil.com./", None, "c"), (903, "//evil.com", zero + dt.timedelta(days=12), "c"), (903, "//evil.com", zero + dt.timedelta(days=12), "c")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, fetched date, domain string")
    entries = spark.createDataFrame([(a, b, zero + dt.timedelta(days=c), d) for a, b, c, d in ENTRIES], "list string, domain string, day date, action string")
    got = url_filters.judge(df, entries).collect()
    assert len(got) == len(pages) + len(odd)
    by = {r.page_id: r for r in got}
    for i, u, day, _ in pages:
        assert by[i].verdict == naive_verdict(u.split("@")[1].split(":")[0].lower(), (day - zero).days), (u, day)
    assert {by[i].verdict for i in (900, 901, 902)} == {"keep"} and by[903].verdict == "drop"
    assert url_filters.judge(df.limit(0), entries).count() == 0 and {r.verdict for r in url_filters.judge(df, entries.limit(0)).collect()} == {"keep"}


# ---------------------------------------------------------------- toxicity


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for d in range(n):
        toxic = d % 5 == 0
        ws = prose(rng, 60).split()
        for _ in range(4 if toxic else 0):
            ws.insert(rng.randrange(60), rng.choice(["nastiest", "nastily", "awful", "vile"]))
        docs.append((d, " ".join(ws)))
        if d % 3:
            labels.append((d, int(toxic)))
    return docs, labels


def test_scores_hold_on_rows_left_out(spark):
    docs, labels = labelled()
    odd = [(1000, None), (1001, ""), (None, "vile awful nastily"), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, "x", 9) for d, t in docs + odd], "doc_id long, text string, lang string, score int")
    lab = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    rows = toxicity.score(df, lab).collect()
    assert len(rows) == len(docs) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert len(out) > 60 and all(r.predicted == (r.doc_id % 5 == 0) for r in out)
    assert {r.doc_id: r.predicted for r in rows}[None] == 1
    # held-out labels change nothing
    flipped = spark.createDataFrame([(d, 1 - x if zlib.crc32(str(d).encode()) % 4 == 2 else x) for d, x in labels], "doc_id long, toxic int")
    assert sorted(map(str, toxicity.score(df, flipped).collect())) == sorted(map(str, rows))


def plain_scores(train, asked):
    """Votes by dense vectors over all terms; ``train`` has (id, label, text), ``asked`` texts."""
    count = toxicity.TermCounter({}).count
    rows = [(y, count(t)) for _, y, t in sorted(train)]
    n, rate = len(rows), sum(y for y, _ in rows) / len(rows)
    weight = {}
    for t in {t for _, c in rows for t in c}:
        df, a = sum(t in c for _, c in rows), sum(y for y, c in rows if t in c)
        weight[t] = (math.log((1 + n) / (1 + df)) + 1) * (1 + max(a - df * rate, 0) ** 2 / ((df + toxicity.SHRINK) * rate * (1 - rate)))

    def unit(c):
        v = {t: (1 + math.log(k)) * weight.get(t, math.log(1 + n) + 1) for t, k in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    held = [(y, unit(c)) for y, c in rows if c]

    def vote(v, skip=-1):
        near = sorted(((sum(x * u.get(t, 0) for t, x in v.items()), y) for i, (y, u) in enumerate(held) if i != skip), reverse=True)[: toxicity.NEIGHBOURS]
        w = sum(s * s for s, _ in near)
        return (sum(s * s * y for s, y in near) + toxicity.PRIOR_WEIGHT * rate) / (w + toxicity.PRIOR_WEIGHT), [s for s, _ in near[:3] if s > 0]

    knots = toxicity.monotone(np.array([vote(u, i)[0] for i, (_, u) in enumerate(held)]), np.array([y for y, _ in held], float))
    blank = [y for y, c in rows if not c]
    out = []
    for c in map(count, asked):
        v, near = vote(unit(c)) if c else (0, [])
        out.append((float(np.interp(v, *knots)) if c else (sum(blank) + rate) / (len(blank) + 1), near))
    return out


def test_scores_match_dense_vectors(spark):
    """Random vocabularies of all sizes, through the whole operator."""
    rng = random.Random(8)
    for words_known in (40, 400, 4000):
        texts = [" ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}{chr(97 + x // 676)}ing" for x in (int(words_known * rng.random() ** 2) for _ in range(rng.choice([3, 30, 90])))) for _ in range(500)]
        texts[::50] = [""] * 10
        labels = [(d, int(rng.random() < 0.2 or "waaa" in texts[d] and rng.random() < 0.5)) for d in range(0, 500, 2)]
        got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        train = [(d, y, texts[d]) for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2]
        want = plain_scores(train, texts)
        for r in got:
            score, near = want[r.doc_id]
            assert np.allclose(r.near_cosines, near, atol=2e-6), (r, near)
            assert abs(r.score - score) < 1e-6 or len(set(r.near_cosines)) < len(r.near_cosines), (r, score)


def test_blocks_are_skipped_only_below_the_kth():
    """Against all cosines, over many blocks; every example itself comes first unless it is skipped."""
    rng = random.Random(4)
    rows = []
    for d in range(700):
        c = toxicity.TermCounter({}).count(" ".join("abcdefgh"[d % 8] * rng.randint(1, 60) for _ in range(30)))
        rows.append((d, int(d % 8 == 3), list(c), list(c.values())))
    index = toxicity.Index(rows)
    assert index.blocks > 10
    dense = np.zeros((len(index.terms), len(index.ids)))
    term = np.repeat(np.arange(len(index.terms)), index.begin[index.of_term[1:]] - index.begin[index.of_term[:-1]])
    dense[term, index.example] = index.value
    assert np.allclose(np.linalg.norm(dense, axis=0), 1)
    for j in range(0, 700, 7):
        d = rows[index.ids[j]]
        at, w = index.vector({index.terms[t]: c for t, c in zip(d[2], d[3])} | {"unknown": 2})
        for skip in (-1, j):
            near, cosines = index.nearest(at, w, skip)
            all_ = w @ dense[at]
            all_[skip : skip + 1 if skip >= 0 else skip] = 0
            order = np.argsort(-all_, kind="stable")[: toxicity.NEIGHBOURS]
            assert np.allclose(cosines, all_[order][all_[order] > 0]) and np.allclose(all_[near], cosines)
            assert (near[0] == j) == (skip < 0)


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_no_labels_to_learn_from(spark, labels):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    rows = toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(rows) == 2 and len({r.score for r in rows}) == 1
    assert toxicity.score(df.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)
    docs, labels = labelled(120)
    docs += [(d + 500, t) for d, t in corpus(2, 20) if t]
    items = [(i, prose(rng, 20, 5000)) for i in range(4)]
    docs += [(900 + i, f"{prose(rng, 30)} {t} {prose(rng, 9)}") for i, t in items]
    docs += [(950 + i, f"{prose(rng, 30, 9000)}\nthis very line is in many documents here\n{prose(rng, 20, 9000)}") for i in range(8)]
    rows = [(d, t, "en", f"s{d % 4}", len(t)) for d, t in docs]
    at = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    lab.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = pipeline.run(spark, at).collect()

    bad = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{at}/documents.parquet"), lab).collect() if r.predicted}
    left = [(d, t) for d, t in docs if d not in bad]
    lines = dedupe(left)
    left = [(d, lines[d, t]) for d, t in left if lines[d, t] == t or words(lines[d, t])]
    left = [r for r, g in zip(left, groups(left)) if g[2] == r[0]]
    leaky = {d for d, _ in leaks(left, items)}
    left = [r for r in left if r[0] not in leaky]
    want = {d: n for d, _, _, _, _, n in naive_mix([(d, f"s{d % 4}", t) for d, t in left]) if n}
    assert len(bad) > 10 and leaky and {d for d, _ in docs if d >= 951 and d < 958} & {r.doc_id for r in got}
    sums = {}
    for r in got:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.epoch_words
        assert r.text == dict(left)[r.doc_id]
    assert sums == want


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    docs, labels = labelled(120)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    marked = toxicity.score(spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string"), lab).collect()
    toxic = dict(docs)[next(r.doc_id for r in marked if r.predicted)]
    item = prose(rng, 20, 5000)
    lone, two = prose(rng, 60, 9000), prose(rng, 60, 9000)
    mine = [(None, toxic), (None, f"{prose(rng, 30)} {item} x"), (None, lone), (None, lone), (None, two), (800, two), (800, two), (800, prose(rng, 50, 9000)), (801, lone + " end")]
    mine += [(None, f"{prose(rng, 30, 9000)}\nthis very line is in many documents here") for _ in range(4)]
    at = str(tmp_path)
    lab.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    df = spark.createDataFrame([(d, t, "en", f"s{i % 2}", len(t)) for i, (d, t) in enumerate(docs + mine)], shape).repartition(3)
    for name, stage in pipeline.STAGES[:-1]:
        df = stow(stage(spark, df, at), name)
        texts = [r.text for r in df.collect()]
        assert (toxic in texts) is False
        assert name == "toxicity" or sum("this very line" in t for t in texts) == 1
        assert name in ("toxicity", "line_dedup") or (texts.count(two), texts.count(lone), texts.count(lone + " end")) == (1, 0, 1)
        assert any(item in t for t in texts) == (name != "decontamination")
    left = df.collect()
    assert sum(r.doc_id == 800 for r in left) == 2 and sum(r.doc_id is None for r in left) == 4
    got = pipeline.STAGES[-1][1](spark, df, at).collect()
    taken = mixing.mix_sources(df).collect()
    assert sum(r.epoch_words for r in got) == sum(r.taken for r in taken) and len({(r.doc_id, r.text, r.epoch) for r in got}) == len(got)
