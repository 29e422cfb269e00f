"""The Jaccard join, decontamination and line dedup against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import corpus, dedupe, edited, groups, leaks, prose

from rillwork.llm import decontaminate, jaccard_join, line_templates
from rillwork.llm.common import components


def test_groups_match_all_pairs(spark):
    rows = corpus()
    rows += [(None, rows[5][1]), (None, "all alone with these words here"), (7, rows[7][1])]
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, cls string, n int").repartition(3)
    got = sorted((tuple(r)[:3] for r in jaccard_join.link_groups(df).collect()), key=str)
    assert got == sorted(groups(rows), key=str)
    assert len({g[2] for g in got}) < len(got)
    kept = [r.doc_id for r in jaccard_join.keep_first(df).collect()]
    want = [d for (d, _), g in zip(rows, groups(rows)) if d is None or g[2] == d]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_shared_tokens_in_any_batches():
    rng = random.Random(3)
    rows = sorted((t, c) for t in range(40) for c in range(rng.choice([1, 1, 2, 5, 9])) for _ in range(rng.choice([1, 1, 2])))
    was, jaccard_join.COUNT_TOP = jaccard_join.COUNT_TOP, 4
    try:
        for size in (1, 2, 3, 7, 1000):
            batches = []
            for i in range(0, len(rows), size):
                part = rows[i : i + size]
                t, c = (np.array(x, np.int64) for x in zip(*part))
                k = len(part)
                batches.append(pa.record_batch([pa.array(t), pa.array(c), pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array([False] * k)], schema=jaccard_join._POSTING))
            got = [(r["tok"], r["cls"], r["c"]) for b in jaccard_join._shared(iter(batches)) for r in b.to_pylist()]
            held = {t: len({c for u, c in rows if u == t}) for t, _ in rows}
            assert sorted(got) == sorted((t, c, min(held[t], 4)) for t, c in set(rows) if held[t] > 1)
    finally:
        jaccard_join.COUNT_TOP = was


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (5, 5), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in (1, 2, 3, 7, 8, 9)}) == 1 and got[20] == got[21] != got[1] and 5 not in got


def test_components_of_long_chains(spark):
    """Many rounds: shuffled paths of up to 300 nodes."""
    rng = random.Random(12)
    edges, part, at = [], {}, 0
    for n in (300, 120, 40, 2):
        ids = rng.sample(range(at, at + n), n)
        edges += list(zip(ids, ids[1:]))
        part |= {i: at for i in ids}
        at += n
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got.keys() == part.keys() and len({(got[i], part[i]) for i in part}) == 4 == len(set(got.values()))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_leaks_match_every_window(spark, broadcast):
    """Both for a benchmark that the engine broadcasts and for one that it shuffles."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        leaks_match(spark)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def leaks_match(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.choice([6, 18, 40]), 5000)) for i in range(12)] + [(90, "too short"), (91, None), (92, "")]
    docs = [(d, prose(rng, rng.choice([4, 30, 120]), 5000)) for d in range(30)]
    for d in range(30, 60):
        item = items[d % 12][1]
        docs.append((d, f"{prose(rng, 20)} {edited(rng, item, 0.03) if d % 3 else item.upper()} {prose(rng, rng.choice([0, 30]))}"))
    docs += [(60, items[0][1]), (61, None), (62, ""), (62, ""), (None, items[1][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, w string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks(docs, items)
    assert got.keys() == want.keys() and len(got) > 15
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)
    left = {r.doc_id for r in decontaminate.without_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want if d is not None}


def test_near_blocks_hold_the_radius():
    rng = random.Random(7)
    per = 64 // decontaminate.BLOCKS
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), decontaminate.RADIUS))
        assert any(bin(x >> (per * b) & ((1 << per) - 1)).count("1") <= decontaminate.RADIUS // decontaminate.BLOCKS for b in range(decontaminate.BLOCKS))


def test_lines_match_plain_templates(spark):
    rng = random.Random(9)
    docs = []
    for d in range(30):
        lines = [prose(rng, rng.choice([2, 6, 15]), 9000) for _ in range(4)]
        lines.append(f"page {d} of {d + 7} printed on 2024-01-{d:02d}")
        if d % 2:
            lines.append(f"posted by user name{'abc'[d % 3]} in the news forum today")
        if d % 5 == 0:
            lines += ["all rights reserved by the owner", "short line"]
        if d % 10 < 2:
            lines.append("only two documents share this line")
        docs.append((d, "\n".join(rng.sample(lines, len(lines)))))
    docs += [(40, docs[1][1]), (41, ""), (42, None), (7, docs[7][1])]
    df = spark.createDataFrame([(d, t, 5, "k") for d, t in docs], "doc_id long, text string, n_lines int, key string")
    got = line_templates.dedupe_lines(df).collect()
    want = dedupe(docs)
    assert sorted((r.doc_id, str(r.text)) for r in got) == sorted((d, str(want[d, t])) for d, t in docs)
    assert sum(r.n_dropped for r in got) > 30 and {r.key for r in got} == {"k"}


def test_fourth_word_may_vary(spark):
    """A field without digits as the fourth word, each value in one document."""
    docs = [(d, f"posted by user {chr(97 + d)}name in the news forum today\nline of {'xyzuvw'[d]} alone here") for d in range(6)]
    got = {r.doc_id: r.text for r in line_templates.dedupe_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: t if d == 0 else t.split("\n")[1] for d, t in docs} == {d: t for (d, _), t in dedupe(docs).items()}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (1, ""), (1, "")]])
def test_empty_and_null(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert sorted(map(str, jaccard_join.link_groups(df).select("doc_id", "n_shingles", "component_id").collect())) == sorted(f"Row(doc_id={d}, n_shingles=0, component_id={d})" for d, _ in rows)
    assert decontaminate.leaks(df, items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0
    assert sorted((str(r.doc_id), str(r.text)) for r in line_templates.dedupe_lines(df).collect()) == sorted((str(d), str(t)) for d, t in rows)
