import pytest

from rillwork.catalog import base


@pytest.fixture
def folder(tmp_path):
    def save(df, name):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


def test_costs_at_a_tie_round_up_whatever_the_order(spark, folder):
    from rillwork.catalog import pond  # noqa: F401

    # 0.1 five thousand times is 500; added up as doubles it is not, from either side
    rows = [(1, 0.7)] * 5000 + [(2, 0.1)] * 5000
    d = folder(spark.createDataFrame(rows, "o_custkey long, o_totalprice double"), "orders")
    got = {(r.site, r.item): r.value for r in base.QUERIES["proposal_sheet"](spark, d).collect()}
    assert got[1, "indicative_cost"] == "4"
    assert got[2, "indicative_cost"] == "1"
    assert got[2, "depth"] == "5000"


def test_boundary_key_names_its_points_once(spark):
    """The plan of a key holds one rounding of each coordinate, and rings keep their classes."""
    from pyspark.sql import functions as F

    from rillwork.operators import spatial as S

    square, bow = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    rings = [square, square[2:] + square[:2], square[::-1], [*square, square[0]], bow, [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rings)], "i int, ring array<struct<x:double,y:double>>")
    keyed = df.select("i", S.boundary_key(F.col("ring")).alias("k"))
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 2
    k = [r.k for r in keyed.orderBy("i").collect()]
    assert len(set(k[:4])) == 1 and len(set(k)) == 3


def test_near_copies_meet_few_pivots(spark, monkeypatch):
    """Rare tokens of a group's near copies do not make a pair of sets each."""
    import random

    from rillwork.llm import jaccard_join

    rng, looked = random.Random(4), []
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(3):
            ws[rng.randrange(300)] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(ws)))
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: (looked.append(pairs.count()), plain(pairs, *a))[1])
    got = jaccard_join.link_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(w.split()[j : j + 5]) for j in range(len(w.split()) - 4)} for _, w in rows]
    root = list(range(150))
    for _ in range(8):
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 75 * len(a | b))
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert sum(looked) <= 3 * 150


def test_copies_below_the_threshold_are_ruled_out_by_their_home(spark, monkeypatch):
    """Copies with too many edits are not compared with every copy that the group holds."""
    import random

    from rillwork.llm import jaccard_join

    rng, looked = random.Random(6), []
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        ws = list(base)
        for k in rng.sample(range(150), i % 9):
            ws[k] = f"y{k}" if rng.random() < 0.2 else f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws[: 150 - rng.choice([0] * 18 + [2, 5])])))
    plain = jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *a: (looked.append(pairs.count()), plain(pairs, *a))[1])
    got = jaccard_join.link_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [{tuple(w.split()[j : j + 5]) for j in range(len(w.split()) - 4)} for _, w in rows]
    root = list(range(300))
    while True:
        was = list(root)
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 75 * len(a | b))
        if root == was:
            break
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    assert len(set(root)) > 60  # most of those with five edits and more stay alone
    homes = 300  # each is also compared with its home, once
    assert sum(looked) + homes <= 4 * 300


def test_a_set_larger_than_what_others_reach_still_meets(spark):
    """A set that is not linked with its home may be larger than any set that such ones reach."""
    from pyspark.sql import functions as F

    from rillwork.llm import jaccard_join

    late = spark.createDataFrame([(9, 1, 130, 1, 1, 2.0), (9, 2, 100, 2, 1, 2.0)], "tok long, cls long, n int, root long, place int, usual double")
    known = [(1, 5, 130, 1, 100, [], False, 1), (2, 5, 100, 2, 99, [], True, 5)]
    known = spark.createDataFrame(known, "cls long, home long, n int, root long, within int, rest array<long>, linked boolean, label long")
    assert [tuple(r) for r in jaccard_join._apart(late, known, 75, F.lit(True)).collect()] == [(1, 2)]
