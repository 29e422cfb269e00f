"""Columns of the user's come back as they were, also those that share a name with one an operator uses inside."""

import inspect
import random
import re

import pytest
from brute import prose

from rillwork.llm import common, decontaminate, jaccard_join, line_templates, mixing, surrogates, toxicity

RNG = random.Random(5)
ITEM = prose(RNG, 20, 5000)
LINE = "this very line is in many documents here"
COPY = prose(RNG, 60, 9000)
TEXTS = [
    (1, COPY), (2, COPY), (3, f"{prose(RNG, 30)} {ITEM} x"), (None, prose(RNG, 30)), (5, None), (6, ""),
    *[(10 + i, f"{prose(RNG, 30, 9000)}\n{LINE}\nMr. John Smith has 8.20.209.178") for i in range(5)],
    *[(20 + i, f"{prose(RNG, 40)} {'idiot scum moron ' * 3 if i % 4 == 0 else ''}") for i in range(80)],
]
#: Operator, its module, the columns that it replaces on purpose.
CASES = {
    "lines": (lambda s, d: line_templates.dedupe_lines(d), line_templates, {"n_lines", "n_dropped"}),
    "private": (lambda s, d: surrogates.replace_private(d), surrogates, {"n_replaced"}),
    "mixture": (lambda s, d: mixing.mixture(d), mixing, {"epoch", "epoch_words"}),
    **{f"first-{k}": (lambda s, d, k=k: jaccard_join.keep_first(d, by_row=k), jaccard_join, set()) for k in (False, True)},
    **{f"leaks-{k}": (lambda s, d, k=k: decontaminate.without_leaks(d, s.createDataFrame([(1, ITEM)], "item_id long, text string"), by_row=k), decontaminate, set()) for k in (False, True)},
    **{
        f"toxic-{k}": (lambda s, d, k=k: toxicity.without_toxic(d, s.createDataFrame([(20 + i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int"), by_row=k), toxicity, set())
        for k in (False, True)
    },
}


def inner_names(module):
    """Everything in the module, or the helpers it shares, that could be a column's name."""
    found = set(re.findall(r'"([A-Za-z_]{1,16})"', inspect.getsource(module) + inspect.getsource(common)))
    found |= set(re.findall(r"\b([a-z_]{1,16})=True", inspect.getsource(module))) | {"_KEY", "_Row", "_key_", "a.b", "a`b"}
    seen, out = {"doc_id", "text", "source"}, []
    for name in sorted(found):
        if name.lower() not in seen:
            seen.add(name.lower())
            out.append(name)
    return out


@pytest.mark.parametrize("case", CASES)
def test_every_inner_name_passes(spark, case):
    make, module, made = CASES[case]
    names = inner_names(module)
    shape = ", ".join(["doc_id long", "text string", "source string", *[f"`{n.replace('`', '``')}` string" for n in names]])
    rows = [(d, t, f"s{i % 2}", *[f"{n}/{i}" for n in names]) for i, (d, t) in enumerate(TEXTS)]
    got = make(spark, spark.createDataFrame(rows, shape).repartition(3))
    assert {*got.columns} == {"doc_id", "text", "source", *names} | made
    plain = make(spark, spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string"))
    rows_got = got.collect()
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    assert sorted(map(key, rows_got)) == sorted(map(key, plain.collect())) and rows_got
    ids = {d: i for i, (d, _) in enumerate(TEXTS)}
    for r in rows_got:
        assert all(r[n] == f"{n}/{ids[r['doc_id']]}" for n in names if n not in made)
