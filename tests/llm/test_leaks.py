"""Candidates of leaks against all pairs of windows."""

import random

import numpy as np
import pytest

from hyphae.llm.leaks import ItemIndex, find_leaks, shingles, windows
from hyphae.llm.textkernel import normalise, words
from hyphae.session import prepare


def tables():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(12)]
    docs = []
    for k in range(60):
        own = rng.choice(items)[1].split()[: rng.choice([13, 20, 40])]
        own = [rng.choice(vocabulary) if rng.random() < 0.1 else x for x in own]
        docs.append((k, " ".join([*rng.choices(vocabulary, k=20), *own, *rng.choices(["x", "y"], k=20)])))
    edited = items[0][1].split()[5:16]
    docs.append((100, " ".join(["zzz"] * 15 + edited + ["qqq"] * 15)))
    return docs, items


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_no_pair_of_windows_is_lost(spark, similarity):
    docs, items = tables()
    index = ItemIndex.build([i for i, _ in items], [t for _, t in items], 12, 2)
    want = {}
    for name, text in docs:
        w = words([normalise(text)])
        p, at = shingles(w), windows(w, 12)
        d, i = (x.ravel() for x in np.meshgrid(np.arange(len(at)), np.arange(len(index.prints)), indexing="ij"))
        s = index.similarity(p[at[d][:, None] + np.arange(11)], i)
        for k in np.flatnonzero(s >= similarity):
            item = int(items[index.item[i[k]]][0])
            hits, best = want.setdefault((name, item), (set(), 0.0))
            hits.add(int(d[k]))
            want[name, item] = hits, max(best, s[k])
    got = find_leaks(prepare(spark).createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_similarity=similarity).collect()
    assert {(r["doc_id"], r["item_id"]): (r["windows"], round(r["similarity"], 9)) for r in got} == {k: (len(h), round(b, 9)) for k, (h, b) in want.items()}


@pytest.mark.parametrize("exact", [False, True])
def test_blocks_change_nothing(spark, exact):
    docs, items = tables()
    # shingles that many items share weigh little, also for an item in a block of its own
    items += [(100 + k, items[0][1] + f" tail{k}") for k in range(20)]
    d = prepare(spark).createDataFrame([*docs, (200, None), (201, ""), (100, docs[-1][1])], "doc_id long, text string")
    i = spark.createDataFrame([*items, (900, None), (901, "too short"), items[0]], "item_id long, text string")
    rows = lambda chars: {(r["doc_id"], r["item_id"]): (r["windows"], round(r["similarity"], 9)) for r in find_leaks(d, i, min_similarity=0.6, exact=exact, block_chars=chars).collect()}
    whole = rows(20_000_000)
    assert whole and rows(sum(len(t) for _, t in items) // 7) == whole
    assert find_leaks(d.limit(0), i).count() == find_leaks(d, i.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_repeated_words_on_both_sides(exact):
    import resource

    import pyarrow as pa
    from pyspark.sql import types as T

    from hyphae.llm.leaks import _scan

    index = ItemIndex.build([1, 2], ["spam " * 500, "other words of a second item that has more than twelve of them in all"], 12, 2)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("windows", T.LongType()), T.StructField("similarity", T.DoubleType())])
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["spam " * 20_000])], names=["doc_id", "text"])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = pa.Table.from_batches(_scan(index, [1, 2], schema, 0.8, exact, not exact)(iter([batch]))).to_pylist()
    assert out == [{"doc_id": 7, "item_id": 1, "windows": 19_989, "similarity": 1.0}]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
