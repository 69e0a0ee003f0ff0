"""Brute-force fixtures of the operators for p2, p4, p5: nulls, NaN, ties, repeated rows, hubs, empty tables."""

import heapq
import random

from hyphae.llm.pieces import PIECE, SHORT, cut, ends, split_texts
from hyphae.llm.topn import top_of_group
from hyphae.session import prepare


def test_p2_top_of_group(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", "hub" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None]), rng.choice([0.0, -0.0, 0.5, 0.9, 1.0, 1.1, -0.1, float("nan"), None, rng.random()])) for i in range(600)]
    rows += rng.sample(rows, 200)
    df = prepare(spark).createDataFrame(rows, "id string, source_id string, confidence double").repartition(7)
    want = set()
    for g in {r[1] for r in rows} - {None}:
        own = {(r[0], r[2]) for r in rows if r[1] == g and r[2] is not None and 0 <= r[2] <= 1}
        want |= {(g, i) for i, _ in sorted(own, key=lambda x: (-x[1], x[0]))[:3]}
    got = top_of_group(df).select("source_id", "id").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert top_of_group(df.limit(0)).count() == 0
    # ranges of a few rows each, so that groups begin, end and go on in all ways
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n in (1, 3, 40):
            want = set()
            for g in {r[1] for r in rows} - {None}:
                own = {(r[0], r[2]) for r in rows if r[1] == g and r[2] is not None and 0 <= r[2] <= 1}
                want |= {(g, i, k + 1) for k, (i, _) in enumerate(sorted(own, key=lambda x: (-x[1], x[0]))[:n])}
            assert {(r["source_id"], r["id"], r["place"]) for r in top_of_group(df, n=n).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_p5_pieces(spark):
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(rng.choice(["word ", ". ", "\n", "\n\n", "x" * 5000, " " * 4000, "。", "á", "b "]) for _ in range(rng.randrange(1, 2000)))
        parts = cut(text)
        if not text:
            continue
        assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(0 < b - a <= 4000 for a, b in parts)
        for (a, b), (c, d) in zip(parts, parts[1:]):
            assert a < c <= b < d and b - c <= 200
    prose = "One sentence of a few words. " * 400
    for a, b in cut(prose):
        assert prose[:a] == "" or prose[a - 1] == " "
        assert prose[:b].rstrip().endswith(".")
    rows = [(1, "x" * 4000), (2, "x" * 4001), (3, None), (4, ""), (5, "\U0001f600" * 4000), (6, "\U0001f600" * 4001)]
    got = split_texts(prepare(spark).createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {2, 6}


def test_p4_most_similar(spark):
    import numpy as np

    from hyphae.llm.neighbours import most_similar

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 64))
    rows = [(f"v{k}", (centres[k % 6] + 0.3 * rng.standard_normal(64)).tolist()) for k in range(150)]
    rows += [(f"same{k}", rows[7][1]) for k in range(9)] + [(f"far{k}", rng.standard_normal(64).tolist()) for k in range(5)]
    sound = dict(rows)
    rows += rows[:20] + [("null", None), ("zero", [0.0] * 64), ("nan", [float("nan")] * 64), ("short", [1.0] * 63)]
    ids = sorted(sound)
    x = np.array([sound[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:5]}
    df = prepare(spark).createDataFrame(rows, "id string, embedding array<double>")
    got = [tuple(r) for r in most_similar(df).select("id", "neighbor_id").collect()]
    assert len(got) == len(set(got)) == 5 * len(ids)
    assert len(set(got) & want) >= 0.97 * len(want)
    for i in [f"same{k}" for k in range(9)] + [f"far{k}" for k in range(5)]:
        assert {p for p in got if p[0] == i} == {p for p in want if p[0] == i}
    assert most_similar(df.limit(0)).count() == 0


def _cost(text, parts, size, overlap):
    """What cut() makes least: pieces, kinds of ends and beginnings, and overlap that isn't used."""
    kind, unit = dict(zip(*ends(text, size))), max(1, overlap)
    cost = PIECE * unit * len(parts) + sum(kind[b] * unit for _, b in parts)
    return cost + sum(kind[c] * unit + SHORT * (overlap - (b - c)) for (_, b), (c, _) in zip(parts, parts[1:]))


def _least(text, size, overlap):
    """Least cost of all covers, by Dijkstra's search over all beginnings and ends."""
    places, costs = ends(text, size)
    kind, unit, n = dict(zip(places, costs)), max(1, overlap), len(text)
    heap, done = [(0, 0)], set()
    while heap:
        cost, a = heapq.heappop(heap)
        if a == n:
            return cost
        if a in done:
            continue
        done.add(a)
        for b in places:
            if a < b <= a + size:
                if b == n:
                    heapq.heappush(heap, (cost + (PIECE + kind[b]) * unit, n))
                for c in places:
                    if b - overlap <= c <= b < n and c != a:
                        heapq.heappush(heap, (cost + (PIECE + kind[b] + kind[c]) * unit + SHORT * (overlap - (b - c)), c))
    return None


def test_p5_least_cost():
    rng = random.Random(5)
    for size, overlap in [(40, 6), (40, 0), (60, 10), (90, 15)]:
        for _ in range(60):
            words = ["ab ", "c. ", "long word. ", "\n", "\n\n", "x" * (size - rng.randrange(12)) + " ", "y" * rng.randrange(1, 2 * size), "。", "á ", " " * rng.randrange(1, size)]
            text = "".join(rng.choices(words, [9, 3, 4, 1, 1, 1, 1, 1, 2, 1], k=rng.randrange(10, 60)))
            parts = cut(text, size, overlap)
            if len(text) <= size:
                continue
            assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(0 < b - a <= size for a, b in parts)
            assert all(a < c <= b < d and b - c <= overlap for (a, b), (c, d) in zip(parts, parts[1:]))
            assert _cost(text, parts, size, overlap) == _least(text, size, overlap)


def test_p5_begins_inside_no_word():
    # no word ends in the last 200 characters of the first piece, and the middle one is short
    text = "x" * 3990 + " " + "y" * 300 + " " + "z" * 3990
    assert cut(text) == [(0, 3991), (3991, 4292), (4292, 8282)]
    text = "x" * 3990 + "\n\n" + "Few words here. " * 5 + "\n\n" + "z" * 3990
    assert all(a == 0 or text[a - 1].isspace() for a, _ in cut(text)) and all(b == len(text) or text[b - 1].isspace() for _, b in cut(text))
    # a sentence to begin with is worth a few repeated words
    prose = "Some ten words make one sentence of middle length here. " * 200
    assert all(a == 0 or prose[a - 2] == "." for a, _ in cut(prose))
