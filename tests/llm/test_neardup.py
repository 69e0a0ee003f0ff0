"""Near-duplicates against all pairs: copies, edits, short, empty and null texts, repeated rows, one huge text."""

import random
import time
import unicodedata

from hyphae.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from hyphae.llm.textkernel import INVISIBLE, normalise
from hyphae.session import prepare


def grams(text, n):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_pairs_and_classes(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 30, 80]))) for _ in range(60)]
    for _ in range(120):
        w = rng.choice(texts[:60]).split()
        for _ in range(rng.randrange(6) if w else 0):
            k = rng.randrange(max(1, len(w) - 1))
            w[k : k + 1] = rng.choice([[], ["x"], [*w[k : k + 1], "y"]])
        texts.append(" ".join(w))
    texts += [texts[0]] * 5 + ["", None, " \n", "one two"] + [" ".join(rng.choices(vocabulary, k=30_000))]
    rows = [(k, t, "a") for k, t in enumerate(texts)]
    df = prepare(spark).createDataFrame([*rows, rows[3], (None, texts[3], "a")], "doc_id long, text string, sig string")
    sets = {k: grams(t, 3) for k, t, _ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 2 >= len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_duplicate_pairs(df, n=3, similarity=0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    classes = {r["doc_id"]: r for r in near_duplicate_classes(df, n=3, similarity=0.5).collect()}
    assert set(classes) == {k for k in sets if sets[k]}
    for a, b in want:
        assert classes[a]["group_id"] == classes[b]["group_id"]
        assert (classes[a]["class_id"] == classes[b]["class_id"]) == (sets[a] == sets[b])
    for k, r in classes.items():
        assert r["links"] == len({frozenset(sets[b]) for b in sets if sets[b] and sets[b] != sets[k] and (min(k, b), max(k, b)) in want})
    assert near_duplicate_pairs(df.limit(0)).count() == 0


def test_normalise_is_the_definition_in_less_time():
    plain = lambda t: unicodedata.normalize("NFKC", t).translate(INVISIBLE).lower()
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for text in (every, every[::-1], "a\u200bb\ufeff\u00adC\u200d\u200c", "\u200b" * 5, "", "ABC"):
        assert normalise(text) == plain(text)
    prose = "Wörter und Sätze eines Textes. " * 20_000
    took = []
    for f in (normalise, plain):
        took.append(min(-time.process_time() + (f(prose), time.process_time())[1] for _ in range(3)))
    assert took[0] < took[1] / 3
