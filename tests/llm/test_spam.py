"""Keyword, link and tag pages against prose with tags, links, blobs and odd case in it."""

import random

import pytest

from hyphae.llm.spam import Classes, abnormal_share, fit_prose, parts, spam_pages
from hyphae.session import prepare

NOUNS = "index table label queue cache filter graph vector store edge".split()


def sentence(rng):
    return rng.choice(["The {} of the {} was moved to the {} after {} days.", "In {} we found that a {} is not in the {}, and {} of them were lost.", "Der {} ist nach dem {} in die {} gebracht und war um {} Uhr da.", "Le {} est dans la {} pour que les {} ne soient pas en retard de {} jours."]).format(rng.choice(NOUNS), rng.choice(NOUNS), rng.choice(NOUNS), rng.randrange(99))


def prose(rng, n=30):
    return " ".join(sentence(rng) for _ in range(n))


def pages():
    rng = random.Random(9)
    good = [prose(rng) for _ in range(40)]
    one = prose(rng)
    good += [one.upper(), one.title(), one.replace(" ", "\n"), one + "\nTags: cache, label, graph", one + " " + "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 400, "\n".join(f"[{k}] https://a{k}.example/{k} {sentence(rng)}" for k in range(20))]
    words = [f"{a}{b}" for a in "kalo miro tesu".split() for b in "lamp case fan kit".split()]
    bad = [" ".join(rng.choices(words, k=300)), ", ".join(f"best {rng.choice(words)} {rng.randrange(999)}" for _ in range(90)), " ".join(f"https://{rng.choice(words)}.example/{rng.randrange(9999)}" for _ in range(60)), " ".join("#" + rng.choice(words) for _ in range(80)), sentence(rng) + " " + " | ".join(rng.choices(words, k=200)), '<a href="https://x.example/1">cheap lamp</a> ' * 50]
    return good, bad


def test_pages(spark):
    good, bad = pages()
    rows = [(k, t, "handbook" if k < 40 else "web") for k, t in enumerate(good)] + [(1000 + k, t, "web") for k, t in enumerate(bad)]
    rows += [(2000, None, "web"), (2001, "", "web"), (2002, " \n\t", "web"), (2003, "★★ !!", "web"), (1000, bad[0], "web"), (None, bad[0], "web")]
    df = prepare(spark).createDataFrame(rows, "doc_id long, text string, share string")
    got = [r["doc_id"] for r in spam_pages(df, df.where("share = 'handbook'")).collect()]
    assert sorted(got) == [1000 + k for k in range(len(bad))]
    assert spam_pages(df.limit(0), df.where("share = 'handbook'")).count() == 0
    assert spam_pages(df, df.limit(0)).count() == 0


def test_long_text_is_taken_in_parts(spark):
    rng = random.Random(3)
    model = fit_prose(prepare(spark).createDataFrame([(prose(rng),) for _ in range(30)], "text string"))
    text = prose(rng, 12_000) + " ".join(f"kw{rng.randrange(50)}" for _ in range(30_000))
    assert "".join(parts(text)) == text and len(list(parts(text))) > 3
    spam = sum(len(w) for w in text.split() if w.startswith("kw")) / sum(len(w) for w in text.split())
    assert abnormal_share(text, model, Classes(), 4.0, 0.5) == pytest.approx(spam, abs=0.05)
    assert list(parts("x" * 500_000)) == ["x" * 200_000, "x" * 200_000, "x" * 100_000] and list(parts("")) == [""]
