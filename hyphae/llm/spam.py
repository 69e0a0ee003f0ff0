"""Pages of keywords, links and product tags, by perplexity under a model of prose.

Every token of a text becomes a symbol: its class (function word, number or
content) and how many function words stand around it. A three-gram model of
these symbols is counted on prose. Lists of keywords, links or tags have long
stretches without function words, which prose hardly ever has, so their
perplexity is abnormally high; symbols that repeat without end have an
abnormally low one. Perplexity is taken over a window around every token, and a
page is flagged if the larger part of its characters lies in abnormal windows.

Links, tags and mark-up are content like any word, so that prose with links in
it keeps its function words. Case, line breaks and punctuation don't count.
Encoded data (an unbroken run of BLOB characters or more) is left out on both
sides. Hiragana are the function words of Japanese.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyphae.llm.textkernel import INVISIBLE

#: Function words of English, German, French and Spanish.
ENGLISH = "the a an of and or in on at to for from by with as is are was were be been has have had not no that which this it its than then if but while when who what will would can may we they he she you i our their his her my your more less into over under after before since between near about each every only still also so there these those because through during until very too any some all both such up out off"
GERMAN = "der die das den dem des ein eine einer einem einen eines und oder in im an am auf aus bei bis für mit nach nicht noch ohne seit um unter vom von vor war wird wurde wurden hat haben ist sind zu zum zur dass obwohl wenn weniger mehr als es sie er wir ich ihr trotz laut aber auch nur sich wie durch gegen über kein keine sehr dann man bliebe"
FRENCH = "le la les un une des du et ou à au aux en dans sur sous pour par avec sans est sont sera serait ont été que qui ne pas plus moins puis depuis entre près selon se ce cette ces il elle ils elles nous vous je sa son ses leur dont mais comme si a après avant pendant chez tout très"
SPANISH = "el los las lo una uno y o del al con por para sin sobre entre es son era está estaba se no que como más menos desde hasta según antes después luego durante cuando porque su sus pero si muy ya ha han fue este esta ese esa donde también todo le les"
FUNCTION_WORDS = frozenset(f"{ENGLISH} {GERMAN} {FRENCH} {SPANISH}".split())

BLOB = 48
#: Tokens around a token in which function words are counted, and tokens over which perplexity is taken.
AROUND, WINDOW = 16, 16
#: Characters taken at once; a longer text is cut at white space and its parts are added up.
PART = 200_000
KINDS, LEVELS = 3, 8
SYMBOLS = KINDS * LEVELS
#: Weight of one, two and three symbols in a row, and tokens of backing off for a million tokens of training.
WEIGHTS, BACK_OFF = (0.65, 0.2, 0.15), 50_000

_TOKEN = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|[a-zA-Z]{1,12}://[^\s\"'<>)\]]+|\b[\w-]{1,64}(?:\.[\w-]{1,64}){1,8}/[^\s\"'<>)\]]*|[A-Za-z0-9+/=]{48,}|#\w+|\d+(?:[.,:]\d+)*|[^\W\d_]+")
_EAST = re.compile("[぀-ヿ一-鿿]")
_EAST_RUN = re.compile("[぀-ゟ]+|[゠-ヿ]+|[一-鿿]+|[^぀-ヿ一-鿿]+")
FUNCTION, NUMBER, CONTENT, SKIP = 0, 1, 2, 3


class Classes(dict):
    """Class of a token; those seen are remembered, in a table of bounded size."""

    MOST = 200_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        kind = self[token] = self.classify(token)
        return kind

    @staticmethod
    def classify(token: str) -> int:
        if token.lower() in FUNCTION_WORDS or "぀" <= token[0] <= "ゟ":
            return FUNCTION
        if len(token) >= BLOB and "://" not in token and "." not in token and token[0] not in "#<":
            return SKIP
        return NUMBER if token[0].isdigit() and "/" not in token else CONTENT


def tokens(text: str) -> list[str]:
    if text.isascii():
        return _TOKEN.findall(text)
    found = _TOKEN.findall(unicodedata.normalize("NFKC", text).translate(INVISIBLE))
    if not _EAST.search(text):
        return found
    return [part for token in found for part in (_EAST_RUN.findall(token) if _EAST.search(token) else (token,))]


def parts(text: str) -> Iterator[str]:
    """The text in parts of at most about PART characters, cut at white space where there is some."""
    at = 0
    while len(text) - at > PART:
        cut = max(text.rfind(" ", at + PART // 2, at + PART), text.rfind("\n", at + PART // 2, at + PART))
        cut = cut if cut > at else at + PART
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _around(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the values around each place, and how many there are; `width` of them, or all if there are fewer."""
    n = len(values)
    total = np.concatenate(([0], np.cumsum(values)))
    at = np.arange(n)
    lo = np.maximum(0, np.minimum(at - width // 2, n - width))
    hi = np.minimum(n, lo + width)
    return total[hi] - total[lo], hi - lo


def symbols(text: str, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length of every token that counts."""
    found = tokens(text)
    kind = np.fromiter((classes[t] for t in found), np.int64, len(found))
    size = np.fromiter(map(len, found), np.int64, len(found))
    kind, size = kind[kind != SKIP], size[kind != SKIP]
    near, of = _around((kind == FUNCTION).astype(np.int64), AROUND)
    level = np.minimum(LEVELS - 1, near * AROUND // np.maximum(1, of))
    return kind * LEVELS + level, size


def _before(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    longer = np.concatenate(([SYMBOLS, SYMBOLS], symbol))
    return longer[:-2], longer[1:-1], symbol


class ProseModel:
    """Three-gram model of symbols; its size is fixed."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS + 1, SYMBOLS + 1, SYMBOLS).astype(np.float64)
        c2, one = c3.sum(0), c3.sum((0, 1))
        total = one.sum()
        back = max(1.0, BACK_OFF * total / 1e6)
        p1 = (one + 0.5) / (total + 0.5 * SYMBOLS)
        p2 = (c2 + back * p1) / (c2.sum(1, keepdims=True) + back)
        p3 = (c3 + back * p2) / (c3.sum(2, keepdims=True) + back)
        self.log = WEIGHTS[0] * np.log(p1) + WEIGHTS[1] * np.log(p2) + WEIGHTS[2] * np.log(p3)

    def surprise(self, symbol: np.ndarray) -> np.ndarray:
        """Logarithm of the perplexity of the window around each symbol."""
        total, of = _around(-self.log[_before(symbol)], WINDOW)
        return total / np.maximum(1, of)


def abnormal_share(text: str, model: ProseModel, classes: Classes, high: float, low: float) -> float:
    """Share of the characters of a text that lies in windows of abnormal perplexity."""
    odd = every = 0
    for part in parts(text):
        symbol, size = symbols(part, classes)
        if len(symbol):
            s = model.surprise(symbol)
            odd += int(size[(s > high) | (s < low)].sum())
            every += int(size.sum())
    return odd / every if every else 0.0


def _count_task(least_function: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        total = np.zeros((SYMBOLS + 1) * (SYMBOLS + 1) * SYMBOLS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for part in parts(value.as_py()):
                    symbol, _ = symbols(part, classes)
                    if len(symbol) and (symbol < LEVELS * (FUNCTION + 1)).mean() >= least_function:
                        a, b, c = _before(symbol)
                        total += np.bincount((a * (SYMBOLS + 1) + b) * SYMBOLS + c, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    return run


def fit_prose(prose: DataFrame, *, text_col: str = "text", least_function: float = 0.15) -> ProseModel:
    """A model of all rows of `prose`.

    Parts of which less than `least_function` of the tokens are function words
    are no prose and left out. At most (SYMBOLS + 1)**2 * SYMBOLS = 15,000
    counters reach the driver, whatever the corpus.
    """
    counted = prose.select(F.col(f"`{text_col}`").alias("text")).where("text is not null").mapInArrow(_count_task(least_function), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((SYMBOLS + 1) * (SYMBOLS + 1) * SYMBOLS, np.int64)
    counts[counted.column("gram").to_numpy()] = counted.column("n").to_numpy()
    return ProseModel(counts)


def spam_pages(docs: DataFrame, prose: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", high: float = 4.0, low: float = 0.5, most: float = 0.5) -> DataFrame:
    """(id, share): documents of which more than `most` of the characters are keywords, links or tags.

    `share` is the part of the characters of tokens in windows whose
    log-perplexity under the model of `prose` is above `high` or below `low`.
    Null, empty and blank texts and those without any word or number are never
    flagged; without prose to learn from, no page is. Repeated rows count once.
    Other columns are ignored. Fitting the model runs as soon as this is called;
    the scan is one narrow pass without a shuffle but for repeated rows.
    """
    model = fit_prose(prose, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    if not np.ptp(model.log):
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, share double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes()
        for batch in batches:
            share = np.fromiter((abnormal_share(t.as_py(), model, classes, high, low) for t in batch.column(1)), float, batch.num_rows)
            at = np.flatnonzero(share > most)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(share[at])], names=["id", "share"])

    pages = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    return pages.mapInArrow(run, f"id {kind}, share double").groupBy("id").agg(F.max("share").alias("share")).withColumnRenamed("id", id_col)
