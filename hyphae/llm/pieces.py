"""Long texts cut into overlapping pieces at the best places, by dynamic programming.

A piece ends at an end of a paragraph, line, sentence or word, and the next one
begins at such an end up to `overlap` characters before, or right there. Of all
ways to cover the text the one of least cost is taken, where every piece costs
PIECE, its end and its beginning cost by their kinds, and what it doesn't repeat
of the overlap costs SHORT in full, less in part. Inside a word is far dearer
than anything else, so it is cut or begun only where there is no other way. The
windows of pieces that may come before an end, and of ends that may come before
a beginning, move forward, so the cheapest are found in linear time.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = 0, 1, 2, 4, 100_000
PIECE = SHORT = 4
_SPACE = re.compile(r"\s+")
_LINE_END = re.compile("\r\n|[\n\r\u2028\u2029\x85\x0b\x0c]")
_SENTENCE = re.compile(r"[.!?…؟।][\"'’”»)\]]*\Z")
_WIDE = re.compile(r"[。！？][」』”）]*")
#: Joiner and variation selector: a place before them, or after the joiner, is inside a character as it is seen.
_JOINER, _JOINS = "\u200d", "\u200d\ufe0f"


def ends(text: str, size: int) -> tuple[list[int], list[int]]:
    """Places where a piece may end, in order, and the cost of each."""
    cost: dict[int, int] = {}
    for m in _WIDE.finditer(text):
        cost[m.end()] = SENTENCE
    for m in _SPACE.finditer(text):
        lines = len(_LINE_END.findall(m.group()))
        cost[m.end()] = PARAGRAPH if lines > 1 or "\u2029" in m.group() else LINE if lines else SENTENCE if _SENTENCE.search(text, max(0, m.start() - 8), m.start()) else WORD
    cost[len(text)] = PARAGRAPH
    cost.pop(0, None)
    at = sorted(cost)
    step = max(1, size // 40)
    for a, b in zip([0, *at], list(at)):
        if b - a > size * 3 // 4:  # nothing within reach: places inside the run
            for p in range(a + step, b, step):
                whole = next((q for q in range(p, min(b, p + step)) if not (unicodedata.combining(text[q]) or text[q] in _JOINS or text[q - 1] == _JOINER)), p)
                cost.setdefault(whole, WORD if text[whole - 1].isspace() else INSIDE)
    at = sorted(cost)
    return at, [cost[p] for p in at]


def cut(text: str, size: int = 4_000, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece if it isn't longer than `size`."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    places, costs = ends(text, size)
    at, kind, last = [0, *places], [0, *costs], len(places)
    unit, none = max(1, overlap), float("inf")  # costs are whole numbers of 1 / unit
    begun = [0, *[none] * last]  # least cost of all before a piece that begins here
    far = [none] * (last + 1)  # least of `begun` for a piece that ends here and is longer than the overlap
    ended = [none] * (last + 1)  # cost with that piece, less SHORT for every character before its end
    opened, before, closed = [-1] * (last + 1), [-1] * (last + 1), [-1] * (last + 1)
    # windows, the cheapest (of `dear` the dearest) first: beginnings of long pieces, of short ones, ends, and `far` of these ends
    long, short, finish, dear = deque(), deque(), deque(), deque()
    ready, e = 0, 1
    for s in range(1, last):
        here = at[s]
        while short and at[short[0]] < here - overlap:
            short.popleft()
        while short and begun[short[-1]] >= begun[s - 1]:
            short.pop()
        short.append(s - 1)
        while e < last and at[e] <= here + overlap:
            while at[ready] < at[e] - overlap:
                while long and begun[long[-1]] >= begun[ready]:
                    long.pop()
                long.append(ready)
                ready += 1
            while long and at[long[0]] < at[e] - size:
                long.popleft()
            if long:
                opened[e], far[e] = long[0], begun[long[0]]
                ended[e] = far[e] + (PIECE + kind[e]) * unit - SHORT * at[e]
            while finish and ended[finish[-1]] >= ended[e]:
                finish.pop()
            finish.append(e)
            while dear and far[dear[-1]] <= far[e]:
                dear.pop()
            dear.append(e)
            e += 1
        while finish[0] < s:
            finish.popleft()
        while dear[0] < s:
            dear.popleft()
        whole = kind[s] * unit + SHORT * (overlap + here)
        begun[s], before[s], closed[s] = ended[finish[0]] + whole, opened[finish[0]], finish[0]
        # a piece no longer than the overlap is worth it only if its beginning is cheaper than those further off
        if begun[short[0]] < far[dear[0]]:
            r, least = s, -1
            for k in range(e - 1, s - 1, -1):
                # the later the end, the fewer beginnings are within the overlap of it
                while r > 0 and at[r - 1] >= at[k] - overlap:
                    r -= 1
                    if least < 0 or begun[r] < begun[least]:
                        least = r
                if least >= 0 and (cost := begun[least] + (PIECE + kind[k]) * unit - SHORT * at[k] + whole) < begun[s]:
                    begun[s], before[s], closed[s] = cost, least, k
    s = min((k for k in range(last) if at[k] >= n - size), key=lambda k: (begun[k], k))
    if begun[s] == none:
        raise RuntimeError("no cover found")
    out = [(at[s], n)]
    while s:
        out.append((at[before[s]], at[closed[s]]))
        s = before[s]
    return out[::-1]


def split_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4_000, overlap: int = 200) -> DataFrame:
    """(id, piece, start, text): the pieces of every text of more than `size` characters.

    Pieces are numbered from 0; `start` is the place of the first character in
    the text. Characters are code points. Null texts have no piece; repeated
    rows are cut once each. Other columns are ignored.
    """
    if not 0 <= 6 * overlap <= size or size < 40:
        raise ValueError("size must be 40 at least and overlap at most a sixth of it")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("text", T.StringType())])
    long = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).where(F.char_length(F.col(f"`{text_col}`")) > size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                parts = cut(text, size, overlap)
                name = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts), arrow.field(0).type), pa.array(range(len(parts)), pa.int32()), pa.array([a for a, _ in parts], pa.int64()), pa.array([text[a:b] for a, b in parts], arrow.field(3).type)], schema=arrow)

    return long.mapInArrow(run, schema)
