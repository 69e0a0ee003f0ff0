"""Hash embeddings: deterministic vectors from the words of a text, and a registry of other models."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSION = 384
#: Words whose slots a task remembers.
REMEMBERED = 500_000


class Slots(dict):
    """Place and sign of a word in a vector of `dim` values."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        digest = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
        slot = self[word] = (int.from_bytes(digest[:4], "big") % self.dim, 1.0 - 2.0 * (digest[4] & 1))
        return slot


def hash_vector(text: str | None, dim: int = DIMENSION, slots: Slots | None = None) -> list[float]:
    """Unit vector of the signed counts of a text's words; zeros for no text, equal values where nothing is left."""
    out = np.zeros(dim)
    if not text:
        return out.tolist()
    slots = Slots(dim) if slots is None else slots
    for word in text.lower().split():
        at, sign = slots[word]
        out[at] += sign
    norm = math.sqrt(float(out @ out))
    return (out / norm if norm else np.full(dim, 1.0 / math.sqrt(dim))).tolist()


def hash_vectors(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", dim: int = DIMENSION) -> DataFrame:
    """(id, embedding): one narrow pass; a null text gives zeros. Other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(dim)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                vectors = pa.array([hash_vector(t, dim, slots) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], names=["id", "embedding"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, embedding array<double>")


def hash_buckets(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", dim: int = DIMENSION) -> DataFrame:
    """(id, slot, weight): the signed word counts before they are scaled, without zeros; native throughout."""
    from hyphae.functions.text import WHITE

    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.filter(F.split(F.lower(F.col(f"`{text_col}`")), f"{WHITE}+", -1), lambda w: w != "")).alias("word"))
    digest = words.select("id", F.sha2("word", 256).alias("h"))
    slot = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = F.lit(1) - 2 * (F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2)
    return digest.select("id", slot.alias("slot"), sign.alias("sign")).groupBy("id", "slot").agg(F.sum("sign").alias("weight")).where("weight <> 0")


Encoder = Callable[[str], list[float]]
_models: dict[str, Callable[[str, int], Encoder]] = {}


def register_model(name: str, make: Callable[[str, int], Encoder]) -> None:
    """Add a kind of embedding model: make(model_name, dim) gives a function of a text; ImportError if it isn't there."""
    _models[name] = make


def _sentence_transformer(model: str, dim: int) -> Encoder:
    from sentence_transformers import SentenceTransformer

    loaded = SentenceTransformer(model)
    return lambda text: [float(x) for x in loaded.encode(text, normalize_embeddings=True)]


register_model("hash", lambda model, dim: lambda text: hash_vector(text, dim))
register_model("sentence-transformer", _sentence_transformer)


def encoder(kind: str = "sentence-transformer", model: str = "all-MiniLM-L6-v2", dim: int = DIMENSION) -> Encoder:
    """The model asked for, or hash embeddings where its package or weights are missing."""
    try:
        return _models[kind](model, dim)
    except (ImportError, OSError, KeyError):
        return _models["hash"](model, dim)


def model_vectors(docs: DataFrame, kind: str, *, model: str = "all-MiniLM-L6-v2", id_col: str = "id", text_col: str = "text", dim: int = DIMENSION) -> DataFrame:
    """(id, embedding) by a registered model, loaded once a task."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(kind, model, dim)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], names=["id", "embedding"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {id_type}, embedding array<double>")
