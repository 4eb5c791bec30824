"""Texts for embeddings, batches and providers."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.schema import EMBEDDABLE

#: Characters of a text.
LIMIT = 2500
#: Texts in a call.
BATCH = 8


def is_embeddable(label: Column) -> Column:
    return label.isin(*EMBEDDABLE)


def embedding_text(nodes: DataFrame) -> Column:
    """Label and id, then what there is of signature, stereotypes, docstring and code, a line each, cut to LIMIT characters."""
    def part(head: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(head), value))

    head = F.concat(F.lit("["), F.col("label"), F.lit("] "), F.col("id"))
    parts = [part("Signature: ", F.col("signature")), part("Stereotypes: ", F.array_join("stereotypes", ", ")), part("Docstring: ", F.col("docstring")), part("Code: ", F.col("code"))]
    return F.substring(F.concat_ws("\n", head, *parts), 1, LIMIT)


def batches_of(rows: DataFrame, scope: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """Adds the number of the batch, from 0, when the rows of a scope are taken in order, `size` at a time."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size))


Provider = Callable[[list[str]], list[list[float]]]
_providers: dict[str, Callable[[int], Provider]] = {}


def register_provider(name: str, factory: Callable[[int], Provider]) -> None:
    """Makes a provider known by name; the factory gets the number of dimensions."""
    _providers[name.lower()] = factory


def provider(name: str, dimensions: int) -> Provider:
    if name.lower() not in _providers:
        raise ValueError(f"unknown embedding provider {name!r}")
    return _providers[name.lower()](dimensions)


def _hashed(dimensions: int) -> Provider:
    """Unit vectors that depend on the text only; needs no network."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            seed = int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).standard_normal(dimensions)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    return embed


register_provider("hashed", _hashed)


def one_by_one(factory: Callable[[int], Callable[[str], list[float]]]) -> Callable[[int], Provider]:
    """The factory of a provider from that of one which takes a single text a call."""

    def made(dimensions: int) -> Provider:
        single = factory(dimensions)
        return lambda texts: [single(text) for text in texts]

    return made


#: Seconds before the second attempt; each further one waits twice as long.
WAIT = 0.5


def _called(embed_texts: Provider, batch: list[str], dimensions: int, attempts: int, wait: float) -> tuple[list, str | None]:
    """The vectors of a batch, or nulls and why there are none."""
    why = None
    for attempt in range(attempts):
        if attempt:
            time.sleep(wait * 2 ** (attempt - 1))
        try:
            got = embed_texts(batch)
        except Exception as x:  # a provider's failure must not end the job
            why = f"{type(x).__name__}: {x}"
            continue
        if len(got) != len(batch):
            why = f"{len(got)} vectors for {len(batch)} texts"
        elif any(v is not None and len(v) != dimensions for v in got):
            why = f"vectors of another size than {dimensions}"
        else:
            return list(got), None
    return [None] * len(batch), why


def embed_with_errors(nodes: DataFrame, name: str = "hashed", dimensions: int = 64, attempts: int = 3, wait: float = WAIT) -> DataFrame:
    """`nodes` with the embedding of every embeddable one, and embedding_error: why a node that should have one has none.

    Texts go to the provider BATCH at a time. A batch that fails, or answers with another number of vectors or with vectors of another
    size, is tried again after a wait; after `attempts` times its nodes get a null and the last error. Other batches go on.
    """
    embed_texts = provider(name, dimensions)

    @F.pandas_udf("struct<embedding: array<float>, error: string>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out, errors = [], []
            for i in range(0, len(texts), BATCH):
                batch = texts.iloc[i : i + BATCH].tolist()
                got, why = _called(embed_texts, batch, dimensions, attempts, wait)
                out += got
                errors += [why] * len(batch)
            yield pd.DataFrame({"embedding": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    rest = [c for c in nodes.columns if c != "embedding"]
    wanted = nodes.filter(is_embeddable(F.col("label"))).select(*rest, vectors(embedding_text(nodes)).alias("_made"))
    wanted = wanted.select(*rest, F.col("_made.embedding").alias("embedding"), F.col("_made.error").alias("embedding_error"))
    others = nodes.filter(~is_embeddable(F.col("label"))).select(*rest, F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_error"))
    return wanted.unionByName(others).select(*[c for c in nodes.columns if c != "embedding_error"], "embedding_error")


def embed(nodes: DataFrame, name: str = "hashed", dimensions: int = 64, attempts: int = 3, wait: float = WAIT) -> DataFrame:
    """The same without the errors."""
    return embed_with_errors(nodes, name, dimensions, attempts, wait).select(*nodes.columns)
