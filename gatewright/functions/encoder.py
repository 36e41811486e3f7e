"""A hook for an ONNX text encoder on CPU, one session a worker process."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=2)
def _session(model: str | bytes):
    """One session a process and model, however many tasks run there."""
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def onnx_encoder(model: str | bytes, prepare: Callable[[list[str]], dict[str, np.ndarray]], output: int = 0) -> Callable[[list[str]], np.ndarray]:
    """Texts to FP32 vectors. prepare: model inputs for texts, as the model's tokenizer makes them; model: its file on each worker, or its bytes, which travel to the workers with the function."""
    return lambda texts: np.asarray(_session(model).run(None, prepare(texts))[output], np.float32)


def by_length(encoder: Callable[[list[str]], np.ndarray], rows: int = 32) -> Callable[[list[str]], np.ndarray]:
    """An encoder that gives texts of about one length to another, at most `rows` at a time, so that little is padded; vectors come in the order of the texts."""

    def vectors(texts: list[str]) -> np.ndarray:
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        found = [encoder([texts[i] for i in order[at : at + rows]]) for at in range(0, len(order), rows)]
        out = np.concatenate(found) if found else np.zeros((0, 0), np.float32)
        back = np.empty_like(out)
        back[order] = out
        return back

    return vectors


def hashing_encoder(dimensions: int = 256) -> Callable[[list[str]], np.ndarray]:
    """An encoder without weights: how many lower-case tokens of a text, split at blanks, fall into each bucket by the first bytes of their MD5. Deterministic, so rankings through encode() can be tested end to end."""

    def vectors(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float32)
        for i, text in enumerate(texts):
            for token in filter(None, text.lower().split(" ")):
                out[i, int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % dimensions] += 1
        return out

    return vectors


def encode(df: DataFrame, text: str, out: str, encoder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """df with a vector column; null text is encoded as empty. Arrow batches, no shuffle."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(encoder(part.fillna("").tolist())) if len(part) else [], index=part.index, dtype=object)

    return df.withColumn(out, run(F.col(text)))
