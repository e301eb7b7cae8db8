"""Embedders: deterministic ones made of columns or Arrow functions, and the base class for models of one's own."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FeatureNotAvailable
from .text import tokens_of


class Embedder:
    """Subclasses give dimension and embed_batch(); column() runs it over Arrow batches."""

    dimension = 0

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0].tolist()

    def column(self, text: Column) -> Column:
        me = self

        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            x = me.embed_batch([t or "" for t in texts.to_pylist()]).astype(np.float32)
            return pa.array(list(x), pa.list_(pa.float32()))

        return run(text)


class HashEmbedder(Embedder):
    """Dimensions are hashes of the text in [0, 1): no semantics, but the same everywhere, and pure columns."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, text: str) -> list[float]:
        """The same on the driver."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        return list(spark.range(1).select(self.column(F.lit(text))).first()[0])

    def column(self, text: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(self.dimension - 1)), lambda i: (F.pmod(F.xxhash64(text, i), F.lit(1 << 31)) / float(1 << 31)).cast("float"))


def _fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


class BagEmbedder(Embedder):
    """Words (weight 1) and word pairs (0.8), each hashed to three dimensions (1, 0.5, 0.25); length 1."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            words = tokens_of(text)
            for weight, grams in ((1.0, words), (0.8, [f"{a} {b}" for a, b in zip(words, words[1:])])):
                for g in grams:
                    h = _fnv(g)
                    for k, part in enumerate((1.0, 0.5, 0.25)):
                        row[(h >> 21 * k) % self.dimension] += weight * part
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out


class OnnxEmbedder(Embedder):
    """A sentence encoder in ONNX form with its tokenizer file, such as a 384-dimensional MiniLM: token vectors averaged under the attention mask, length 1. Opened where it is first used; both packages are optional."""

    def __init__(self, model: str, tokenizer: str, dimension: int = 384, max_length: int = 256):
        try:
            import onnxruntime  # noqa: F401
            import tokenizers  # noqa: F401
        except ImportError as x:
            raise FeatureNotAvailable(f"embedder: {x.name} is not installed") from x
        self.model, self.tokenizer, self.dimension, self.max_length = model, tokenizer, dimension, max_length

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimension))
        if "_open" not in self.__dict__:
            import onnxruntime
            import tokenizers

            tok = tokenizers.Tokenizer.from_file(self.tokenizer)
            tok.enable_truncation(self.max_length)
            tok.enable_padding()
            self._open = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), tok
        session, tok = self._open
        encoded = tok.encode_batch(texts)
        mask = np.array([e.attention_mask for e in encoded], np.int64)
        given = {"input_ids": np.array([e.ids for e in encoded], np.int64), "attention_mask": mask, "token_type_ids": np.array([e.type_ids for e in encoded], np.int64)}
        names = {i.name for i in session.get_inputs()}
        hidden = session.run(None, {k: v for k, v in given.items() if k in names})[0]
        return pooled(hidden, mask)


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Means of the tokens' vectors where mask is 1, of length 1."""
    x = (hidden * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def embed_missing(df, embedder, text: str = "text", vector: str = "embedding"):  # noqa: ANN001, ANN201
    """Embeds the rows whose vector hasn't the embedder's dimension."""
    return df.withColumn(vector, F.when(F.size(F.coalesce(F.col(vector), F.array().cast("array<float>"))) == embedder.dimension, F.col(vector)).otherwise(embedder.column(F.col(text))))
