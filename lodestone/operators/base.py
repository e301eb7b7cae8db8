"""What an index, a chunker and a cross-encoder are, for ones of one's own."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..errors import FeatureNotAvailable


class Index(ABC):
    """Searches a table of vectors. save() and load() are refused unless an index has them."""

    @abstractmethod
    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """The best k, best first."""

    @abstractmethod
    def search_filtered(self, query: Sequence[float], k: int, where: Column) -> DataFrame: ...

    @abstractmethod
    def delete(self, ids: DataFrame) -> Index: ...

    def save(self, path: str) -> Index:
        raise FeatureNotAvailable("index persistence")

    @classmethod
    def load(cls, path: str, docs: DataFrame, *a, **how) -> Index:
        raise FeatureNotAvailable("index persistence")


class Chunker(ABC):
    """Cuts a text into chunks."""

    @abstractmethod
    def chunk(self, text: str) -> list[str]: ...


class CrossEncoder(ABC):
    """Scores pairs of a query and a text."""

    @abstractmethod
    def scores(self, query: str, texts: list[str]) -> list[float]: ...
