"""Chunkers as table functions for SQL: ``SELECT d.doc_id, c.* FROM docs d, LATERAL boundary_chunks(d.text, 2000) c``.

``register`` gives a session ``boundary_chunks(text, size)``, ``section_chunks(text, size)`` and ``sentence_chunks(text, size)``. Each text becomes its
chunks (chunk_index, total_chunks, text) where it stands, in Arrow batches; a null text is an empty one, and a size must be over 0.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loresmith.operators import pack

CHUNK = "chunk_index int, total_chunks int, text string"


class BoundaryChunks:
    kind = "boundaries"

    def eval(self, text: str, size: int):
        if size is None or size < 1:
            raise ValueError("a chunk's size must be over 0")
        parts = pack.cut(text or "", self.kind, size=size)
        for i, part in enumerate(parts):
            yield i, len(parts), part


class SectionChunks(BoundaryChunks):
    kind = "sections"

    def eval(self, text: str, size: int):
        yield from super().eval(text, size)


class SentenceChunks(BoundaryChunks):
    kind = "sentences"

    def eval(self, text: str, size: int):
        yield from super().eval(text, size)


def register(spark: SparkSession) -> None:
    """Make the chunkers known to the session's SQL."""
    for name, made in (("boundary_chunks", BoundaryChunks), ("section_chunks", SectionChunks), ("sentence_chunks", SentenceChunks)):
        spark.udtf.register(name, F.udtf(made, returnType=CHUNK, useArrow=True))
