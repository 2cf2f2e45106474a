"""Queries of the training-data operators."""

from __future__ import annotations

from loresmith.llm import chat, embeddings, licenses, packing, pieces, pitman_yor, private, quality, repair, simhash, templates, trie, webpages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (chat, embeddings, licenses, packing, pieces, pitman_yor, private, quality, repair, simhash, templates, trie, webpages):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
