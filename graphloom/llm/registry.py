"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from . import html_extract, langid, licenses, packing, quality, sentencepiece_bpe, sharding, simhash, url_filter, winnowing

_MODULES = (langid, sentencepiece_bpe, winnowing, simhash, packing, sharding, quality, licenses, html_extract, url_filter)


def queries() -> dict:
    return {k: q for m in _MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
