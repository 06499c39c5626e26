"""All registered queries: name → (function of session and folder, equivalent SQL or None)."""

from __future__ import annotations

from . import clean_queries, feature_queries, model_queries, profile_queries


def catalog() -> dict:
    merged: dict = {}
    for module in (clean_queries, profile_queries, feature_queries, model_queries):
        repeated = set(merged) & set(module.QUERIES)
        if repeated:
            raise ValueError(f"query names occur twice: {sorted(repeated)}")
        merged.update(module.QUERIES)
    return merged
