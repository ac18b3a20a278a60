"""A search as configuration: rewrites, legs, fusion, pool, re-ranking and post-filter become one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..operators import bitmaps, dense, lexical, rank, vector_blocks
from ..operators.pairs import PairModel

Form = Callable[[DataFrame], DataFrame] | None


@dataclass
class SearchPlan:
    """``forms`` name the rewrites of the queries (qid, text) that every leg searches.

    The lexical leg needs an ``index``, the dense leg ``vectors`` (doc_id, vector, or stored blocks of them) and an ``encoder`` of queries into
    (qid, vector); a plan may have either or both.  ``expand`` rewrites the queries of the lexical leg alone.  ``retrieve_k`` hits a leg
    are fused if there are several legs.  With a scorer they are re-ranked on the original text and cut to ``top_k``
    before the post-filter; without, the filter sees all of them.
    """

    index: lexical.Index | None = None
    vectors: DataFrame | vector_blocks.VectorBlocks | None = None
    encoder: Callable[[DataFrame], DataFrame] | None = None
    forms: dict[str, Form] = field(default_factory=lambda: {"full": None})
    expand: Form = None
    retrieve_k: int = 20
    top_k: int = 20
    scorer: Callable[[Column, Column], Column] | PairModel | None = None
    post_filter: Callable[[DataFrame], DataFrame] | None = None
    allowed: lexical.Pool | DataFrame | None = None

    def legs(self, queries: DataFrame) -> dict[str, DataFrame]:
        """The hits of each form in each leg."""
        out = {}
        for name, form in self.forms.items():
            asked = form(queries) if form else queries
            if self.index is not None:
                out[name] = lexical.bm25_search(self.expand(asked) if self.expand else asked, self.index, self.retrieve_k, self.allowed)
            if self.vectors is not None:
                pairs = bitmaps.pool_members(asked, self.allowed, self.index) if isinstance(self.allowed, lexical.Pool) else self.allowed
                if isinstance(self.vectors, vector_blocks.VectorBlocks):
                    out[f"{name}_dense"] = vector_blocks.search_blocks(self.encoder(asked), self.vectors, self.retrieve_k, allowed=pairs).hits
                else:
                    out[f"{name}_dense"] = dense.dense_search(self.encoder(asked), self.vectors, self.retrieve_k, allowed=pairs)
        return out

    def run(self, queries: DataFrame, docs: DataFrame) -> DataFrame:
        legs = self.legs(queries)
        hits = rank.rrf(rank.union_runs(legs), self.retrieve_k) if len(legs) > 1 else next(iter(legs.values()))
        if self.scorer is not None:
            hits = rank.rerank(hits, queries, docs, self.top_k, self.scorer)
        if self.post_filter is not None:
            hits = self.post_filter(hits)
        return hits.where(f"rank <= {self.top_k}")
