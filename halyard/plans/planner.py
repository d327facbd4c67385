"""Access paths: chosen when a search is declared, from what the caller asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from halyard.operators import graph, knn

#: Queries under which expressions beat matrix products where a filter leaves few rows.
FEW_QUERIES = 4


def search(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", ef: int | None = None, where: Column | None = None, graphs: DataFrame | None = None, vid: str = "vid") -> DataFrame:
    """qid, vid, dist, rk.  Exact unless the caller gives ef and there are graphs, whatever the number of rows.

    A filter is applied below the ranking, so an exact plan is used for it: fewer rows than k come back only if
    fewer qualify.
    """
    k, width = knn.clamp(k, ef)
    if ef is not None and graphs is not None and where is None:
        return graph.search(graphs, queries.select("qid", "vec"), k, width, kind=dict(base.dtypes)[vid])
    form = knn.expressions if where is not None and queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES else knn.blocks
    return form(queries, base, k, metric, where, vid=vid)
