"""Multi-source runs: merge, check, split, read early signs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.diagnose import source_probe
from ..operators.evaluate import score
from ..operators.inventory import index_problems, merge_sources, require_valid
from ..operators.models import nearest_centroid_oof
from ..operators.splits import leave_one_source_out
from ..operators.vectors import per_group_normalise


def build_index(parts: Sequence[DataFrame], files: DataFrame | None = None, published=None) -> DataFrame:
    """Union of the parsed sources, checked as a whole."""
    index = merge_sources(parts).drop("problem")
    kwargs = {} if published is None else {"published": published}
    require_valid(index_problems(index, files, **kwargs))
    return index


def early_read(df: DataFrame, key: str, vec: str, label: str, group: str, source: str, base: str) -> dict[str, DataFrame]:
    """Base only against all sources pooled, on the same base test folds, plus the source probe."""
    from ..operators.splits import with_group_fold

    rows = per_group_normalise(df, vec, group)
    own = with_group_fold(rows.where(F.col(source) == base), group, 5)
    outside = rows.where(F.col(source) != base).withColumn("fold", F.lit(-1))
    control = nearest_centroid_oof(own, key, vec, label).select(F.lit("control").alias("arm"), "y_true", "y_pred")
    pooled = nearest_centroid_oof(own.unionByName(outside), key, vec, label).where(F.col("fold") >= 0)
    table = score(control.unionByName(pooled.select(F.lit("pooled").alias("arm"), "y_true", "y_pred")), "arm")
    return {"scores": table, "probe": source_probe(df, key, vec, group, source)}


def source_holdout(df: DataFrame, key: str, vec: str, label: str, source: str, order: Sequence[str] | None = None) -> DataFrame:
    """Scores with each source held out, over present and over all classes."""
    folds = leave_one_source_out(df, key, source, order).where(F.col("split") == "test").select(key, "fold")
    pred = nearest_centroid_oof(df.join(folds, key), key, vec, label)
    return score(pred, "fold")
