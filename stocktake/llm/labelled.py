"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktake.llm.common import held_out_rows


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text",
           modulus: int = 4, remainder: int = 2) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` training documents of each class, and the classes' sizes.

    Only labels whose document is not held out count; of several labels of a document the largest
    does; null labels are left out. The rows are those with the smallest hash of the id, so the
    sample is the same at every run. The broadcast side has 2 * per_class rows at most.
    """
    y = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out_rows(id_col, modulus, remainder))
    y = y.groupBy(F.col(id_col).alias("id__")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {int(r[0]): int(r[1]) for r in y.groupBy("y").count().collect()}
    chosen = None
    for value in (0, 1):
        some = y.where(F.col("y") == value).orderBy(F.xxhash64("id__"), "id__").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(id_col).alias("id__"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "id__").select("text", "y"), sizes
