"""A bounded sample of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes of all texts of a sample together; of rows in hash order those that fit are taken.
MAX_SAMPLE_BYTES = 64 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, held_out: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``max_rows`` (text, label), of MAX_SAMPLE_BYTES together, of rows that are not held out, chosen by a hash of the id.

    Which rows depends on ids and texts alone, not on how the table is split; rows without text or label are left out.
    An id with several labels or texts counts with each, rows that agree in id, text and label count once. In the order of the
    hash a text that does not fit any more is passed over, and the next ones are tried."""
    chosen = labels.filter(F.col(label_col).isNotNull() & ~held_out).select(id_col, F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col, "y").limit(max_rows)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).filter(F.col(text_col).isNotNull())
    found = found.withColumns({"h": F.xxhash64(id_col), "t": F.xxhash64(text_col), "n": F.octet_length(text_col)})
    sizes = found.filter(F.col("n") <= MAX_SAMPLE_BYTES).groupBy("h", "t", "y").agg(F.min("n").alias("n"))
    total, fitting = 0, []
    for h, t, y, n in sizes.orderBy("h", "t", "y").limit(max_rows).collect():  # numbers only
        if total + n <= MAX_SAMPLE_BYTES:
            total += n
            fitting.append((h, t, y))
    if not fitting:
        return []
    keys = docs.sparkSession.createDataFrame(fitting, "h long, t long, y int")  # max_rows at most
    rows = found.join(F.broadcast(keys), ["h", "t", "y"]).groupBy("h", "t", "y").agg(F.first(text_col).alias("text")).collect()
    return [(r[3], r[2]) for r in sorted(rows)]


def held_out(parts: int, part: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``parts``, is ``part`` (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def logistic(features, labels, ridge: float = 1.0, rounds: int = 60):
    """Weights, means and deviations of a ridge logistic regression by Newton steps (numpy)."""
    import numpy as np

    mean, deviation = features.mean(0), features.std(0) + 1e-9
    x = np.c_[np.ones(len(features)), (features - mean) / deviation]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * ridge, x.T @ (labels - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, deviation


def logistic_score(features, model):
    import numpy as np

    w, mean, deviation = model
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(features)), (features - mean) / deviation] @ w, -30, 30)))
