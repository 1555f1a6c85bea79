"""Where a host's own functions take part: decoding pictures, recognising text, embedding texts and pictures.

The engine plans the work and keeps its results; a model or codec is a function that the caller hands over. It is called with
Arrow batches of a bounded size, once per batch, in the Python workers; a batch that fails is tried row by row, and a row that
fails is a row with its problem, so one bad file neither ends the job nor is tried again before it changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterloom.session import ship

#: Rows that a model takes at once, at most.
LARGEST_BATCH = 64


def applied(rows: DataFrame, column: str, function: Callable[[Sequence], Sequence], result: str, kind: T.DataType, batch: int = LARGEST_BATCH) -> DataFrame:
    """rows without ``column``, with ``result`` (what the function gives for the values of column) and problem, of which
    one is null. The function gets a list of up to ``batch`` values and returns as many results."""
    if not 1 <= batch <= LARGEST_BATCH:
        raise ValueError(f"a batch has 1 to {LARGEST_BATCH} rows")
    kept = [c for c in rows.columns if c != column]

    def one(value) -> tuple:
        try:
            return function([value])[0], None
        except Exception as e:  # whatever the host's function raises is the row's problem
            return None, " ".join(str(e).split()) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            results, problems = [], []
            for i in range(0, len(pdf), batch):
                values = pdf[column].iloc[i : i + batch].tolist()
                try:
                    got = list(function(values))
                    if len(got) != len(values):
                        raise ValueError("a function returns one result for each value")
                    pairs = [(g, None) for g in got]
                except Exception:
                    pairs = [one(v) for v in values]
                results += [p[0] for p in pairs]
                problems += [p[1] for p in pairs]
            yield pdf[kept].assign(**{result: pd.Series(results, index=pdf.index, dtype=object), "problem": pd.Series(problems, index=pdf.index, dtype=object)})

    ship(rows.sparkSession)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField(result, kind), T.StructField("problem", T.StringType())])
    return rows.mapInPandas(run, schema)


def embedded_texts(backlog: DataFrame, model: Callable[[Sequence[str]], Sequence], width: int, batch: int = LARGEST_BATCH) -> tuple[DataFrame, DataFrame]:
    """(asset_id, fingerprint, embedding) of a backlog's texts, and the failures (asset_id, fingerprint, problem): also vectors
    of another width or with numbers that are not finite."""
    done = applied(backlog.select("asset_id", "source_modified_ns", "source_size", "content"), "content", model, "embedding", T.ArrayType(T.FloatType(), False), batch)
    usable = (F.size("embedding") == width) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.col("problem").isNull() & F.coalesce(usable, F.lit(False))
    bad = done.where(~good).select("asset_id", "source_modified_ns", "source_size", F.coalesce("problem", F.lit("not a vector of the model's width")).alias("problem"))
    return done.where(good).drop("problem"), bad
