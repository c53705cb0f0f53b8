"""Adding only what is new: batches by anti-join, files by Structured Streaming, and a pluggable scorer."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.keys import dedupe_by_key, pending


def ingest_new(source: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of source whose key isn't known."""
    return source.join(known.select(key).distinct(), key, "left_anti")


def ingest_stream(spark: SparkSession, schema: StructType, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, key: list[str] | None = None, changed: str = "keep") -> None:
    """Takes in the files that came since the last call, each once; progress is kept in checkpoint. With key, rows go through keyed_sink()."""
    rows = spark.readStream.schema(schema).parquet(source)
    if key:
        out = rows.writeStream.foreachBatch(keyed_sink(sink, key, transform, changed))
    else:
        out = transform(rows).writeStream.format("parquet").option("path", sink)
    out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


BATCH = "batch_id"


def _earlier(spark: SparkSession, sink: str, batch_id: int) -> DataFrame | None:
    """What other batches than this one wrote; None where there is nothing."""
    try:
        return spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*").where(F.col(BATCH) != batch_id)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def keyed_sink(sink: str, key: list[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, changed: str = "keep", good: str = "true") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function under which a batch that runs twice, or a key that comes again, makes no second row.

    Each batch has a folder of its own, which running it again replaces, so the sink is idempotent by batch id. In a batch, of rows with one
    key the smallest counts. changed "keep": keys that another batch has are left out, before transform (which may be costly)
    sees them. changed "replace": they are written too, and current_rows() takes the latest. good says which rows of other batches count as done;
    the rest, such as failures, are taken in again."""
    if changed not in ("keep", "replace"):
        raise ValueError(f"changed is keep or replace, not {changed}")

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in key]
        rows = dedupe_by_key(batch, key, F.struct(*rest)) if rest else batch.dropDuplicates(key)
        earlier = _earlier(spark, sink, batch_id)
        if earlier is not None and changed == "keep":
            rows = rows.join(earlier.where(good).select(*key).distinct(), key, "left_anti")
        transform(rows).write.mode("overwrite").parquet(f"{sink}/{BATCH}={batch_id}")

    return take


def current_rows(spark: SparkSession, sink: str, key: list[str]) -> DataFrame:
    """The latest row of each key that keyed_sink() wrote."""
    rows = spark.read.option("basePath", sink).parquet(f"{sink}/{BATCH}=*")
    return dedupe_by_key(rows, key, F.col(BATCH), "last").drop(BATCH)


def score_stream(spark: SparkSession, source_schema: StructType, source: str, sink: str, checkpoint: str, key: list[str], scorer: Callable[[dict], dict], schema: str) -> None:
    """Scores the rows of new files whose key has no good result yet; failures may come again and then replace what they left."""
    run = keyed_sink(sink, key, lambda df: apply_scorer(df, scorer, schema), "keep", "status = 'ok'")
    spark.readStream.schema(source_schema).parquet(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def apply_scorer(df: DataFrame, scorer: Callable[[dict], dict], schema: str, error: str = "status") -> DataFrame:
    """A user's function for each row, in parallel. Where it fails, the result columns are NULL and error says ERROR: why; the job goes on."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for row in batch.to_dict("records"):
                try:
                    got.append({**scorer(row), error: "ok"})
                except Exception:  # one bad row is a result, not the end of the job
                    got.append({error: "ERROR: " + traceback.format_exc(limit=0).strip().splitlines()[-1]})
            yield pd.concat([batch, pd.DataFrame(got, index=batch.index, columns=[*names, error])], axis=1)

    return df.mapInPandas(run, f"{fields}, {schema}, {error} string")


def score_new(df: DataFrame, done: DataFrame, key: str, scorer: Callable[[dict], dict], schema: str) -> DataFrame:
    """Earlier good results, and new ones for rows that are missing there or failed."""
    failed: Column = F.coalesce(F.col("status"), F.lit("")) != "ok"
    fresh = apply_scorer(pending(df, done, key, failed), scorer, schema)
    return done.where(~failed).unionByName(fresh)
