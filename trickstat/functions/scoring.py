"""A user's scorer as a table function of SQL: several rows for each row, with a schema of its own."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _as_typed(kind: DataType) -> Callable:
    """Makes a scorer's value one of kind: numbers may be given as any sort of number."""
    if isinstance(kind, DecimalType):
        return lambda v: v
    make = float if isinstance(kind, FractionalType) else int if isinstance(kind, IntegralType) else str if isinstance(kind, StringType) else None
    return (lambda v: None if v is None else make(v)) if make else (lambda v: v)


def scorer_table(spark: SparkSession, name: str, scorer: Callable[[dict], Iterable[dict]], schema: StructType | str, status: str = "status") -> None:
    """Registers name(TABLE(...), keep => 'a, b') for SQL.

    For each row of the table the function gives what scorer(row) gives, any number of rows of schema, each with the columns
    in keep (all if it isn't stated; unknown ones are an error when the query is analyzed) and status "ok". Where scorer fails, what it had given of
    this row is dropped: one row has NULLs and status "ERROR: why", and the job goes on. Keep must not name columns of schema."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = fields.fieldNames()
    typed = [(f.name, _as_typed(f.dataType)) for f in fields]

    class Scorer:
        def __init__(self, analyzed: AnalyzeResult | None = None) -> None:
            self.kept = [f.name for f in analyzed.schema.fields[: -len(names) - 1]]

        @staticmethod
        def analyze(rows: AnalyzeArgument, keep: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            have = {f.name: f for f in rows.dataType.fields}
            kept = list(have) if keep is None or keep.value is None else [c.strip() for c in keep.value.split(",") if c.strip()]
            for c in kept:
                if c not in have:
                    raise ValueError(f"no column {c}; there are {', '.join(have)}")
                if c in names or c == status:
                    raise ValueError(f"{c} is a column of the result")
            return AnalyzeResult(StructType([*(have[c] for c in kept), *fields.fields, StructField(status, StringType())]))

        def eval(self, rows: Row, keep: str | None = None) -> Iterator[tuple]:
            row = rows.asDict(recursive=True)
            own = tuple(row[c] for c in self.kept)
            try:
                made = [(*own, *(make(r.get(n)) for n, make in typed), "ok") for r in scorer(row)]
            except Exception:  # one bad row is a result, not the end of the job
                made = [(*own, *(None for _ in names), "ERROR: " + traceback.format_exc(limit=0).strip().splitlines()[-1])]
            yield from made

    spark.udtf.register(name, F.udtf(Scorer, useArrow=False))  # with Arrow, each row would be a batch of its own


def scored_by(df: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """The rows that a registered scorer gives for df."""
    more = "" if keep is None else ", keep => '" + ", ".join(keep) + "'"
    return df.sparkSession.sql(f"select * from {name}(table({{rows}}){more})", rows=df)
