"""Table and aggregate functions in Python for SQL: `register` makes them known to a session.

    SELECT * FROM line_rows(TABLE(SELECT doc_id, text FROM documents), 5)
    SELECT doc_id, trimmed_mean(n_chars) FROM ... GROUP BY doc_id

The table function partitions its table by its first column, so a document's lines are made where the document is; the aggregate gets the rows of
one group at a time and is meant for groups of bounded size, such as the lines of a document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class LineRows:
    """(id, line_no, line, n_chars, repeated) of each \\n-split line of at least `least` characters of a table (id, text).

    repeated: an earlier row of the id had the line.  Null text has no lines; rows of one id follow each other in order of text and their lines are numbered
    on; the id keeps its name and type.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) != 2:
            raise ValueError("line_rows takes a table of an id and a text")
        if not least.isConstantExpression or least.value is None or least.value < 0:
            raise ValueError("the least number of characters is a constant of at least 0")
        id_, text = rows.dataType.fields
        out = T.StructType([T.StructField(id_.name, id_.dataType), *(T.StructField(n, t) for n, t in (("line_no", T.LongType()), ("line", T.StringType()), ("n_chars", T.LongType()), ("repeated", T.BooleanType())))])
        return AnalyzeResult(out, partitionBy=[PartitioningColumn(id_.name)], orderBy=[OrderingColumn(text.name)])

    def __init__(self):
        self.seen: set[str] = set()
        self.n = 0

    def eval(self, row, least):
        for line in (row[1] or "").split("\n"):
            if len(line) >= least and row[1] is not None:
                yield row[0], self.n, line, len(line), line in self.seen
                self.n += 1
                self.seen.add(line)


def trimmed_mean(values: pd.Series) -> float:
    """Mean without the smallest and the greatest value, where there are three or more; nulls don't count."""
    v = values.dropna().sort_values()
    v = v.iloc[1:-1] if len(v) > 2 else v
    return float(v.mean()) if len(v) else None


def register(spark: SparkSession) -> None:
    spark.udtf.register("line_rows", F.udtf(LineRows))
    spark.udf.register("trimmed_mean", F.pandas_udf(trimmed_mean, "double"))
