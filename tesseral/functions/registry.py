"""User functions as SQL scalar functions, which Catalyst inlines into the plan."""

from __future__ import annotations

from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

#: The functions of an engine whose user gives no file.
DEFAULT = "CREATE OR REPLACE TEMPORARY FUNCTION discount(price DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN price * rate;"


def statements(text: str) -> list[str]:
    """The statements of a file, which end in semicolons; lines that begin with -- are comments."""
    lines = [line for line in text.splitlines() if not line.lstrip().startswith("--")]
    return [s.strip() for s in "\n".join(lines).split(";") if s.strip()]


#: By session, the statements that ran last: an engine that brings the same costs nothing.
_done: WeakKeyDictionary[SparkSession, str] = WeakKeyDictionary()


def register_functions(spark: SparkSession, path: str | None = None) -> None:
    """Runs the CREATE FUNCTION statements of a file (``custom.sql`` in the working directory if it is there, else DEFAULT)."""
    if path is None:
        path = "custom.sql" if Path("custom.sql").is_file() else None
    text = Path(path).read_text() if path else DEFAULT
    if _done.get(spark) == text:
        return
    for statement in statements(text):
        if not statement.upper().startswith("CREATE"):
            raise ValueError(f"not a function definition: {statement}")
        spark.sql(statement)
    _done[spark] = text


def register_vectorized(spark: SparkSession, name: str, function, returns: str = "double") -> None:
    """A function over pandas series for what SQL can't say; batches travel by Arrow."""
    from pyspark.sql.functions import pandas_udf

    spark.udf.register(name, pandas_udf(function, returns))
