"""What the operators of this package share: the word rule, scratch tables and names.

Rules that hold for every operator unless its docstring says otherwise:

* A null text counts as the empty text. A null id is a value like any other: such rows are kept and null sorts first.
* An operator reads only the columns that it names. Result columns replace input columns of the same name, whatever the
  case of the letters; other columns pass through.
* Nothing is dropped, capped or sampled to escape skew.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.sources.scratch import discard, scratch, written  # noqa: F401  the operators' tables between steps

#: A word: code points other than the blank and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The same, for Spark's regular expressions inside SQL literals.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Return memory that this process has freed to the system, where the C library can: a driver's later steps and a task's executor may need it."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop input columns that a result column would clash with, in any case of letters."""
    taken = {x.lower() for x in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Where all characters are ASCII, lower() is the same and much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def thinned(rows: DataFrame, hashed: str, n: int, of: Column) -> DataFrame:
    """Rows with the smallest of `of` uniform 64-bit hashes: n of them and some more, so that a task passes on its share and no more.

    The n smallest are among them but with a probability below 1e-9: five deviations and 50 rows are added to what is expected.
    """
    most = (n + 6 * n**0.5 + 50) / of
    return rows.where((F.col(hashed).cast("double") / 2.0**64 + 0.5) < most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
