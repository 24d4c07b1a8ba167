"""Helpers the operators share: inputs, scratch tables and bounded slices of long texts."""

from __future__ import annotations

import ctypes
import functools
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from wicara.session import remove_on_exit, shared_dir

# str.split() also breaks at the four separators U+001C to U+001F, which are no white space elsewhere.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Exchange whole texts with Python in batches of ``rows``, unless the session says otherwise.

    The default of 10,000 rows is meant for short rows; with texts, every task would hold tens of
    megabytes of them on both sides.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(rows))


class Scratch:
    """Tables written to the shared folder of the session, each removed when no longer needed.

    Written tables cut the lineage and survive the loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def path(self, name: str) -> str:
        self.names.add(name)
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        remove_on_exit(self.spark, self.root)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def finish(self, df: DataFrame, name: str = "result") -> DataFrame:
        """Write the result and drop every other table."""
        result = self.write(df, name)
        self.drop(*(self.names - {name}))
        return result


def split_words(text: str) -> list[str]:
    """Runs between Unicode white space."""
    if SEPARATORS.search(text):
        return [w for w in SPACE.split(text) if w]
    return text.split()


def slices(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut only at blanks or line ends."""
    start = 0
    while len(text) - start > size:
        found = re.compile("[ \n]").search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def pieces(batches, rows: int = 512) -> Iterator:
    """Arrow batches in parts of at most ``rows`` rows, so that few texts are Python objects at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def lean(run: Callable, block: int = 1 << 20, spare: int = 1 << 17) -> Callable:
    """Have a function over batches return its memory to the system when a task ends.

    Python workers live on between tasks; without this their unused heap adds up on an executor. Blocks
    above ``block`` bytes are mapped and go back when freed, as does free heap above ``spare`` bytes; larger
    values, up to 32 MB for ``block``, spare a task that frees and takes alike blocks all the time the new pages.
    """

    @functools.wraps(run)
    def wrapped(batches):
        library = ctypes.CDLL(None)
        if hasattr(library, "mallopt"):
            library.mallopt(-3, block)
            library.mallopt(-1, spare)
        yield from run(batches)
        if hasattr(library, "malloc_trim"):
            library.malloc_trim(0)

    return wrapped
