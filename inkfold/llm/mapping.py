"""Running a function over the texts of a table, a column batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

#: Bytes of text handed to a function at once (one longer text goes alone).
CHUNK_BYTES = 1 << 20

_TEXT = "__text_of_row"


def chunks(sizes: Sequence[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to `limit` at most, one row at least."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of a text column and their UTF-8 texts (null: empty).  A range is cut before it
    is turned into Python's bytes, so that a task holds one chunk beside the column batch."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, j in chunks(sizes):
        yield i, j, [t or b"" for t in column.slice(i, j - i).to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], dict]],
    schema: str,
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns `keep` (default: all) and what a function makes of the texts.

    `make()` is called once in each task and gives a function from a list of UTF-8
    texts (null: empty) to a dict of columns named as in `schema`.  A kept column with
    a name of `schema` gives way to the result.  There is no shuffle, and a task holds
    one column batch and one chunk of texts.
    """
    made = StructType.fromDDL(schema)
    names = [f.name for f in made.fields]
    lower = {n.lower() for n in names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in lower]
    kept = list(dict.fromkeys(kept))
    ready = df.select(*[F.col(f"`{c}`") for c in kept])
    # A text that is kept travels once.
    place = kept.index(text) if text in kept and isinstance(df.schema[text].dataType, StringType) else len(kept)
    if place == len(kept):
        ready = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias(_TEXT))
    out = StructType([ready.schema[c] for c in kept] + made.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, call = to_arrow_schema(out), make()
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(place)):
                result = call(texts)
                columns = [batch.column(k).slice(i, j - i) for k in range(len(kept))]
                columns += [pa.array(result[n], target.field(n).type) for n in names]
                columns = [c.cast(f.type) for c, f in zip(columns, target, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
            pa.default_memory_pool().release_unused()

    return ready.mapInArrow(run, out)
