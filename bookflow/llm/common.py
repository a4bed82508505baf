"""What the operators share: reading, tables in the shared folder, row numbers, word patterns."""

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators.lineage import checkpoint_root

WHITE = r"\x20\x09-\x0D"
#: A word is a run of anything but ASCII white space.
WORD = rf"[^{WHITE}]+"


def documents(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def held(df, name):
    """`df` as a Parquet table in the folder all executors share: it is computed once, and a lost executor loses nothing."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def fraction(*parts):
    """A hash of the columns as a double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def steps(batches, name, limit=8 << 20):
    """Arrow batches in slices of about `limit` bytes in column `name`, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        length = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = (np.cumsum(length) - length) // limit
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def arrow(columns, kinds):
    """A record batch of named Python lists or Arrow arrays; `kinds` names the type of each list."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


#: Rows up to which a table of one short row per key is broadcast; beyond it the join is shuffled.
FEW = 10_000


def few(df):
    """`df`, a table that is cheap to count, to be broadcast if its size allows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
