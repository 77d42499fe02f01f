"""Vendor HDF5 recordings, where h5py is installed."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession


def table_of(content: bytes) -> dict[str, list[float]]:
    """Column name to values: every dataset ``Values`` below the group ``Data``, or below the first
    group without one, named by its ``Label``; the first ``Time`` found is the time.

    It raises without h5py, and if there are no values.
    """
    import h5py

    found: dict[str, list[float]] = {}
    with h5py.File(io.BytesIO(content), "r") as tree:
        root = tree["Data"] if "Data" in tree else tree[next(iter(tree))]
        for key in root:
            if "Values" not in root[key]:
                continue
            label = root[key]["Values"].attrs.get("Label", root[key].attrs.get("Label", key))
            found[label.decode() if isinstance(label, bytes) else str(label)] = list(map(float, root[key]["Values"][()]))
            if "Time" in root[key] and "Time(s)" not in found:
                found["Time(s)"] = list(map(float, root[key]["Time"][()]))
    if not set(found) - {"Time(s)"}:
        raise ValueError("the file has no values")
    return found


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """A recording for each file: (rec, idx, name, value), one task a file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rec = file.rpartition("/")[2].partition(".")[0]
                for name, values in table_of(content).items():
                    yield pa.RecordBatch.from_pydict({"rec": [rec] * len(values), "idx": list(range(len(values))), "name": [name] * len(values), "value": values})

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.mapInArrow(run, "rec string, idx long, name string, value double")
