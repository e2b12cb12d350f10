"""Writers of histograms: CSV with three header lines, Parquet, HDF5 where h5py is present, and a text summary."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Meta:
    """What a histogram's columns mean."""

    x_label: str = "x"
    x_unit: str = ""
    y_unit: str = ""
    description: str = ""


def wide(hist: DataFrame) -> DataFrame:
    """One row for each bin: x, each key in order, then each key smoothed (where y_smooth is there)."""
    keys = sorted(r[0] for r in hist.select("key").distinct().collect())  # names of partials, a few for each pair of elements
    columns = [("y", ""), ("y_smooth", "_smoothed")][: 1 + ("y_smooth" in hist.columns)]
    values = [F.coalesce(F.max(F.when(F.col("key") == k, F.col(c))), F.lit(0.0)).alias(f"{k}{tail}") for c, tail in columns for k in keys]
    return hist.groupBy("bin_idx", "x").agg(*values).orderBy("bin_idx") if values else hist.select("bin_idx", "x")


def write_csv(hist: DataFrame, path: str, meta: Meta | None = None) -> None:
    """A folder with one text file: names, units, descriptions, then rows of five decimals."""
    meta, table = meta or Meta(), wide(hist)
    names = [c for c in table.columns if c not in ("bin_idx", "x")]
    head = [",".join([meta.x_label, *names]), ",".join([meta.x_unit, *[meta.y_unit] * len(names)]), ",".join([meta.description, *names])]
    body = table.select("bin_idx", F.concat_ws(",", *[F.format_string("%.5f", F.col(f"`{c}`").cast("double")) for c in ("x", *names)]).alias("value"))
    lines = hist.sparkSession.createDataFrame([(k - len(head), v) for k, v in enumerate(head)], "bin_idx long, value string").unionByName(body)
    lines.coalesce(1).sortWithinPartitions("bin_idx").select("value").write.mode("overwrite").text(path)


def write_parquet(hist: DataFrame, path: str, meta: Meta | None = None) -> None:
    """Columns as 32-bit floats with their units in the columns' metadata."""
    meta, table = meta or Meta(), wide(hist).drop("bin_idx")
    columns = []
    for c in table.columns:
        about = {"dim_label": meta.x_label, "bin_unit": meta.x_unit, "data_unit": meta.y_unit, "description": meta.description}
        columns.append(F.col(f"`{c}`").cast("float").alias(meta.x_label if c == "x" else re.sub(r"[ ,;{}()\n\t=]", "_", c), metadata=about))
    table.select(*columns).coalesce(1).write.mode("overwrite").parquet(path)


def write_hdf5(hists: dict[str, DataFrame], path: str, meta: Meta | None = None) -> None:
    """One local file with a group for each histogram; needs h5py. Histograms are small: a row for each bin and key."""
    import h5py

    meta = meta or Meta()
    with h5py.File(path, "w") as out:
        for name, hist in hists.items():
            group = out.create_group(re.sub(r"[() /]", "_", name))
            group.attrs.update({"x_label": meta.x_label, "x_unit": meta.x_unit, "y_unit": meta.y_unit, "description": meta.description})
            for c, v in wide(hist).toPandas().items():
                group.create_dataset(c, data=v.to_numpy())


def summary_text(values: dict[str, float | None]) -> str:
    """Lines of name and value; N/A where the value is missing or not positive."""
    return "\n".join(f"{k}: {v:.6g}" if v is not None and v > 0 else f"{k}: N/A" for k, v in values.items())


WRITERS = {"csv": write_csv, "parquet": write_parquet}


def write_hist(hist: DataFrame, base: str, formats: tuple[str, ...] = ("csv",), meta: Meta | None = None) -> dict[str, str]:
    """Writes base.csv, base.parquet ...; returns the error of each format that failed."""
    errors = {}
    for name in formats:
        try:
            if name == "h5":
                write_hdf5({"hist": hist}, f"{base}.h5", meta)
            else:
                WRITERS[name](hist, f"{base}.{name}", meta)
        except Exception as e:  # one format's failure leaves the others
            errors[name] = str(e)
    return errors
