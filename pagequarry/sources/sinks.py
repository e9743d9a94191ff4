"""Outputs: CSV and JSON of candidates, URL lists, logs, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.operators.reports import format_log

# Columns of the exports.
CSV_COLUMNS = ["image_url", "source_page_url", "width", "height", "file_size", "extension", "depth", "status"]
JSON_COLUMNS = ["id", "image_url", "source_page_url", "width", "height", "file_size", "mime_type", "extension", "depth", "status"]


def write_candidates_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Eight columns with a header; a value is quoted only if it holds a quote, a comma or a line break; null is empty."""

    def quoted(c: str):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)

    lines = df.select(F.concat_ws(",", *[quoted(c) for c in CSV_COLUMNS]).alias("value"))
    # Each part file begins with the header, as Spark's own CSV writer does it.
    lines.mapInArrow(_with_header(",".join(CSV_COLUMNS)), "value string").write.mode(mode).text(path)


def _with_header(header: str):
    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [header]})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": batch.column(0)})

    return run


def write_candidates_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; absent fields are explicit nulls."""
    df.select(*JSON_COLUMNS).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_url_list(df: DataFrame, path: str, url: str = "image_url", mode: str = "overwrite") -> None:
    df.where("selected").select(F.col(url).alias("value")).write.mode(mode).text(path)


def write_log(logs: DataFrame, path: str, mode: str = "append") -> None:
    format_log(logs).write.mode(mode).text(path)


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of jobs, by job_id; jobs that are saved again replace their old rows, others stay."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(f"{path}/{name}")
