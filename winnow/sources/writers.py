"""Sinks. Pools are written by the executors; reports and registries are small and written by the driver."""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE_ROWS = 10_000


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(value: object, path: str) -> None:
    """A small value as indented JSON."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, default=lambda x: x.asDict(True) if hasattr(x, "asDict") else str(x))


def write_json_array(df: DataFrame, path: str) -> None:
    """All rows as one JSON array. The executors write the records, each led by a comma, beside the path; the driver only has the
    file system append these parts, whose rows it never sees, without the first comma."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}.parts-{uuid4().hex}")
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(F.concat(F.lit(","), record)).write.text(parts.toString())
    out = fs.create(target, True)
    try:
        out.write(bytearray(b"[\n"))
        first = True
        for status in sorted(fs.listStatus(parts), key=lambda s: s.getPath().getName()):
            if status.getLen() and status.getPath().getName().startswith("part-"):
                piece = fs.open(status.getPath())
                if first:
                    piece.seek(1)
                    first = False
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
                piece.close()
        out.write(bytearray(b"]\n"))
    finally:
        out.close()
        fs.delete(parts, True)


def _small(df: DataFrame) -> list:
    """The rows of a table for people to read; a table that no one would is an error, not a driver out of memory."""
    rows = df.limit(TABLE_ROWS + 1).collect()
    if len(rows) > TABLE_ROWS:
        raise ValueError(f"more than {TABLE_ROWS} rows for a table in a report")
    return rows


def convert_arrow(df: DataFrame, path: str, lines: bool = False) -> None:
    (write_json_lines if lines else write_json_array)(df, path)


def markdown(df: DataFrame) -> str:
    """A small table as a pipe table."""
    rows = [df.columns, ["---"] * len(df.columns), *[["--" if v is None else str(v) for v in r] for r in _small(df)]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def comma_grid(df: DataFrame) -> str:
    return "\n".join(",".join("--" if v is None else str(v) for v in r) for r in [df.columns, *_small(df)]) + "\n"


def latex(df: DataFrame) -> str:
    line = lambda r: " & ".join("--" if v is None else str(v).replace("_", r"\_") for v in r) + r" \\"
    body = [line(r) for r in _small(df)]
    return "\n".join([rf"\begin{{tabular}}{{l{'c' * (len(df.columns) - 1)}}}", r"\toprule", line(df.columns), r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def register_dataset(df: DataFrame, name: str, folder: str, registry: str | None = None) -> str:
    """Writes <folder>/<name>.json and its entry in the registry; other entries stay, a broken registry starts anew."""
    path = os.path.join(folder, f"{name}.json")
    write_json_array(df, path)
    registry = registry or os.path.join(folder, "dataset_info.json")
    try:
        with open(registry, encoding="utf-8") as f:
            known = json.load(f)
        known = known if isinstance(known, dict) else {}
    except (OSError, ValueError):
        known = {}
    same = os.path.abspath(os.path.dirname(registry)) == os.path.abspath(folder)
    known[name] = {"file_name": f"{name}.json" if same else os.path.abspath(path), "formatting": "sharegpt", "columns": {"messages": "messages", "images": "images"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}}
    write_json(known, registry)
    return path


def report(df: DataFrame, metrics: dict[str, Callable[[DataFrame], object]], wanted: list[str], folder: str | None = None) -> dict[str, object]:
    """Every wanted metric by name; one that fails or is not known says so and leaves the others alone."""
    out: dict[str, object] = {}
    for name in wanted:
        if name not in metrics:
            out[name] = {"status": "not_registered"}
            continue
        try:
            got = metrics[name](df)
            out[name] = [r.asDict(True) for r in _small(got)] if isinstance(got, DataFrame) else got
        except Exception as e:  # noqa: BLE001
            out[name] = {"error": f"{type(e).__name__}: {e}"[:500]}
    if folder:
        write_json(out, os.path.join(folder, "report.json"))
        with open(os.path.join(folder, "report.md"), "w", encoding="utf-8") as f:
            f.writelines(f"## {k}\n\n```json\n{json.dumps(v, ensure_ascii=False, indent=2, default=str)}\n```\n\n" for k, v in out.items())
    return out


def rating_sheet(a: DataFrame, b: DataFrame, pos: str = "pos") -> DataFrame:
    """Pairs of two methods' answers by place, with an empty column for each rater."""
    x = a.select(F.col(pos).alias("pair_id"), "question", F.col("answer").alias("answer_a"))
    return x.join(b.select(F.col(pos).alias("pair_id"), F.col("answer").alias("answer_b")), "pair_id").withColumn("rater_1", F.lit("")).withColumn("rater_2", F.lit("")).orderBy("pair_id")


def file_logger(name: str, folder: str) -> logging.Logger:
    """A logger to the console and to a file named by the time of its start."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        for h in (logging.StreamHandler(), logging.FileHandler(os.path.join(folder, f"{name}_{datetime.now(UTC):%Y%m%d_%H%M%S}.log"), encoding="utf-8")):
            h.setFormatter(form)
            log.addHandler(h)
    return log
