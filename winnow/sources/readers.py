"""Sources. Schemas are explicit; a dynamic part is a map or a JSON string, never inferred."""

from __future__ import annotations

import os
from collections.abc import Iterator

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCORES = "struct<ar double, clip double, qr double, ppl double, composite double>"
VQA_SCHEMA = f"image_path string, image_id string, question string, answer string, generation_model string, cycle_scores {SCORES}"
CHAT_SCHEMA = f"messages array<struct<role string, content string>>, images array<string>, image_id string, question string, answer string, generation_model string, cycle_scores {SCORES}, cycle_score double, round_added int"
RUN_SCHEMA = "method string, prep_sec double, train_sec double, eval_sec double, results array<struct<benchmark string, score double, metric string, num_samples bigint, sub_scores map<string, double>, wall_time_sec double>>"
METRICS_SCHEMA = "round_id int, generated int, passed int, pass_rate double, mean_cycle_score double, data_diversity_score double, drift_from_prev double, timestamp string"
IMAGE_ENDINGS = ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp")


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = _path(spark, path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_pool(spark: SparkSession, path: str, schema: str = CHAT_SCHEMA) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character; broken lines are left out; nothing there gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not head:
        return spark.createDataFrame([], schema)
    array = head[0][0].lstrip("﻿ \t").startswith("[")
    return spark.read.schema(schema).json(path, multiLine=array, mode="DROPMALFORMED")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a broken line is an error, a blank one is skipped."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def json_data(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of a list, or of the list under "data", with their place (pos)."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<{item}>")
    wrapped = F.from_json("value", f"struct<data array<{item}>>")["data"]
    return whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped)).alias("pos", "x")).select("pos", "x.*")


def json_by_key(spark: SparkSession, path: str, value: str, key: str = "question_id") -> DataFrame:
    """A row for each entry of a JSON object: its key and its value's fields."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {value}>")).alias(key, "x")).select(key, "x.*")


def csv_texts(spark: SparkSession, path: str, schema: str = "text string", text: str = "text") -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="DROPMALFORMED").na.drop(subset=[text])


def choices_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions; choices maps the letters that have a text."""
    schema = "`index` string, question string, hint string, A string, B string, C string, D string, answer string, category string, `l2-category` string"
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    letters = F.create_map(*[x for c in "ABCD" for x in (F.lit(c), F.col(c))])
    return rows.withColumn("choices", F.map_filter(letters, lambda k, v: F.coalesce(v, F.lit("")) != "")).drop(*"ABCD")


def _file_system(path: str):
    """(pyarrow's file system, path on it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        at, path = _file_system(self.path)
        if at.get_file_info(path).type == fs.FileType.Directory:
            return [_File(f.path) for f in sorted(at.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if f.path.endswith(".arrow")]
        return [_File(path)]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        with _file_system(self.path)[0].open_input_file(partition.path) as f:
            magic = f.read(6)
            f.seek(0)
            if magic == b"ARROW1":
                reader = pa.ipc.open_file(f)
                yield from (reader.get_batch(i) for i in range(reader.num_record_batches))
            else:
                yield from pa.ipc.open_stream(f)


class ArrowSource(DataSource):
    """spark.read.format("arrow_ipc").schema(...).load(path): Arrow stream or file format, a task per file."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> str:
        raise ValueError("give a schema")

    def reader(self, schema) -> DataSourceReader:
        return _ArrowReader(self.options["path"])


def arrow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_ipc").schema(schema).load(path)


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text").withColumn("path", F.input_file_name())


def pages(spark: SparkSession, source: str) -> DataFrame:
    """(page_id, url, html) from literal markup, a JSON-lines file of {url, html}, or an HTML file or folder."""
    if source.lstrip().startswith("<"):
        return spark.createDataFrame([(0, "", source)], "page_id bigint, url string, html string")
    if source.endswith((".jsonl", ".json")):
        rows = spark.read.schema("url string, html string").json(source)
    else:
        rows = spark.read.text(source, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return rows.select(F.xxhash64("url", "html").alias("page_id"), "url", "html")


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the images below a folder, by path; none is an error."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = rows.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*IMAGE_ENDINGS)).select("path", "content").orderBy("path")
    if found.select("path").limit(1).count() == 0:
        raise ValueError(f"no images below {folder}")
    return found


def spec(path: str, smoke: bool = False) -> dict:
    """An experiment's YAML with defaults; a smoke run takes 20 samples of a benchmark at most."""
    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f) or {}
    got.setdefault("methods", [])
    got.setdefault("metrics", [])
    got["benchmarks"] = [{"name": b} if isinstance(b, str) else dict(b) for b in got.get("benchmarks") or []]
    for b in got["benchmarks"]:
        b.setdefault("max_samples", None)
        if smoke:
            b["max_samples"] = min(b["max_samples"] or 20, 20)
    return got


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every <folder>/<run>/run.json that can be read, with its path."""
    return spark.read.schema(RUN_SCHEMA).option("pathGlobFilter", "run.json").option("recursiveFileLookup", True).json(folder, multiLine=True, mode="DROPMALFORMED").withColumn("run", F.input_file_name())


def results_of(run_rows: DataFrame) -> DataFrame:
    return run_rows.select("run", "method", F.explode("results").alias("r")).select("run", "method", "r.*")


def sweep_results(spark: SparkSession, folder: str) -> DataFrame:
    """(run, benchmark, score) of every run.json directly below a folder of the sweep whose name holds a theta; analysis.sweep() orders them."""
    return results_of(runs(spark, folder)).filter(F.col("run").rlike(r"/[^/]*theta[_-]?(\d+p\d+|\d+\.\d+)[^/]*/run\.json$")).select("run", "benchmark", "score")


def round_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every round_<n>/metrics.json that can be read, by number of the round."""
    rows = spark.read.schema(METRICS_SCHEMA).option("pathGlobFilter", "metrics.json").option("recursiveFileLookup", True).json(folder, multiLine=True, mode="DROPMALFORMED")
    return rows.filter("round_id IS NOT NULL").orderBy("round_id")


def training_losses(spark: SparkSession, path: str) -> tuple[float, float]:
    """First and last loss of a trainer's JSON-lines log; 0 where there is none."""
    if not exists(spark, path):
        return 0.0, 0.0
    rows = spark.read.schema("loss double, step bigint").json(path).withColumn("__at", F.monotonically_increasing_id()).filter("loss IS NOT NULL")
    r = rows.agg(F.min_by("loss", "__at"), F.max_by("loss", "__at")).first()
    return float(r[0] or 0.0), float(r[1] or 0.0)


def ratings(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    df = spark.read.csv(path, header=True)
    return df, [c for c in df.columns if c.startswith("rater_")]
