"""Readers: line and array JSON, number tables, XML scans, job records, file listings, connectors, keyset pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholia.functions import structured as S


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema. Blank lines are skipped; what is no JSON becomes nulls in `_corrupt`, if the schema has it."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one array (or object) each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def ascii_table(spark: SparkSession, path: str, header_lines: int = 50) -> DataFrame:
    """Rows (file, x, y) of tables of numbers; lines that are no numbers, such as a header of any length, are left out."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    cells = F.split(F.trim(F.regexp_replace("value", r"[,\t]+", " ")), r"\s+")
    rows = lines.where(~F.col("value").rlike(r"^\s*[#!;$]") & (F.size(cells) >= 2)).select("file", cells[0].try_cast("double").alias("x"), cells[1].try_cast("double").alias("y"))
    return rows.where("x IS NOT NULL AND y IS NOT NULL")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, text), one per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def xrdml(spark: SparkSession, path: str) -> DataFrame:
    """Scans of XRDML files: file, and the axis between its ends beside the counts."""
    plain = F.regexp_replace("text", r'\sxmlns="[^"]*"', "")
    rows = whole_texts(spark, path).withColumn("text", plain)
    counts = F.split(F.trim(F.coalesce(*(F.nullif(F.xpath_string("text", F.lit(f"//{tag}")), F.lit("")) for tag in ("intensities", "counts")))), r"\s+")
    start, end = (F.xpath_double("text", F.lit(f"//positions[@axis='2Theta']/{p}")) for p in ("startPosition", "endPosition"))
    intensity = F.transform(counts, lambda x: x.try_cast("double"))
    return rows.select("file", S.linspace(start, end, F.size(intensity)).alias("axis"), intensity.alias("intensity"))


def emsa(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of EMSA files: file, x, y; the axis follows from offset and step where only y is given."""
    rows = whole_texts(spark, path)
    tag = lambda name: F.regexp_extract("text", rf"(?m)^#{name}[^:]*:\s*([-\d.eE+]+)", 1).try_cast("double")
    numbers = F.regexp_extract_all(F.regexp_replace("text", r"(?m)^#.*$", ""), F.lit(r"(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)"), F.lit(1))
    xy = F.upper("text").rlike(r"#DATATYPE\s*:\s*XY")
    y = rows.select("file", xy.alias("xy"), tag("OFFSET").alias("offset"), tag("XPERCHAN").alias("step"), F.posexplode(numbers).alias("i", "v"))
    single = y.where("NOT xy").select("file", (F.col("offset") + F.col("i") * F.col("step")).alias("x"), F.col("v").cast("double").alias("y"))
    pairs = y.where("xy").groupBy("file", F.floor(F.col("i") / 2).alias("p")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("v"))).cast("double").alias("x"), F.max(F.when(F.col("i") % 2 == 1, F.col("v"))).cast("double").alias("y"))
    return single.unionByName(pairs.select("file", "x", "y"))


# Extension -> bytes ahead of the numbers, the range that good numbers are in (ends exclusive, or not), and the ends of the axis.
BINARY = {
    ".raw": (712, 0.0, 1e9, 10.0, 80.0),
    ".wdf": (512, 0.0, 1e8, 100.0, 3500.0),
    ".sp": (4096, -10.0, 10.0, 800.0, 200.0),
}


def binary_spectrum(extension: str, content: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Axis and intensity of a file of little-endian 32-bit numbers; None if it holds none. SPC files tell their points, axis and exponent."""
    if extension == ".spc":
        if len(content) < 512:
            return None
        points, (first, last) = int.from_bytes(content[4:8], "little"), np.frombuffer(content[8:24], "<f8")
        y = np.frombuffer(content[512 : 512 + 4 * points], "<f4", len(content[512 : 512 + 4 * points]) // 4).astype(float)
        y = y if content[3] == 128 else y * 2.0 ** (content[3] - 128)
        return (np.linspace(first, last, points), y) if len(y) == points else None
    skip, low, high, first, last = BINARY[extension]
    body = content[skip:]
    y = np.frombuffer(body, "<f4", len(body) // 4).astype(float)
    y = y[np.isfinite(y) & ((y >= low) if low == 0 else (y > low)) & (y < high)]
    return (np.linspace(first, last, len(y)), y) if len(y) else None


def binary_spectra(spark: SparkSession, path: str) -> DataFrame:
    """file, axis, intensity of the binary spectra below a folder, one row per file that isn't empty; files without numbers have nulls."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{raw,RAW,wdf,WDF,sp,SP,spc,SPC}").load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = [binary_spectrum("." + n.rpartition(".")[2].lower(), c) for n, c in zip(names, b.column(1).to_pylist())]
            axis, intensity = (pa.array([f and f[i] for f in found], pa.list_(pa.float64())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), axis, intensity], ["file", "axis", "intensity"])

    return files.select("path", "content").mapInArrow(decode, "file string, axis array<double>, intensity array<double>")


JOB = "job_id STRING, label STRING, code STRING, status STRING, created_at TIMESTAMP, started_at TIMESTAMP, ended_at TIMESTAMP, exit_code INT, error STRING, mpi_np INT, extra_args ARRAY<STRING>, workdir STRING"


def jobs(spark: SparkSession, root: str, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest job records, of one status if given."""
    rows = spark.read.schema(JOB).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "status.json").json(root)
    return (rows if status is None else rows.where(F.col("status") == status)).orderBy(F.desc_nulls_last("created_at"), "job_id").limit(limit)


def listing(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files by name: path, name, size, time. Their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "modificationTime")


def new_files(spark: SparkSession, root: str, pattern: str, known: DataFrame, column: str) -> DataFrame:
    """The listed files whose names are not known yet."""
    return listing(spark, root, pattern).join(known.select(F.col(column).alias("name")).distinct(), "name", "left_anti")


def pseudopotentials(spark: SparkSession, root: str) -> DataFrame:
    """UPF files: element, functional and type as their names tell."""
    low = F.lower("name")
    element = F.initcap(F.regexp_extract("name", r"^([A-Za-z]{1,2})[._-]", 1))
    functional = F.when(low.contains("pbesol"), "pbesol").when(low.contains("pbe"), "pbe").when(low.rlike(r"pz|lda"), "lda").otherwise("unknown")
    kind = F.when(low.contains("kjpaw") | low.contains("paw"), "paw").when(low.contains("rrkjus") | low.contains("us"), "us").when(low.rlike("oncv|nc"), "nc").otherwise("unknown")
    return listing(spark, root, "*.[uU][pP][fF]").select("path", "name", element.alias("element"), functional.alias("functional"), kind.alias("type"))


def ranked_pseudopotentials(files: DataFrame, species: DataFrame, functional: str = "pbe", kind: str = "us") -> DataFrame:
    """For each species its files, the best first: of the functional asked for, then of the type; species without files have none."""
    best = Window.partitionBy("_e").orderBy(F.col("functional") != functional, F.col("type") != kind, "name")
    first = files.select(F.lower("element").alias("_e"), "functional", "type", "name").withColumn("_r", F.row_number().over(best)).where("_r <= 5")
    found = first.groupBy("_e").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("names"))
    rows = species.join(found, F.lower("symbol") == F.col("_e"), "left")
    return rows.select("symbol", F.get("names", F.lit(0)).alias("recommended"), F.slice("names", 2, 4).alias("alternatives"), F.col("names").isNull().alias("missing"))


def connectors(*frames: DataFrame) -> DataFrame:
    """Search results of several sources as one frame; columns that a source lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def arxiv(feed: DataFrame, xml: str) -> DataFrame:
    """Entries of Atom feeds held in a column: title, summary, id."""
    plain = F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', "")
    of = lambda tag: F.xpath(plain, F.lit(f"//entry/{tag}/text()")).alias(tag)
    return feed.select(F.inline(F.arrays_zip(of("title"), of("summary"), of("id"))))


class _Page(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class KeysetReader(DataSourceReader):
    """Reads ranges of a numeric key in parallel, each page by page with a cursor."""

    def __init__(self, schema, options: dict, fetch: Callable[[int, int, int], list[tuple]]) -> None:
        self.fetch, self.size = fetch, int(options.get("pageSize", 100))
        self.low, self.high, self.parts = int(options.get("low", 0)), int(options["high"]), int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-(self.high - self.low) // self.parts))
        return [_Page(a, min(a + step, self.high)) for a in range(self.low, self.high, step)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        cursor = partition.start - 1
        while True:
            rows = self.fetch(cursor, partition.stop, self.size)
            yield from rows
            if len(rows) < self.size:
                return
            cursor = rows[-1][0]


def paged_source(name: str, schema: str, fetch: Callable[[int, int, int], list[tuple]]) -> type[DataSource]:
    """A data source over a paged service: fetch(cursor, stop, size) gives up to `size` rows with cursor < key < stop, in order of the key,
    which comes first. Register it with spark.dataSource.register; options: high, low, partitions, pageSize (100 at most)."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return KeysetReader(schema, {"pageSize": min(100, int(self.options.get("pageSize", 100))), **{k: v for k, v in self.options.items() if k != "pageSize"}} | {k: v for k, v in (("low", self.options.get("low", 0)), ("high", self.options.get("high", 0)), ("partitions", self.options.get("partitions", 4)))}, fetch)

    return Paged
