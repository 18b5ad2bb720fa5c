"""Loaders of raw tables: a registry of named readers, and the dialects they need.

Every reader has an explicit schema; text that is no number where one is due becomes null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import to_number
from ..session import stable

STANDARD_CHARSETS = {"UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "ISO-8859-1", "US-ASCII"}
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(name: str):
    """Register a reader (spark, path) -> rows with a ``target`` column."""
    def register(f):
        LOADERS[name] = f
        return f

    return register


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown data set {name!r}: one of {sorted(LOADERS)}")
    return LOADERS[name](spark, path)


def read_csv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None, sep: str = ",", header: bool = False, missing: str | None = None, encodings: Sequence[str] = ("UTF-8",)) -> DataFrame:
    """All columns as text, trimmed; ``missing`` is null. The first encoding that decodes everything is taken."""
    options = {"sep": sep, "header": str(header).lower(), "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    for e in encodings:
        if e.upper() not in STANDARD_CHARSETS:
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark refuses other encodings without it
        rows = spark.read.options(**options, encoding=e)
        if names is not None and not header:
            rows = rows.schema(", ".join(f"`{n}` string" for n in names))
        found = rows.csv(path)
        bad = [F.contains(F.col(f"`{c}`"), F.lit("�")) for c in found.columns]
        if e == encodings[-1] or found.filter(_any(bad)).isEmpty():
            break
    if header and found.columns and found.columns[0].startswith("﻿"):
        found = found.withColumnRenamed(found.columns[0], found.columns[0].lstrip("﻿"))
    if missing is not None:
        found = found.select(*[F.when(F.col(f"`{c}`") != missing, F.col(f"`{c}`")).alias(c) for c in found.columns])
    return found


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def read_blank_separated(spark: SparkSession, path: str | list[str], names: Sequence[str]) -> DataFrame:
    """Columns divided by runs of blanks, which the CSV reader cannot take as a separator."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])


def numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[to_number(F.col(f"`{c}`")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns])


def unique_names(names: Sequence[str]) -> list[str]:
    """``a, a, b`` becomes ``a, a.1, b``."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}.{k}" if k else n)
    return out


def first_path(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first path that exists in whatever store it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def numbered_lines(df: DataFrame, name: str = "__line") -> DataFrame:
    """Rows that come straight from files, with their 0-based place: files by path, then by their order in the file.

    A file is read in splits, whose starts order them. Within a split rows are read one after another, so ids that rise within a partition number them; what is
    added up is one count a split.
    """
    placed = stable(df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id")))
    splits = placed.groupBy("__file", "__start").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    starts = splits.select("__file", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), ["__file", "__start"]).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__before") + F.col("__id") - F.col("__first")).alias(name))


def side_by_side(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """Row i of each beside row i of the others, by numbered lines: frames of different length keep nulls.

    Only for files whose rows belong together by position and that carry no key.
    """
    out = None
    for f in frames:
        numbered = numbered_lines(f)
        out = numbered if out is None else out.join(numbered, "__line", "full")
    return out.drop("__line")


def class_codes(column: str, codes: dict[str, int]) -> Column:
    """Code of each name; null for names that have none."""
    return F.create_map(*[F.lit(v) for kv in codes.items() for v in kv])[F.col(column)]


@loader("qsar")
def _qsar(spark: SparkSession, path: str) -> DataFrame:
    names = [f"feature_{i}" for i in range(41)]
    rows = numbers(read_csv(spark, path, [*names, "label"], sep=";"), names)
    return rows.withColumn("target", class_codes("label", {"RB": 1, "NRB": 0})).drop("label")


@loader("statlog")
def _statlog(spark: SparkSession, path: str) -> DataFrame:
    return read_blank_separated(spark, path, [*(f"col{i}" for i in range(20)), "target"])


# The columns of the published files, in their order.
ADULT = ["age", "workclass", "fnlwgt", "education", "education_num", "marital_status", "occupation", "relationship", "race", "sex", "capital_gain", "capital_loss", "hours_per_week", "native_country", "target"]
GLASS = ["Id", "RI", "Na", "Mg", "Al", "Si", "K", "Ca", "Ba", "Fe", "target"]
SEEDS = ["area", "perimeter", "compactness", "length_of_kernel", "width_of_kernel", "asymmetry_coefficient", "length_of_kernel_groove", "target"]


@loader("adult")
def _adult(spark: SparkSession, path: str) -> DataFrame:
    return numbers(read_csv(spark, path, ADULT, missing="?"), ["age", "fnlwgt", "education_num", "capital_gain", "capital_loss", "hours_per_week"])


def _renamed(label: str, sep: str = ","):
    def read(spark: SparkSession, path: str) -> DataFrame:
        return read_csv(spark, path, sep=sep, header=True).withColumnRenamed(label, "target")

    return read


LOADERS["diabetes130"] = _renamed("readmitted")
LOADERS["bank_marketing"] = _renamed("y", ";")
LOADERS["credit_default"] = _renamed("default payment next month")


@loader("wine_quality")
def _wine(spark: SparkSession, path: str) -> DataFrame:
    """``path``: a folder with the red and the white file. Quality up to 5 is low, from 7 high."""
    from ..operators.prep import three_way_bins
    from ..plans.results import union_with_origin

    parts = {kind: read_csv(spark, f"{path}/winequality-{kind}.csv", sep=";", header=True) for kind in ("red", "white")}
    rows = union_with_origin(parts, "wine_type")
    rows = numbers(rows, [c for c in rows.columns if c != "wine_type"])
    return three_way_bins(rows, "quality", 5, 7).drop("quality")


@loader("glass")
def _glass(spark: SparkSession, path: str) -> DataFrame:
    return numbers(read_csv(spark, path, GLASS), GLASS[:-1]).drop("Id")


@loader("seeds")
def _seeds(spark: SparkSession, path: str) -> DataFrame:
    return numbers(read_blank_separated(spark, path, SEEDS))


@loader("letter_recognition")
def _letters(spark: SparkSession, path: str) -> DataFrame:
    names = [f"f{i}" for i in range(16)]
    return numbers(read_csv(spark, path, ["target", *names]), names)


@loader("har")
def _har(spark: SparkSession, path: str) -> DataFrame:
    """``path``: a folder with features.txt and, per side, subject, y and X files that belong together line by line."""
    names = unique_names([r["value"].split(maxsplit=1)[1] for r in spark.read.text(f"{path}/features.txt").collect() if r["value"].strip()])
    out = None
    for side in ("train", "test"):
        read = lambda kind, columns, side=side: read_blank_separated(spark, f"{path}/{side}/{kind}_{side}.txt", columns)
        both = side_by_side(spark, read("subject", ["subject"]), read("y", ["target"]), numbers(read("X", names)))
        out = both if out is None else out.unionByName(both)
    return out


def _plane(spark: SparkSession, path: str) -> DataFrame:
    """Features standardised, the label called y in some files."""
    from ..operators.prep import standardise

    rows = read_csv(spark, path, header=True)
    rows = rows.withColumnRenamed("y", "target") if "target" not in rows.columns else rows
    features = [c for c in rows.columns if c != "target"]
    return standardise(numbers(rows, features), features)


for _name in ("concentric_circles", "concentric_three_circles", "two_gaussian_distributions", "3D_gaussian_clusters", "3D_8_gaussian_clusters"):
    LOADERS[_name] = _plane


@loader("mice")
def _mice(spark: SparkSession, path: str) -> DataFrame:
    """The table as CSV or Parquet; missing numbers are imputed from near rows."""
    from ..operators.prep import knn_impute

    rows = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path, header=True)
    features = [c for c in rows.columns if c not in ("MouseID", "class", "Genotype", "Treatment", "Behavior")]
    rows = numbers(rows.select("MouseID", *features, F.col("class").alias("target")), features)
    return knn_impute(rows, "MouseID", features).drop("MouseID")


def _exported(label: str = "target"):
    """A table of a data library that was exported as CSV with a header or as Parquet: ``path``, or the first of several that exists."""
    def read(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
        found = path if isinstance(path, str) else first_path(spark, path)
        rows = spark.read.parquet(found) if found.rstrip("/").endswith(".parquet") else read_csv(spark, found, header=True)
        features = [c for c in rows.columns if c not in (label, "Drug", "Drug_ID")]
        return numbers(rows, features).withColumnRenamed(label, "target")

    return read


# Names of data sets and of their label columns.
for _name in ("breast_cancer", "diabetes", "digits", "digits_v2"):
    LOADERS[_name] = _exported()
LOADERS["housing"] = _exported("MedHouseVal")
for _name in ("mnist", "fashion_mnist"):
    LOADERS[_name] = _exported("class")
for _name in ("ames", "tox21_sr_are", "hiv", "cyp3a4", "cyp2d6", "cyp1a2"):
    LOADERS[_name] = _exported("Y")
