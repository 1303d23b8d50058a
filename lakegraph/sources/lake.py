"""Discovery of a lake: SQL and DAX files, dataset folders, table columns."""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lakegraph import model
from lakegraph.functions.naming import infer_layer, path_for_type, stem_of
from lakegraph.functions.sqltext import is_view, sql_sources, writes_table
from lakegraph.functions.text import slugify
from lakegraph.session import scratch_path
from lakegraph.sources.bundle import relative_path, scan_files


def classify_statements(files: DataFrame, *, compat: bool = False) -> DataFrame:
    """``path, text`` -> one row per SQL file with layer, kind and tables read."""
    path, text = F.col("path"), F.col("text")
    return files.select(
        path,
        stem_of(path).alias("stem"),
        text.alias("sql"),
        infer_layer(path).alias("layer"),
        is_view(text, path, compat=compat).alias("is_view"),
        writes_table(text).alias("writes_table"),
        sql_sources(text, compat=compat).alias("refs"),
    )


def read_statements(spark: SparkSession, root: str, *, compat: bool = False) -> DataFrame:
    return classify_statements(scan_files(spark, root, "*.sql"), compat=compat)


def read_measures(spark: SparkSession, root: str) -> DataFrame:
    """``path, stem, expression`` of the DAX files of a lake."""
    files = scan_files(spark, root, "*.dax")
    return files.select("path", stem_of(F.col("path")).alias("stem"), F.col("text").alias("expression"))


def parquet_datasets(spark: SparkSession, root: str) -> DataFrame:
    """``folder, name, layer`` of the folders that hold parquet files.

    Only file listings are read: the content column is pruned from the scan.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(root).select("path")
    )
    base = root.rstrip("/").rsplit("/", 1)[-1]
    folder = F.regexp_replace(relative_path(F.col("path"), root), r"/[^/]*$", "")
    folders = files.select(folder.alias("folder")).distinct()
    name = F.when(F.col("folder") == "", F.lit(base)).otherwise(F.substring_index("folder", "/", -1))
    layer = infer_layer(F.col("folder"))
    return folders.select(
        "folder", name.alias("name"),
        F.when(layer.isin("raw", *model.MEDALLION), layer).otherwise(F.lit("bronze")).alias("layer"),
    ).filter(~F.col("name").startswith("_"))


def harvest_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, position, column_name, data_type, row_count, null_count`` of real tables.

    Types come from the table's schema.  Whether a column is nullable is
    measured, one aggregate pass per table, because file formats mark every
    column nullable.
    """
    return reduce(DataFrame.unionByName, [_column_rows(name, df, range(len(df.columns))) for name, df in tables.items()])


def _nested(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def _column_rows(name: str, df: DataFrame, places) -> DataFrame:
    """A row per column at ``places``, out of one aggregate."""
    fields = [(i, df.schema.fields[i]) for i in places]
    # Footers know the nulls of leaves, so nested columns are counted in a form that is never pushed down to them.
    filled = lambda f: F.count_if(F.col(f"`{f.name}`").isNotNull()) if _nested(f) else F.count(F.col(f"`{f.name}`"))
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), *[filled(f).alias(f"c{i}") for i, f in fields])
    columns = F.array(*[
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), (F.col("row_count") - F.col(f"c{i}")).alias("null_count"))
        for i, f in fields
    ])
    return counts.select(F.lit(name).alias("table_name"), "row_count", F.inline(columns))


def footer_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one whose Parquet counts come from file footers."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    used = [s for s in other.conf.get("spark.sql.sources.useV1SourceList").split(",") if s != "parquet"]
    other.conf.set("spark.sql.sources.useV1SourceList", ",".join(used))
    other.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return other


def footer_counts(name: str, df: DataFrame) -> list[DataFrame]:
    """Column rows of a Parquet table of a ``footer_session``: those that footers answer, then those that need a scan.

    Footers hold the counts of leaves, so nested columns are the ones that are read.
    """
    nested = {i for i, f in enumerate(df.schema.fields) if _nested(f)}
    kinds = [i for i in range(len(df.columns)) if i not in nested], sorted(nested)
    return [_column_rows(name, df, places) for places in kinds if places]


def harvest_footers(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """As ``harvest_columns`` for Parquet tables at ``paths``, without reading column data but of nested columns.

    Schemas are those of the files; counts are sums over footers, so the work grows with
    the number of files. One job counts all tables and writes the result, which the given session
    reads. Files without statistics make it fail; the tables are then counted by scans.
    """
    other = footer_session(spark)
    rows = reduce(DataFrame.unionByName, [part for name, path in paths.items() for part in footer_counts(name, other.read.parquet(path))])
    target = scratch_path(spark, "footers")
    try:
        rows.write.parquet(target)
    except (PySparkException, Py4JJavaError):
        return harvest_columns({name: spark.read.parquet(path) for name, path in paths.items()})
    # A table without any row group has no sums: they come as null or, as counts are never null, as a number below 0.
    counted = spark.read.schema(rows.schema).parquet(target)
    return counted.withColumns({c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("row_count", "null_count")})


def column_concepts(harvested: DataFrame, layer: str, schema: str, source: str) -> tuple[DataFrame, DataFrame]:
    """``(concepts, links)`` of the tables, columns and schema behind ``harvested``."""
    table_slug = slugify(F.concat_ws("-", F.lit(layer), "table_name"))
    rows = harvested.withColumn("table_path", path_for_type(F.lit("Table"), table_slug)).withColumn(
        "column_path",
        path_for_type(F.lit("Column"), slugify(F.concat_ws("-", table_slug, F.col("column_name")))),
    )
    schema_path = path_for_type(F.lit("Schema"), slugify(F.lit(schema)))
    tables = rows.select("table_path", "table_name").distinct()
    concepts = (
        tables.select(F.col("table_path").alias("path"), F.lit("Table").alias("type"),
                      F.col("table_name").alias("title"), F.lit(layer).alias("layer"))
        .unionByName(rows.select(F.col("column_path").alias("path"), F.lit("Column").alias("type"),
                                 F.concat_ws(".", "table_name", "column_name").alias("title"),
                                 F.lit(layer).alias("layer")))
        .unionByName(tables.select(schema_path.alias("path"), F.lit("Schema").alias("type"),
                                   F.lit(schema).alias("title"), F.lit(None).cast("string").alias("layer"))
                     .distinct())
    )

    def link(df: DataFrame, src: Column | str, rel: str, target: Column | str) -> DataFrame:
        as_col = lambda c: F.col(c) if isinstance(c, str) else c
        return df.select(as_col(src).alias("src"), F.lit(rel).alias("rel"), as_col(target).alias("target"))

    links = (
        link(tables, "table_path", "layered_as", path_for_type(F.lit("Layer"), F.lit(layer)))
        .unionByName(link(tables, "table_path", "defines", schema_path))
        .unionByName(link(tables, "table_path", "sourced_from", path_for_type(F.lit("SourceSystem"), slugify(F.lit(source)))))
        .unionByName(link(tables, schema_path, "contains", "table_path"))
        .unionByName(link(rows, "table_path", "contains", "column_path"))
        .unionByName(link(rows, "column_path", "defines", "table_path"))
    )
    return concepts, links


def discovery_receipt(statements: DataFrame) -> DataFrame:
    """Counts per artifact kind and layer in one scan, as ``kind, layer, n``."""
    kind = (
        F.when(F.col("is_view"), F.lit("view"))
        .when(F.col("writes_table"), F.lit("table_write"))
        .otherwise(F.lit("query"))
    )
    return statements.groupBy(kind.alias("kind"), "layer").agg(F.count(F.lit(1)).alias("n"))
