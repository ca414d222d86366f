"""Readers for pixel tables, patch and score stores, and area metadata files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import aoi_index, sanitize_array
from ..schemas import AOI_META, AOI_POLYGON


# ---- discovery -------------------------------------------------------------


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Paths and sizes below ``root``; file contents are never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
        .select("path", "length")
    )


def area_files(
    spark: SparkSession, root: str, areas: list[str] | None = None, glob: str = "*"
) -> DataFrame:
    """One row per file below the area folders of ``root``, ``AOI_<n>`` or ``aoi=AOI_<n>``.

    Columns ``aoi, aoi_index, band, name, path, length, modified``; ``band`` is that of a
    ``band=`` folder, else the file's lower-cased stem.  A chosen list of areas is part of
    the listed paths, so other folders are never opened; a list of which no folder exists
    raises.  Contents are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    where = root.rstrip("/")
    if areas is not None:
        names = ",".join(f"{a},aoi={a}" for a in areas)
        where = f"{where}/{{{names}}}"
    folder = F.regexp_extract("path", r"/(?:aoi=)?(AOI_\d+)/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    band = F.regexp_extract("path", r"/band=([^/]+)/", 1)
    stem = F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))
    return (
        reader.option("pathGlobFilter", glob)
        .load(where)
        .where(folder != "")
        .select(
            folder.alias("aoi"),
            aoi_index(folder).alias("aoi_index"),
            F.when(band != "", band).otherwise(stem).alias("band"),
            name.alias("name"),
            "path",
            "length",
            F.col("modificationTime").alias("modified"),
        )
    )


def areas_in_paths(files: DataFrame, must_contain: str = "ndvi") -> DataFrame:
    """Areas named in the paths that own a file of the required band.

    The band stands in the path below the area's folder, in a folder's or the file's name.
    """
    below = F.lower(F.regexp_extract("path", r"AOI_\d+/(.*)$", 1))
    return (
        files.where(F.contains(below, F.lit(must_contain)))
        .select(F.regexp_extract("path", r"(AOI_\d+)/", 1).alias("aoi"))
        .where(F.col("aoi") != "")
        .distinct()
        .withColumn("aoi_index", aoi_index(F.col("aoi")))
    )


def areas_from_patch_files(files: DataFrame, suffix: str = "_all_patches") -> DataFrame:
    """Area names from patch file names with their suffix stripped.

    A dataset that Spark wrote is a folder of that name, or ``file=`` and that name.
    """
    named = r"(?:^|[/=])(AOI_[^/]*)" + suffix + r"(?:\.[^/.]*)?(?:/part-[^/]*)?$"
    return (
        files.select(F.regexp_extract("path", named, 1).alias("aoi")).where(F.col("aoi") != "").distinct()
    )


def pick_input_file(files: DataFrame, band: str, required: bool = False) -> DataFrame:
    """First file, by ``ordinal``, whose lower-cased name contains the band.

    With ``required`` a missing band raises when the result is evaluated.
    """
    match = F.contains(F.lower("name"), F.lit(band.lower()))
    out = files.agg(
        F.min_by(F.when(match, F.col("name")), F.when(match, F.col("ordinal"))).alias("name")
    )
    if required:
        absent = F.raise_error(F.lit(f"no {band} file among the inputs"))
        out = out.select(
            F.when(F.col("name").isNull(), absent.cast("string")).otherwise(F.col("name")).alias("name")
        )
    return out


# ---- stores ----------------------------------------------------------------


def read_by_area(
    spark: SparkSession, path: str, areas: list[str] | None = None, schema=None
) -> DataFrame:
    """A store partitioned by area; a chosen list prunes partitions."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    rows = reader.parquet(path)
    return rows if areas is None else rows.where(F.col("aoi").isin(list(areas)))


def read_patches(spark: SparkSession, path: str, channels, areas=None) -> DataFrame:
    """Patch store with every channel sanitised for model input."""
    rows = read_by_area(spark, path, areas)
    return rows.withColumns({c: sanitize_array(F.col(c)) for c in channels})


def with_default_patch_ids(patches: DataFrame, metadata: DataFrame) -> DataFrame:
    """Join metadata by ordinal; a patch without any is called ``p<ordinal>``."""
    fallback = F.concat(F.lit("p"), F.col("ordinal").cast("string"))
    return patches.join(metadata, "ordinal", "left").withColumn(
        "patch_id", F.coalesce("patch_id", fallback)
    )


# ---- area metadata ---------------------------------------------------------


def read_aoi_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One ``metadata.json`` per area."""
    return spark.read.schema(AOI_META).option("multiLine", "true").json(path)


def metadata_or_zero(areas: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every area with its bounds; zeros where the metadata is absent."""
    bounds = ("min_lat", "max_lat", "min_lon", "max_lon")
    found = metadata.withColumnRenamed("aoi_id", "aoi").select("aoi", *bounds)
    return areas.join(found, "aoi", "left").select(
        "aoi", *[F.coalesce(b, F.lit(0.0)).alias(b) for b in bounds]
    )


# The keys of a coordinate file.
COORDINATE_KEYS = ("AOI_ID", "LiDAR_File", "min_lon", "min_lat", "max_lon", "max_lat")


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``key: value`` files with the file they came from."""
    return (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    )


def parse_coordinates(lines: DataFrame) -> DataFrame:
    """One row per file; the point cloud name points at its raster twin.

    Only the text between the first and second colon is the value.
    """
    part = F.split("line", ":")
    pairs = lines.select(
        "file", F.trim(part[0]).alias("key"), F.trim(F.try_element_at(part, F.lit(2))).alias("v")
    )
    wide = pairs.groupBy("file").agg(
        *[F.min(F.when(F.col("key") == k, F.col("v"))).alias(k) for k in COORDINATE_KEYS]
    )
    return wide.select(
        F.col("AOI_ID").alias("aoi"),
        F.replace("LiDAR_File", F.lit(".laz"), F.lit(".tif")).alias("lidar_file"),
        *[F.col(k).cast("double").alias(k) for k in COORDINATE_KEYS[2:]],
    )


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Bounding box of each area polygon."""
    docs = spark.read.schema(AOI_POLYGON).option("multiLine", "true").json(path)
    ring = F.col("f.geometry.coordinates")[0]
    lon, lat = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return docs.select(F.explode("features").alias("f")).select(
        F.col("f.properties.aoi_id").alias("aoi"),
        F.array_min(lon).alias("min_lon"),
        F.array_min(lat).alias("min_lat"),
        F.array_max(lon).alias("max_lon"),
        F.array_max(lat).alias("max_lat"),
        F.size(ring).alias("ring_points"),
    )


# ---- reference sites and published results ---------------------------------


def read_site_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV ``aoi_name, patch_id, emb_000..`` to one vector column.

    Columns are ordered by their number, whatever their order in the file.
    """
    rows = spark.read.option("header", "true").csv(path)
    cols = sorted((c for c in rows.columns if c.startswith("emb_")), key=lambda c: int(c[4:]))
    return rows.select(
        F.col("aoi_name").alias("aoi"),
        "patch_id",
        F.array(*[F.col(c).cast("double") for c in cols]).alias("embedding"),
    )


def dimension_mismatches(sites: DataFrame, expected: DataFrame) -> DataFrame:
    """Sites whose vector has another length than the one row ``expected`` (``dim``) says.

    A warning, not an error; a site without a vector is one of them.
    """
    length = F.coalesce(F.size("embedding"), F.lit(-1))
    dim = expected.select(F.max("dim")).scalar()
    return sites.where(length != dim).select("aoi", "patch_id")


def read_run_record(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Summary, successful areas, and failed areas with their reasons, of a finished run."""
    counts = "successful long, failed long, success_rate double"
    areas = spark.read.schema("aoi string, reason string, ok boolean").json(f"{path}/areas")
    return {
        "summary": spark.read.schema(counts).json(f"{path}/summary"),
        "successful": areas.where("ok").select("aoi"),
        "failed": areas.where("not ok").select("aoi", "reason"),
    }


def read_report(spark: SparkSession, root: str, schemas: dict) -> dict[str, DataFrame]:
    """Blocks of a JSON report; ``schemas`` has one for each wanted block."""
    return {part: spark.read.schema(s).json(f"{root}/{part}") for part, s in schemas.items()}


def read_document(spark: SparkSession, root: str, schemas=None) -> dict[str, DataFrame]:
    """Parts of a published result document; give schemas to skip inference."""
    parts = ("summary", "aois", "top_candidates", "all_anomalies")
    schemas = schemas or {}
    return {
        p: (spark.read.schema(schemas[p]) if p in schemas else spark.read).json(f"{root}/{p}")
        for p in parts
    }


def read_document_file(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The same document as one JSON file; the first location that has it wins."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        at = hadoop(p)
        if at.getFileSystem(conf).exists(at):
            doc = spark.read.option("multiLine", "true").json(p)
            return {
                "summary": doc.select("summary.*"),
                "aois": doc.select(F.inline("aois")),
                "top_candidates": doc.select(F.inline("top_candidates")),
                "all_anomalies": doc.select(F.inline("all_anomalies")),
            }
    raise FileNotFoundError(f"no result document in {paths}")
