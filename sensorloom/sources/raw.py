"""Raw store: partitioned gzip JSON batches, object digests, exploded observations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom import schemas
from sensorloom.functions.identity import checksum, content_digest

_INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

# Folder names are read as text, so that "07" stays an hour and not a number.
DOCUMENT = T.StructType([*schemas.RAW_BATCH.fields, T.StructField(schemas.CORRUPT, T.StringType())])
STORED_BATCH = T.StructType([*DOCUMENT.fields, *[T.StructField(c, T.StringType()) for c in schemas.RAW_PARTITIONS]])


def json_options(multiline: bool) -> dict[str, str]:
    return {
        "multiLine": str(multiline).lower(),
        "allowNonNumericNumbers": "false",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": schemas.CORRUPT,
    }


def scan_raw_batches(
    spark: SparkSession, root: str, multiline: bool = True, folders: str | None = None
) -> DataFrame:
    """Stored batches with their partition columns and ``object_path``.

    ``multiline`` reads one JSON document per object; files of ``write_raw_batches``
    hold one document per line. Filters on the partition columns prune folders;
    ``folders``, a path pattern below ``root``, also keeps the others from being listed.
    """
    return (
        spark.read.schema(STORED_BATCH)
        .options(**json_options(multiline))
        .option("basePath", root)
        .json(f"{root}/{folders}" if folders else root)
        .withColumn("object_path", F.col("_metadata.file_path"))
    )


def scan_selected_batches(spark: SparkSession, root: str, selected: DataFrame, multiline: bool = True) -> DataFrame:
    """Only the given batches (batch_id, facility_id, collector_id, received_at) of the store.

    Only folders of their receipt days are listed; the folder join then prunes to the
    exact hours at run time, and the id join keeps the exact batches.
    """
    folders = selected.select(
        F.col("facility_id").alias("facility"),
        F.date_format("received_at", "yyyy-MM-dd").alias("date"),
        F.date_format("received_at", "HH").alias("hour"),
        F.col("collector_id").alias("collector"),
    ).distinct()
    # One row per calendar day with receipts.
    days = [r["date"] for r in folders.select("date").distinct().orderBy("date").collect()]
    if not days:
        return spark.createDataFrame([], T.StructType([*STORED_BATCH.fields, T.StructField("object_path", T.StringType())]))
    pattern = "facility=*/date={" + ",".join(days) + "}"
    return (
        scan_raw_batches(spark, root, multiline, pattern)
        .join(folders, schemas.RAW_PARTITIONS, "left_semi")
        .join(selected.select(F.col("batch_id").alias("batchId")), "batchId", "left_semi")
    )


def scan_batch_documents(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Batches from a folder without the partition layout."""
    return spark.read.schema(DOCUMENT).options(**json_options(multiline)).json(path)


def explode_observations(batches: DataFrame) -> DataFrame:
    """One row per observation with its order in the batch; a batch without any gives one empty row.

    A missing sequence counts as zero. Each row carries its batch's contract version and number of observations.
    """
    kept = [c for c in ("received_at", "processing_attempt_count", "object_path", "digest_failed") if c in batches.columns]
    exploded = batches.select(
        F.col("batchId").alias("batch_id"),
        F.col("collectorId").alias("collector_id"),
        F.col("collectorVersion").alias("collector_version"),
        F.col("facilityId").alias("facility_id"),
        F.col("createdAt").alias("created_at"),
        F.col("contractVersion").alias("contract_version"),
        F.coalesce(F.size("observations"), F.lit(0)).alias("item_count"),
        *kept,
        F.posexplode_outer("observations").alias("item_order", "_o"),
    )
    return exploded.select(
        "batch_id", "collector_id", "collector_version", "facility_id", "created_at", "contract_version", "item_count",
        *kept, "item_order",
        F.col("_o.sourceSystem").alias("source_system"),
        F.col("_o.sourceEpoch").alias("source_epoch"),
        F.when(F.col("_o").isNotNull(), F.coalesce("_o.sourceSequence", F.lit(0))).alias("source_sequence"),
        F.col("_o.sourceTag").alias("source_tag"),
        F.col("_o.observedAt").alias("observed_at"),
        F.col("_o.rawValue").alias("raw_value"),
        F.col("_o.rawUnit").alias("raw_unit"),
        F.col("_o.sourceQualityCode").alias("source_quality_code"),
    )


def assemble_batches(obs: DataFrame) -> DataFrame:
    """Nested contract batches from flat observations that already carry batch and item order.

    A batch holds at most 500 observations by contract, which bounds each array; a
    higher item order fails the job.
    """
    too_many = F.raise_error(F.concat(F.lit("Batch holds too many observations: "), "batch_id"))
    item = F.struct(
        F.when(F.col("item_order") < schemas.MAX_OBSERVATIONS, F.col("item_order"))
        .otherwise(too_many.cast("long"))
        .alias("item_order"),
        F.struct(
            F.col("source_system").alias("sourceSystem"),
            F.col("source_epoch").alias("sourceEpoch"),
            F.col("source_sequence").alias("sourceSequence"),
            F.col("source_tag").alias("sourceTag"),
            F.col("observed_at").alias("observedAt"),
            F.col("raw_value").alias("rawValue"),
            F.col("raw_unit").alias("rawUnit"),
            F.col("source_quality_code").alias("sourceQualityCode"),
        ).alias("o"),
    )
    batch = ["batch_id", "collector_id", "collector_version", "facility_id", "created_at", "received_at"]
    by_order = lambda a, b: F.when(a["item_order"] < b["item_order"], -1).when(a["item_order"] > b["item_order"], 1).otherwise(0)
    return obs.groupBy(*batch).agg(F.collect_list(item).alias("_items")).select(
        F.lit(schemas.RAW_BATCH_CONTRACT).alias("contractVersion"),
        F.col("batch_id").alias("batchId"),
        F.col("collector_id").alias("collectorId"),
        F.col("collector_version").alias("collectorVersion"),
        F.col("facility_id").alias("facilityId"),
        F.col("created_at").alias("createdAt"),
        F.transform(F.array_sort("_items", by_order), lambda i: i["o"]).alias("observations"),
        "received_at",
    )


def object_key(facility: Column, received_at: Column, collector: Column, batch_id: Column) -> Column:
    """Key of a stored batch below the store's root: its receipt folder, then its id."""
    return F.concat(
        F.lit("facility="), facility, F.lit("/date="), F.date_format(received_at, "yyyy-MM-dd"),
        F.lit("/hour="), F.date_format(received_at, "HH"), F.lit("/collector="), collector, F.lit("/batch="), batch_id,
    )


def scan_stored_batches(spark: SparkSession, root: str) -> DataFrame:
    """Key, batch id, length and digests of every batch in files of ``write_raw_batches``.

    Such a file holds a batch a line, and a line is read as the bytes it is stored as, so each
    batch is measured and verified on its own whatever it was packed with. A line without a
    readable batch id has a key that ends in ``batch=``.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").text(root)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "(facility=[^/]+/date=[^/]+/hour=[^/]+/collector=[^/]+)/[^/]*$", 1)
    batch_id = F.get_json_object("value", "$.batchId")
    content = F.col("value").cast("binary")
    return lines.select(
        F.concat(folder, F.lit("/batch="), F.coalesce(batch_id, F.lit(""))).alias("object_key"),
        batch_id.alias("batch_id"),
        F.octet_length("value").cast("long").alias("decompressed_length"),
        checksum(content).alias("checksum"),
        content_digest(content).alias("content_digest"),
    )


def scan_object_digests(spark: SparkSession, root: str) -> DataFrame:
    """Path, length and digests over the exact compressed bytes of every object that holds one batch.

    Objects are at most 1 MiB by contract; longer files are packed by ``write_raw_batches``
    and read by ``scan_stored_batches``.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.gz")
        .load(root)
        .select(
            F.col("path").alias("object_key"), "length",
            checksum(F.col("content")).alias("checksum"),
            content_digest(F.col("content")).alias("content_digest"),
        )
    )


#: Bytes that are inflated at a time, and of objects sent to Python at a time.
INFLATE_STEP, BATCH_BYTES = 64 * 1024, "16m"


def inflated_length(content: bytes, limit: int) -> int | None:
    """Length of gzip data once inflated, counted up to ``limit`` + 1; null if it is not gzip data or breaks off.

    Never holds more than INFLATE_STEP inflated bytes.
    """
    total, left = 0, content
    while left:
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            try:
                total += len(inflate.decompress(left, INFLATE_STEP))
            except zlib.error:
                return None
            if total > limit:
                return limit + 1
            left = inflate.unconsumed_tail
            if not left and not inflate.eof:
                total += len(inflate.flush())  # what the window still holds
                return total if inflate.eof and total <= limit else (limit + 1 if total > limit else None)
        left = inflate.unused_data
    return total if content else None


def _measure(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [inflated_length(c.as_py(), limit) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("object_key"), batch.column("length"), pa.array(lengths, pa.int64())], ["object_key", "length", "decompressed_length"]
            )

    return run


def scan_object_sizes(
    spark: SparkSession, root: str, max_compressed: int = schemas.MAX_COMPRESSED_BYTES,
    max_decompressed: int = schemas.MAX_DECOMPRESSED_BYTES,
) -> DataFrame:
    """Compressed and, for objects within the compressed limit, decompressed length.

    Larger objects are not opened. Inflating stops at ``max_decompressed``, so an object that expands without end is
    counted as one byte more than that and costs no more memory than any other. Damaged objects have no decompressed length.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(root)
    measured = (
        files.where(F.col("length") <= max_compressed)
        .select(F.col("path").alias("object_key"), "length", "content")
        .mapInArrow(_measure(max_decompressed), "object_key string, length long, decompressed_length long")
    )
    refused = files.where(F.col("length") > max_compressed).select(
        F.col("path").alias("object_key"), "length", F.lit(None).cast("long").alias("decompressed_length")
    )
    return measured.unionByName(refused)


def write_raw_batches(batches: DataFrame, root: str, known: DataFrame | None = None) -> None:
    """Append batches that are not stored yet, by receipt time in UTC.

    ``batches`` are nested documents with ``received_at``. ``known`` (column
    ``batch_id``) lists stored batches; without it the store itself is read. The first
    receipt of a batch id is kept.
    """
    spark = batches.sparkSession
    if known is None:
        try:
            known = scan_raw_batches(spark, root, multiline=False).select(F.col("batchId").alias("batch_id"))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    # Receipts are reduced to one row per batch id before anything is joined on it.
    first = batches.groupBy("batchId").agg(F.min("received_at").alias("received_at"))
    if known is not None:
        first = first.join(known.select(F.col("batch_id").alias("batchId")), "batchId", "left_anti")
    fresh = batches.join(first, ["batchId", "received_at"], "left_semi").dropDuplicates(["batchId"])
    laid_out = fresh.select(
        *[f.name for f in schemas.RAW_BATCH.fields],
        F.col("facilityId").alias("facility"),
        F.date_format("received_at", "yyyy-MM-dd").alias("date"),
        F.date_format("received_at", "HH").alias("hour"),
        F.col("collectorId").alias("collector"),
    )
    (
        laid_out.hint("rebalance", *schemas.RAW_PARTITIONS)
        .write.partitionBy(*schemas.RAW_PARTITIONS)
        .option("compression", "gzip")
        .option("timestampFormat", _INSTANT)
        .mode("append")
        .json(root)
    )
