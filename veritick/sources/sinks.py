"""Content-addressed series archives and fine-tuning files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritick.functions.helpers import canonical_text
from veritick.session import cut


def series_texts(bars: DataFrame) -> DataFrame:
    """(asset, text, sha256): canonical JSON of each asset's closes in time order. A series is one asset's daily bars."""
    points = F.array_sort(F.collect_list(F.struct(F.col("t_ms").alias("tMs"), "close")))
    texts = bars.groupBy("asset").agg(canonical_input(points).alias("json"))
    texts = texts.select("asset", canonical_text("json").alias("text"))
    return texts.withColumn("sha256", F.sha2(F.encode("text", "utf-8"), 256))


def canonical_input(points):
    return F.to_json(points)


PACK = 2  # digits of a hash that name a folder


def archive_series(bars: DataFrame, path: str, pinned: DataFrame | None = None) -> DataFrame:
    """Write each series once below ``path``, under its hash (``read_archive``); returns rejects (asset, sha256, reason).

    Series that are there already are not written again; other bytes under the same name are a collision and rejected.
    ``pinned`` (asset, pinned_sha) refuses any other bytes.
    """
    spark = bars.sparkSession
    texts = series_texts(bars)
    if pinned is not None:
        texts = texts.join(pinned, "asset", "left")
        rejects = texts.where("pinned_sha is not null and pinned_sha <> sha256").select("asset", "sha256", F.lit("bytes differ from the pinned hash").alias("reason"))
        texts = texts.where("pinned_sha is null or pinned_sha = sha256").drop("pinned_sha")
    else:
        rejects = texts.limit(0).select("asset", "sha256", F.lit("").alias("reason"))
    new = texts.dropDuplicates(["sha256"])
    there = read_archive(spark, path)
    if there is not None:
        there = there.withColumn("stored", F.sha2(F.encode("text", "utf-8"), 256))
        torn = texts.join(there.where("stored <> sha256").select("sha256").distinct(), "sha256").select("asset", "sha256", F.lit("other bytes are archived under this hash").alias("reason"))
        rejects = cut(rejects.unionByName(torn))
        new = new.join(there.select("sha256").distinct(), "sha256", "left_anti")
    pack = F.substring("sha256", 1, PACK)
    packed = new.select(F.concat_ws(" ", "sha256", "text").alias("value"), pack.alias("pack")).repartition("pack")
    packed.withColumnRenamed("pack", "sha256").write.mode("append").partitionBy("sha256").text(path)
    return rejects


def read_archive(spark: SparkSession, path: str) -> DataFrame | None:
    """(text, sha256) of an archive; None where there is none yet.

    A folder is named by the first digits of the hashes in it, and its lines have the hash before the text: a bounded number
    of folders, however many series there are. Folders named by a whole hash hold the text alone.
    """
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.schema("value string, sha256 string").text(path)
        packed = F.length("sha256") == PACK
        text, sha = F.when(packed, F.expr("substring(value, 66)")).otherwise(F.col("value")), F.when(packed, F.substring("value", 1, 64)).otherwise(F.col("sha256"))
        return lines.select(text.alias("text"), sha.alias("sha256"))
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


PLACE = ("asset", "cell_id", "bar_idx")


def in_places(rows: DataFrame) -> DataFrame:
    """Rows in ranges of their place, sorted."""
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PLACE).sortWithinPartitions(*PLACE)


def write_jsonl(lines: DataFrame, path: str, single: bool = False, placed: bool = False, compression: str | None = None) -> None:
    """One canonical JSON per line: files per asset range, each sorted by place; or one file for small exports.

    ``placed``: the lines were made from rows in such ranges (``sft.derived``), which are far smaller than texts.
    ``compression``: of the files, such as gzip; most of a line is the same in all of them.
    """
    out = lines if placed else lines.coalesce(1).sortWithinPartitions(*PLACE) if single else in_places(lines)
    out.select("value").write.text(path, compression=compression)
