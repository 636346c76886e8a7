"""Library tables, file inventories, M3U playlists, relation JSON, artist lists and lyrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.graph import RECORDING, RELEASE
from ..schemas import SCHEMAS

FOLDER_BUCKETS = 64


def write_library(tables: dict[str, DataFrame], path: str) -> None:
    """Write the library's tables as Parquet; tracks are laid out by a hash bucket of their folder."""
    for name, df in tables.items():
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        out = df.select(*[c for c in columns if c in df.columns])
        if name == "tracks":
            bucket = F.pmod(F.xxhash64(S.parent_dir(F.col("path"))), F.lit(FOLDER_BUCKETS)).cast("int")
            out.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            out.write.mode("overwrite").parquet(f"{path}/{name}")


def read_library(spark: SparkSession, path: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Tables under their declared schemas; columns that a file lacks are null."""
    out = {n: spark.read.schema(SCHEMAS[n] + (", bucket int" if n == "tracks" else "")).parquet(f"{path}/{n}") for n in names}
    return {n: df.drop("bucket") if n == "tracks" else df for n, df in out.items()}


def file_inventory(listing: DataFrame) -> DataFrame:
    """(path, mtime, size, extension, supported) of files (path, mtime, size); hidden ones and those without an extension are left out."""
    ext = S.extension(F.col("path"))
    rows = listing.withColumn("extension", ext).where((F.col("extension") != "") & ~S.file_name(F.col("path")).startswith("."))
    return rows.select("path", "mtime", "size", "extension", F.col("extension").isin(*S.SUPPORTED).alias("supported"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime, size) of all files below ``path``, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.unix_micros("modificationTime").cast("double").alias("us"), F.col("length").alias("size")).select("path", (F.col("us") / 1e6).alias("mtime"), "size")


def read_m3u(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, entry) in order; blank lines and comments are left out."""
    texts = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("ordinal", "entry"))
    return texts.select("file", "ordinal", F.trim("entry").alias("entry")).where("entry <> '' and not startswith(entry, '#')")


def m3u_texts(members: DataFrame, tracks: DataFrame) -> DataFrame:
    """(playlist_id, text) of playlists (playlist_id, track_id, position): a head, then two lines for each track, by position."""
    line = F.concat(F.lit("#EXTINF:"), F.floor("duration").cast("string"), F.lit(","), "artist", F.lit(" - "), "title", F.lit("\r\n"), "path")
    joined = members.select("playlist_id", F.col("track_id").alias("id"), "position").join(tracks.select("id", line.alias("line")), "id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "id", "line"))), lambda x: x["line"])
    return joined.groupBy("playlist_id").agg(lines.alias("lines")).select("playlist_id", F.concat_ws("\r\n", F.lit("#EXTM3U"), "lines").alias("text"))


def export_m3u(members: DataFrame, tracks: DataFrame, names: DataFrame, path: str) -> None:
    """Write each playlist's text in a folder of its clean name (playlist_id, name)."""
    texts = m3u_texts(members, tracks).join(names, "playlist_id")
    texts.select("text", S.sanitize_file_name(F.col("name")).alias("playlist")).write.mode("overwrite").partitionBy("playlist").text(path)


def read_relation_json(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """(seq, json, document) of JSON files, one document each, or one in each line with ``lines``; broken ones have a null document."""
    seq = F.input_file_name()
    if lines:
        seq = F.concat_ws(":", seq, F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    texts = spark.read.option("wholetext", str(not lines).lower()).text(path).select(seq.alias("seq"), F.col("value").alias("json"))
    return texts.withColumn("document", F.from_json("json", RECORDING if kind == "recording" else RELEASE))


def read_known_artists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> '' and not startswith(name, '#')").distinct()


def read_lyrics(spark: SparkSession, path: str, tracks: DataFrame, lines: bool = False) -> DataFrame:
    """(id, kind, text) of .lrc and .srt files whose stem is that of a track's file.

    With ``lines`` the files are packed, as catalogues of millions keep them: JSON in lines, each with the ``file`` and its ``text``; lines that cannot be read are left out.
    """
    if lines:
        packed = spark.read.text(path).select(F.from_json("value", "file string, text string").alias("x")).select("x.file", "x.text")
        return match_lyrics(packed.where("file is not null and text is not null"), tracks)
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return match_lyrics(texts.withColumn("file", F.coalesce(F.try_url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "file")), tracks)


def match_lyrics(texts: DataFrame, tracks: DataFrame) -> DataFrame:
    """(id, kind, text) of texts (file, text) by the stems of their files and the tracks'."""
    keyed = texts.select(F.lower(S.file_stem(F.col("file"))).alias("stem"), S.extension(F.col("file")).alias("kind"), "text").where("kind in ('lrc', 'srt')")
    return keyed.join(tracks.select("id", F.lower(S.file_stem(F.col("path"))).alias("stem")), "stem").select("id", "kind", "text")
