"""Lyrics files as rows of timed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"\[(\d{1,3}:\d{1,2}(?:\.\d{1,3})?)\]"


def _seconds(stamp: Column) -> Column:
    parts = F.split(stamp, "[:.]")
    fraction = F.coalesce(F.get(parts, 2), F.lit("0"))
    return F.get(parts, 0).cast("int") * 60 + F.get(parts, 1).cast("int") + fraction.cast("int") / F.pow(F.lit(10.0), F.length(fraction))


def lrc_lines(texts: DataFrame) -> DataFrame:
    """(id, start, end, line) of LRC texts (id, text): a row for each stamp of a line; a line ends where the next starts."""
    lines = texts.select("id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("no", "raw")).where(F.col("raw").rlike(rf"^\s*{STAMP}"))
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", rf"^(\s*{STAMP})+", ""), r"<\d{1,3}:\d{1,2}(\.\d{1,3})?>", ""), r"\s+", " "))
    head = F.regexp_extract("raw", rf"^((?:\s*{STAMP})+)", 1)
    rows = lines.select("id", "no", body.alias("line"), F.explode(F.regexp_extract_all(head, F.lit(STAMP), 1)).alias("stamp")).withColumn("start", _seconds(F.col("stamp")))
    return rows.withColumn("end", F.lead("start").over(Window.partitionBy("id").orderBy("start", "no"))).select("id", "start", "end", "line")


def srt_lines(texts: DataFrame) -> DataFrame:
    """(id, start, end, line) of SRT texts (id, text): blocks of three lines or more, the second with both times."""
    blocks = texts.select("id", F.explode(F.split(F.regexp_replace("text", r"\r\n|\r", "\n"), r"\n\s*\n+")).alias("block"))
    lines = blocks.select("id", F.split(F.regexp_replace("block", r"^\s+|\s+$", ""), "\n").alias("l")).where(F.size("l") >= 3)
    time = r"(\d{2}):(\d{2}):(\d{2})[,.](\d{3})"
    both = lines.where(F.col("l")[1].rlike(rf"^\s*{time}\s*-->\s*{time}"))
    at = lambda g: (F.regexp_extract(F.col("l")[1], rf"^\s*{time}\s*-->\s*{time}", g).cast("int") * 3600 + F.regexp_extract(F.col("l")[1], rf"^\s*{time}\s*-->\s*{time}", g + 1).cast("int") * 60
                    + F.regexp_extract(F.col("l")[1], rf"^\s*{time}\s*-->\s*{time}", g + 2).cast("int") + F.regexp_extract(F.col("l")[1], rf"^\s*{time}\s*-->\s*{time}", g + 3).cast("int") / 1000)
    return both.select("id", at(1).alias("start"), at(5).alias("end"), F.array_join(F.slice("l", 3, F.size("l")), "\n").alias("line"))


def plain_lines(texts: DataFrame) -> DataFrame:
    rows = texts.select("id", F.explode(F.split("text", r"\r\n|\r|\n")).alias("line")).where("trim(line) <> ''")
    return rows.select("id", F.lit(0.0).alias("start"), F.lit(None).cast("double").alias("end"), "line")


def best_lyrics(lrc: DataFrame, srt: DataFrame, embedded: DataFrame, online: DataFrame) -> DataFrame:
    """(id, source, start, end, line): the first source of a track that has lines; embedded and online texts are tried as LRC, then as plain lines."""
    tagged = lambda df, n, name: df.select("id", F.lit(n).alias("rank"), F.lit(name).alias("source"), "start", "end", "line")
    parts = [tagged(lrc_lines(lrc), 0, "lrc"), tagged(srt_lines(srt), 1, "srt")]
    for n, (name, df) in enumerate((("embedded", embedded), ("online", online))):
        parts += [tagged(lrc_lines(df), 2 + 2 * n, name), tagged(plain_lines(df), 3 + 2 * n, name)]
    every = reduce(DataFrame.union, parts)
    best = every.groupBy("id").agg(F.min("rank").alias("rank"))
    return every.join(best, ["id", "rank"]).select("id", "source", "start", "end", "line")
