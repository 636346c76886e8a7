"""Tag, title and number rules as Column expressions (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Placeholders that stand for missing tags.
UNKNOWN_TITLE, UNKNOWN_ARTIST, UNKNOWN_ALBUM = "Unknown Title", "Unknown Artist", "Unknown Album"
UNKNOWN_COMPOSER, UNKNOWN_GENRE, UNKNOWN_YEAR = "Unknown Composer", "Unknown Genre", "Unknown Year"
UNKNOWN_ALBUM_ARTIST, UNKNOWN_DECADE, VARIOUS = "Unknown Album Artist", "Unknown Decade", "Various Artists"
PLACEHOLDERS = (UNKNOWN_ARTIST, UNKNOWN_ALBUM, UNKNOWN_COMPOSER, UNKNOWN_GENRE, UNKNOWN_YEAR, UNKNOWN_ALBUM_ARTIST, UNKNOWN_DECADE)

# File extensions and codecs.
SUPPORTED = ("mp3", "m4a", "wav", "aac", "aiff", "aif", "alac", "flac", "ogg", "oga", "opus", "ape", "mpc", "wv", "tta", "spx", "dsf", "dff", "mod", "it", "s3m", "xm", "au")
UNSUPPORTED = ("wma", "m4b", "m4p", "ra", "ram", "amr", "ac3", "dts")
LOSSLESS_CODECS = ("flac", "apple lossless", "alac", "wavpack", "ape", "tta", "dsd", "dsf", "dff")
LOSSLESS_FORMATS = ("flac", "alac", "wav", "wave", "aiff", "aif", "aifc", "ape", "wv", "tta", "dsf", "dff", "au", "mod", "it", "s3m", "xm")

# Marks of mix classes and genre families, in the order in which they are tried.
MIX_MARKS = (
    ("extended", ("extended", "club", "maxi", '12"')),
    ("radioEdit", ("radio", "single", "airplay", "video", "edit")),
    ("remix", ("remix",)),
)
FAMILY_MARKS = (
    ("dance", ("dance", "techno", "house", "trance", "rave", "hardcore", "hardstyle", "electro", "electró", "downtempo", "eurobeat")),
    ("hiphop", ("hip hop", "hip-hop", "hiphop", "rap", "trap")),
    ("schlager", ("schlager", "volksmusik", "volkstümlich")),
    ("classical", ("klassik", "classical", "orchest", "sinfon", "symphon", "opera", "baroque", "concerto")),
    ("jazzBlues", ("jazz", "blues", "swing")),
    ("rock", ("rock", "grunge", "punk", "metal", "indie", "alternative")),
    ("pop", ("pop",)),
)
FAMILIES = tuple(f for f, _ in FAMILY_MARKS)
# Labels of relations by type, forward and backward.
RELATION_LABELS = (
    ("remix", "has remix", "remix of"),
    ("cover", "covered by", "cover of"),
    ("edit", "has edit", "edit of"),
    ("karaoke", "has karaoke", "karaoke of"),
    ("samples material", "sampled by", "samples"),
    ("mashes up", "mashed up in", "mashes up"),
    ("medley", "medley of", "medley of"),
)
# Lossy scores by format: (formats, ((least bitrate, score), ...), score below them).
LOSSY_SCORES = (
    (("mp3",), ((320, 800), (256, 600), (192, 400)), 200),
    (("aac", "m4a"), ((256, 700), (192, 500)), 300),
    (("ogg",), ((192, 600),), 400),
    (("opus", "oga"), ((128, 650),), 450),
    (("mpc",), ((192, 600),), 400),
    (("spx",), (), 300),
)


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def nocase(c: Column) -> Column:
    """A-Z lowered and nothing else, as in comparisons that ignore ASCII case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip(c: Column) -> Column:
    """Without white space of any kind, line breaks included, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension, empty where there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.]\.([^.]+)$", 1))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def with_track_defaults(tracks: DataFrame) -> DataFrame:
    """Placeholders for null or empty tags, file stem as title, extension as format, empty year."""
    new = {
        "title": F.coalesce(empty_to_null(F.col("title")), file_stem(F.col("path"))),
        "artist": F.coalesce(empty_to_null(F.col("artist")), F.lit(UNKNOWN_ARTIST)),
        "album": F.coalesce(empty_to_null(F.col("album")), F.lit(UNKNOWN_ALBUM)),
        "genre": F.coalesce(empty_to_null(F.col("genre")), F.lit(UNKNOWN_GENRE)),
        "composer": F.coalesce(empty_to_null(F.col("composer")), F.lit(UNKNOWN_COMPOSER)) if "composer" in tracks.columns else F.lit(UNKNOWN_COMPOSER),
        "year": F.coalesce(F.col("year"), F.lit("")),
        "format": F.coalesce(empty_to_null(F.col("format")), extension(F.col("path"))),
    }
    return tracks.withColumns(new)


def normalize_artist_name(c: Column) -> Column:
    """Key of an artist name: initials joined, hyphens tightened, spaces squeezed, lower case."""
    joined = F.regexp_replace(F.lower(c), r"(?U)\b([a-z])\.? *", "$1")
    tight = F.replace(F.replace(F.replace(joined, F.lit(" - "), F.lit("-")), F.lit("- "), F.lit("-")), F.lit(" -"), F.lit("-"))
    return F.trim(F.regexp_replace(tight, r"\s+", " "))


def normalize_album_title(c: Column) -> Column:
    """Key of an album title; every "the " goes, inside words too."""
    for a, b in ((" - ", " "), ("  ", " "), ("the ", "")):
        c = F.replace(F.lower(c), F.lit(a), F.lit(b))
    return F.trim(c)


def year_from_date(c: Column) -> Column:
    return empty_to_null(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1))


def year_from_mb_date(c: Column) -> Column:
    """First four-digit window from 1900 to 2100, moving by one character."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(c) - 3, F.lit(1)))
    windows = F.transform(starts, lambda i: c.substr(i, F.lit(4)))
    fits = F.filter(windows, lambda w: w.rlike(r"^[0-9]{4}$") & (w >= "1900") & (w <= "2100"))
    return F.get(fits, 0).cast("int")


def leading_year(c: Column) -> Column:
    head = F.substring(F.trim(c), 1, 4)
    return F.when(head.rlike(r"^[+-]?\d+$"), head.cast("int"))


def int_prefix(c: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(empty_to_null(F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1)).cast("long"), F.lit(0).cast("long"))


def normalize_rating(c: Column) -> Column:
    out = F.when(c.isNull() | (c <= 0), F.lit(None).cast("int")).when(c <= 5, c.cast("int"))
    for top, stars in ((31, 1), (95, 2), (159, 3), (223, 4)):
        out = out.when(c <= top, stars)
    return out.otherwise(5)


def sanitize_duration(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (c < 0) | (c == float("inf")), F.lit(0.0)).otherwise(c)


def is_lossless(lossless: Column, codec: Column, fmt: Column) -> Column:
    by_codec = F.lit(False)
    for name in LOSSLESS_CODECS:
        by_codec = by_codec | F.coalesce(F.lower(codec), F.lit("")).contains(name)
    return F.coalesce(lossless, by_codec | F.lower(fmt).isin(*LOSSLESS_FORMATS))


def quality_score(tracks: DataFrame) -> Column:
    """Score by which the best of several copies is found; columns that ``tracks`` lacks count as null."""
    col = lambda n, kind: F.col(n) if n in tracks.columns else F.lit(None).cast(kind)
    fmt, rate = F.lower(F.col("format")), F.coalesce(col("bitrate", "int"), F.lit(0))
    lossy = F.lit(100)
    for formats, steps, rest in LOSSY_SCORES:
        score = F.lit(rest)
        for least, points in reversed(steps):
            score = F.when(rate >= least, points).otherwise(score)
        lossy = F.when(fmt.isin(*formats), score).otherwise(lossy)
    lossless = is_lossless(col("lossless", "boolean"), col("codec", "string"), F.col("format"))
    total = F.when(lossless, F.when(fmt.isin("dsf", "dff"), 1200).otherwise(1000)).otherwise(lossy)
    points = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    for name, unknown in (("title", UNKNOWN_TITLE), ("artist", UNKNOWN_ARTIST), ("album", UNKNOWN_ALBUM)):
        total = total + points((F.col(name) != "") & (F.col(name) != unknown), 50)
    total = total + points(col("album_artist", "string").isNotNull(), 25) + points(col("track_number", "int").isNotNull(), 25)
    total = total + points(F.col("year") != UNKNOWN_YEAR, 25) + points(col("artwork_ref", "string").isNotNull(), 100)
    rate = col("sample_rate", "int")
    return total + F.when(rate >= 96000, 100).when(rate >= 48000, 50).otherwise(0) + points(col("bit_depth", "int") >= 24, 50)


def duplicate_key(title: Column, artist: Column, album: Column, year: Column, duration: Column) -> Column:
    even = (F.round(sanitize_duration(duration) / 2) * 2).cast("long").cast("string")
    return F.concat_ws("|", *[F.lower(strip(c)) for c in (title, artist, album)], strip(year), even)


def mix_class(version: Column) -> Column:
    low = F.lower(version)
    out = F.when(version.isNull() | (version == ""), "original")
    for name, marks in MIX_MARKS:
        out = out.when(_any_in(low, marks), name)
    return out.otherwise("other")


def _any_in(c: Column, marks: tuple[str, ...]) -> Column:
    found = c.contains(marks[0])
    for m in marks[1:]:
        found = found | c.contains(m)
    return found


def genre_family(genre: Column) -> Column:
    low = F.lower(genre)
    out = F.when(genre.isNull() | (genre == ""), F.lit(None).cast("string"))
    for name, marks in FAMILY_MARKS:
        out = out.when(_any_in(low, marks), name)
    return out


def extended_field(json: Column, name: str) -> Column:
    """A field of the extended metadata; broken JSON gives null."""
    return F.get_json_object(json, f"$.{name}")


def valid_mbid(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), t)


def relation_label(kind: Column, direction: Column) -> Column:
    base, back = F.lower(F.coalesce(kind, F.lit("related"))), F.lower(F.coalesce(direction, F.lit(""))) == "backward"
    out = F.when(F.lit(False), "")
    for name, forward, backward in RELATION_LABELS:
        out = out.when(base == name, F.when(back, backward).otherwise(forward))
    return out.otherwise(F.when(back, F.concat(base, F.lit(" (←)"))).otherwise(base))


def decade_text(year: Column) -> Column:
    return F.when(year.isNull() | year.isin("", UNKNOWN_YEAR), UNKNOWN_DECADE).otherwise(F.concat(F.substring(year, 1, 3), F.lit("0s")))


def decade_int(year: Column) -> Column:
    return (F.floor(leading_year(year) / 10) * 10).cast("int")


def parse_duration(c: Column) -> Column:
    """"H:MM:SS", "M:SS" or "SS" in seconds; anything else is null."""
    parts = F.transform(F.split(F.trim(c), ":"), lambda p: p.cast("long"))
    ok = F.trim(c).rlike(r"^\d{1,9}(:\d{1,9}){0,2}$")
    return F.when(ok, F.aggregate(F.when(ok, parts), F.lit(0).cast("long"), lambda acc, p: acc * 60 + p))


def hide_duplicates(df: DataFrame, hide: bool = True) -> DataFrame:
    return df.where(~F.coalesce(F.col("is_duplicate"), F.lit(False))) if hide else df


def sanitize_file_name(c: Column) -> Column:
    clean = F.substring(F.trim(F.regexp_replace(c, r'[:/\\?%*|"<>]', "_")), 1, 255)
    return F.coalesce(empty_to_null(clean), F.lit("Untitled"))
