"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPEAKER_LIMIT = 40
TRANSCRIPT_LIMIT = 1000


def py_round(x: Column, places: int) -> Column:
    """Half-even rounding of the exact binary value, as a double."""
    return py_fixed(x, places).cast("double")


def py_fixed(x: Column, places: int) -> Column:
    """The same rounding as text with fixed places, such as 0.2 or 12.35."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places if places else "0"))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|(?<!\s)\s+$", "")


def one_line(x: Column) -> Column:
    return F.replace(strip(x), F.lit("\n"), F.lit(" "))


def present(x: Column) -> Column:
    """Null where a string is empty: both count as missing."""
    return F.nullif(x, F.lit(""))


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(present(c) for c in columns))


def after_comma(x: Column) -> Column:
    """What follows the first comma, or the whole without one."""
    return F.coalesce(F.get(F.split(x, ",", 2), F.lit(1)), x)


def speaker_of(line: Column) -> Column:
    """The stripped prefix before the first colon, if that prefix is short enough as it stands; else null."""
    parts = F.split(line, ":", 2)
    return F.when((F.size(parts) == 2) & (F.length(parts[0]) < SPEAKER_LIMIT), strip(parts[0]))


def speech_of(line: Column) -> Column:
    """What the speaker says, or the whole line without a speaker."""
    parts = F.split(line, ":", 2)
    return F.when((F.size(parts) == 2) & (F.length(parts[0]) < SPEAKER_LIMIT), strip(F.get(parts, F.lit(1)))).otherwise(line)


def shortened(x: Column, limit: int = TRANSCRIPT_LIMIT) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.left(x, F.lit(limit - 3)), F.lit("..."))).otherwise(x)


def person_name(speaker: Column, person_id: Column) -> Column:
    return F.coalesce(present(speaker), F.concat(F.lit("Person "), person_id.cast("string")))


def vtt_seconds(x: Column) -> Column:
    """HH:MM:SS.mmm or MM:SS.mmm to seconds; null where malformed."""
    ok = x.rlike(r"^(\d+:)?[0-5]?\d:[0-5]?\d[.,]\d{1,3}$")
    parts = F.reverse(F.split(F.replace(x, F.lit(","), F.lit(".")), ":"))
    value = parts[0].cast("double") + 60 * parts[1].cast("double") + 3600 * F.coalesce(F.get(parts, F.lit(2)).cast("double"), F.lit(0.0))
    return F.when(ok, value)


def stream_error(x: Column) -> Column:
    """A failure's text to its class; the first that applies counts."""
    return (
        F.when(x.contains("No segments found"), "no_segments")
        .when(x.contains("Failed to download"), "segments_unavailable")
        .when(F.lower(x).contains("variant"), "bad_variant_playlist")
        .otherwise(F.concat(F.lit("failed: "), x))
    )


def is_transport_stream(content: Column) -> Column:
    """Whether bytes begin with the sync byte 0x47."""
    return F.hex(F.substring(content, 1, 1)) == "47"


def is_playlist_url(url: Column) -> Column:
    return F.endswith(F.lower(url), F.lit(".m3u8")) | F.contains(F.lower(url), F.lit("m3u8"))


def swap_suffix(url: Column, old: str, new: str) -> Column:
    return F.replace(url, F.lit(old), F.lit(new))


def masked(secret: Column, shown: int = 4) -> Column:
    return F.concat(F.lit("..."), F.right(secret, F.lit(shown)))


def decoded(content: Column) -> Column:
    return F.decode(content, "UTF-8")


def target_size(width: Column, height: Column) -> Column:
    """Landscape and square frames become 1920x1080, portrait ones 1080x1920."""
    wide = width >= height
    return F.struct(F.when(wide, 1920).otherwise(1080).alias("width"), F.when(wide, 1080).otherwise(1920).alias("height"))


def object_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def merged_maps(left: Column, right: Column) -> Column:
    """One map of both; the right-hand value stays where both have a key. Null maps count as empty."""
    empty = F.create_map().cast("map<string,string>")
    right = F.coalesce(right, empty)
    return F.map_concat(F.map_filter(F.coalesce(left, empty), lambda k, v: ~F.map_contains_key(right, k)), right)


# The parts of a reference, each with its delimiters, so that a missing part differs from an empty one.
_SCHEME, _AUTHORITY, _PATH, _QUERY, _FRAGMENT = 1, 2, 3, 4, 5
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(url: Column, part: int) -> Column:
    return F.regexp_extract(url, _PARTS, part)


def without_dots(path: Column) -> Column:
    """A path without its "." and ".." parts: "." goes as text, the others by a fold, as each takes back a part."""
    dotted = F.startswith(path, F.lit(".")) | path.contains("/.")
    single = F.regexp_replace(path, r"(?<![^/])\.(?:/|\z)", "")
    back = F.startswith(path, F.lit("..")) | path.contains("/..")
    return F.when(back, _folded(path)).when(dotted, single).otherwise(path)


def _folded(path: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))
    parts = F.split(F.when(rooted, F.substring(path, F.lit(2), F.length(path))).otherwise(path), "/")
    none = F.array().cast("array<string>")
    back = lambda kept: F.when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
    kept = F.aggregate(parts, none, lambda kept, p: F.when(p == ".", kept).when(p == "..", back(kept)).otherwise(F.array_append(kept, p)))
    # A last part of dots leaves the folder that it names.
    folder = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), joined)


def joined_urls(rows: DataFrame, base: str, ref: Column | str, name: str) -> DataFrame:
    """rows with url_join(base, ref) as column name, in steps that read each part of either once; for many rows."""
    given = F.col(ref) if isinstance(ref, str) else ref
    parts = {f"{side}_{part}": url_part(url, part) for side, url in (("__base", F.col(base)), ("__ref", given)) for part in range(_SCHEME, _FRAGMENT + 1)}
    base_part, ref_part = ([F.col(f"{side}_{part}") for part in range(_SCHEME, _FRAGMENT + 1)] for side in ("__base", "__ref"))
    split = rows.withColumns(parts).withColumn("__path", _whole_path(base_part, ref_part))
    return split.withColumn(name, _joined(F.col(base), given, base_part, ref_part, F.col("__path"))).drop(*parts, "__path")


def url_join(base: Column | str, ref: Column | str) -> Column:
    """A reference resolved against its base, as RFC 3986, section 5.2, says; null if either is.

    Three choices that it leaves open or that HTTP clients make: an empty reference gives the base as it is, a reference
    with the base's own scheme and no authority is relative, and one with an authority keeps its path as it is written.
    """
    base, ref = (F.col(x) if isinstance(x, str) else x for x in (base, ref))
    base_part, ref_part = ([url_part(x, part) for part in range(_SCHEME, _FRAGMENT + 1)] for x in (base, ref))
    return _joined(base, ref, base_part, ref_part, _whole_path(base_part, ref_part))


def _whole_path(base: list[Column], ref: list[Column]) -> Column:
    """The path of a reference with a path, behind its base's folder unless it is rooted; dots still in it."""
    _, authority, base_path, _, _ = base
    path = ref[_PATH - 1]
    folder = F.when((base_path == "") & (authority != ""), F.lit("/")).otherwise(F.regexp_extract(base_path, r"(?s)^(.*/)?", 1))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))


def _joined(base: Column, ref: Column, base_part: list[Column], ref_part: list[Column], whole_path: Column) -> Column:
    base_scheme, base_authority, base_path, base_query, _ = base_part
    own, authority, path, query, fragment = ref_part
    absolute = (own != "") & ((own != base_scheme) | (authority != ""))
    merged = F.when(path == "", base_path).otherwise(without_dots(whole_path))
    asked = F.when((path == "") & query.isin("", "?"), base_query).otherwise(query)
    with_authority = F.concat(authority, path, query)
    relative = F.concat(base_authority, merged, asked)
    return F.when(base.isNull() | ref.isNull(), F.lit(None).cast("string")).when(ref == "", base).when(base == "", ref).when(absolute, ref).otherwise(F.concat(base_scheme, F.when(authority != "", with_authority).otherwise(relative), fragment))
