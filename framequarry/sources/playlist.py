"""HLS playlists: variants and segments as rows, the best variant, fetching with failures skipped, diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framequarry.functions.scalars import is_transport_stream, joined_urls, url_join
from framequarry.runtime import materialise
from framequarry.sources.media import Fetcher, fetched


# A tag's line, what may stand between it and its URI (nothing or blank lines; any comments but another such tag), the URI.
_BLANK = r"(?:\n[ \t]*+(?=\n))*+"
_VARIANT = r"(?m)^ *+(#EXT-X-STREAM-INF:[^\n]*+" + _BLANK + r"\n *+[^#\s][^\n]*+)"
_SEGMENT = r"(?m)^ *+#EXTINF[^\n]*+(?:\n *+(?:#(?!EXTINF)[^\n]*+)?(?=\n))*+\n *+([^#\s][^\n]*+)"


def text_lines(playlists: DataFrame) -> Column:
    return F.regexp_replace("text", r"\r\n?", "\n")


def variants(playlists: DataFrame) -> DataFrame:
    """(playlist_url, pos, uri, bandwidth, width, height) of master playlists: URIs right behind a variant's tag."""
    rows = playlists.select("playlist_url", F.posexplode(F.regexp_extract_all(text_lines(playlists), F.lit(_VARIANT), F.lit(1))).alias("pos", "found"))
    return rows.select("playlist_url", "pos", *variant_fields(F.col("found")))


def variant_fields(found: Column) -> list[Column]:
    """uri, bandwidth, width and height of a variant's text, from its tag to its URI."""
    tag, uri = F.substring_index(found, "\n", 1), F.trim(F.substring_index(found, "\n", -1))
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(tag, pattern, 1), F.lit("")), F.lit("999999999999999999")).cast("long")
    return [uri.alias("uri"), number(r"(?:^|[:,])BANDWIDTH=(\d+)").alias("bandwidth"), number(r"RESOLUTION=(\d+)x").cast("int").alias("width"), number(r"RESOLUTION=\d+x(\d+)").cast("int").alias("height")]


def segments(playlists: DataFrame) -> DataFrame:
    """(playlist_url, pos, uri) of media playlists: URIs behind a duration tag, whatever comments stand between."""
    rows = playlists.select("playlist_url", F.posexplode(F.regexp_extract_all(text_lines(playlists), F.lit(_SEGMENT), F.lit(1))).alias("pos", "uri"))
    return rows.select("playlist_url", "pos", F.trim("uri").alias("uri"))


def best_variants(found: DataFrame) -> DataFrame:
    """The variant with the highest bandwidth, a missing one being 0; of equals the first."""
    lead = F.struct(F.coalesce("bandwidth", F.lit(0)).alias("b"), (-F.col("pos")).alias("p"))
    best = found.groupBy("playlist_url").agg(F.max_by(F.struct("pos", "uri", "bandwidth", "width", "height"), lead).alias("v"))
    return best.select("playlist_url", "v.*").withColumn("url", url_join("playlist_url", "uri"))


def segment_urls(found: DataFrame) -> DataFrame:
    return joined_urls(joined_urls(found, "playlist_url", F.lit("."), "__folder"), "__folder", "uri", "url").drop("__folder")


def fetch_segments(found: DataFrame, fetcher: Fetcher) -> DataFrame:
    """Segments that could be fetched, with content; error rows for playlists of which none could."""
    return fetched(segment_urls(found), "url", fetcher)


def assembled(parts: DataFrame) -> DataFrame:
    """Fetched segments joined in order, one row per playlist; error where none was fetched or all are empty.

    For short videos only: a row holds the whole file. `write_streams` holds one segment at a time.
    """
    good = F.collect_list(F.when(F.col("ok"), F.struct("pos", "content")))
    whole = parts.groupBy("playlist_url").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("ok").cast("int")).alias("fetched"), F.array_sort(good).alias("p"))
    content = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["content"])), ""))  # one pass, where appending binaries would copy what is there each time
    whole = whole.withColumn("content", content)
    error = F.when(F.col("fetched") == 0, "Failed to download any segments").when(F.octet_length("content") == 0, "assembled file is empty")
    return whole.select("playlist_url", "segments", "fetched", F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"), is_transport_stream(F.col("content")).alias("is_ts"))


def write_streams(found: DataFrame, fetcher: Fetcher, opened: Callable[[str], Any]) -> DataFrame:
    """(playlist_url, segments, fetched, bytes, error): segments fetched and written in order, one in memory at a time.

    found: playlist_url, pos and url. opened: gives a writable file for a playlist; a task that is run again opens it
    anew, so it must replace what is there. A segment that can't be fetched is skipped.
    """
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    names = ["playlist_url", "segments", "fetched", "bytes", "error"]

    def closed(name, target, segments, fetched, size, error):
        if target is not None:
            target.close()
        error = error or ("Failed to download any segments" if not fetched else "assembled file is empty" if not size else None)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, segments, fetched, size, error), kinds)], names=names)

    def run(batches):
        name, state = None, None
        for batch in batches:
            for playlist, url in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if playlist != name:
                    if name is not None:
                        yield closed(name, *state)
                    name, state = playlist, [None, 0, 0, 0, None]
                state[1] += 1
                try:
                    status, content = fetcher.fetch(url)
                    if status >= 400:
                        continue
                except Exception:
                    continue
                try:
                    state[0] = state[0] or opened(playlist)
                    state[0].write(content)
                    state[2], state[3] = state[2] + 1, state[3] + len(content)
                except Exception as failure:
                    state[4] = str(failure)
        if name is not None:
            yield closed(name, *state)

    rows = found.select("playlist_url", "pos", "url")
    return rows.repartition("playlist_url").sortWithinPartitions("playlist_url", "pos").mapInArrow(run, "playlist_url string, segments int, fetched int, bytes long, error string")


def diagnostics(playlists: DataFrame) -> DataFrame:
    """One row per playlist: its kind, counts, the first three variants, and the URL to try next.

    A playlist is told from its own text alone, so nothing is shuffled, and of its segments only the first is resolved.
    """
    kinds = "playlist_url", "playlist_size", "variant_count", "segment_count", "first_segment_url"
    counted = playlists.select("playlist_url", F.length("text").alias("playlist_size"), text_lines(playlists).alias("text"))
    counted = counted.withColumns({"found": F.regexp_extract_all("text", F.lit(_VARIANT), F.lit(1)), "uris": F.regexp_extract_all("text", F.lit(_SEGMENT), F.lit(1))})
    counted = counted.select("playlist_url", "playlist_size", F.greatest(F.size("found"), F.lit(0)).cast("long").alias("variant_count"), F.greatest(F.size("uris"), F.lit(0)).cast("long").alias("segment_count"), F.slice("found", 1, 3).alias("found"), F.trim(F.get("uris", F.lit(0))).alias("uri"))
    rows = segment_urls(counted).withColumnRenamed("url", "first_segment_url").select(*kinds, *(F.get("found", F.lit(k)).alias(f"found_{k}") for k in range(3)))
    for k in range(3):
        uri, bandwidth, width, height = variant_fields(F.col(f"found_{k}"))
        resolution = F.when(width.isNotNull(), F.concat_ws("x", width.cast("string"), height.cast("string")))
        rows = rows.withColumns({f"uri_{k}": uri, f"bandwidth_{k}": bandwidth, f"resolution_{k}": resolution})
        rows = joined_urls(rows, "playlist_url", f"uri_{k}", f"url_{k}")
    details = [F.when(F.col("variant_count") > k, F.struct(F.lit(k).alias("pos"), F.col(f"bandwidth_{k}").alias("bandwidth"), F.col(f"resolution_{k}").alias("resolution"), F.col(f"url_{k}").alias("url"))) for k in range(3)]
    return rows.select(*kinds, F.when(F.col("variant_count") > 0, F.filter(F.array(*details), lambda v: v.isNotNull())).alias("variant_details"), F.col("url_0").alias("first_variant_url"), (F.col("variant_count") > 0).alias("is_variant_playlist"))


def fetch_playlists(urls: DataFrame, fetcher: Fetcher) -> tuple[DataFrame, DataFrame]:
    """(playlist_url, text of those that could be fetched; playlist_url, error of the others)."""
    got = materialise(fetched(urls.select("playlist_url"), "playlist_url", fetcher), "playlists")
    return got.where("ok").select("playlist_url", F.decode("content", "UTF-8").alias("text")), got.where("not ok").select("playlist_url", "error")


def assemble_streams(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(playlist_url, segments, fetched, content, error, is_ts): from a master or media playlist to the joined segments.

    A playlist with segments is used as it is; of a master playlist, the media playlist of its best variant is.
    """
    first, lost = fetch_playlists(urls, fetcher)
    direct = segments(first)
    masters = first.join(direct.select("playlist_url").distinct(), "playlist_url", "left_anti")
    chosen = materialise(best_variants(variants(masters)).select(F.col("playlist_url").alias("asked"), F.col("url").alias("playlist_url")), "variants")
    second, lost_variants = fetch_playlists(chosen, fetcher)
    found = direct.withColumn("asked", F.col("playlist_url")).unionByName(segments(second).join(chosen, "playlist_url"))
    parts = fetched(segment_urls(found), "url", fetcher)
    whole = assembled(parts.withColumn("playlist_url", F.col("asked")))
    failed = lost.unionByName(lost_variants.join(chosen, "playlist_url").select(F.col("asked").alias("playlist_url"), "error"))
    why = F.coalesce("lost_error", "error", F.when(F.col("segments").isNull(), F.lit("No segments found")))
    joined = urls.select("playlist_url").distinct().join(whole, "playlist_url", "left").join(failed.withColumnRenamed("error", "lost_error"), "playlist_url", "left")
    return joined.select("playlist_url", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("fetched", F.lit(0)).alias("fetched"), "content", why.alias("error"), "is_ts")


def tested(urls: DataFrame, fetcher: Fetcher) -> DataFrame:
    """Diagnostics of playlists that are fetched now, with whether the first variant and the first segment answer."""
    texts, lost = fetch_playlists(urls, fetcher)
    told = materialise(diagnostics(texts), "diagnostics")
    variant_texts, variant_lost = fetch_playlists(told.where("first_variant_url is not null").select(F.col("first_variant_url").alias("playlist_url")).distinct(), fetcher)
    inner = diagnostics(variant_texts).select(F.col("playlist_url").alias("first_variant_url"), F.lit(True).alias("variant_playlist_accessible"), F.col("segment_count").alias("variant_segment_count"), F.col("first_segment_url").alias("variant_first_segment_url"))
    rows = told.join(inner, "first_variant_url", "left").join(variant_lost.select(F.col("playlist_url").alias("first_variant_url"), F.col("error").alias("variant_playlist_error")), "first_variant_url", "left")
    rows = rows.withColumn("first_segment_url", F.coalesce("first_segment_url", "variant_first_segment_url")).drop("variant_first_segment_url")
    heads = fetched(rows.where("first_segment_url is not null").select("first_segment_url").distinct(), "first_segment_url", fetcher, content=False)
    rows = rows.join(heads.select("first_segment_url", (F.col("status") == 200).alias("first_segment_accessible"), F.col("error").alias("first_segment_error")), "first_segment_url", "left")
    return rows.withColumn("playlist_accessible", F.lit(True)).withColumn("error", F.lit(None).cast("string")).unionByName(lost.withColumn("playlist_accessible", F.lit(False)), allowMissingColumns=True)
