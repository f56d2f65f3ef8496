"""Prefix scans, sweeps, bounded aggregates and references, over any number of partitions."""

import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from framequarry.functions import scalars
from framequarry.operators import context, islands, sampling
from framequarry.sources import playlist, vtt


def at_width(spark, width, run):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(width))
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_ranges(rows):
    out = []
    for video in sorted({v for v, _, _ in rows}):
        number, held = 0, None
        for s, e in sorted((s, e) for v, s, e in rows if v == video):
            if held is None or s > held[1]:
                if held:
                    out.append((video, number, *held))
                number, held = number + 1, [s, e, 1]
            else:
                held = [held[0], max(held[1], e), held[2] + 1]
        out.append((video, number, *held))
    return out


@pytest.mark.parametrize("width", [1, 5, 23])
def test_ranges_of_a_hot_video(spark, width):
    rng = random.Random(width)
    rows = [("hot", float(s := rng.randrange(4000)), s + float(rng.choice([0, 1, 2, 300]))) for _ in range(600)]
    rows += [("last", 5.0, 9.0), ("a", 1.0, 1.0), ("a", 1.0, 1.0), ("long", 0.0, 10_000.0)] + [("long", float(i), float(i)) for i in range(0, 9000, 40)]
    got = at_width(spark, width, lambda: islands.merged(spark.createDataFrame(rows + [(None, 1.0, 2.0)], "video_id string, start double, end double")).collect())
    assert sorted(map(tuple, got)) == plain_ranges(rows)


def test_regions_without_rows(spark):
    assert sampling.regions(spark.createDataFrame([], "video_id long, ts double")).count() == 0


def test_running_most():
    import numpy as np

    assert islands.running_most(np.array([3.0, 1, 5, 2, 2, 9]), np.array([0, 0, 0, 1, 1, 2])).tolist() == [3, 3, 5, 2, 2, 9]


def plain_context(ts, captions):
    for c in captions:
        if c[2] is not None and c[2] <= ts and c[3] is not None and ts <= c[3]:
            return c[4], c[5]
    for c in captions:
        if c[2] is not None and abs(c[2] - ts) < 2.0:
            return c[4], c[5]
    return None, None


@pytest.mark.parametrize("width", [1, 7, 31])
def test_sweep_equals_loops(spark, width):
    """A video with all rows, captions of hours among short ones, ends before starts, ties, and moments that share all."""
    rng = random.Random(width)
    captions = []
    for v, count in (("hot", 300), ("b", 9)):
        for i in range(count):
            start = rng.randrange(0, 2000) / 4
            captions.append((v, i, start, start + rng.choice([-1.0, 0.0, 0.5, 3.0, 3.0, 36_000.0 if i > 250 else 8.0]), rng.choice([None, "", "Ann"]), f"t{i}"))
    captions += [("hot", 5, 7.0, 9.0, None, "again"), ("b", 50, 1.0, None, "x", "no end"), ("b", 51, None, 4.0, "x", "no start"), (None, 1, 0.0, 99.0, "x", "no video")]
    moments = [("hot", i, rng.randrange(0, 2100) / 4, "kept") for i in range(900)] + [("b", i, i / 2, "kept") for i in range(60)] + [("c", 1, 5.0, "kept"), ("c", 1, 5.0, "kept"), ("b", 1, None, "kept"), (None, 2, 1.0, "kept")]
    got = at_width(spark, width, lambda: context.with_context(spark.createDataFrame(moments, "video_id string, m long, ts double, note string"), spark.createDataFrame(captions, "video_id string, ordinal int, start double, end double, speaker string, text string")).collect())
    by_video = {v: sorted((c for c in captions if c[0] == v), key=lambda c: c[1]) for v in ("hot", "b")}
    by_video["hot"] = [c for c in by_video["hot"] if c[5] != "again"]  # shares the ordinal of another
    assert len(got) == len(moments)
    ambiguous = next(c for c in captions if c[:2] == ("hot", 5))
    for r in got:
        assert r["note"] == "kept"
        if r["text" if "text" in r else "context_text"] in ("again", ambiguous[5]):
            continue
        assert (r["speaker"], r["context_text"]) == (plain_context(r["ts"], by_video.get(r["video_id"], [])) if r["ts"] is not None else (None, None))


def test_long_captions_are_not_repeated(spark):
    """A caption of ten hours is one row, and one more for each partition that it is carried into."""
    moments = spark.range(2000).select(F.lit("v").alias("video_id"), (F.col("id") * 18.0).alias("ts"))
    captions = spark.createDataFrame([("v", 0, 0.0, 36_000.0, "Ann", "all along")], "video_id string, ordinal int, start double, end double, speaker string, text string")
    assert context.laid_out(moments, captions, "ts").where("kind = 0").count() == 1
    assert context.with_context(moments, captions).where("context_text = 'all along'").count() == 2000


def test_transcript_of_a_hot_video(spark):
    rng = random.Random(3)
    rows = [("hot", i, float(i), i + 1.0, rng.choice([None, "", "Ann"]), rng.choice(["", "word", "several words here"])) for i in range(6000)] + [("b", 0, 1.25, 2.0, None, "x" * 1500), ("c", 0, 1.0, 2.0, None, None), ("d", 4, 0.0, 1.0, None, "one")]
    want = {}
    for video in ("hot", "b", "d"):
        lines = [f"[{s:.1f}s] " + (f"{who}: " if who else "") + text for v, _, s, _, who, text in rows if v == video and text]
        said = " ".join(lines)
        want[video] = said[:997] + "..." if len(said) > 1000 else said
    rng.shuffle(rows)
    found = vtt.transcripts(spark.createDataFrame(rows, "video_id string, ordinal int, start double, end double, speaker string, text string").repartition(11))
    assert {r["video_id"]: r["transcription"] for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().toString()


def test_transcripts_around_the_limit(spark):
    """Lines that end just before, at and just after the limit, alone and with more behind them, in one part and in many."""
    rows = [(f"{size}-{more}", i, float(i), i + 1.0, None, "x" * n) for size in (998, 999, 1000, 1001) for more in (0, 1, 2) for i, n in enumerate([500, size - 515, *[3] * more])]
    want = {}
    for video, _, s, _, _, text in rows:
        want[video] = (want[video] + " " if video in want else "") + f"[{s:.1f}s] " + text
    assert {len(want[f"{size}-0"]) for size in (998, 999, 1000, 1001)} == {998, 999, 1000, 1001}
    for parts in (1, 7):
        found = vtt.transcripts(spark.createDataFrame(rows, "video_id string, ordinal int, start double, end double, speaker string, text string").repartition(parts))
        assert {r["video_id"]: r["transcription"] for r in found.collect()} == {v: s[:997] + "..." if len(s) > 1000 else s for v, s in want.items()}


#: Examples of RFC 3986, sections 5.4.1 and 5.4.2.
BASE = "http://a/b/c/d;p?q"
CASES = """g:h g:h|g http://a/b/c/g|./g http://a/b/c/g|g/ http://a/b/c/g/|/g http://a/g|//g http://g|?y http://a/b/c/d;p?y|g?y http://a/b/c/g?y
#s http://a/b/c/d;p?q#s|g#s http://a/b/c/g#s|g?y#s http://a/b/c/g?y#s|;x http://a/b/c/;x|g;x http://a/b/c/g;x|g;x?y#s http://a/b/c/g;x?y#s
. http://a/b/c/|./ http://a/b/c/|.. http://a/b/|../ http://a/b/|../g http://a/b/g|../.. http://a/|../../ http://a/|../../g http://a/g
../../../g http://a/g|../../../../g http://a/g|/./g http://a/g|/../g http://a/g|g. http://a/b/c/g.|.g http://a/b/c/.g|g.. http://a/b/c/g..|..g http://a/b/c/..g
./../g http://a/b/g|./g/. http://a/b/c/g/|g/./h http://a/b/c/g/h|g/../h http://a/b/c/h|g;x=1/./y http://a/b/c/g;x=1/y|g;x=1/../y http://a/b/c/y
g?y/./x http://a/b/c/g?y/./x|g?y/../x http://a/b/c/g?y/../x|g#s/./x http://a/b/c/g#s/./x|g#s/../x http://a/b/c/g#s/../x|http:g http://a/b/c/g"""


def test_references(spark):
    cases = [c.split(" ") for line in CASES.split("\n") for c in line.split("|")]
    rows = [(BASE, ref, want) for ref, want in cases] + [(BASE, "", BASE), ("", "x", "x"), (None, "x", None), (BASE, None, None)]
    others = [("https://h.example.test/a/b.m3u8?t=1", r) for r in ("s.ts", "../s.ts?x=1", "/s.ts", "https://o.example.test/z/../s.ts", "//cdn.example.test/s.ts", "a b.ts", "été.ts", "?k=2", ".")] + [("https://h.example.test", "x/y"), ("/a/b", "../c"), ("a/b", "c"), ("https://h.example.test/", "")]
    rows += [(b, r, urljoin(b, r)) for b, r in others]
    found = spark.createDataFrame(rows, "base string, ref string, want string").select("*", scalars.url_join("base", "ref").alias("got"))
    assert not [tuple(r) for r in found.collect() if r["got"] != r["want"]]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_playlist_lines(spark):
    text = "#EXTM3U\r\n#EXTINF:4,\r\n\r\n#EXT-X-BYTERANGE:1\r\n  one.ts \r\nstray.ts\r\n#EXTINF:4,\n#EXTINF:5,\ntwo.ts\n#EXT-X-STREAM-INF:BANDWIDTH=9,RESOLUTION=3x2\n\nv.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=1\n#c\nlost.m3u8\n#EXTINF:1"
    lists = spark.createDataFrame([("u", text), ("e", ""), ("n", None)], "playlist_url string, text string")
    assert [tuple(r) for r in playlist.segments(lists).collect()] == [("u", 0, "one.ts"), ("u", 1, "two.ts")]
    assert [tuple(r) for r in playlist.variants(lists).collect()] == [("u", 0, "v.m3u8", 9, 3, 2)]


def test_urls_of_many_segments_are_read_once(spark):
    """The plan names each part of a reference a few times, where joins within joins named them thousands of times."""
    lists = spark.createDataFrame([("https://h.example.test/a/./b/../m.m3u8?t=1", "#EXTM3U\n#EXTINF:4,\ns.ts\n#EXTINF:4,\n?k=2\n#EXTINF:4,\n../s.ts\n#EXTINF:4,\n./x/./y.ts")], "playlist_url string, text string")
    found = playlist.segment_urls(playlist.segments(lists))
    assert [r["url"] for r in found.orderBy("pos").collect()] == ["https://h.example.test/a/" + x for x in ("s.ts", "?k=2", "../s.ts", "x/y.ts")][:2] + ["https://h.example.test/s.ts", "https://h.example.test/a/x/y.ts"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") < 40


def test_diagnostics_move_no_rows(spark):
    """A row per playlist from its own text: nothing is shuffled, and equal or missing URLs don't mix playlists."""
    variant = "#EXT-X-STREAM-INF:BANDWIDTH={0},RESOLUTION={0}x1\nv{0}.m3u8\n"
    media, master = "#EXTINF:4,\n../s1.ts\n#EXTINF:4,\ns2.ts\n", "#EXTM3U\n" + "".join(variant.format(k) for k in range(1, 6)) + "#EXT-X-STREAM-INF:PROGRAM-ID=1\nlast.m3u8"
    rows = [("https://h/x/m.m3u8", master), ("https://h/x/m.m3u8", media), (None, media), ("https://h/e.m3u8", ""), ("https://h/n.m3u8", None)]
    found = playlist.diagnostics(spark.createDataFrame(rows, "playlist_url string, text string"))
    got = [(r["playlist_url"], r["playlist_size"], r["variant_count"], r["segment_count"], r["first_variant_url"], r["first_segment_url"], [tuple(v) for v in r["variant_details"] or []]) for r in found.collect()]
    details = [(k - 1, k, f"{k}x1", f"https://h/x/v{k}.m3u8") for k in (1, 2, 3)]
    assert got == [(*rows[0][:1], len(master), 6, 0, "https://h/x/v1.m3u8", None, details), (*rows[1][:1], len(media), 0, 2, None, "https://h/s1.ts", []), (None, len(media), 0, 2, None, None, []), ("https://h/e.m3u8", 0, 0, 0, None, None, []), ("https://h/n.m3u8", None, 0, 0, None, None, [])]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
