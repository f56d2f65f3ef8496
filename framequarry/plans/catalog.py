"""Registered queries of the engine's own operators, with SQL that gives the same rows.

Every query reads its tables whole. Logical inputs (videos, detections, captions, regions) are derived from the
synthetic tables by fixed projections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from framequarry.functions import scalars
from framequarry.operators import clustering, context, payload, requests, sampling, scoring, selection
from framequarry.plans import pipeline
from framequarry.plans.profiles import CANONICAL, JOB, ORGANIZED, PROFILES
from framequarry.runtime import table
from framequarry.sources import playlist, vtt

Query = Callable[[SparkSession, str], DataFrame]

FPS = 25.0
ROI_MARGIN = 3600.0
#: The synthetic vectors lie about 1.4 apart, the nearest from 1.0 on; these radii give several clusters and noise.
VECTOR_EPS, SPARSE_EPS = 1.15, 1.2
#: Of the plan with two passes, which looks at fewer frames.
TWO_PASS_EPS = 1.32


# Logical inputs ------------------------------------------------------------------------------------------------------


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    portrait = F.col("doc_id") % 2 == 1
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), F.lit(FPS).alias("fps"), F.col("n_chars").alias("total_frames"), F.when(portrait, 720).otherwise(1280).alias("width"), F.when(portrait, 1280).otherwise(720).alias("height"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, ordinal, start, end, line): every third turn has no speaker."""
    line = F.when(F.col("turn") % 3 == 2, F.col("text")).otherwise(F.concat("role", F.lit(": "), "text"))
    start = 5.0 * F.col("turn")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("ordinal"), start.alias("start"), (start + 4).alias("end"), scalars.one_line(line).alias("line"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vtt.spoken(caption_lines(spark, sf_dir), "line")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), ((F.col("event_id") % 90) / F.lit(2.0)).alias("ts"))


def roi_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("ts"))


def points(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % parts).alias("video_id"), F.col("vec_id").alias("det_ord"), "embedding", ((F.col("vec_id") * 37 % 101) / F.lit(100.0)).alias("score"))


# Sampling ------------------------------------------------------------------------------------------------------------

_PICKS = """
    v AS (SELECT doc_id AS video_id, n_chars AS n FROM documents),
    c AS (SELECT video_id, n, unnest(list_concat(
            [0, least(29, n - 1), greatest(0, n - 31), greatest(0, n - 2)],
            CASE WHEN n > 10 THEN list_transform(range(1, 9), lambda k: CAST(trunc(30.0::DOUBLE + k * (CAST(n - 61 AS DOUBLE) / 9)) AS BIGINT)) ELSE [] END)) AS f FROM v),
    s AS (SELECT DISTINCT video_id, n, f FROM c)"""
_NUMBERED = "SELECT video_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(f AS BIGINT) AS frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY f) - 1 AS ordinal FROM {}) WHERE ordinal < 10 AND f BETWEEN 0 AND n - 1"

SAMPLING_SQL = {
    "rep_frames": f"WITH {_PICKS} " + _NUMBERED.format("s"),
    "rep_frames_padded": f"""WITH {_PICKS},
        l AS (SELECT video_id, n, count(*) AS size, list(f) AS fs FROM s GROUP BY ALL),
        extra AS (SELECT video_id, n, unnest(CASE
            WHEN size >= least(10, n) THEN []
            WHEN n BETWEEN 4 AND 10 OR n = 15 THEN list_filter(range(0, n), lambda x: NOT list_contains(fs, x))[1:least(10, n) - size]
            ELSE range(size, least(10, n)) END) AS f FROM l),
        a AS (SELECT * FROM s UNION SELECT video_id, n, f FROM extra) """ + _NUMBERED.format("a"),
    "coarse_sample": """WITH v AS (SELECT doc_id AS video_id, n_chars AS n, CASE WHEN n_chars / 125.0::DOUBLE > 100 THEN CAST(trunc(n_chars / 100.0::DOUBLE) AS BIGINT) ELSE 125 END AS step FROM documents)
        SELECT video_id, unnest(range(0, n, step)) AS frame_idx, frame_idx / 25.0::DOUBLE AS ts FROM v""",
    "modulo_sample": "SELECT l_orderkey AS video_id, CAST(l_partkey AS BIGINT) AS frame_idx FROM lineitem WHERE l_partkey % greatest(l_linenumber, 1) = 0",
}
for _name, _tiers in (("canonical", "CASE WHEN s < 600 THEN 1.0 ELSE 2.0 END"), ("organized", "CASE WHEN s < 600 THEN 1.0 WHEN s < 1800 THEN 2.0 ELSE 5.0 END"), ("job", "CASE WHEN s < 30 THEN 0.5 ELSE 1.0 END")):
    SAMPLING_SQL[f"uniform_sample_{_name}"] = f"""WITH v AS (SELECT doc_id AS video_id, n_chars AS n, n_chars / 25.0::DOUBLE AS s FROM documents),
        w AS (SELECT video_id, n, greatest(1, CAST(trunc(25 * {_tiers}) AS BIGINT)) AS step FROM v)
        SELECT video_id, unnest(range(0, n, step)) AS frame_idx, frame_idx / 25.0::DOUBLE AS ts FROM w"""

_REGIONS = f"""
    p AS (SELECT user_id AS video_id, CAST(floor(epoch(ts)) AS DOUBLE) AS ts FROM events),
    q AS (SELECT *, greatest(0, ts - {ROI_MARGIN}) AS s, ts + {ROI_MARGIN} AS e FROM p),
    m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
    o AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS range_no FROM m),
    r AS (SELECT video_id, CAST(range_no AS BIGINT) AS range_no, min(s) AS start, max(e) AS "end", count(*) AS points FROM o GROUP BY ALL)"""
SAMPLING_SQL["roi_merge"] = f'WITH {_REGIONS} SELECT video_id, range_no, start, "end", points FROM r'
SAMPLING_SQL["refine_plan"] = f'WITH {_REGIONS} SELECT video_id, sum("end" - start) AS total_seconds, greatest(5, CAST(trunc(sum("end" - start) * 25 / 150) AS BIGINT)) AS step FROM r GROUP BY video_id'
SAMPLING_SQL["refined_sample"] = f"""WITH {_REGIONS},
    l AS (SELECT video_id, greatest(5, CAST(trunc(sum("end" - start) * 25 / 150) AS BIGINT)) AS step FROM r GROUP BY video_id)
    SELECT video_id, range_no, unnest(range(CAST(start * 25 AS BIGINT), CAST("end" * 25 AS BIGINT) + 1, step)) AS frame_idx, frame_idx / 25.0::DOUBLE AS ts FROM r JOIN l USING (video_id)"""
SAMPLING_SQL["readable_sample"] = """WITH v AS (SELECT doc_id AS video_id, n_chars AS n, unnest(range(0, n_chars, 125)) AS f FROM documents),
    m AS (SELECT video_id, min(f) AS stop FROM v WHERE (f // 125) % 11 = 10 GROUP BY video_id)
    SELECT v.video_id, f AS frame_idx FROM v LEFT JOIN m USING (video_id) WHERE stop IS NULL OR f < stop"""


def user_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct().select("video_id", F.lit(FPS).alias("fps"), F.lit(10**15).alias("total_frames"))


def readable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = videos(spark, sf_dir).select("video_id", F.explode(sampling.stepped(F.col("total_frames"), F.lit(125))).alias("frame_idx"))
    return sampling.readable(samples, samples.where(F.expr("(frame_idx div 125) % 11 = 10")))


SAMPLING: dict[str, Query] = {
    "rep_frames": lambda s, d: sampling.representative_frames(videos(s, d)),
    "rep_frames_padded": lambda s, d: sampling.representative_frames(videos(s, d), padded=True),
    "uniform_sample_canonical": lambda s, d: sampling.uniform_samples(videos(s, d), CANONICAL),
    "uniform_sample_organized": lambda s, d: sampling.uniform_samples(videos(s, d), ORGANIZED),
    "uniform_sample_job": lambda s, d: sampling.uniform_samples(videos(s, d), JOB),
    "coarse_sample": lambda s, d: sampling.coarse_samples(videos(s, d)),
    "modulo_sample": lambda s, d: sampling.modulo_samples(table(s, d, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("frame_idx"), F.col("l_linenumber").alias("interval"))).drop("interval"),
    "roi_merge": lambda s, d: sampling.regions(roi_points(s, d), ROI_MARGIN),
    "refine_plan": lambda s, d: sampling.refine_plan(sampling.regions(roi_points(s, d), ROI_MARGIN), user_videos(s, d)).select("video_id", "total_seconds", "step"),
    "refined_sample": lambda s, d: sampling.refined_samples(sampling.regions(roi_points(s, d), ROI_MARGIN), user_videos(s, d)),
    "readable_sample": readable_sample,
}


# Scores and selection ------------------------------------------------------------------------------------------------


def event_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("video_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("det_score"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    pose = scoring.pose_score(F.col("l_quantity") - 25, F.col("l_tax") * 100, F.col("l_discount") * 100)
    score = scoring.quality_score(F.col("l_discount") * 10, pose, F.col("l_quantity"), F.lit(50.0))
    return rows.select("l_orderkey", "l_linenumber", scalars.py_round(score, 6).alias("score"))


def best_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.best_per_group(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


def roi_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), F.col("o_orderkey").alias("frame_idx"))
    faces = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.lit(1).alias("x"), F.col("l_orderkey").alias("frame_idx"))
    owned = faces.join(frames, "frame_idx").select("video_id", "frame_idx")
    return sampling.with_faces(frames, owned)


SELECTION: dict[str, Query] = {
    "confident_events_strict": lambda s, d: scoring.confident(event_detections(s, d)),
    "confident_events_inclusive": lambda s, d: scoring.confident(event_detections(s, d), inclusive=True),
    "quality_score": quality,
    "best_per_group": best_event,
    "roi_semi_join": roi_semi_join,
}

SELECTION_SQL = {
    "confident_events_strict": "SELECT event_id, user_id AS video_id, least(value / 100, 1.0::DOUBLE) AS det_score FROM events WHERE least(value / 100, 1.0::DOUBLE) > 0.6::DOUBLE",
    "confident_events_inclusive": "SELECT event_id, user_id AS video_id, least(value / 100, 1.0::DOUBLE) AS det_score FROM events WHERE least(value / 100, 1.0::DOUBLE) >= 0.6::DOUBLE",
    "quality_score": """SELECT l_orderkey, l_linenumber, round(l_discount * 10 * 40::DOUBLE
        + greatest(0.0::DOUBLE, 100.0::DOUBLE - (abs(l_quantity - 25) * 1.2::DOUBLE + abs(l_tax * 100) + abs(l_discount * 100) * 0.5::DOUBLE)) * 0.4::DOUBLE
        + l_quantity / 50.0::DOUBLE * 20, 6) AS score FROM lineitem""",
    "best_per_group": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1",
    "roi_semi_join": "SELECT o_custkey AS video_id, o_orderkey AS frame_idx FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
}


# Clusters and people -------------------------------------------------------------------------------------------------


def cluster_sql(raw: str, eps: float) -> str:
    """Common table expressions from raw (video_id, det_ord, e, score) down to `labels`: video_id, det_ord, label."""
    return f"""{raw},
    unit AS (SELECT video_id, det_ord, score, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM raw),
    nb AS (SELECT a.video_id, a.det_ord AS a, b.det_ord AS b FROM unit a JOIN unit b ON a.video_id = b.video_id AND (a.det_ord = b.det_ord OR list_inner_product(a.u, b.u) >= {clustering.cosine_floor(eps)!r}::DOUBLE)),
    core AS (SELECT video_id, a AS c FROM nb GROUP BY ALL HAVING count(*) >= 3),
    ce AS (SELECT nb.video_id, a, b FROM nb JOIN core x ON nb.video_id = x.video_id AND a = x.c JOIN core y ON nb.video_id = y.video_id AND b = y.c),
    reach(video_id, c, l) AS (SELECT video_id, c, c FROM core UNION SELECT ce.video_id, ce.b, r.l FROM reach r JOIN ce ON r.video_id = ce.video_id AND r.c = ce.a WHERE r.l < ce.b),
    comp AS (SELECT video_id, c, min(l) AS l FROM reach GROUP BY ALL),
    num AS (SELECT video_id, c, dense_rank() OVER (PARTITION BY video_id ORDER BY l) - 1 AS label FROM comp),
    got AS (SELECT nb.video_id, nb.a AS det_ord, min(label) AS label FROM nb JOIN num ON nb.video_id = num.video_id AND nb.b = num.c GROUP BY ALL),
    labels AS (SELECT raw.*, CAST(coalesce(label, -1) AS INTEGER) AS label FROM raw LEFT JOIN got USING (video_id, det_ord))"""


def raw_vectors(parts: int) -> str:
    return f"RECURSIVE raw AS (SELECT vec_id % {parts} AS video_id, vec_id AS det_ord, CAST(embedding AS DOUBLE[]) AS e, (vec_id * 37 % 101) / 100.0::DOUBLE AS score FROM embeddings)"


def best_people(spark: SparkSession, sf_dir: str, parts: int = 1, eps: float = VECTOR_EPS) -> DataFrame:
    rows = points(spark, sf_dir, parts)
    return selection.best_per_person(rows, clustering.clusters(rows, eps)).select("video_id", "person_id", "det_ord", "score")


def best_person_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best frame of each person with the line being spoken, named."""
    best = best_people(spark, sf_dir, 5, SPARSE_EPS).withColumn("ts", (F.col("det_ord") % 90) / F.lit(2.0))
    found = context.with_context(best, captions(spark, sf_dir))
    return found.select("video_id", "person_id", "det_ord", "score", "ts", scalars.person_name(F.col("speaker"), F.col("person_id")).alias("name"), "context_text")


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(points(spark, sf_dir, 1), VECTOR_EPS).groupBy("label").agg(F.count(F.lit(1)).alias("members"))


PEOPLE: dict[str, Query] = {
    "face_clusters": lambda s, d: clustering.clusters(points(s, d, 1), VECTOR_EPS),
    "face_clusters_grouped": lambda s, d: clustering.clusters_grouped(points(s, d, 5), SPARSE_EPS),
    "cluster_sizes": cluster_sizes,
    "best_per_person": best_people,
    "best_person_lines": best_person_lines,
}


# Captions and context ------------------------------------------------------------------------------------------------

_CAPTIONS = r"""
    raw AS (SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS ordinal, 5.0::DOUBLE * turn AS start, 5.0::DOUBLE * turn + 4 AS "end",
        replace(regexp_replace(regexp_replace(CASE WHEN turn % 3 = 2 THEN text ELSE role || ': ' || text END, '^\s+', ''), '\s+$', ''), chr(10), ' ') AS line FROM conversations),
    cut AS (SELECT *, strpos(line, ':') AS colon FROM raw),
    cap AS (SELECT video_id, ordinal, start, "end",
        CASE WHEN colon > 0 AND colon - 1 < 40 THEN trim(substr(line, 1, colon - 1)) END AS speaker,
        CASE WHEN colon > 0 AND colon - 1 < 40 THEN trim(substr(line, colon + 1)) ELSE line END AS text FROM cut)"""


def context_sql(moments_cte: str, key: str) -> str:
    return f"""{moments_cte},
    hit AS (SELECT {key}, speaker, text, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN ts BETWEEN start AND "end" THEN 1 ELSE 2 END, ordinal) AS n
        FROM m JOIN cap USING (video_id) WHERE ts BETWEEN start AND "end" OR abs(start - ts) < 2.0)"""


CAPTIONS_SQL = {
    "captions_parsed": f"WITH {_CAPTIONS} SELECT * FROM cap",
    "vtt_parsed": f"WITH {_CAPTIONS} SELECT * FROM cap",
    "transcript_text": f"""WITH {_CAPTIONS},
        t AS (SELECT video_id, string_agg('[' || CAST(CAST(start AS INTEGER) AS VARCHAR) || '.0s] ' || coalesce(nullif(speaker, '') || ': ', '') || text, ' ' ORDER BY ordinal) AS s FROM cap WHERE text <> '' GROUP BY video_id)
        SELECT video_id, CASE WHEN length(s) > 1000 THEN substr(s, 1, 997) || '...' ELSE s END AS transcription FROM t""",
    "context_join": f"""WITH {_CAPTIONS},
        {context_sql("m AS (SELECT event_id, user_id AS video_id, (event_id % 90) / 2.0::DOUBLE AS ts FROM events)", "event_id")}
        SELECT m.event_id, m.video_id, ts, speaker, text AS context_text FROM m LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON m.event_id = h.event_id""",
    "caption_counts": "SELECT doc_id AS video_id, count(conv_id) AS entries_count FROM documents LEFT JOIN conversations ON doc_id = conv_id GROUP BY doc_id",
}


def vtt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption files of the conversations, as text."""
    stamp = lambda c: F.concat(F.lit("00:"), F.lpad((F.floor(c / 60)).cast("string"), 2, "0"), F.lit(":"), F.lpad((c.cast("int") % 60).cast("string"), 2, "0"), F.lit(".000"))
    cue = F.concat(F.col("ordinal").cast("string"), F.lit("\n"), stamp(F.col("start")), F.lit(" --> "), stamp(F.col("end")), F.lit("\n"), "line")
    rows = caption_lines(spark, sf_dir).select("video_id", F.struct("ordinal", cue.alias("cue")).alias("c"))
    return rows.groupBy("video_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["cue"]), "\n\n")).alias("vtt"))


def caption_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = captions(spark, sf_dir).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return videos(spark, sf_dir).join(counts, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("entries_count"))


CAPTIONS: dict[str, Query] = {
    "captions_parsed": captions,
    "vtt_parsed": lambda s, d: vtt.parse_captions(vtt_texts(s, d)),
    "transcript_text": lambda s, d: vtt.transcripts(captions(s, d)),
    "context_join": lambda s, d: context.with_context(moments(s, d), captions(s, d)),
    "caption_counts": caption_counts,
}

PEOPLE_SQL = {
    "face_clusters": f"WITH {cluster_sql(raw_vectors(1), VECTOR_EPS)} SELECT video_id, det_ord, label FROM labels",
    "face_clusters_grouped": f"WITH {cluster_sql(raw_vectors(5), SPARSE_EPS)} SELECT video_id, det_ord, label FROM labels",
    "cluster_sizes": f"WITH {cluster_sql(raw_vectors(1), VECTOR_EPS)} SELECT label, count(*) AS members FROM labels GROUP BY label",
    "best_per_person": f"WITH {cluster_sql(raw_vectors(1), VECTOR_EPS)} SELECT video_id, label AS person_id, det_ord, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY score DESC, det_ord) AS n FROM labels WHERE label <> -1) WHERE n = 1",
    "best_person_lines": f"""WITH {cluster_sql(raw_vectors(5), SPARSE_EPS)}, {_CAPTIONS.replace("    raw AS", "    line_raw AS").replace("FROM raw)", "FROM line_raw)")},
        {context_sql("m AS (SELECT video_id, label AS person_id, det_ord, score, (det_ord % 90) / 2.0::DOUBLE AS ts FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY score DESC, det_ord) AS n FROM labels WHERE label <> -1) WHERE n = 1)", "video_id, person_id")}
        SELECT m.video_id, m.person_id, det_ord, score, ts, coalesce(nullif(speaker, ''), 'Person ' || CAST(m.person_id AS VARCHAR)) AS name, text AS context_text
        FROM m LEFT JOIN (SELECT * FROM hit WHERE n = 1) h ON m.video_id = h.video_id AND m.person_id = h.person_id""",
}


# Requests, playlists, payload ----------------------------------------------------------------------------------------


def caption_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("en,"), "url")).otherwise(F.concat(F.lit("en,"), "url", F.lit(",x")))
    return table(spark, sf_dir, "pages").select("page_id", scalars.after_comma(listed).alias("caption_url"))


def asset_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's URL in three forms as a request's assets."""
    kind = F.when(F.col("page_id") % 4 == 0, "video/webm").otherwise("video/mp4")
    asset = lambda url, mime: F.struct(url.alias("url"), F.lit("clip").alias("type"), mime.alias("mimeType"))
    url = F.col("url")
    assets = F.array(asset(F.concat(url, F.lit("/a")), kind), asset(F.concat(url, F.lit("/b")), kind), asset(F.concat(url, F.lit("/long")), F.lit("image/png")))
    return table(spark, sf_dir, "pages").select("page_id", requests.best_asset(assets).alias("asset_url"))


def source_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of pages, resolved: some with a listing, some direct, some with neither."""
    pages = table(spark, sf_dir, "pages")
    listing = F.when(F.col("page_id") % 5 < 3, F.struct(F.col("page_id").cast("string").alias("broadcast_id"), F.lit("shop").alias("shop_id"), F.lit(None).cast("string").alias("broadcast_title"), F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise("").alias("hls_url"), F.concat(F.lit("en,"), "url").alias("closed_captions"), F.lit(None).cast("string").alias("aci_content_id"), F.lit("r").alias("reference_id"), F.lit(None).cast("string").alias("synopsis"), F.lit("0:58").alias("formatted_duration"), F.when(F.col("page_id") % 5 == 1, F.array(F.struct(F.concat("url", F.lit("/p")).alias("url"), F.lit("clip").alias("type"), F.lit("video/mp4").alias("mimeType")))).alias("video_preview_assets")))
    rows = pages.select("page_id", F.when(F.col("page_id") % 5 == 3, F.col("url")).alias("video_url"), F.lit("").alias("transcript_url"), F.create_map(F.lit("shop_id"), F.lit("old"), F.lit("note"), F.lit("kept")).alias("metadata"), listing.alias("listing"))
    found = requests.resolved(rows, "https://video.example.test/base")
    return found.select("page_id", "source_url", "caption_url", F.try_element_at("metadata", F.lit("shop_id")).alias("shop"), F.try_element_at("metadata", F.lit("note")).alias("note"), "error")


def playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A master playlist per brand, with a variant per part."""
    part = table(spark, sf_dir, "part")
    stream = F.concat(F.lit("#EXT-X-STREAM-INF:"), F.when(F.col("p_size") % 7 == 0, F.lit("PROGRAM-ID=1")).otherwise(F.concat(F.lit("BANDWIDTH="), (F.col("p_size") * 1000).cast("string"))), F.lit(",RESOLUTION="), (F.col("p_size") * 16).cast("string"), F.lit("x"), (F.col("p_size") * 9).cast("string"), F.lit("\n"), F.lit("v"), F.col("p_partkey").cast("string"), F.lit(".m3u8"))
    rows = part.select(F.concat(F.lit("https://h.example.test/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/master.m3u8")).alias("playlist_url"), F.struct("p_partkey", stream.alias("t")).alias("s"))
    return rows.groupBy("playlist_url").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n")).alias("text"))


def media_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.concat(F.lit("#EXTINF:4.0,\nseg"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("t")).alias("s"))
    return rows.groupBy(F.concat(F.lit("https://h.example.test/o"), F.col("l_orderkey").cast("string"), F.lit("/media.m3u8")).alias("playlist_url")).agg(F.concat(F.lit("#EXTM3U\n#EXT-X-TARGETDURATION:4\n"), F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n"), F.lit("\n#EXT-X-ENDLIST\n")).alias("text"))


def diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of the diagnostics of master and media playlists, the variants shown as text."""
    both = playlists(spark, sf_dir).unionByName(media_playlists(spark, sf_dir))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    shown = F.transform("variant_details", lambda v: F.concat_ws("|", text(v["bandwidth"]), text(v["resolution"]), v["url"]))
    return playlist.diagnostics(both).select("playlist_url", "playlist_size", "is_variant_playlist", "variant_count", "segment_count", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("variants"), "first_variant_url", "first_segment_url")


def url_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.length(url).alias("url_length"), F.endswith(url, F.lit(".html")).alias("is_html"), F.contains(url, F.lit("?")).alias("has_query"), F.startswith(url, F.lit("https:")).alias("is_secure"), scalars.swap_suffix(url, ".html", ".mp4").alias("as_video"), F.left(url, F.lit(20)).alias("head"), scalars.masked(url).alias("masked"))


def url_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.concat(F.lit("/seg"), F.col("page_id").cast("string"), F.lit(".ts"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.url_join("url", ref).alias("joined"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.lit("none")).alias("a"), F.from_json("props", "map<string,string>").alias("b"))
    merged = rows.select("event_id", scalars.merged_maps(F.col("a"), F.col("b")).alias("m"))
    return merged.select("event_id", F.try_element_at("m", F.lit("kind")).alias("kind"), F.try_element_at("m", F.lit("k")).alias("k"), F.size("m").alias("entries"), scalars.first_present(F.try_element_at("m", F.lit("title")), F.try_element_at("m", F.lit("kind"))).alias("title"))


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of all events' properties; every fiftieth text is cut short, and so malformed."""
    text = F.when(F.col("event_id") % 50 == 0, F.left("props", F.lit(4))).otherwise(F.col("props"))
    return requests.variant_fields(table(spark, sf_dir, "events").select("event_id", text.alias("value")), ["event_id"])


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of pages as JSON, some without a parameter, some cut short: what is missing, and which are malformed."""
    pages = table(spark, sf_dir, "pages")
    field = lambda name, every: F.when(F.col("page_id") % every != 0, F.lit("x")).otherwise(F.when(F.col("page_id") % 2 == 0, F.lit("")).otherwise(F.lit(None).cast("string"))).alias(name)
    body = F.to_json(F.struct(F.col("page_id").cast("string").alias("request_id"), field("bucket", 3), field("main_folder", 5), field("account_id", 7), F.lit("c").alias("content_id"), F.col("url").alias("video_key")))
    cut = F.when(F.col("page_id") % 11 == 0, F.left(body, F.lit(9))).otherwise(body)
    found = requests.missing_parameters(requests.parse_requests(pages.select("page_id", cut.alias("value"))))
    return found.select("request_id", "error", F.col("malformed").isNotNull().alias("is_malformed"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with no frames or no rate, made of documents, and the error that each has."""
    rows = videos(spark, sf_dir).withColumn("fps", F.when(F.col("video_id") % 6 == 0, 0.0).otherwise(F.col("fps"))).withColumn("total_frames", F.when(F.col("video_id") % 9 == 0, 0).otherwise(F.col("total_frames")))
    return sampling.quarantine(rows).select("video_id", "error")


def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures made of pages' texts, cut to 500 characters and classified, and whether bytes begin as a stream's do."""
    page = F.col("page_id")
    text = F.when(page % 5 == 0, F.concat(F.lit("No segments found in "), "url")).when(page % 5 == 1, F.concat(F.lit("Failed to download "), "url")).when(page % 5 == 2, F.concat(F.lit("no VARIANT of "), "url")).otherwise(F.concat("url", F.lit(" "), F.coalesce("html", F.lit(""))))
    content = F.encode(F.concat(F.when(page % 3 == 0, F.lit("G")).otherwise(F.lit("g")), F.col("url")), "UTF-8")
    return table(spark, sf_dir, "pages").select("page_id", scalars.stream_error(F.left(text, F.lit(500))).alias("failure"), scalars.is_transport_stream(content).alias("is_ts"), scalars.decoded(content).alias("text"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 10, F.lit(250)
    size = scalars.target_size(w, h)
    return table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("target_w"), size["height"].alias("target_h"), payload.resolution(w, h).alias("resolution"), scalars.object_key(F.lit("out"), F.col("p_brand"), F.concat(F.lit("frame_"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(".jpg"))).alias("object_key"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.floor("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", payload.cost(seconds, 0.000416).alias("cost"), scalars.py_round(payload.throughput(F.lit(1000.0), F.floor(seconds / 1000)), 6).alias("throughput"))


def labels_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", "toxic", F.col("quality").isNotNull().alias("labelled"))


CLIP_FRAMES = 10_000


def analysis_eps(profile: str) -> float:
    return SPARSE_EPS if PROFILES[profile].two_pass_from is None else TWO_PASS_EPS


def analysis(spark: SparkSession, sf_dir: str, profile: str = "canonical") -> DataFrame:
    """The whole plan over five clips of 400 seconds that hold the embeddings, a row per person, or per clip without any."""
    frame = (F.floor(F.col("vec_id") / 5) * 8 % 400 * 25).alias("frame_idx")
    detections = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).cast("string").alias("video_id"), F.col("vec_id").alias("det_ord"), frame, "embedding", (0.5 + (F.col("vec_id") * 37 % 101) / F.lit(202.0)).cast("float").alias("det_score"), F.struct(F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(110.0).alias("x2"), F.lit(90.0).alias("y2")).alias("bbox"), F.struct(F.lit(5.0).alias("yaw"), F.lit(2.0).alias("pitch"), F.lit(4.0).alias("roll")).alias("pose"))
    clips = spark.range(5).select(F.col("id").cast("string").alias("video_id"), F.lit(FPS).alias("fps"), F.lit(CLIP_FRAMES).cast("long").alias("total_frames"), F.lit(1280).alias("width"), F.lit(720).alias("height"))
    asked = spark.range(5).select(F.col("id").cast("string").alias("request_id"), F.lit("https://video.example.test/a.mp4").alias("video_url"), F.lit("https://video.example.test/a.vtt").alias("transcript_url"), *(F.lit("x").alias(c) for c in requests.REQUIRED), F.lit("t.vtt").alias("transcript_key"), F.create_map().cast("map<string,string>").alias("metadata"), F.create_map().cast("map<string,string>").alias("custom_metadata"), F.lit(None).cast(requests.LISTING).alias("listing"))
    said = captions(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string"))
    plugins = pipeline.Plugins(videos=clips, detections=detections, captions=said, date=F.lit("2026-01-01"), job_id=F.concat(F.lit("job"), "video_id"), elapsed=F.lit(12.5), eps=analysis_eps(profile))
    rows, _ = pipeline.run(asked, plugins, PROFILES[profile])
    known = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c)
    frames = F.array_join(F.transform("representative_frames", lambda f: F.concat(f["filename"], F.lit("@"), f["frame_index"].cast("string"))), ",") if "representative_frames" in rows.columns else F.lit("")
    flat = rows.select("video_id", "status", "talent_count", F.col("processing_metrics.estimated_cost_usd").alias("cost"), F.col("video_metadata.resolution").alias("video_resolution"), known("transcription", "string"), frames.alias("frames"), F.explode_outer("talent_frames").alias("t"))
    return flat.select("video_id", "status", "talent_count", "cost", "video_resolution", "transcription", "frames", "t.person_id", "t.s3_key", "t.name", "t.context_text", "t.timestamp", F.round("t.score", 6).alias("score"), F.col("t.resolution").alias("frame_resolution"))


def analysis_sql(profile: str) -> str:
    """The same rows: frames looked at, confident detections, clusters, winners, their lines, and the payload's fields."""
    p = PROFILES[profile]
    looked = f"looked AS (SELECT CAST(v AS VARCHAR) AS video_id, f AS frame_idx FROM range(5) a(v), range(0, {CLIP_FRAMES}, 25) b(f))"
    if p.two_pass_from is not None:
        looked = f"""hit AS (SELECT DISTINCT video_id, frame_idx / 25.0::DOUBLE AS ts FROM seen WHERE frame_idx % 125 = 0),
    q AS (SELECT *, greatest(0, ts - {sampling.MARGIN}) AS s, ts + {sampling.MARGIN} AS e FROM hit),
    m0 AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
    o AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS range_no FROM m0),
    r AS (SELECT video_id, range_no, min(s) AS start, max(e) AS "end" FROM o GROUP BY ALL),
    l AS (SELECT video_id, greatest({sampling.REFINE_LEAST}, CAST(trunc(sum("end" - start) * 25 / {sampling.REFINE_CHECKS}) AS BIGINT)) AS step FROM r GROUP BY video_id),
    looked AS (SELECT DISTINCT video_id, frame_idx FROM (SELECT video_id, unnest(range(CAST(start * 25 AS BIGINT), CAST("end" * 25 AS BIGINT) + 1, step)) AS frame_idx FROM r JOIN l USING (video_id)) WHERE frame_idx < {CLIP_FRAMES})"""
    score = "CAST(s AS DOUBLE) * 40 + greatest(0.0::DOUBLE, 100.0::DOUBLE - (5 * 1.2::DOUBLE + 2 + 4 * 0.5::DOUBLE)) * 0.4::DOUBLE + 8000.0::DOUBLE / (1280.0::DOUBLE * 720) * 20" if p.composite_score else "CAST(s AS DOUBLE)"
    raw = f"""RECURSIVE seen AS (SELECT CAST(vec_id % 5 AS VARCHAR) AS video_id, vec_id AS det_ord, vec_id // 5 * 8 % 400 * 25 AS frame_idx, embedding, CAST(0.5::DOUBLE + (vec_id * 37 % 101) / 202.0::DOUBLE AS FLOAT) AS s FROM embeddings),
    {looked},
    raw AS (SELECT video_id, det_ord, frame_idx, CAST(embedding AS DOUBLE[]) AS e, {score} AS score FROM seen SEMI JOIN looked USING (video_id, frame_idx) WHERE CAST(s AS DOUBLE) {">=" if p.inclusive else ">"} {p.threshold}::DOUBLE)"""
    said = _CAPTIONS.replace("    raw AS", "    line_raw AS").replace("FROM raw)", "FROM line_raw)").replace("SELECT conv_id AS video_id", "SELECT CAST(conv_id AS VARCHAR) AS video_id")
    moments_cte = "m AS (SELECT video_id, label AS person_id, score, frame_idx / 25.0::DOUBLE AS ts FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY score DESC, det_ord) AS n FROM labels WHERE label <> -1) WHERE n = 1)"
    spoken = "coalesce(nullif(speaker, ''), 'Person ' || CAST(m.person_id AS VARCHAR))" if p.transcript else "'Person ' || CAST(m.person_id AS VARCHAR)"
    base = "'extracted-frames/2026-01-01/job' || m.video_id" if p.key_prefix == "dated" else "'x/x/x/extraction-talent-frames'"
    told = "coalesce(transcription, '')" if p.key_prefix == "dated" else "CAST(NULL AS VARCHAR)"
    picks = f"list_sort(list_distinct(list_concat([0, 29, {CLIP_FRAMES} - 31, {CLIP_FRAMES} - 2], list_transform(range(1, 9), lambda k: CAST(trunc(30.0::DOUBLE + k * (CAST({CLIP_FRAMES} - 61 AS DOUBLE) / 9)) AS BIGINT)))))[1:10]"
    frames = f"(SELECT string_agg('frame_' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') || '.jpg@' || ({picks})[i], ',' ORDER BY i) FROM range(1, 11) t(i))" if p.representative_frames else "''"
    return f"""WITH {cluster_sql(raw, analysis_eps(profile))}, {said},
    {context_sql(moments_cte, "video_id, person_id").replace("hit AS", "line AS")},
    w AS (SELECT video_id, string_agg('[' || CAST(CAST(start AS INTEGER) AS VARCHAR) || '.0s] ' || coalesce(nullif(speaker, '') || ': ', '') || text, ' ' ORDER BY ordinal) AS s FROM cap WHERE text <> '' GROUP BY video_id),
    t AS (SELECT video_id, CASE WHEN length(s) > 1000 THEN substr(s, 1, 997) || '...' ELSE s END AS transcription FROM w),
    people AS (SELECT m.video_id, m.person_id, {base} || '/talent/person_' || m.person_id || '.jpg' AS s3_key, {spoken} AS name, {"text" if p.transcript else "CAST(NULL AS VARCHAR)"} AS context_text, round(ts, 2) AS timestamp, round({"round(score, 2)" if p.round_scores else "score"}, 6) AS score
        FROM m LEFT JOIN (SELECT * FROM line WHERE n = 1) h ON m.video_id = h.video_id AND m.person_id = h.person_id),
    clips AS (SELECT CAST(v AS VARCHAR) AS video_id FROM range(5) a(v))
SELECT clips.video_id, 'success' AS status, CAST(count(person_id) OVER (PARTITION BY clips.video_id) AS INTEGER) AS talent_count, round(12.5::DOUBLE * {p.price_per_second}::DOUBLE, 4) AS cost, '1280x720' AS video_resolution, {told} AS transcription, {frames} AS frames,
    person_id, s3_key, name, context_text, timestamp, score, CASE WHEN person_id IS NOT NULL THEN '1920x1080' END AS frame_resolution
FROM clips LEFT JOIN people ON clips.video_id = people.video_id LEFT JOIN t ON clips.video_id = t.video_id"""


REQUESTS: dict[str, Query] = {
    "caption_url": caption_url,
    "asset_choice": asset_choice,
    "source_choice": source_choice,
    "variant_choice": lambda s, d: playlist.best_variants(playlist.variants(playlists(s, d))).select("playlist_url", "uri", "bandwidth", "width", "height", "url"),
    "segment_list": lambda s, d: playlist.segment_urls(playlist.segments(media_playlists(s, d))),
    "playlist_diagnostics": diagnosed,
    "url_features": url_features,
    "url_joins": url_joins,
    "event_fields": event_fields,
    "request_checks": request_checks,
    "quarantined": quarantined,
    "stream_errors": stream_errors,
    "metadata_merge": metadata_merge,
    "targets": targets,
    "cost": costs,
    "labels_left": labels_left,
    "analysis_canonical": lambda s, d: analysis(s, d, "canonical"),
    "analysis_organized": lambda s, d: analysis(s, d, "organized"),
    "analysis_job": lambda s, d: analysis(s, d, "job"),
    "analysis_legacy": lambda s, d: analysis(s, d, "legacy"),
}

_BRAND_URL = "'https://h.example.test/' || replace(p_brand, '#', '-')"
REQUESTS_SQL = {
    "caption_url": "SELECT page_id, CASE WHEN strpos(l, ',') > 0 THEN substr(l, strpos(l, ',') + 1) ELSE l END AS caption_url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'en,' || url ELSE 'en,' || url || ',x' END AS l FROM pages)",
    "asset_choice": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '/long' ELSE url || '/a' END AS asset_url FROM pages",
    "source_choice": """SELECT page_id,
        CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '/p' WHEN 2 THEN 'https://video.example.test/base/' || page_id || '/default.mp4' WHEN 3 THEN url END AS source_url,
        CASE WHEN page_id % 5 < 3 THEN url END AS caption_url,
        CASE WHEN page_id % 5 < 3 THEN 'shop' ELSE 'old' END AS shop, 'kept' AS note,
        CASE WHEN page_id % 5 = 4 THEN 'no video URL' END AS error FROM pages""",
    "variant_choice": f"""SELECT {_BRAND_URL} || '/master.m3u8' AS playlist_url, 'v' || p_partkey || '.m3u8' AS uri, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size * 1000 AS BIGINT) END AS bandwidth, CAST(p_size * 16 AS INTEGER) AS width, CAST(p_size * 9 AS INTEGER) AS height, {_BRAND_URL} || '/v' || p_partkey || '.m3u8' AS url
        FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END DESC, p_partkey) AS n FROM part) WHERE n = 1""",
    "segment_list": "SELECT 'https://h.example.test/o' || l_orderkey || '/media.m3u8' AS playlist_url, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'seg' || l_partkey) - 1 AS INTEGER) AS pos, 'seg' || l_partkey || '.ts' AS uri, 'https://h.example.test/o' || l_orderkey || '/seg' || l_partkey || '.ts' AS url FROM lineitem",
    "playlist_diagnostics": f"""WITH v AS (SELECT {_BRAND_URL} AS base, p_partkey, 'v' || p_partkey || '.m3u8' AS uri, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n,
            length('#EXT-X-STREAM-INF:' || CASE WHEN p_size % 7 = 0 THEN 'PROGRAM-ID=1' ELSE 'BANDWIDTH=' || p_size * 1000 END || ',RESOLUTION=' || p_size * 16 || 'x' || p_size * 9) + 1 + length('v' || p_partkey || '.m3u8') AS size FROM part),
        seg AS (SELECT 'https://h.example.test/o' || l_orderkey AS base, 'seg' || l_partkey || '.ts' AS uri, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'seg' || l_partkey) AS n FROM lineitem)
        SELECT base || '/master.m3u8' AS playlist_url, CAST(8 + sum(size) + count(*) - 1 AS INTEGER) AS playlist_size, true AS is_variant_playlist, count(*) AS variant_count, CAST(0 AS BIGINT) AS segment_count,
            string_agg(CASE WHEN p_size % 7 = 0 THEN '-' ELSE CAST(p_size * 1000 AS VARCHAR) END || '|' || p_size * 16 || 'x' || p_size * 9 || '|' || base || '/' || uri, ';' ORDER BY n) FILTER (WHERE n <= 3) AS variants,
            base || '/' || min(CASE WHEN n = 1 THEN uri END) AS first_variant_url, CAST(NULL AS VARCHAR) AS first_segment_url FROM v GROUP BY base
        UNION ALL
        SELECT base || '/media.m3u8', CAST(32 + sum(length(uri) + 13) + count(*) - 1 + 16 AS INTEGER), false, CAST(0 AS BIGINT), count(*), '', NULL, base || '/' || min(CASE WHEN n = 1 THEN uri END) FROM seg GROUP BY base""",
    "url_features": "SELECT page_id, CAST(length(url) AS INTEGER) AS url_length, ends_with(url, '.html') AS is_html, contains(url, '?') AS has_query, starts_with(url, 'https:') AS is_secure, replace(url, '.html', '.mp4') AS as_video, left(url, 20) AS head, '...' || right(url, 4) AS masked FROM pages",
    "event_fields": """SELECT event_id, j.key AS field, CASE j.type WHEN 'UBIGINT' THEN 'BIGINT' ELSE j.type END AS kind, json_extract_string(props, '$.' || j.key) AS text, CAST(NULL AS VARCHAR) AS error FROM events, json_each(props) j WHERE event_id % 50 <> 0
        UNION ALL SELECT event_id, NULL, NULL, NULL, 'malformed JSON: ' || left(props, 4) FROM events WHERE event_id % 50 = 0""",
    "request_checks": """WITH g AS (SELECT *, list_filter([CASE WHEN page_id % 3 = 0 THEN 'bucket' END, CASE WHEN page_id % 5 = 0 THEN 'main_folder' END, CASE WHEN page_id % 7 = 0 THEN 'account_id' END], lambda x: x IS NOT NULL) AS gone FROM pages)
        SELECT CASE WHEN page_id % 11 <> 0 THEN CAST(page_id AS VARCHAR) END AS request_id,
            CASE WHEN page_id % 11 = 0 THEN 'missing: bucket, main_folder, account_id, content_id, video_key' WHEN len(gone) > 0 THEN 'missing: ' || array_to_string(gone, ', ') END AS error, page_id % 11 = 0 AS is_malformed FROM g""",
    "quarantined": "SELECT doc_id AS video_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 9 = 0 OR n_chars <= 0 THEN 'video is empty or corrupt' END AS error FROM documents",
    "stream_errors": """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'no_segments' WHEN 1 THEN 'segments_unavailable' WHEN 2 THEN 'bad_variant_playlist'
            ELSE CASE WHEN contains(t, 'No segments found') THEN 'no_segments' WHEN contains(t, 'Failed to download') THEN 'segments_unavailable' WHEN contains(lower(t), 'variant') THEN 'bad_variant_playlist' ELSE 'failed: ' || t END END AS failure,
            page_id % 3 = 0 AS is_ts, CASE WHEN page_id % 3 = 0 THEN 'G' ELSE 'g' END || url AS text FROM (SELECT *, left(url || ' ' || coalesce(html, ''), 500) AS t FROM pages)""",
    "url_joins": "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*') || '/seg' || page_id || '.ts' AS joined FROM pages",
    "metadata_merge": "SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k, CAST(2 AS INTEGER) AS entries, event_type AS title FROM events",
    "targets": "SELECT p_partkey, CAST(CASE WHEN p_size * 10 >= 250 THEN 1920 ELSE 1080 END AS INTEGER) AS target_w, CAST(CASE WHEN p_size * 10 >= 250 THEN 1080 ELSE 1920 END AS INTEGER) AS target_h, (p_size * 10) || 'x250' AS resolution, 'out/' || p_brand || '/frame_' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '.jpg' AS object_key FROM part",
    "cost": "SELECT o_orderkey, round(floor(o_totalprice) * 0.000416::DOUBLE, 4) AS cost, round(CASE WHEN floor(floor(o_totalprice) / 1000) > 0 THEN 1000.0::DOUBLE / floor(floor(o_totalprice) / 1000) ELSE 0 END, 6) AS throughput FROM orders",
    "labels_left": "SELECT d.doc_id, quality, toxic, quality IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
}


REQUESTS_SQL |= {f"analysis_{name}": analysis_sql(name) for name in PROFILES}


def queries() -> dict[str, Query]:
    return {**SAMPLING, **SELECTION, **PEOPLE, **CAPTIONS, **REQUESTS}


def oracle_sql() -> dict[str, str]:
    return {**SAMPLING_SQL, **SELECTION_SQL, **PEOPLE_SQL, **CAPTIONS_SQL, **REQUESTS_SQL}
