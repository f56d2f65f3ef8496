"""The whole analysis of many videos as one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.operators import clustering, context, payload, requests, sampling, scoring, selection
from framequarry.plans.profiles import CANONICAL, Profile
from framequarry.progress import Progress
from framequarry.runtime import checkpointed, materialise
from framequarry.sources import media, objects, parts, sinks, vtt


@dataclass
class Plugins:
    """Tables, or what makes them, and what reaches outside; whatever is left out is not done.

    videos: video_id, fps, total_frames, width, height, where video_id is the request's id; without it, sources are
    probed. captions: video_id, ordinal, start, end, speaker, text; without them, caption URLs are fetched.
    """

    videos: DataFrame | None = None
    detector: media.Detector | None = None
    detections: DataFrame | None = None
    captions: DataFrame | None = None
    accelerator: str = "none"
    url_base: str = ""
    fallback_base: str | None = None
    fetcher: media.Fetcher | None = None
    prober: media.Prober | None = None
    #: Streams (.m3u8) become files in work_dir before they are probed.
    remuxer: media.Remuxer | None = None
    work_dir: str = ""
    #: Frames of persons and representative frames are encoded and stored; what can't be read or stored is dropped.
    encoder: media.Encoder | None = None
    put: Callable[[str, bytes, str, dict], None] | None = None
    #: Or a folder of any store that Arrow opens: objects are published there at once when all tasks have written theirs.
    object_root: str | None = None
    #: Videos are archived through these by byte ranges, not as a value of a row.
    ranges: parts.RangeFetcher | None = None
    archive: parts.Multipart | None = None
    #: Told what stages have done.
    log: Callable[[str], None] | None = None
    webhook: str | None = None
    post: Callable[[str, bytes, float], None] | None = None
    #: Column expressions over a job's row, injected in tests.
    date: Column | None = None
    job_id: Column | None = None
    elapsed: Column | None = None
    eps: float = clustering.EPS


def sources_of(good: DataFrame, plugins: Plugins) -> DataFrame:
    """(video_id, path, error) of accepted requests: the source itself, or the file that a stream was remuxed to."""
    rows = good.select(F.col("request_id").alias("video_id"), F.col("source_url").alias("path"))
    if plugins.remuxer is None:
        return rows.withColumn("error", F.lit(None).cast("string"))
    stream = F.lower(F.regexp_replace("path", r"[?#].*$", "")).endswith(".m3u8")
    target = F.concat(F.lit(plugins.work_dir.rstrip("/") + "/"), "video_id", F.lit(".mp4"))
    done = materialise(media.remuxed(rows.where(stream).select(F.col("path").alias("url"), target.alias("target")), plugins.remuxer), "remuxed")
    whole = rows.where(~F.coalesce(stream, F.lit(False))).withColumn("error", F.lit(None).cast("string"))
    made = rows.where(stream).join(done.select("target", F.col("error")), target == F.col("target")).select("video_id", F.col("target").alias("path"), "error")
    return whole.unionByName(made)


def probed_videos(good: DataFrame, plugins: Plugins) -> tuple[DataFrame, DataFrame]:
    """(videos, request_id and error of sources that can't be read)."""
    sources = sources_of(good, plugins)
    seen = materialise(media.probed(sources.where("error is null"), plugins.prober), "probed")
    lost = sources.where("error is not null").select("video_id", "error").unionByName(seen.where("error is not null").select("video_id", "error"))
    return seen.where("error is null").drop("error"), lost.select(F.col("video_id").alias("request_id"), "error")


def fetched_captions(good: DataFrame, plugins: Plugins) -> tuple[DataFrame, DataFrame]:
    """(captions, request_id and error of caption files that can't be fetched)."""
    asked = good.where("caption_url is not null").select(F.col("request_id").alias("video_id"), "caption_url")
    got = materialise(media.fetched(asked, "caption_url", plugins.fetcher), "captions")
    said = vtt.parse_captions(got.where("ok").select("video_id", F.decode("content", "UTF-8").alias("vtt")))
    return said, got.where("not ok").select(F.col("video_id").alias("request_id"), "error")


def stored_keys(talent: DataFrame, frames: DataFrame | None, videos: DataFrame, plugins: Plugins) -> DataFrame:
    """Keys of the frames that were read, encoded and stored."""
    wanted = talent.select("video_id", "frame_idx", F.col("s3_key").alias("key"))
    if frames is not None:
        wanted = wanted.unionByName(frames.select("video_id", F.col("frame_index").alias("frame_idx"), F.col("s3_key").alias("key")))
    encoded = media.encoded_frames(wanted.join(videos.select("video_id", "width", "height"), "video_id"), plugins.encoder)
    done = objects.store_objects(encoded, plugins.object_root) if plugins.object_root else sinks.put_objects(encoded, plugins.put)
    return materialise(done.where("ok").select(F.col("key").alias("stored_key")), "stored-keys")


def sampled(videos: DataFrame, detections: DataFrame | None, profile: Profile, detector, progress: Progress | None = None, spent: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames looked at, raw detections). Long videos of a two-pass profile are looked at coarsely first. What a detector
    finds is stored, so that it runs once; spent gets what each pass took: video_id, frames and seconds."""
    progress = progress or Progress(videos.sparkSession)

    def see(samples: DataFrame, stage: str = "detect") -> DataFrame:
        if detector is None:
            return detections.join(samples.select("video_id", "frame_idx").distinct(), ["video_id", "frame_idx"], "left_semi")
        found = media.watched(samples, detector)
        found = materialise(progress.watch(found, stage, frames=F.col("frames"), seconds=F.col("seconds")), stage)
        progress.done(stage)
        if spent is not None:
            spent.append(found.where("det_ord is null").select("video_id", "frames", "seconds"))
        return found.where("det_ord is not null").drop("frames", "seconds")

    if profile.two_pass_from is None:
        samples = sampling.uniform_samples(videos, profile)
        return samples, see(samples)
    seconds = sampling.duration(F.col("total_frames"), F.col("fps"))
    short, long = videos.where(seconds < profile.two_pass_from), videos.where(seconds >= profile.two_pass_from)
    coarse = sampling.coarse_samples(long)
    roi = sampling.with_faces(coarse, see(coarse, "detect-coarsely"))
    refined = sampling.refined_samples(checkpointed(sampling.regions(roi)), long).select("video_id", "frame_idx", "ts")
    samples = sampling.uniform_samples(short, profile).unionByName(refined)
    return samples, see(samples)


def seconds_of(spent: list[DataFrame]) -> DataFrame | None:
    """Per video the frames that a detector looked at, the seconds that took, and those of all its measured work."""
    if not spent:
        return None
    rows = [s.select("video_id", "frames" if "frames" in s.columns else F.lit(None).cast("long").alias("frames"), "seconds") for s in spent]
    looked = F.col("frames").isNotNull()
    return reduce(DataFrame.unionByName, rows).groupBy("video_id").agg(F.sum("frames").alias("looked_frames"), F.sum(F.when(looked, F.col("seconds"))).alias("looked_seconds"), F.sum("seconds").alias("work_seconds"))


def run(request_rows: DataFrame, plugins: Plugins, profile: Profile = CANONICAL) -> tuple[DataFrame, DataFrame]:
    """(payload per video, requests that ended with an error). Elapsed time, unless injected, is what a video's own work
    took in tasks (probing it and looking at its frames), and an equal share of what else the run took up to the
    payloads."""
    watch, measured = media.Stopwatch(), media.Stopwatch(running=False)
    progress = Progress(request_rows.sparkSession, plugins.log)
    spent = []
    if plugins.detector is not None:
        media.require(plugins.detector)
    rows = requests.missing_parameters(request_rows).withColumn("source_url", F.concat_ws("/", "bucket", "video_key")).withColumn("caption_url", F.col("transcript_key")) if profile.key_prefix == "account" else requests.resolved(request_rows, plugins.fallback_base)
    good, failed = requests.split_errors(rows)
    errors = failed.select("request_id", "error")
    captions = plugins.captions if profile.transcript else None
    if captions is None and profile.transcript and plugins.fetcher is not None:
        captions, silent = fetched_captions(good, plugins)
        if profile.transcript_errors_fail:
            errors = errors.unionByName(silent)
            good = good.join(silent.select("request_id"), "request_id", "left_anti")
    videos = plugins.videos
    if videos is None:
        with measured:
            videos, unread = probed_videos(good, plugins)
        spent.append(videos.select("video_id", "seconds"))
        videos = videos.drop("seconds")
        errors = errors.unionByName(unread)
    videos = sampling.quarantine(videos.where("video_id is not null").withColumn("duration", sampling.duration(F.col("total_frames"), F.col("fps"))))
    errors = errors.unionByName(good.join(videos.where("error is not null").select(F.col("video_id").alias("request_id"), F.col("error").alias("why")), "request_id").select("request_id", F.col("why").alias("error")))
    videos = videos.where("error is null").drop("error").join(good.select(F.col("request_id").alias("video_id")), "video_id", "left_semi")
    with measured:
        samples, raw = sampled(videos, plugins.detections, profile, plugins.detector, progress, spent)
    ranked = checkpointed(scoring.scored(raw, videos, profile))
    best = selection.best_per_person(ranked, clustering.clusters(ranked, plugins.eps))
    best = best.join(videos.select("video_id", "fps"), "video_id").withColumn("ts", sampling.timestamp(F.col("frame_idx"), F.col("fps"))).drop("fps")
    if captions is not None:
        best = context.with_context(best, captions)
    else:
        best = best.withColumns({"speaker": F.lit(None).cast("string"), "context_text": F.lit(None).cast("string")})
    jobs = payload.with_job(good.withColumnRenamed("request_id", "video_id").drop("error"), plugins.date, plugins.job_id).join(videos, "video_id").withColumn("base_path", payload.base_path(profile))
    looked = samples.groupBy("video_id").agg(F.count(F.lit(1)).alias("inference_frames"))
    jobs = jobs.join(looked, "video_id", "left")
    taken = seconds_of(spent)
    if taken is not None:
        jobs = jobs.join(taken, "video_id", "left").withColumn("inference_frames", F.coalesce("looked_frames", "inference_frames"))
    else:
        jobs = jobs.withColumns({c: F.lit(None).cast("double") for c in ("looked_seconds", "work_seconds")})
    if captions is not None:
        counts = captions.groupBy("video_id").agg(F.count(F.lit(1)).cast("int").alias("entries_count"))
        jobs = jobs.join(counts, "video_id", "left").join(vtt.transcripts(captions), "video_id", "left")
    else:
        jobs = jobs.withColumns({"entries_count": F.lit(None).cast("int"), "transcription": F.lit(None).cast("string")})
    jobs = checkpointed(jobs.withColumn("accelerator", F.lit(plugins.accelerator)))  # ids and dates are drawn once
    if profile.archive and plugins.archive is not None and plugins.ranges is not None:
        files = jobs.select(F.concat("base_path", F.lit("/video.mp4")).alias("key"), F.col("source_url").alias("url"), "video_id")
        whole = parts.store_files(files, plugins.ranges, plugins.archive).where("error is null").select("key")
        kept = materialise(files.join(whole, "key").select("video_id", F.col("key").alias("archived_s3_key"), F.concat(F.lit(plugins.url_base), "key").alias("archived_s3_url")), "archived")
        jobs = jobs.join(kept, "video_id", "left")
    elif profile.archive and plugins.put is not None and plugins.fetcher is not None:
        content = media.fetched(jobs.select("video_id", "source_url"), "source_url", plugins.fetcher).where("ok")
        kept = materialise(sinks.archived(jobs, content, plugins.put, sinks.iso_now(), plugins.url_base), "archived")
        jobs = jobs.join(kept, "video_id", "left")
    else:
        jobs = jobs.withColumns({"archived_s3_key": F.lit(None).cast("string"), "archived_s3_url": F.lit(None).cast("string")})
    talent = payload.talent_frames(best, jobs, profile, plugins.url_base)
    frames = payload.representative_rows(sampling.representative_frames(videos, profile.pad_frames), jobs, plugins.url_base) if profile.representative_frames else None
    if plugins.encoder is not None and (plugins.put is not None or plugins.object_root):
        talent = checkpointed(talent)
        stored = stored_keys(talent, frames, videos, plugins)
        talent = talent.join(stored, F.col("s3_key") == F.col("stored_key"), "left_semi")
        frames = frames.join(stored, F.col("s3_key") == F.col("stored_key"), "left_semi") if frames is not None else None
    if plugins.elapsed is not None:
        jobs = jobs.withColumns({"elapsed_seconds": plugins.elapsed, "inference_seconds": plugins.elapsed})
    else:
        share = F.lit(max(0.0, watch.seconds() - measured.seconds()) / max(1, jobs.count()))
        jobs = jobs.withColumns({"elapsed_seconds": F.coalesce("work_seconds", F.lit(0.0)) + share, "inference_seconds": F.coalesce("looked_seconds", share)})
    return payload.payloads(jobs, talent, frames, profile), errors


def analyse(request_rows: DataFrame, plugins: Plugins, profile: Profile = CANONICAL, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """run, and its results delivered: written as JSON to out, and posted to the webhook, each if given."""
    results, errors = run(request_rows, plugins, profile)
    results = checkpointed(results)
    if out:
        sinks.write_json(results, out)
    sinks.post_results(results, plugins.webhook, post=plugins.post)
    return results, errors
