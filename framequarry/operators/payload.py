"""Result rows: keys and names of artifacts, metrics, and the nested payload of each video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framequarry.functions.scalars import object_key, person_name, py_round, target_size
from framequarry.plans.profiles import Profile


def base_path(profile: Profile) -> Column:
    """Prefix of a job's artifacts; columns date_folder and job_id, or main_folder, account_id and content_id."""
    if profile.key_prefix == "account":
        return object_key(F.col("main_folder"), F.col("account_id"), F.col("content_id"), F.lit("extraction-talent-frames"))
    return object_key(F.lit("extracted-frames"), F.col("date_folder"), F.col("job_id"))


def cost(seconds: Column, price: float) -> Column:
    return py_round(seconds * price, 4)


def throughput(frames: Column, seconds: Column) -> Column:
    """Frames per second; 0 without time."""
    return F.when(seconds > 0, frames / F.nullif(seconds, F.lit(0.0))).otherwise(F.lit(0.0))


def resolution(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def with_job(rows: DataFrame, date: Column | None = None, job_id: Column | None = None) -> DataFrame:
    """Adds date_folder and job_id; injected in tests, else today's date and eight hexadecimal digits."""
    fresh = F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(8))
    return rows.withColumn("date_folder", date if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")).withColumn("job_id", job_id if job_id is not None else fresh)


def talent_frames(best: DataFrame, jobs: DataFrame, profile: Profile, url_base: str = "") -> DataFrame:
    """One row per person of a video: person_id, frame, file, key, URL, name, spoken text, time and score, and target size."""
    rows = best.join(jobs.select("video_id", "base_path", "width", "height"), "video_id")
    filename = F.concat(F.lit("person_"), F.col("person_id").cast("string"), F.lit(".jpg"))
    key = object_key(F.col("base_path"), F.lit("talent"), filename)
    score = F.col("score").cast("double")
    return rows.select(
        "video_id",
        "frame_idx",
        "person_id",
        filename.alias("filename"),
        key.alias("s3_key"),
        F.concat(F.lit(url_base), key).alias("s3_url"),
        person_name(F.col("speaker"), F.col("person_id")).alias("name"),
        "context_text",
        py_round(F.col("ts"), 2).alias("timestamp"),
        (py_round(score, 2) if profile.round_scores else score).alias("score"),
        resolution(target_size(F.col("width"), F.col("height"))["width"], target_size(F.col("width"), F.col("height"))["height"]).alias("resolution"),
    )


def representative_rows(picks: DataFrame, jobs: DataFrame, url_base: str = "") -> DataFrame:
    rows = picks.join(jobs.select("video_id", "base_path", "fps"), "video_id")
    filename = F.concat(F.lit("frame_"), F.lpad(F.col("ordinal").cast("string"), 3, "0"), F.lit(".jpg"))
    key = object_key(F.col("base_path"), F.lit("representative"), filename)
    return rows.select("video_id", "ordinal", F.col("frame_idx").alias("frame_index"), filename.alias("filename"), key.alias("s3_key"), F.concat(F.lit(url_base), key).alias("s3_url"), py_round(F.try_divide(F.col("frame_idx").cast("double"), F.col("fps")), 2).alias("timestamp"))


def listed(rows: DataFrame, order: str, name: str, drop: list[str] | None = None) -> DataFrame:
    """Rows of each video as one array of structs in the given order."""
    rest = [c for c in rows.columns if c not in ("video_id", *(drop or []))]
    return rows.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("v")))), lambda x: x["v"]).alias(name))


def payloads(jobs: DataFrame, talent: DataFrame, frames: DataFrame | None, profile: Profile) -> DataFrame:
    """One nested row per video; jobs has what the video, its captions and the run are known by."""
    rows = jobs.join(listed(talent, "person_id", "talent_frames", ["frame_idx"]), "video_id", "left")
    empty = F.array().cast(rows.schema["talent_frames"].dataType)
    rows = rows.withColumn("talent_frames", F.coalesce("talent_frames", empty))
    columns = ["video_id", F.lit("success").alias("status")]
    if profile.key_prefix == "dated":
        columns += ["job_id", "date_folder", "base_path", "metadata"]
    else:
        columns += ["account_id", "content_id", "custom_metadata"]
    metrics = [py_round(F.col("elapsed_seconds"), 2).alias("duration_seconds"), cost(F.col("elapsed_seconds"), profile.price_per_second).alias("estimated_cost_usd"), F.col("accelerator").alias("gpu_type")]
    if profile.inference_fps:
        metrics.append(throughput(F.col("inference_frames"), F.col("inference_seconds")).alias("inference_fps"))
    video = [py_round(F.col("duration"), 2).alias("duration_seconds"), "total_frames", py_round(F.col("fps"), 2).alias("fps"), resolution(F.col("width"), F.col("height")).alias("resolution"), F.col("source_url")]
    if profile.archive:
        video += ["archived_s3_key", "archived_s3_url"]
    columns += [F.struct(*metrics).alias("processing_metrics"), F.struct(*video).alias("video_metadata")]
    if profile.key_prefix == "dated":
        columns += [F.when(F.col("caption_url").isNotNull(), F.struct(F.col("caption_url").alias("source_url"), F.coalesce("entries_count", F.lit(0)).alias("entries_count"))).alias("transcript_metadata"), F.coalesce("transcription", F.lit("")).alias("transcription")]
    columns += [F.size("talent_frames").alias("talent_count"), "talent_frames"]
    if frames is not None:
        rows = rows.join(listed(frames, "ordinal", "representative_frames", ["ordinal"]), "video_id", "left")
        columns.append(F.coalesce("representative_frames", F.array().cast(rows.schema["representative_frames"].dataType)).alias("representative_frames"))
    return rows.select(*columns)
