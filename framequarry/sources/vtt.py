"""WebVTT captions: text to rows in Spark, and a data source for files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from framequarry.functions.scalars import TRANSCRIPT_LIMIT, one_line, py_fixed, shortened, speaker_of, speech_of, vtt_seconds

TIMING = r"^\s*((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})\s+-->\s+((?:\d+:)?\d{1,2}:\d{2}[.,]\d{1,3})"


def parse_captions(tracks: DataFrame) -> DataFrame:
    """(video_id, vtt) to (video_id, ordinal, start, end, speaker, text); blocks without a timing line are skipped.

    Blocks are separated by blank lines; what stands above the timing line is the cue's name.
    """
    cue = F.split(F.regexp_replace("vtt", r"\r\n?", "\n"), r"\n[ \t]*\n+")
    lines = F.transform(cue, lambda c: F.split(c, "\n"))
    at = lambda x: F.array_position(F.transform(x, lambda y: y.rlike(TIMING)), True).cast("int")

    def read(x):
        timing = F.get(x, at(x) - 1)
        stamp = lambda k: vtt_seconds(F.regexp_extract(timing, TIMING, k))
        return F.struct(stamp(1).alias("start"), stamp(2).alias("end"), F.array_join(F.slice(x, at(x) + 1, F.size(x)), "\n").alias("text"))

    found = F.transform(F.filter(lines, lambda x: at(x) > 0), read)
    # Ordinals are places in the track's own array, so no track is sorted or gathered.
    rows = tracks.select("video_id", F.posexplode(F.filter(found, lambda x: x["start"].isNotNull() & x["end"].isNotNull())).alias("ordinal", "cue"))
    return spoken(rows.select("video_id", "ordinal", "cue.start", "cue.end", one_line(F.regexp_replace("cue.text", r"<[^<>]*>", "")).alias("line")), "line")


def spoken(rows: DataFrame, line: str) -> DataFrame:
    """Splits a caption's line into speaker and text."""
    clean = F.col(line)
    return rows.select("video_id", "ordinal", "start", "end", speaker_of(clean).alias("speaker"), speech_of(clean).alias("text"))


def first_lines(rows, limit: int) -> list[tuple]:
    """The first (ordinal, line) rows in order, up to the one with which the joined lines get longer than limit.

    Lines that fill the limit exactly are not enough: whether any other follows tells if the text is shortened.
    """
    out, length = [], -1
    for row in sorted(rows):
        if length > limit:
            break
        out.append(row)
        length += len(row[1]) + 1
    return out


def first_captions(lines: DataFrame, limit: int, held: int = 20_000) -> DataFrame:
    """The lines (video_id, ordinal, s) of each video that its text of limit characters can begin with, as one row
    (video_id, ordinals, said) a video.

    A bounded aggregate: the beginning of a whole is made of the beginnings of its parts. Every task keeps the beginnings
    of the videos it reads and passes them on; these are merged for 64 parts of a video, and then for the video.
    """
    kind = lines.schema["video_id"].dataType.simpleString()
    names = ["video_id", "part", "ordinals", "said"]

    def rows_of(videos, parts, beginnings, video_type):
        return [pa.array(videos, video_type), pa.array(parts, pa.int32()), pa.array([[o for o, _ in b] for b in beginnings], pa.list_(pa.int64())), pa.array([[s for _, s in b] for b in beginnings], pa.list_(pa.string()))]

    def partial(batches):
        part, found, count = TaskContext.get().partitionId() % 64, {}, 0

        def out():
            arrays = rows_of(list(found), [part] * len(found), [first_lines(x, limit) for x in found.values()], video_type)
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            video_type = batch.column(0).type
            for video, ordinal, said in zip(*(c.to_pylist() for c in batch.columns)):
                own = found.setdefault(video, [])
                own.append((ordinal, said))
                count += 1
                if len(own) > 2 * limit:
                    found[video] = first_lines(own, limit)
            if count > held:
                yield out()
                found, count = {}, 0
        if found:
            yield out()

    def merge(got):
        rows = [r for ordinals, said in zip(got["ordinals"].to_pylist(), got["said"].to_pylist()) for r in zip(ordinals, said)]
        return pa.table(rows_of(got["video_id"][:1].to_pylist(), [0], [first_lines(rows, limit)], got["video_id"].type), names=names)

    schema = f"video_id {kind}, part int, ordinals array<long>, said array<string>"
    first = lines.select("video_id", F.col("ordinal").cast("long").alias("ordinal"), "s").mapInArrow(partial, schema)
    return first.groupBy("video_id", "part").applyInArrow(merge, schema).groupBy("video_id").applyInArrow(merge, schema).drop("part")


def transcripts(captions: DataFrame) -> DataFrame:
    """One text per video: "[12.0s] Speaker: words", captions without text left out, shortened to a thousand characters.

    Only captions that the shortened text can show travel (first_captions), so no video's list grows with it.
    """
    said = F.concat(F.lit("["), py_fixed(F.col("start"), 1), F.lit("s] "), F.coalesce(F.when(F.col("speaker") != "", F.concat("speaker", F.lit(": "))), F.lit("")), F.col("text"))
    lines = captions.where("text is not null and text <> ''").select("video_id", "ordinal", said.alias("s"))
    return first_captions(lines, TRANSCRIPT_LIMIT).select("video_id", shortened(F.array_join("said", " ")).alias("transcription"))


class VttFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class VttReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """Files that match the path's pattern, of any file system that Arrow opens; the driver lists names only."""
        import fnmatch

        from pyarrow import fs

        path = self.options["path"]
        fixed = re.match(r"[^*?\[]*", path)[0]
        if fixed == path:
            return [VttFile(path)]
        folder, scheme = fixed[: fixed.rindex("/") + 1], re.match(r"[A-Za-z][A-Za-z0-9+.-]*://|", path)[0]
        system, root = fs.FileSystem.from_uri(folder)
        pattern = root.rstrip("/") + "/" + path[len(folder) :]
        found = system.get_file_info(fs.FileSelector(root, recursive="/" in path[len(folder) :]))
        return [VttFile((scheme if scheme else "") + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and fnmatch.fnmatch(f.path, pattern)]

    def read(self, partition: VttFile) -> Iterator[tuple]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path) as f:
            text = re.sub(r"\r\n?", "\n", f.read().decode("utf-8"))
        ordinal = 0
        for block in re.split(r"\n[ \t]*\n+", text):
            lines = block.split("\n")
            for k, line in enumerate(lines):
                if m := re.match(TIMING, line):
                    yield partition.path, ordinal, seconds(m[1]), seconds(m[2]), "\n".join(lines[k + 1 :])
                    ordinal += 1
                    break


def seconds(stamp: str) -> float:
    total = 0.0
    for part in stamp.replace(",", ".").split(":"):
        total = total * 60 + float(part)
    return total


class VttSource(DataSource):
    """spark.read.format("vtt").load(glob) over files of a system that Arrow opens on every executor; any other store goes
    through spark.read.text(wholetext=True) and parse_captions."""

    @classmethod
    def name(cls) -> str:
        return "vtt"

    def schema(self) -> str:
        return "path string, ordinal int, start double, end double, line string"

    def reader(self, schema) -> VttReader:
        return VttReader(self.options)


def read_captions(spark, path: str) -> DataFrame:
    """Caption files at a path of any file system, parsed in Spark; video_id is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("video_id"), F.col("value").alias("vtt"))
    return parse_captions(files)
