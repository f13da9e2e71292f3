"""Scans of recording folders, and the row-level parsers those scans share with in-memory text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry as g
from ..operators.ordered import carried

LINE_CHUNK = 4096
NUMBER = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"


def recording_of(path: Column, depth: int = 2) -> Column:
    """The folder name `depth` parts from the end of a file path."""
    return F.element_at(F.split(path, "/"), -depth)


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Frame headers of every recording under `path`, one JSON line each."""
    reader = spark.readStream if stream else spark.read
    frames = reader.schema(schemas.FRAME).json(path)
    return frames.withColumn("recording", recording_of(F.col("_metadata.file_path")))


def read_imu(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    rows = reader.schema(schemas.IMU).option("header", True).csv(path)
    return rows.withColumn("recording", recording_of(F.col("_metadata.file_path")))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.RUN).option("multiLine", True).json(f"{root}/*/*/*/run.json")


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.UPDATE).json(path)


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.CALIBRATION).option("multiLine", True).json(path)
    return rows.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small text files with their line number, each file split by the caller's parser."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def flatten_tracker(frames: DataFrame, keys: Sequence[str] = ("recording", "seq")) -> DataFrame:
    """The nested tracker record as flat columns; an absent record is reported as NO_ARCORE."""
    t = F.col("arcore")
    return frames.select(
        *keys,
        F.coalesce(t["tracking"], F.lit("ABSENT")).alias("tracking"),
        F.when(t.isNull(), "NO_ARCORE").otherwise(t["failure"]).alias("failure"),
        t["t_ns"].alias("tracker_t_ns"), t["pose"].alias("pose"), t["device_pose"].alias("device_pose"),
        t["intrinsics"].alias("intrinsics"), t["depth"].alias("depth"),
        F.coalesce(F.size(t["points"]), F.lit(0)).alias("point_count"),
    )


def tracked_points(frames: DataFrame, keys: Sequence[str] = ("recording", "seq")) -> DataFrame:
    p = F.col("p")
    names = ("x", "y", "z", "u", "v", "confidence")
    return frames.select(*keys, F.explode("arcore.points").alias("p")).select(
        *keys, p[0].cast("long").alias("point_id"), *[p[i + 1].alias(n) for i, n in enumerate(names)]
    )


def anchor_events(frames: DataFrame, keys: Sequence[str] = ("recording", "seq")) -> DataFrame:
    """Anchor creations and corrections as rows; creation sorts before corrections of one frame."""
    created = frames.where("arcore.anchor is not null").select(
        *keys, F.col("arcore.anchor.id").alias("anchor_id"), F.lit("created").alias("kind"),
        F.col("arcore.anchor.pose").alias("pose"),
    )
    updated = frames.select(*keys, F.explode("arcore.anchors").alias("a")).select(
        *keys, F.col("a")[0].cast("long").alias("anchor_id"), F.lit("updated").alias("kind"),
        F.slice("a", 2, 7).alias("pose"),
    )
    return created.unionByName(updated)


def missing_counters(lines: DataFrame, text: str, fields: Sequence[str] = schemas.TELEMETRY_FIELDS) -> DataFrame:
    """Number of telemetry counters a record lacks; an explicit null is present."""
    record = F.from_json(F.col(text), "map<string,string>")
    wanted = F.array(*[F.lit(f) for f in fields])
    return lines.withColumn(
        "missing", F.size(F.array_except(wanted, F.coalesce(F.map_keys(record), F.array().cast("array<string>"))))
    ).withColumn("complete", F.col("missing") == 0)


def committed_rows(
    log: DataFrame, commits: DataFrame, text: str, keys: Sequence[str] = ("recording",)
) -> DataFrame:
    """Log rows covered by the last readable commit line of their recording."""
    message = F.from_json(F.col(text), "n bigint")
    through = (
        commits.select(*keys, message["n"].alias("_n")).where("_n is not null")
        .groupBy(*keys).agg(F.max("_n").alias("through"))
    )
    return log.join(through, list(keys)).where("n <= through")


def _decode_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("recording", pa.string()), ("seq", pa.int64()), ("row", pa.int32()), ("col", pa.int32()),
        ("depth_m", pa.float64()), ("confidence", pa.int32()),
    ])
    for batch in batches:
        for record in batch.to_pylist():
            height, width, content = record["height"], record["width"], record["content"]
            if len(content) != width * height * 3:
                raise ValueError(f"{record['recording']}/{record['seq']}: depth size is not {width} x {height}")
            cut = width * height * 2
            depth = np.frombuffer(content[:cut], "<u2").reshape(height, width)
            confidence = np.frombuffer(content[cut:], np.uint8).reshape(height, width)
            rows, cols = np.nonzero(depth)
            count = len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([record["recording"]] * count, pa.string()),
                    pa.array(np.full(count, record["seq"], np.int64)),
                    pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)),
                    pa.array(depth[rows, cols] / 1000.0),
                    pa.array(confidence[rows, cols].astype(np.int32)),
                ],
                schema=schema,
            )


def read_depth_pixels(spark: SparkSession, path: str, frames: DataFrame) -> DataFrame:
    """Raw depth files as pixel rows: 16-bit millimetres then 8-bit confidence; zero is missing."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
        .select(
            recording_of(F.col("path"), 3).alias("recording"),
            F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("seq"), "content",
        )
    )
    sizes = frames.where("arcore.depth is not null").select(
        "recording", "seq", F.col("arcore.depth.width").alias("width"), F.col("arcore.depth.height").alias("height")
    )
    return files.join(sizes, ["recording", "seq"]).mapInArrow(_decode_depth, schemas.DEPTH_PIXEL)


def exact_nanoseconds(seconds: Column) -> Column:
    """Exact nanoseconds of decimal seconds text."""
    return (seconds.cast("decimal(30,9)") * F.lit(1_000_000_000)).cast("long")


def _numbers(line: Column, separator: str = r"\s+") -> Column:
    return F.split(F.trim(line), separator)


def _doubles(parts) -> Column:
    """All parts as doubles, null where one is not a number; computed once, then indexed."""
    return F.transform(parts, lambda p: p.try_cast("double"))


def parse_tum(lines: DataFrame, keys: Sequence[str], line_no: str = "line_no", line: str = "line") -> DataFrame:
    """`time x y z qx qy qz qw` lines; comments and blanks dropped, extra columns ignored.

    Every broken rule becomes the row's `problem` instead of stopping the job.
    """
    parts = lines.where(~F.trim(line).rlike("^(#.*)?$")).withColumn("_p", _numbers(F.col(line)))
    parts = parts.withColumn("_v", _doubles("_p"))
    value = [F.get("_v", F.lit(i)) for i in range(8)]
    named = dict(zip(("x", "y", "z", "qx", "qy", "qz", "qw"), value[1:]))
    rows = parts.withColumns({
        "t_ns": F.when(F.get("_p", F.lit(0)).rlike(NUMBER), exact_nanoseconds(F.get("_p", F.lit(0)))),
        "_columns": F.size("_p"), **named,
    }).drop("_p", "_v")
    rows = carried(
        rows, keys, [line_no], F.floor(F.col(line_no) / LINE_CHUNK), lag={"_before": "t_ns"}
    )
    norm = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2)
    return rows.withColumn(
        "problem",
        F.when(F.col("_columns") < 8, "columns")
        .when(F.col("t_ns").isNull() | norm.isNull(), "number")
        .when(F.col("t_ns") <= F.col("_before"), "order")
        .when(F.abs(norm - 1) >= 1e-3, "quaternion"),
    ).drop("_before", "_columns", line)


def parse_wide_csv(
    lines: DataFrame, columns: Sequence[int], quaternion: str = "xyzw", time_scale: float = 1e-9,
    line: str = "line",
) -> DataFrame:
    """Wide CSV poses: chosen columns, either quaternion order, quaternion normalised."""
    cells = lines.where(F.trim(line).rlike(r"^\d")).withColumn("_c", _doubles(F.split(line, ",")))
    value = [F.get("_c", F.lit(i)) for i in columns]
    x, y, z, w = value[4:8] if quaternion == "xyzw" else (value[5], value[6], value[7], value[4])
    size = F.sqrt(x * x + y * y + z * z + w * w)
    return cells.withColumns({
        "t_s": value[0] * time_scale,
        "pose": g.pose_from_quaternion(value[1:4], [x / size, y / size, z / size, w / size]),
    }).drop("_c", line)


def parse_slam(lines: DataFrame, line: str = "line") -> DataFrame:
    """`time segment x y z qx qy qz qw` rows; `time lost` keeps its time with null segment and pose."""
    parts = lines.where(F.trim(line) != "").withColumn("_p", _numbers(F.col(line)))
    parts = parts.withColumn("_v", _doubles("_p"))
    lost = F.get("_p", F.lit(1)) == "lost"
    value = [F.get("_v", F.lit(i)) for i in range(9)]
    size = F.sqrt(sum((value[i] * value[i] for i in range(6, 9)), value[5] * value[5]))
    placed = g.pose_from_quaternion(value[2:5], [v / size for v in value[5:9]])
    return parts.withColumns({
        "t_s": value[0],
        "segment": F.when(~lost, F.get("_p", F.lit(1)).try_cast("long")),
        "pose": F.when(~lost, placed),
    }).drop("_p", "_v", line)


def parse_trajectory(lines: DataFrame, time_scale: float = 1.0, line: str = "line") -> DataFrame:
    """A one-map final trajectory; rows without exactly eight numbers are skipped."""
    eight = lines.where(F.size(_numbers(F.col(line))) == 8)
    parts = F.split(F.trim(line), r"\s+")
    widened = eight.withColumn(
        line, F.concat_ws(" ", parts[0], F.lit("0"), F.slice(parts, 2, 7))
    )
    return parse_slam(widened, line).withColumn("t_s", F.col("t_s") * time_scale)


def parse_timestamp_table(
    lines: DataFrame, keys: Sequence[str], line_no: str = "line_no", line: str = "line"
) -> DataFrame:
    """Two-column `time path` tables; the first broken rule of each row goes to `problem`."""
    rows = lines.where(~F.trim(line).rlike("^(#.*)?$")).withColumn("_p", _numbers(F.col(line)))
    rows = rows.withColumns({"t_s": F.get("_p", F.lit(0)).try_cast("double"), "path": F.get("_p", F.lit(1))})
    rows = carried(
        rows, keys, [line_no], F.floor(F.col(line_no) / LINE_CHUNK), lag={"_before": "t_s"}
    )
    return rows.withColumn(
        "problem",
        F.when(F.size("_p") != 2, "columns")
        .when(F.col("t_s").isNull() | F.isnan("t_s") | (F.abs("t_s") == float("inf")), "time")
        .when(
            F.col("path").rlike(r"^/") | F.col("path").rlike(r"^[A-Za-z]:") | F.col("path").contains("\\")
            | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path",
        )
        .when(F.col("t_s") <= F.col("_before"), "order"),
    ).drop("_p", "_before", line)


def rigid_problem(matrix: Column, off: float = 1e-6, relative: float = 1e-5) -> Column:
    """`rotation` when R R^T differs from the identity, for a 12-entry pose."""
    r = g.rotation_of(matrix)
    worst = F.lit(False)
    for i in range(3):
        for j in range(i, 3):
            product = g.dot(r[3 * i:3 * i + 3], r[3 * j:3 * j + 3])
            limit = off + relative if i == j else off
            worst = worst | (F.abs(product - (1.0 if i == j else 0.0)) > limit)
    return F.when(worst, "rotation")


def calibration_problem(fx: Column, fy: Column, width: Column, height: Column, matrix: Column) -> Column:
    positive = (fx > 0) & (fy > 0) & (width > 0) & (height > 0)
    return F.when(~positive, "camera").otherwise(rigid_problem(matrix))


def image_annotations(
    images: DataFrame, annotations: DataFrame, categories: DataFrame, detector: DataFrame
) -> DataFrame:
    """Annotations of each image with the detector's class matched by category name.

    images(image_id, width, height); annotations(image_id, instance_id, category_id, x, y, w, h, area,
    iscrowd); categories(category_id, category); detector(class_id, category).
    """
    mapped = categories.join(detector, "category", "left")
    return (
        images.join(annotations, "image_id", "left").join(mapped, "category_id", "left")
        .withColumns({
            "x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"),
        }).drop("x", "y", "w", "h")
    )


def image_records(annotations: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Nested record per image, crowds apart from references; very full images span several parts."""
    sizes = annotations.groupBy("image_id").agg(F.count("instance_id").alias("_n"))
    entry = F.struct("instance_id", "category", "x1", "y1", "x2", "y2", "area")
    return (
        annotations.join(sizes, "image_id")
        .withColumn("part", F.pmod(F.xxhash64("instance_id"), F.greatest(F.ceil(F.col("_n") / part_size), F.lit(1))))
        .groupBy("image_id", "part")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("instance_id").isNotNull() & ~F.col("iscrowd"), entry))).alias("references"),
            F.array_sort(F.collect_list(F.when(F.col("iscrowd"), entry))).alias("crowds"),
        )
    )


def filter_runs(
    runs: DataFrame, recording: str | None = None, tool: str | None = None, grep: str | None = None,
    where: Sequence[str] = (),
) -> DataFrame:
    """Runs by recording, tool, label text and `setting=value` items; newest folder first."""
    kept = runs
    if recording:
        kept = kept.where(F.col("recording") == recording)
    if tool:
        kept = kept.where(F.col("tool") == tool)
    if grep:
        kept = kept.where(F.col("label").contains(grep))
    for item in where:
        key, _, value = item.partition("=")
        kept = kept.where(F.col("settings")[key].contains(value))
    return kept.orderBy(F.col("folder").desc())


def explode_updates(updates: DataFrame) -> DataFrame:
    """One row per detection; an update without detections stays as one row without one."""
    return updates.select("run", "update", F.explode_outer("detections").alias("d")).select(
        "run", "update", "d.*"
    )
