"""Declared schemas of the recording tables; nothing is inferred at read time."""

from pyspark.sql import types as T

_POSE = T.ArrayType(T.DoubleType())
_LONG, _DOUBLE, _STRING = T.LongType(), T.DoubleType(), T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


DEPTH_HEADER = _struct(t_ns=_LONG, width=T.IntegerType(), height=T.IntegerType(), intrinsics=_POSE)
CAMERA = _struct(
    exposure_ns=_LONG, frame_duration_ns=_LONG, rolling_shutter_skew_ns=_LONG,
    focus_distance_dpt=_DOUBLE, iso=T.IntegerType(), ois_mode=T.IntegerType(),
)
TRACKER = _struct(
    t_ns=_LONG, tracking=_STRING, failure=_STRING, pose=_POSE, device_pose=_POSE, intrinsics=_POSE,
    texture_intrinsics=_POSE, points=T.ArrayType(_POSE), depth=DEPTH_HEADER,
    anchor=_struct(id=_LONG, pose=_POSE), anchors=T.ArrayType(_POSE),
)
FRAME = _struct(
    n=_LONG, seq=_LONG, camera_t_ns=_LONG, wall_ms=_LONG, host_received_ms=_DOUBLE,
    grey=_struct(width=T.IntegerType(), height=T.IntegerType()), camera=CAMERA, arcore=TRACKER,
)
IMU = _struct(
    sensor=_STRING, t_ns=_LONG, x=_DOUBLE, y=_DOUBLE, z=_DOUBLE, bx=_DOUBLE, by=_DOUBLE, bz=_DOUBLE
)
RUN = _struct(
    recording=_STRING, tool=_STRING, folder=_STRING, label=_STRING, status=_STRING, started=_STRING,
    settings=T.MapType(_STRING, _STRING), numbers=T.MapType(_STRING, _DOUBLE),
)
UPDATE = _struct(
    run=_STRING, update=_LONG,
    detections=T.ArrayType(_struct(
        label=_STRING, confidence=_DOUBLE, outcome=_STRING, object_id=_STRING, nearest_same_class_m=_DOUBLE,
    )),
    stage_ms=T.MapType(_STRING, _DOUBLE), scale=_DOUBLE, scale_source=_STRING,
)
CALIBRATION = _struct(
    camera=_struct(
        fx=_DOUBLE, fy=_DOUBLE, cx=_DOUBLE, cy=_DOUBLE, width=T.IntegerType(), height=T.IntegerType()
    ),
    distortion=_POSE,
    imu_from_camera=T.ArrayType(_POSE),
)
DEPTH_PIXEL = _struct(
    recording=_STRING, seq=_LONG, row=T.IntegerType(), col=T.IntegerType(), depth_m=_DOUBLE,
    confidence=T.IntegerType(),
)

# counters every telemetry record must carry, fixed values
TELEMETRY_FIELDS = (
    "elapsed_realtime_ns", "wall_ms", "battery_pct", "thermal_status", "free_bytes", "queue_frames",
    "queue_bytes", "frames_captured", "frames_queued", "frames_sent", "frames_acknowledged",
    "frames_dropped", "arcore_update_ms",
)
