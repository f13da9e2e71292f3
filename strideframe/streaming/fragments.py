"""A fused surface kept fragment by fragment: a batch rewrites the fragments it touches and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAGMENT = ["recording", "fragment"]
VOXEL = ["ix", "iy", "iz"]
SUMS = ["samples", "sum_x", "sum_y", "sum_z"]
DATA = "member long, ix long, iy long, iz long, samples long, sum_x double, sum_y double, sum_z double, touched long, version long, recording long, fragment long"
MANIFEST = "recording long, fragment long, version long, replaced long"


class FragmentStore:
    """Voxel sums under data/version=V/recording=R/fragment=F; a manifest names the version that holds each folder.

    A folder holds `span` fragments that follow each other (`member` is the fragment), so that many small fragments
    do not make as many files; it is rewritten whole. `touched` is the last batch with points of the row's fragment.

    A batch merges its sums with the old ones of the fragments it touches, writes those as a new version and
    commits by a manifest of its own: a manifest counts once its success marker is there, so a reader sees
    a batch whole or not at all. A batch that is committed already is not merged again, and what a batch left
    before it failed is cleared when it is repeated. Files of replaced versions go once the manifest stands;
    a sweep that was cut short is done again with the repeated batch. Batches come in ascending order, as
    `foreachBatch` gives them. A point without recording or fragment is an error; one without a coordinate has no voxel
    and is left out.
    """

    def __init__(self, path: str, cell: float, span: int = 1):
        self.path, self.cell, self.span = path.rstrip("/"), cell, span

    def __call__(self, points: DataFrame, batch: int) -> None:
        spark = points.sparkSession
        last = self.latest(spark)
        if last is None or last < batch:
            self._merge(points, batch, last)
        self._sweep(spark, max(batch, -1 if last is None else last))

    def _merge(self, points: DataFrame, batch: int, last: int | None) -> None:
        spark = points.sparkSession
        self._delete(spark, self._version(batch))
        self._delete(spark, self._manifest(batch))
        sums = self._sums(points).persist()
        try:
            merged = sums.withColumn("touched", F.lit(batch).cast("long"))
            if last is not None:
                members = sums.select(*FRAGMENT, "member").distinct().withColumn("_now", F.lit(batch).cast("long"))
                live = self._read_manifest(spark, last).join(members.select(*FRAGMENT).distinct(), FRAGMENT, "left_semi")
                old = self._voxels(spark, live).select(*merged.columns).join(members, [*FRAGMENT, "member"], "left")
                old = old.withColumn("touched", F.coalesce("_now", "touched")).drop("_now")
                merged = merged.unionByName(old).groupBy(*FRAGMENT, "member", *VOXEL).agg(
                    *[F.sum(c).alias(c) for c in SUMS], F.max("touched").alias("touched")
                )
            # the writer sorts by partition columns, so a large folder may be spread over tasks and files
            merged.write.partitionBy(*FRAGMENT).parquet(self._version(batch))
        finally:
            sums.unpersist()
        fresh = self._fragments(spark, batch)
        if last is None:
            manifest = fresh.withColumn("replaced", F.lit(None).cast("long"))
        else:
            before = self._read_manifest(spark, last).select(*FRAGMENT, F.col("version").alias("_was"))
            both = before.join(fresh, FRAGMENT, "full")
            manifest = both.select(
                *FRAGMENT, F.coalesce("version", "_was").alias("version"),
                F.when(F.col("version").isNotNull(), F.col("_was")).alias("replaced"),
            )
        manifest.write.parquet(self._manifest(batch))

    def _sums(self, points: DataFrame) -> DataFrame:
        given = lambda c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit(f"a point without {c}")).cast("long")).alias(c)
        index = [F.floor(F.col(c) / self.cell).cast("long").alias(n) for n, c in zip(VOXEL, "xyz")]
        rows = points.where("x is not null and y is not null and z is not null")
        rows = rows.select(given("recording"), given("fragment").alias("member"), *index, *"xyz")
        rows = rows.withColumn("fragment", F.expr(f"(member - pmod(member, {self.span})) div {self.span}"))
        return rows.groupBy(*FRAGMENT, "member", *VOXEL).agg(F.count("*").alias("samples"), *[F.sum(c).alias(f"sum_{c}") for c in "xyz"])

    # ---- reading ----

    def latest(self, spark: SparkSession) -> int | None:
        """The last committed batch."""
        done = [n for n in self._manifests(spark) if self._exists(spark, f"{self._manifest(n)}/_SUCCESS")]
        return max(done, default=None)

    def surface(self, spark: SparkSession) -> DataFrame:
        """Mean point of every voxel after the last committed batch."""
        return self._means(self._voxels(spark, self._latest_manifest(spark)))

    def changed(self, spark: SparkSession) -> DataFrame:
        """Mean points of the fragments that the last committed batch touched; no other folder is read."""
        last = self._known(spark)
        live = self._read_manifest(spark, last).where(F.col("version") == F.lit(last))
        return self._means(self._voxels(spark, live).where(F.col("touched") == F.lit(last)))

    def _means(self, voxels: DataFrame) -> DataFrame:
        means = [(F.col(f"sum_{c}") / F.col("samples")).alias(c) for c in "xyz"]
        return voxels.select("recording", F.col("member").alias("fragment"), *VOXEL, "samples", *means)

    def _voxels(self, spark: SparkSession, live: DataFrame) -> DataFrame:
        """Stored sums of the named folders; the join prunes folders by the manifest at run time."""
        return spark.read.schema(DATA).parquet(f"{self.path}/data").join(live.select(*FRAGMENT, "version"), [*FRAGMENT, "version"])

    def _fragments(self, spark: SparkSession, batch: int) -> DataFrame:
        rows = spark.read.schema(DATA).option("basePath", f"{self.path}/data").parquet(self._version(batch))
        return rows.select(*FRAGMENT, "version").distinct()

    def _known(self, spark: SparkSession) -> int:
        last = self.latest(spark)
        if last is None:
            raise ValueError(f"no batch is committed under {self.path}")
        return last

    def _latest_manifest(self, spark: SparkSession) -> DataFrame:
        return self._read_manifest(spark, self._known(spark))

    def _read_manifest(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(MANIFEST).parquet(self._manifest(batch))

    # ---- folders ----

    def drop(self, spark: SparkSession) -> None:
        """Delete the whole table."""
        self._delete(spark, self.path)

    def _version(self, batch: int) -> str:
        return f"{self.path}/data/version={batch}"

    def _manifest(self, batch: int) -> str:
        return f"{self.path}/manifest/batch={batch}"

    def _sweep(self, spark: SparkSession, batch: int) -> None:
        """Files replaced by the batch and manifests older than it go; the rows seen here are the batch's own fragments."""
        replaced = self._read_manifest(spark, batch).where(F.col("replaced").isNotNull() & (F.col("version") == F.lit(batch)))
        for row in replaced.toLocalIterator():
            self._delete(spark, f"{self._version(row.replaced)}/recording={row.recording}/fragment={row.fragment}")
        for older in self._manifests(spark):
            if older < batch:
                self._delete(spark, self._manifest(older))

    def _manifests(self, spark: SparkSession) -> list[int]:
        if not self._exists(spark, f"{self.path}/manifest"):
            return []
        files, place = self._at(spark, f"{self.path}/manifest")
        names = [status.getPath().getName() for status in files.listStatus(place)]
        return [int(name.removeprefix("batch=")) for name in names if name.startswith("batch=")]

    def _exists(self, spark: SparkSession, path: str) -> bool:
        files, place = self._at(spark, path)
        return files.exists(place)

    def _delete(self, spark: SparkSession, path: str) -> None:
        files, place = self._at(spark, path)
        files.delete(place, True)

    @staticmethod
    def _at(spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place
