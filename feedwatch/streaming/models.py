"""Scoring a stream with models that change while it runs.

Models of a site lie in version folders. A version counts once it is published, which creates one empty file after
everything else is written, so a micro-batch sees the whole of a version or nothing of it. Every
micro-batch asks for the newest version of each site.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import routing
from ..operators.sites import SiteModel
from ..sources.batches import _folder, folder_names
from ..sources.tables import write_batch


def publish(spark: SparkSession, path: str, site: str, version: int) -> None:
    """Switch a site to a saved version. Going back is publishing an older model under a higher number."""
    marker, files = _folder(spark, f"{path}/site={site}/published/{version}")
    files.create(marker, True).close()


def current_version(spark: SparkSession, path: str, site: str) -> int | None:
    names = folder_names(spark, f"{path}/site={site}/published")
    return max((int(n) for n in names if n.isdigit()), default=None)


class CurrentModels:
    """The newest published model of each site; a loaded version is kept until another is published."""

    def __init__(self, spark: SparkSession, path: str, sites: list[str], load: Callable[[str, int], SiteModel]):
        self.spark, self.path, self.sites, self.load = spark, path, sites, load
        self._held: dict[str, tuple[int, SiteModel]] = {}

    def __call__(self) -> dict[str, tuple[int, SiteModel]]:
        for site in self.sites:
            version = current_version(self.spark, self.path, site)
            if version is not None and self._held.get(site, (None,))[0] != version:
                self._held[site] = (version, self.load(f"{self.path}/site={site}", version))
        return dict(self._held)


def start_versioned_classifier(
    posts: DataFrame,
    models: CurrentModels,
    out: str,
    checkpoint: str,
    threshold: float = routing.NOTIFICATION_THRESHOLD,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Posts (with set_notify and skip_write) scored by the newest model of their site and routed.

    ``out/batch=n`` has what micro-batch n sent, with the version that scored it. Posts of a site without a model count
    as failed to classify.
    """
    kept = ["site", "post_id", "url", "set_notify", "skip_write", "score", "classify_error", "version"]

    def step(batch: DataFrame, batch_id: int) -> None:
        pending = routing.to_classify(batch)
        held = models()
        parts = [pending.where(~F.col("site").isin(list(held)) | F.col("site").isNull()).withColumns({"score": F.lit(None).cast("double"), "version": F.lit(None).cast("int")})]
        for site, (version, model) in held.items():
            scored = model.score(pending.where(F.col("site") == site)).drop("would_notify")
            parts.append(scored.withColumn("version", F.lit(version).cast("int")))
        scored = reduce(DataFrame.unionByName, parts)
        write_batch(routing.route(scored, threshold).select(*kept), out, batch_id)

    return (
        posts.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
