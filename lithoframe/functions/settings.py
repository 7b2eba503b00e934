"""Job settings from JSON text, each field checked on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoframe.functions.color import rounded
from lithoframe.functions.layout import detail_retention_params, retention_from_min_region_ratio

#: The settings of a job that says nothing.
DEFAULTS = {
    "removeBackground": True, "backgroundTolerance": 50,
    "outline": {"sensitivity": 60.0, "thickness": 1.49, "invert": False, "maxDim": 1600.0},
    "vector": {"colorCount": 12, "detailRetention": 100, "smoothness": 1, "maxDim": 1000.0, "snapToPms": True, "pmsTolerance": 10},
}


def _number(text: Column, path: str) -> Column:
    """A JSON number, or null. A string with digits looks like a number once extracted, but its quotes show in the text."""
    raw, name = F.get_json_object(text, f"$.{path}"), path.rsplit(".", 1)[-1]
    plain = raw.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$") & ~text.rlike(rf'"{name}"\s*:\s*"')
    return F.when(plain, raw.try_cast("double"))


def _flag(text: Column, path: str) -> Column:
    name = path.rsplit(".", 1)[-1]
    raw = F.get_json_object(text, f"$.{path}")
    return F.when(raw.isin("true", "false") & ~text.rlike(rf'"{name}"\s*:\s*"'), raw == "true")


def _within(v: Column, low: float, high: float) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)))


def sanitize_settings(text: Column) -> Column:
    """A struct of all settings: what the JSON says where it has the right type, within its limits, else the default. Text that is no JSON object gives the defaults."""
    d, o, v = DEFAULTS, DEFAULTS["outline"], DEFAULTS["vector"]
    n, whole = (lambda p: _number(text, p)), (lambda c: rounded(c))
    keep = lambda c, default: F.coalesce(c, F.lit(default))
    detail = F.coalesce(whole(_within(rounded(n("vector.detailRetention")).cast("double"), 0, 100)), F.when(n("vector.minRegionRatio").isNotNull(), retention_from_min_region_ratio(n("vector.minRegionRatio"))), F.lit(v["detailRetention"]))
    thick = F.when(n("outline.thickness") == 0, 0.1).otherwise(n("outline.thickness"))
    return F.struct(
        keep(_flag(text, "removeBackground"), d["removeBackground"]).alias("remove_background"),
        keep(whole(_within(rounded(n("backgroundTolerance")).cast("double"), 8, 80)), d["backgroundTolerance"]).alias("background_tolerance"),
        F.struct(
            keep(_within(n("outline.sensitivity"), 0, 100), o["sensitivity"]).alias("sensitivity"),
            keep(F.floor(_within(thick, 0.1, 6) * 100 + 0.5) / 100, o["thickness"]).alias("thickness"),
            keep(_flag(text, "outline.invert"), o["invert"]).alias("invert"),
            keep(_within(n("outline.maxDim"), 200, 2000), o["maxDim"]).alias("max_dim"),
        ).alias("outline"),
        F.struct(
            keep(whole(_within(rounded(n("vector.colorCount")).cast("double"), 4, 32)), v["colorCount"]).alias("color_count"),
            detail.alias("detail_retention"),
            detail_retention_params(detail)["min_region_ratio"].alias("min_region_ratio"),
            keep(whole(_within(rounded(n("vector.smoothness")).cast("double"), 0, 5)), v["smoothness"]).alias("smoothness"),
            keep(_within(n("vector.maxDim"), 200, 2000), v["maxDim"]).alias("max_dim"),
            keep(_flag(text, "vector.snapToPms"), v["snapToPms"]).alias("snap_to_pms"),
            keep(whole(_within(rounded(n("vector.pmsTolerance")).cast("double"), 0, 30)), v["pmsTolerance"]).alias("pms_tolerance"),
        ).alias("vector"),
    )


def read_job_settings(jobs: DataFrame, column: str = "settings_json") -> DataFrame:
    """jobs with a struct `settings`."""
    return jobs.withColumn("settings", sanitize_settings(F.col(column)))
