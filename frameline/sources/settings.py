"""Service settings as one row: defaults, overridden by texts such as environment variables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, kind and, for numbers, the least value.  The override of a setting is its name in capitals.
SETTINGS = {
    "lipsync_backend": ("lower text",), "latentsync_ckpt": ("text",), "latentsync_steps": ("int", 1), "latentsync_guidance": ("double",),
    "max_concurrent": ("int", 2), "gpu_ids": ("list",), "use_codeformer": ("flag",), "codeformer_fidelity": ("double",), "codeformer_model": ("text",),
    "asd_mask_dilate": ("int", 0), "asd_vad_expand_max_sec": ("double", 0), "asd_pre_dilate_min_sec": ("double", 0), "use_vsdlm": ("flag",), "vsdlm_model": ("text",),
    "vsdlm_open_threshold": ("double",), "vsdlm_activity_threshold": ("double",), "vsdlm_min_speak_sec": ("double", 0), "vsdlm_mar_open_threshold": ("double",),
    "vsdlm_mar_activity_threshold": ("double",), "vsdlm_soft_closed_mar": ("double", 0), "use_vad_fusion": ("flag",), "vad_url": ("text",),
    "vsdlm_loose_min_speak_sec": ("double", 0), "lipsync_shot_min_speak_sec": ("double", 0), "lipsync_short_shot_sec": ("double", 0),
    "lipsync_short_shot_min_speak_sec": ("double", 0), "lipsync_keep_partial_min_sec": ("double", 0), "vsdlm_temporal_max_radius": ("int", 0),
    "vad_assign_max_gap_sec": ("double", 0), "bbox_detect_stride": ("int", 1), "asd_face_detect_stride": ("int", 1), "vsdlm_batch_size": ("int", 1),
    "use_lr_asd": ("flag",), "asd_threshold": ("double",), "codeformer_stride": ("int", 1), "blend_ramp_frames": ("int", 0), "color_match": ("flag",),
    "min_face_area_ratio": ("double", 0), "asd_dilate_respect_shots": ("flag",), "lipsync_full_speaking_shots": ("flag",), "shot_cut_hist_threshold": ("double",),
}


def settings(spark: SparkSession, given: Mapping[str, str], defaults: Mapping[str, str] | None = None, prefix: str = "") -> DataFrame:
    """One row with a typed column a setting; null where neither ``given`` nor ``defaults`` has a value.

    Numbers that are none are an error; blank texts and lists do not override.  A flag is
    true for 1, true, yes and on.  The two detectors exclude each other: asking for one of
    them (``use_lr_asd``) turns the other (``use_vsdlm``) off.
    """
    out = {}
    for name, (kind, *least) in SETTINGS.items():
        value = given.get(prefix + name.upper())
        if value is None or (not value and kind in ("text", "lower text", "list")):
            value = (defaults or {}).get(name)
        text = F.trim(F.lit(value).cast("string"))
        if kind in ("int", "double"):
            number = text.cast(kind)
            out[name] = F.greatest(number, F.lit(least[0]).cast(kind)) if least else number
            out[name] = F.when(text.isNotNull(), out[name])
        elif kind == "flag":
            out[name] = F.lower(text).isin("1", "true", "yes", "on")
        elif kind == "list":
            out[name] = F.transform(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.cast("int"))
        else:
            out[name] = F.lower(text) if kind == "lower text" else F.lit(value).cast("string")
    if given.get(prefix + "USE_LR_ASD") is not None:
        out["use_vsdlm"] = F.when(out["use_lr_asd"], False).otherwise(out["use_vsdlm"])
    return spark.range(1).select(*[c.alias(n) for n, c in out.items()])
