"""Text helpers: slugs, prompts and embedded images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each theme adds to a prompt. A maker's name that stood in one of them is left out.
THEME_HINTS = {
    "attitude": "tough humorous swagger, rebellious attitude, don’t-mess-with-me energy",
    "patriotism": "patriotic Americana, red white and blue, military/historical icons with attitude",
    "scally": "scally cap hooligan culture, Irish/Boston swagger, flat caps",
    "horror": "horror character with attitude, macabre humor, spooky but bold enamel shapes",
    "animals": "anthropomorphic animal mascot with tough guy attitude and a swagger prop",
    "holiday": "holiday character twisted with attitude, not cute cutesy",
    "sports": "sports swagger mascot, bold athletic iconography for enamel pin",
}
#: Fixed value: how each prompt ends.
ENDING = "single enamel pin design, clean silhouette, manufacture-ready color blocks"


def slugify(text: Column, most: int = 48, default: str = "ai-artwork", kept: str = "a-z0-9") -> Column:
    """Lower case, runs of other characters as one dash, a dash at either end off, cut to length; the default where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), f"[^{kept}]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.left(bare, F.lit(most)), F.lit("")), F.lit(default))


def build_prompt(prompt: Column, themes: Column, bias: str = "") -> Column:
    """The prompt, a style text, the hints of its distinct themes and the ending, joined by commas; 'attitude' leads if it is missing."""
    hints = F.create_map(*(F.lit(v) for pair in THEME_HINTS.items() for v in pair))
    some = F.array_distinct(F.when(F.size(F.coalesce(themes, F.array().cast("array<string>"))) > 0, themes).otherwise(F.array(F.lit("attitude"))))
    all_ = F.when(F.array_contains(some, "attitude"), some).otherwise(F.concat(F.array(F.lit("attitude")), some))
    said = F.concat(F.lit("themes: "), F.array_join(F.transform(all_, lambda t: hints[t]), "; "))
    return F.concat_ws(", ", F.nullif(F.trim(prompt), F.lit("")), F.nullif(F.lit(bias), F.lit("")), said, F.lit(ENDING))


def decode_data_url(df: DataFrame, url: str = "data_url", label: str = "label", stamp: Column | None = None) -> DataFrame:
    """df with content, ext, file_name and error. PNG and JPEG data URLs are decoded; others have an error and no content. The file name is a time stamp and the label's slug."""
    u, good = F.col(url), r"^data:image/(png|jpeg);base64,(.+)$"
    ok = u.rlike(good)
    ext = F.when(ok, F.when(F.regexp_extract(u, good, 1) == "jpeg", "jpg").otherwise("png"))
    at = F.coalesce(stamp, F.current_timestamp()) if stamp is not None else F.current_timestamp()
    name = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("-"), slugify(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("ui")), 40, "ui", "a-z0-9_-"), F.lit("."), ext)
    error = F.when(ok, None).when(u.startswith("data:image/"), "Unsupported image dataUrl").otherwise("Expected dataUrl image")
    return df.withColumns({"content": F.when(ok, F.unbase64(F.regexp_extract(u, good, 2))), "ext": ext, "file_name": F.when(ok, name), "error": F.coalesce(error, F.when(ok, F.lit(None).cast("string")))})
