"""Row shapes and fixed values of captions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = "struct<text:string,style:string,color:string,position:string>"
ELEMENTS = f"array<{ELEMENT}>"
FRAME = "video_id bigint, seq bigint, path string, timestamp double"
VIDEO = "video_id bigint, width int, height int, fps double"
EVENT = f"video_id bigint, seq bigint, start_time double, end_time double, elements {ELEMENTS}"

# The palette, styles, positions and their override codes.
PALETTE = {"white": "#FFFFFF", "yellow": "#FFFF00", "cyan": "#00FFFF"}
STYLES = ("regular", "italic")
POSITIONS = ("top", "bottom")
ALIGNMENT = {"top": 8, "bottom": 2}
DEFAULTS = {"style": "regular", "color": "white", "position": "bottom"}


def resolve_color(name: str) -> str:
    return name if name.startswith("#") else PALETTE.get(name, PALETTE["white"])


def color(col: Column) -> Column:
    """Names of the palette to hex; `#...` stays as it is, all else is white."""
    known = F.create_map(*(F.lit(x) for pair in PALETTE.items() for x in pair))
    return F.when(col.startswith("#"), col).otherwise(F.coalesce(F.try_element_at(known, col), F.lit(PALETTE["white"])))
