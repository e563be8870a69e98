"""ASS subtitle text: colours, override tags, dialogue lines and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.functions.times import ass_time
from cuespark.schema import ALIGNMENT

# The head of an ASS document.
HEADER = (
    "[Script Info]\n"
    "ScriptType: v4.00+\n"
    "PlayResX: {width}\n"
    "PlayResY: {height}\n"
    "ScaledBorderAndShadow: yes\n"
    "\n"
    "[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,40,&H00FFFFFF,&H000000FF,&H00000000,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,10,10,10,1\n"
    "\n"
    "[Events]\n"
    "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


def ass_color(rgb: Column) -> Column:
    """#RRGGBB to &HBBGGRR&, by position and unchecked."""
    c = F.upper(rgb)
    return F.concat(F.lit("&H"), F.substring(c, 6, 2), F.substring(c, 4, 2), F.substring(c, 2, 2), F.lit("&"))


def override_tags(style: Column, rgb: Column, position: Column) -> Column:
    place = F.when(position == "top", str(ALIGNMENT["top"])).otherwise(str(ALIGNMENT["bottom"]))
    italic = F.when(style == "italic", r"\i1").otherwise("")
    return F.concat(F.lit(r"{\an"), place, F.lit(r"\c"), ass_color(rgb), italic, F.lit("}"))


def dialogue_lines(events: DataFrame, escape: bool = False) -> DataFrame:
    """(video_id, seq, pos, line): a line for each element of an event.

    Text is put as it is; escape turns its line breaks into \\N.
    """
    e = events.select("video_id", "seq", "start_time", "end_time", F.posexplode("elements").alias("pos", "e"))
    text = F.regexp_replace("e.text", r"\r?\n", r"\\N") if escape else F.col("e.text")
    return e.select(
        "video_id",
        "seq",
        "pos",
        F.concat(
            F.lit("Dialogue: 0,"),
            ass_time(F.col("start_time")),
            F.lit(","),
            ass_time(F.col("end_time")),
            F.lit(",Default,,0,0,0,,"),
            override_tags(F.col("e.style"), F.col("e.color"), F.col("e.position")),
            text,
        ).alias("line"),
    )


def ass_documents(events: DataFrame, videos: DataFrame, escape: bool = False) -> DataFrame:
    """(video_id, content): the whole document of each video in videos, those without events included."""
    lines = F.array_sort(F.collect_list(F.struct("seq", "pos", "line")))
    bodies = (
        dialogue_lines(events, escape)
        .groupBy("video_id")
        .agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("body"))
    )
    head = F.lit(HEADER)
    for name in ("width", "height"):
        head = F.replace(head, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return videos.join(bodies, "video_id", "left").select(
        "video_id", F.concat(head, F.when(F.col("body").isNull(), "").otherwise(F.concat("body", F.lit("\n")))).alias("content")
    )
