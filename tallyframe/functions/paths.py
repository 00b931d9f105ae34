"""String expressions of the manifest: stems, groups, labels, categories, path safety."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names of annotated sources, and the class without a definition.
ANNOTATED = {"Dark Roast": "dark", "Medium Roast": "medium", "Light Roast": "light", "Raw": "green"}
UNDEFINED = "Maw"
#: The contract's classes, in tie order.
LABELS = ("light", "medium", "dark")


#: The parts of names that tell what belongs together, by tag, as the sources write them.
TIMED = {"": r"^(\d{8}_\d{6})"}
EXPORTED = {"video:": r"^(.*?)_mp4-\d+", "": r"^(LINE_ALBUM_\d+)_", "msg:": r"^\d+-[0-9a-f]{32}-(\d{8})_JPG$"}
NAMED = {"rf_hendi": TIMED, "rf_robusta": EXPORTED, "rf_boos": EXPORTED}
#: The category of a source, with the scene that it holds for ("": any).
CATEGORIES = [
    ("rf_hendi", "", "drop_roaster_interior"), ("agtron", "", "keep_phone_hd"), ("ontoum224", "", "keep_single_bean_plain"), ("rf_boos", "", "review_color_cast_few_beans"),
    ("rf_robusta", "video", "review_label_ambiguous_video"), ("rf_robusta", "full", "review_cluttered_scene"), ("rf_robusta", "", "keep_multi_bean_clear"),
]
OTHER_CLASS = "drop_not_contract_class"
#: Why a label is dropped.
NO_LABEL, ONLY_UNDEFINED, UNKNOWN = "yolo_no_label", "maw_only", "unknown_class:"


def stem(name: Column) -> Column:
    """A file's name without folder and extension, and without an export suffix (.rf. and hexadecimal digits)."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.regexp_replace(base, r"(?i)\.rf\.[0-9a-f]+$", "")


def group_of(source: Column, s: Column, path: Column) -> Column:
    """The unit that no split may cut: by time, video, album or message date where the name tells, else the file."""
    told = [
        F.when(source == name, F.concat(source, F.lit(f":{tag}"), F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))))  # null where the pattern fails
        for name, patterns in NAMED.items()
        for tag, pattern in patterns.items()
    ]
    return F.coalesce(*told, F.concat(source, F.lit(":file:"), path))


def map_label(label: Column, folder: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(label, reason it is dropped or ""), of a folder's class by its map, or of annotated classes joined by |."""
    if folder is not None:
        mapped = lookup(label, folder)
        return mapped, F.when(mapped.isNull(), F.concat(F.lit(UNKNOWN), label)).otherwise("")
    classes = F.array_sort(F.array_distinct(F.split(label, r"\|")))
    unknown = F.array_except(classes, F.array(*map(F.lit, [*ANNOTATED, UNDEFINED])))
    mapped = F.array_distinct(F.transform(classes, lambda c: lookup(c, ANNOTATED)))
    none, undefined = label == "(no_label)", F.array_contains(classes, UNDEFINED)
    alone = F.size(classes) == 1
    out = F.when(none | (undefined & alone), F.lit(None)).when(undefined, "mixed").when(F.size(unknown) > 0, F.lit(None)).when(F.size(mapped) == 1, mapped[0]).otherwise("mixed")
    reason = (
        F.when(none, NO_LABEL).when(undefined & alone, ONLY_UNDEFINED).when(undefined, "").when(F.size(unknown) > 0, F.concat(F.lit(UNKNOWN), F.array_join(unknown, "|"))).otherwise("")
    )
    return out.cast("string"), reason


def lookup(key: Column, values: dict[str, str]) -> Column:
    """A CASE over a small map; null for other keys."""
    return reduce(lambda out, kv: F.when(key == kv[0], kv[1]).otherwise(out), values.items(), F.lit(None).cast("string"))


def category(source: Column, label: Column, group: Column, mode: Column) -> Column:
    """Keep, review or drop, by source and scene."""
    scenes = {"": F.lit(True), "video": F.contains(group, F.lit(":video:")), "full": mode == "full"}
    rules = [F.when((source == name) & scenes[scene], told) for name, scene, told in CATEGORIES]
    unknown = F.raise_error(F.concat(F.lit("unknown source "), source)).cast("string")
    return F.when(label.isNull() | ~label.isin(*LABELS), OTHER_CLASS).otherwise(F.coalesce(*rules, unknown))


def unsafe_reason(path: Column) -> Column:
    """Why an archive member's path must not be extracted; null if it may."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return (
        F.when(F.contains(path, F.lit("\x00")), "nul").when(path.rlike(r"^[/\\]"), "absolute").when(F.array_contains(parts, ".."), "parent").when(F.contains(path, F.lit(":")), "drive")
    )


def flags(**rules: Column) -> Column:
    """The names of the rules that hold, in order; a null rule does not hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def parse_roi(text: Column, scale_x: Column, scale_y: Column) -> Column:
    """x,y,w,h scaled on each axis and rounded half to even; null unless four numbers with positive sides."""
    p = F.transform(F.split(text, ","), lambda v: F.try_to_number(F.trim(v), F.lit("S99999.99")).cast("double"))
    good = (F.size(p) == 4) & ~F.exists(p, lambda v: v.isNull()) & (F.try_element_at(p, F.lit(3)) > 0) & (F.try_element_at(p, F.lit(4)) > 0)
    at = lambda i, s: F.rint(F.try_element_at(p, F.lit(i)) * s).cast("int")
    return F.when(good, F.array(at(1, scale_x), at(2, scale_y), at(3, scale_x), at(4, scale_y)))


def draft_scale(width: Column, height: Column, most: int) -> Column:
    """The largest of 1, 2, 4, 8 by which an image can be reduced with its longer side still at least `most`."""
    longer = F.greatest(width, height)
    return F.when(longer >= 8 * most, 8).when(longer >= 4 * most, 4).when(longer >= 2 * most, 2).otherwise(1)
