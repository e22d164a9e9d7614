"""What a media row's sampled frames show: labels by confidence, facts merged over the frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that say nothing about a scene, and those of animals.
VAGUE_SCENES = ("photograph", "photography", "image", "art", "screenshot", "material", "textile", "structure", "container", "surface", "object")
ANIMALS = ("dog", "cat", "bird", "owl", "raptor", "husky", "puppy", "kitten", "horse", "cow", "sheep", "goat", "pig", "canine", "feline", "wildlife", "deer", "bear", "lion", "tiger", "wolf", "fox")


def _words(label: Column) -> Column:
    return F.lower(F.trim(F.translate(label, "_", " ")))


def scene_labels(labels: Column, most: int = 12) -> Column:
    """Scene labels of an array of (label, confidence) from 0.015 up, the surest first (ties by label)."""
    sure = F.array_sort(F.transform(F.filter(labels, lambda x: x["confidence"] >= 0.015), lambda x: F.struct((-x["confidence"]).alias("c"), _words(x["label"]).alias("w"))))
    return F.slice(F.filter(F.transform(sure, lambda x: x["w"]), lambda w: (w != "") & ~w.isin(*VAGUE_SCENES)), 1, most)


def animal_labels(found: Column, classes: Column) -> Column:
    """Animals that were found (0.25 and up), then classes (0.035 and up) that are animals."""
    seen = F.transform(F.filter(found, lambda x: x["confidence"] >= 0.25), lambda x: F.lower(F.translate(x["label"], "_", " ")))
    named = F.transform(F.filter(classes, lambda x: (x["confidence"] >= 0.035) & F.lower(x["label"]).isin(*ANIMALS)), lambda x: F.lower(x["label"]))
    return F.concat(seen, named)


def text_labels(lines: Column) -> Column:
    """Read lines (0.65 and up) of 2 to 24 characters and at most four words."""
    sure = F.transform(F.filter(lines, lambda x: x["confidence"] >= 0.65), lambda x: F.trim(F.regexp_replace(x["label"], r"\s+", " ")))
    return F.filter(sure, lambda s: F.char_length(s).between(2, 24) & (F.size(F.split(s, " ")) <= 4))


def people_count(bodies: Column, faces: Column, animals: Column, hands: Column) -> Column:
    """None beside animals without a face; one where only hands show; else the bodies."""
    return F.when((F.size(animals) > 0) & (faces == 0), 0).when(hands & (bodies <= 0), 1).otherwise(F.greatest(bodies, F.lit(0)))


def people_id(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "one").when(n == 2, "two").when(n <= 10, "group").otherwise("crowd")


def face_id(area: Column, people: Column) -> Column:
    """How near the largest face is; none without people."""
    return F.when(people <= 0, "none").when(area >= 0.025, "portrait").when(area >= 0.015, "visible").otherwise("distant")


def first_of_each(items: Column, most: int) -> Column:
    """The first of items that differ by case only, ``most`` in all."""
    lower = F.transform(items, lambda x: F.lower(x))
    return F.slice(F.filter(items, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, most)


def merge_frames(frames: DataFrame, key: str) -> DataFrame:
    """(key, people, n_people, hands, face, scenes, animals, texts) of the rows' few sampled frames.

    Frames: key, frame, bodies, faces, hands, face_area and the arrays scenes, animals, texts. Counts and the area are
    the largest of a frame; labels are in the frames' order, once each, at most 5 scenes, 4 animals, 6 texts.
    """
    lists = {"scenes": 5, "animals": 4, "texts": 6}
    of_frame = F.array_sort(F.collect_list(F.struct("frame", *lists)))
    most = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("bodies", "faces", "face_area")]
    merged = frames.groupBy(key).agg(*most, F.coalesce(F.bool_or("hands"), F.lit(False)).alias("hands"), of_frame.alias("f"))
    listed = lambda c: F.flatten(F.transform("f", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))
    each = merged.select(key, "bodies", "faces", "face_area", "hands", *[listed(c).alias(c) for c in lists])
    each = each.withColumns({c: first_of_each(F.col(c), n) for c, n in lists.items()})
    hands = F.col("hands") & ~((F.size("animals") > 0) & (F.col("faces") == 0))
    n = each.withColumn("hands", hands).withColumn("n_people", people_count(F.col("bodies"), F.col("faces"), F.col("animals"), F.col("hands")))
    face = face_id(F.col("face_area"), F.col("n_people"))
    return n.select(key, people_id(F.col("n_people")).alias("people"), "n_people", (F.col("hands") & (F.col("n_people") > 0)).alias("hands"), face.alias("face"), *lists)


def demographic(confidence: Column) -> Column:
    """adult, child or senior by the highest confidence of its labels (map of label to confidence), from 0.15 up; an adult wins ties, then a child."""
    best = lambda *labels: F.array_max(F.array(*[F.coalesce(F.try_element_at(confidence, F.lit(x)), F.lit(0.0)) for x in labels]))
    adult, child, senior = best("adult"), best("child", "baby", "infant", "toddler"), best("senior", "elderly")
    top = F.greatest(adult, child, senior)
    return F.when(top >= 0.15, F.when(adult == top, "adult").when(child == top, "child").otherwise("senior"))
