"""Labels from fixed tables and rules: classes, keywords, speed bands, poses, vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions.vectors import batch_matrix, unit_rows
from mediaops.plans.matching import nearest, score_tiles

# Vehicle classes by detector class id.
VEHICLE_CLASSES = {2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
# Makes and their models; class ids count models and the years from 2010 to 2024.
MAKES = [
    ("Toyota", ["Camry", "Corolla", "Prius", "Land Cruiser", "RAV4"]),
    ("BMW", ["3 Series", "5 Series", "7 Series", "X3", "X5"]),
    ("Mercedes-Benz", ["C-Class", "E-Class", "S-Class", "GLE", "GLS"]),
    ("Audi", ["A3", "A4", "A6", "Q5", "Q7"]),
    ("Honda", ["Civic", "Accord", "CR-V", "Pilot", "Fit"]),
    ("Ford", ["Focus", "Mustang", "F-150", "Explorer", "Escape"]),
    ("Volkswagen", ["Golf", "Passat", "Jetta", "Tiguan", "Atlas"]),
    ("Nissan", ["Altima", "Sentra", "Rogue", "Pathfinder", "Titan"]),
    ("Hyundai", ["Elantra", "Sonata", "Tucson", "Santa Fe", "Genesis"]),
    ("Kia", ["Forte", "Optima", "Sorento", "Sportage", "Stinger"]),
    ("Chevrolet", ["Cruze", "Malibu", "Equinox", "Tahoe", "Silverado"]),
    ("Lexus", ["ES", "IS", "LS", "RX", "GX"]),
    ("Mazda", ["Mazda3", "Mazda6", "CX-5", "CX-9", "MX-5"]),
    ("Subaru", ["Impreza", "Legacy", "Outback", "Forester", "Ascent"]),
    ("Acura", ["ILX", "TLX", "RDX", "MDX", "NSX"]),
]
FIRST_YEAR, YEARS, MODEL_CLASSES = 2010, 15, 431
MIN_CLASS_CONFIDENCE = 0.3
# Words of street signs and names of makes, tried in this order.
STREET_WORDS = [
    "улица", "проспект", "переулок", "бульвар", "шоссе", "ул.", "пр.", "пер.", "бул.", "ш.",
    "street", "avenue", "boulevard", "highway",
]
BRANDS = [
    "TOYOTA", "HONDA", "HYUNDAI", "KIA", "NISSAN", "MAZDA", "VOLKSWAGEN", "BMW", "Mercedes", "AUDI",
    "LADA", "CHEVROLET", "FORD", "OPEL", "RENAULT",
]
# Scene texts and their short names.
SCENES = {
    "news studio with anchor desk": "студия_новости",
    "reporter on location outdoors": "репортаж_улица",
    "interview or talk show setting": "интервью",
    "breaking news graphics and text": "графика_титры",
    "weather forecast display": "прогноз_погоды",
    "sports footage or highlights": "спорт",
    "commercial advertisement": "реклама",
    "office or workplace interior": "офис",
    "industrial factory or manufacturing plant": "завод_производство",
    "rocket launch or space technology": "ракета_космос",
    "city skyline and urban landscape": "город_пейзаж",
    "natural landscape and countryside": "природа_ландшафт",
    "people walking on street": "люди_улица",
    "laboratory or scientific equipment": "лаборатория",
    "meeting room or conference hall": "переговоры_зал",
    "archive footage or historical material": "архивные_кадры",
}
UNKNOWN_SCENE = "неизвестная_сцена"
# Lower bound of the excess over the limit, article and fine, highest first.
SPEED_LIMIT = 10
SPEED_BANDS = [
    (60, "ст. 187 ч.4 КоАП КР", 7500),
    (40, "ст. 187 ч.3 КоАП КР", 5500),
    (20, "ст. 187 ч.2 КоАП КР", 3000),
    (10, "ст. 187 ч.1 КоАП КР", 1000),
]
NO_VIOLATION = "Нарушения нет"
WITHIN_LIMIT = "Скорость в пределах нормы"
UNDECIDED = "Нарушение не определено"
NO_ARTICLE = "Статья не определена"
EXCESS_TEXT = "Превышение скорости на %d км/ч"


def _mapped(value: Column, table: dict, default: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(value == kv[0], kv[1]), table.items(), F).otherwise(default)


def vehicle_class(class_id: Column) -> Column:
    return _mapped(class_id, VEHICLE_CLASSES, F.lit("unknown"))


def scene_name(scene: Column) -> Column:
    return _mapped(scene, SCENES, F.lit(UNKNOWN_SCENE))


def region_name(code: Column, names: dict[str, str]) -> Column:
    """Region of a code, ``Region <code>`` when it is not listed."""
    return _mapped(code, names, F.concat(F.lit("Region "), code))


def make_model(detections: DataFrame, class_id: str = "class_id", confidence: str = "confidence") -> DataFrame:
    """Make, model and year of a fine class id; Unknown outside the table or at 0.3 and below.

    Class ids run over makes, models and years, so the table is arithmetic on the id.
    """
    c = F.col(class_id).cast("long")
    known = c.between(0, MODEL_CLASSES - 1) & (F.col(confidence) > MIN_CLASS_CONFIDENCE)
    model_no = F.floor(c / YEARS).cast("int")
    makes = F.array(*[F.lit(make) for make, models in MAKES for _ in models])
    models = F.array(*[F.lit(m) for _, models in MAKES for m in models])
    year = (F.lit(FIRST_YEAR) + F.pmod(c, F.lit(YEARS))).cast("string")
    unknown = F.lit("Unknown")
    return detections.withColumns(
        {
            "make": F.when(known, F.get(makes, model_no)).otherwise(unknown),
            "model": F.when(known, F.get(models, model_no)).otherwise(unknown),
            "year": F.when(known, year).otherwise(unknown),
        }
    )


def first_keyword(text: Column, words: list[str]) -> Column:
    """First listed word contained in the text, null when there is none."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w in words])


def street_signs(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts with a street word, and the first word found in list order."""
    found = first_keyword(F.lower(F.col(text)), STREET_WORDS)
    return texts.withColumn("keyword_found", found).filter("keyword_found is not null")


def brand_texts(texts: DataFrame, text: str = "text", keys: tuple[str, ...] = ("image_id",), order: str = "pos") -> DataFrame:
    """First text of each region that names a make; texts are compared in upper case."""
    found = first_keyword(F.upper(F.col(text)), BRANDS)
    rows = texts.withColumn("brand", found).filter("brand is not null")
    return rows.groupBy(*keys).agg(F.min_by(F.struct("brand", "confidence"), order).alias("b")).select(*keys, "b.*")


def zero_shot_labels(
    frames: DataFrame, labels: DataFrame, frame_id: str = "id", vec: str = "embedding", max_bytes: int = 32 << 20
) -> DataFrame:
    """Most similar label vector of each frame vector; the lowest label number on ties.

    ``labels`` has label_no, label, embedding.  Label vectors of up to ``max_bytes`` go to every
    task, which picks the best label where the frame is read: frames are never shuffled.  A
    larger label set is matched block by block.
    """
    size = labels.agg(F.sum(F.size("embedding") * F.lit(8))).first()[0] or 0
    if size > max_bytes:
        matched = nearest(frames, labels, 1, frame_id, "label_no", vec, "embedding")
        named = labels.select(F.col("label_no").alias("match_id"), "label")
        return matched.join(named, "match_id").select(
            F.col("query_id").alias(frame_id), F.col("match_id").alias("label_no"), "label", F.col("score").alias("similarity")
        )
    few = labels.filter("embedding is not null").orderBy("label_no").select("label_no", "label", "embedding").collect()
    rows = frames.select(F.col(frame_id).cast("long").alias(frame_id), F.col(vec).alias("vec")).filter("vec is not null")
    schema = f"{frame_id} long, label_no long, label string, similarity double"
    if not few:
        return rows.sparkSession.createDataFrame([], schema)
    numbers, names = [int(r["label_no"]) for r in few], [r["label"] for r in few]
    matrix = unit_rows(np.array([r["embedding"] for r in few], dtype=np.float64))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, _ = batch_matrix(batch.column("vec"))
            best, score = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows)
            for part, scores in score_tiles(unit_rows(vectors), matrix):
                best[part] = scores.argmax(axis=1)
                score[part] = scores.max(axis=1)
            columns = [
                batch.column(0), pa.array([numbers[i] for i in best], pa.int64()), pa.array([names[i] for i in best], pa.string()), pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[frame_id, "label_no", "label", "similarity"])

    return rows.mapInArrow(pick, schema)


def speed_bands(readings: DataFrame, speed: str = "speed") -> DataFrame:
    """Excess over the limit, article, text and fine of each reading; no speed decides nothing."""
    s = F.col(speed)
    has = s.isNotNull() & (s != 0)
    excess = s - SPEED_LIMIT
    article, fine, over = F, F, F.lit(False)
    for bound, name, amount in SPEED_BANDS:
        article, fine = article.when(excess > bound, name), fine.when(excess > bound, amount)
        over = over | (excess > bound)
    return readings.withColumns(
        {
            "excess": F.when(has, excess),
            "article": F.when(has, article.otherwise(NO_VIOLATION)).otherwise(NO_ARTICLE),
            "violation": F.when(
                has, F.when(over, F.format_string(EXCESS_TEXT, excess.cast("long"))).otherwise(WITHIN_LIMIT)
            ).otherwise(UNDECIDED),
            "fine": F.when(has, fine.otherwise(0)).otherwise(0),
        }
    )


def mark_with_vehicle(codes: DataFrame, vehicles: DataFrame, key: str = "image_id") -> DataFrame:
    """Whether any vehicle was found in the image of a code."""
    seen = vehicles.select(key).distinct().withColumn("vehicle_nearby", F.lit(True))
    return codes.join(seen, key, "left").withColumn("vehicle_nearby", F.coalesce("vehicle_nearby", F.lit(False)))


def vector_stats_label(frames: DataFrame, vec: str = "embedding") -> DataFrame:
    """Scene label from mean, deviation, maximum and variance of a vector (rule of last resort)."""
    v = F.transform(vec, lambda x: x.cast("double"))
    rows = frames.withColumn("_v", v).withColumn("_n", F.size("_v"))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / F.col("_n")
    square = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x) / F.col("_n")
    rows = rows.withColumn("mean", mean)
    var = F.greatest(F.lit(0.0), square - F.col("mean") * F.col("mean"))
    rows = rows.withColumn("variance", var).withColumn("deviation", F.sqrt("variance")).withColumn("top", F.array_max("_v"))
    m, s, t, v2 = (F.col(c) for c in ("mean", "deviation", "top", "variance"))
    label = (
        F.when(m > 0.15, F.when(s > 0.2, "репортаж_улица").when(v2 > 0.03, "интервью").otherwise("студия_новости"))
        .when(m > 0.05, F.when(t > 0.25, "графика_титры").when(s > 0.15, "завод_производство").otherwise("офис"))
        .otherwise(F.when(v2 > 0.01, "природа_ландшафт").otherwise("реклама"))
    )
    return rows.withColumn("label", label).drop("_v", "_n")


# Positions of the used body points in a pose array.
POINTS = {
    "nose": 0, "left_ear": 7, "right_ear": 8, "left_shoulder": 11, "right_shoulder": 12,
    "left_elbow": 13, "right_elbow": 14, "left_wrist": 15, "right_wrist": 16,
}
VISIBLE = 0.5


def pose_labels(poses: DataFrame, min_confidence: float = 0.5, landmarks: str = "landmarks") -> DataFrame:
    """Gesture, head, arm and body labels and the padded box of each pose.

    ``landmarks`` is an array of structs (x, y, visibility) in frame shares; ``width`` and
    ``height`` give the frame.  Poses without a visible point, or whose visible points are on
    average below ``min_confidence``, are dropped.
    """
    p = {name: F.get(landmarks, i) for name, i in POINTS.items()}

    def seen(name: str) -> Column:
        return p[name]["visibility"] > VISIBLE

    def either(test) -> Column:
        return (test("left") & seen("left_wrist")) | (test("right") & seen("right_wrist"))

    shoulder_y = (p["left_shoulder"]["y"] + p["right_shoulder"]["y"]) / 2
    lifted = either(lambda s: p[f"{s}_wrist"]["y"] < shoulder_y - 0.1)
    at_face = either(lambda s: p[f"{s}_wrist"]["y"] < p["nose"]["y"] + 0.1)
    raised = {s: (p[f"{s}_wrist"]["y"] < p[f"{s}_shoulder"]["y"]) & seen(f"{s}_wrist") for s in ("left", "right")}
    low = (p["left_wrist"]["y"] > p["left_shoulder"]["y"] + 0.2) & (p["right_wrist"]["y"] > p["right_shoulder"]["y"] + 0.2)
    gesture = (
        F.when(lifted, "presenting").when(at_face, "speaking").when(raised["left"] | raised["right"], "gesturing")
        .when(low, "standing").otherwise("neutral")
    )
    activity = F.when(F.col("gesture") == "standing", 0.8 * 0.9).when(F.col("gesture") == "neutral", 0.8 * 0.7).otherwise(0.8)
    ears = p["left_ear"]["x"] - p["right_ear"]["x"]
    head = F.when(
        seen("left_ear") & seen("right_ear"),
        F.when(F.abs(ears) < 0.05, "front").when(ears > 0, "right").otherwise("left"),
    ).otherwise("unknown")
    arms = (
        F.when(raised["left"] & raised["right"], "both_raised").when(raised["left"], "left_raised")
        .when(raised["right"], "right_raised").otherwise("down")
    )
    body = F.when(
        seen("left_shoulder") & seen("right_shoulder"),
        F.when(F.abs(p["left_shoulder"]["x"] - p["right_shoulder"]["x"]) > 0.15, "angled").otherwise("front"),
    ).otherwise("side")
    visible = F.filter(landmarks, lambda q: q["visibility"] > VISIBLE)
    rows = poses.withColumn("_vis", visible).withColumn("points", F.size("_vis")).filter("points > 0")
    total = F.aggregate("_vis", F.lit(0.0), lambda a, q: a + q["visibility"])
    rows = rows.withColumn("pose_confidence", total / F.col("points")).filter(F.col("pose_confidence") >= min_confidence)
    xs, ys = F.transform("_vis", lambda q: q["x"] * F.col("width")), F.transform("_vis", lambda q: q["y"] * F.col("height"))

    def whole(c: Column) -> Column:
        return F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("long")

    pad = 20
    rows = rows.withColumns(
        {
            "gesture": gesture, "head_pose": head, "arm_position": arms, "body_orientation": body,
            "x1": F.greatest(F.lit(0), whole(F.array_min(xs)) - pad), "y1": F.greatest(F.lit(0), whole(F.array_min(ys)) - pad),
            "x2": F.least(F.col("width"), whole(F.array_max(xs)) + pad),
            "y2": F.least(F.col("height"), whole(F.array_max(ys)) + pad),
        }
    )
    return rows.withColumns(
        {
            "activity_confidence": activity,
            "cx": F.floor((F.col("x1") + F.col("x2")) / 2), "cy": F.floor((F.col("y1") + F.col("y2")) / 2),
        }
    ).drop("_vis")


def shape_colour_labels(boxes: DataFrame) -> DataFrame:
    """Body class by aspect ratio, colour class by mean hue, saturation and value, and rider flag.

    ``boxes`` has w, h, hue, saturation, value, class_id, confidence.
    """
    ratio = F.when(F.col("h") > 0, F.col("w") / F.col("h"))
    shape = (
        F.when(ratio.isNull(), "неопределен").when(ratio > 2.5, "лимузин").when(ratio > 2.0, "седан")
        .when(ratio > 1.8, "хетчбек").when(ratio > 1.5, "внедорожник").otherwise("компактный")
    )
    h, s, v = F.col("hue"), F.col("saturation"), F.col("value")
    colour = (
        F.when(v < 50, "черный").when((v > 200) & (s < 50), "белый").when(s < 50, "серый")
        .when(h.between(0, 10) | h.between(170, 180), "красный").when(h.between(35, 85), "зеленый")
        .when(h.between(100, 130), "синий").when(h.between(15, 35), "желтый").otherwise("другой")
    )
    rider = F.col("class_id") == 3
    return boxes.withColumns(
        {
            "body_class": shape, "colour": colour,
            "flag": F.when(rider, F.lit("potential_no_helmet")),
            "flag_confidence": F.when(rider, F.col("confidence") * 0.7),
        }
    )
