"""Code texts: classification by pattern rules, token layout assembly, overlay texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaops.functions import boxes as G
from mediaops.operators.boxes import with_bounds

# Region names by code.
KAZAKHSTAN_REGIONS = {
    "01": "Almaty", "02": "Almaty Region", "03": "Akmola Region", "04": "Aktobe Region", "05": "Atyrau Region",
    "06": "West Kazakhstan Region", "07": "Zhambyl Region", "08": "Karaganda Region", "09": "Kostanay Region",
    "10": "Kyzylorda Region", "11": "Mangystau Region", "12": "Pavlodar Region", "13": "North Kazakhstan Region",
    "14": "South Kazakhstan Region", "15": "East Kazakhstan Region", "16": "Nur-Sultan", "17": "Shymkent",
}
RUSSIA_REGIONS = {
    "77": "Moscow", "78": "Saint Petersburg", "50": "Moscow Region",
    "178": "Saint Petersburg", "199": "Moscow", "777": "Moscow",
}
# Fixed values: (rule, pattern, groups, country, type, regions, latin letters), tried in this order.
PATTERN_RULES = [
    ("kz_new", r"^(\d{3})([A-Z]{3})(\d{2})$", 3, "Kazakhstan", "standard", KAZAKHSTAN_REGIONS, True),
    ("kz_old", r"^([A-Z])(\d{3})([A-Z]{2})(\d{2})$", 4, "Kazakhstan", "old_format", KAZAKHSTAN_REGIONS, True),
    ("ru_standard", r"^([А-Я])(\d{3})([А-Я]{2})(\d{2,3})$", 4, "Russia", "standard", RUSSIA_REGIONS, False),
    ("ru_taxi", r"^([А-Я]{2})(\d{3})(\d{2,3})$", 3, "Russia", "taxi", RUSSIA_REGIONS, False),
    ("ru_transit", r"^(\d{4})([ТР]{2})(\d{2,3})$", 3, "Russia", "transit", RUSSIA_REGIONS, False),
    ("soviet", r"^(\d{2})-(\d{2})([А-Я]{3})$", 3, "Soviet", "historical", {}, False),
    ("germany", r"^([A-Z]{1,3})-([A-Z]{1,2})\s?(\d{1,4})$", 3, "Germany", "standard", {}, True),
    ("france", r"^(\d{3})-([A-Z]{2})-(\d{2})$", 3, "France", "standard", {}, True),
]
# Cyrillic letters and the Latin letters of the same shape.
CYRILLIC, LATIN = "АВЕКМНОРСТУХЯ", "ABEKMHOPCTYXR"
BASE_CONFIDENCE = 0.8


def classify_codes(codes: DataFrame, text: str = "text", keep_separators: bool = False) -> DataFrame:
    """Country, type, region and matched rule of each code text; null rule for rejects.

    The text is upper-cased and reduced to A-Z, А-Я and digits; shorter than 4 it is a reject.
    Rules that need a dash can only match with ``keep_separators``.
    """
    raw = F.col(text)
    allowed = "[^A-ZА-Я0-9-]" if keep_separators else "[^A-ZА-Я0-9]"
    rows = codes.withColumn("cleaned", F.regexp_replace(F.upper(raw), allowed, "")).withColumn(
        "_latin", F.translate("cleaned", CYRILLIC, LATIN)
    )
    rows = rows.withColumn(
        "rule",
        F.when(
            F.length(raw) >= 4,
            F.coalesce(*[F.when(_tested(r).rlike(r[1]), F.lit(r[0])) for r in PATTERN_RULES]),
        ),
    )
    rule = F.col("rule")
    code = F.coalesce(*[F.when(rule == r[0], F.regexp_extract(_tested(r), r[1], r[2])) for r in PATTERN_RULES if r[5]])
    tables = [(names, [r[0] for r in PATTERN_RULES if r[5] is names]) for names in (KAZAKHSTAN_REGIONS, RUSSIA_REGIONS)]
    region = F.coalesce(
        *[F.when(rule.isin(rules), F.coalesce(F.try_element_at(_map(names), code), F.concat(F.lit("Region "), code)))
          for names, rules in tables],
        F.when(rule.isNotNull(), F.lit("Unknown")),
    )
    return rows.select(
        *codes.columns, "cleaned", "rule",
        F.try_element_at(_map({r[0]: r[3] for r in PATTERN_RULES}), rule).alias("country"),
        F.try_element_at(_map({r[0]: r[4] for r in PATTERN_RULES}), rule).alias("type"),
        region.alias("region"), F.when(rule.isNotNull(), F.lit(BASE_CONFIDENCE)).alias("rule_confidence"),
    )


def _tested(rule: tuple) -> Column:
    """The form of the text a rule is tried on."""
    return F.col("_latin") if rule[6] else F.col("cleaned")


def _map(table: dict[str, str]) -> Column:
    """A fixed table as one literal."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def split_rejects(classified: DataFrame, rule: str = "rule") -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows."""
    return classified.filter(F.col(rule).isNotNull()), classified.filter(F.col(rule).isNull())


# National rules of the second set, and the letters of the Cyrillic form.
_LETTERS = "АВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"
NATIONAL_RULES = [
    r"^(\d{2})(KG)(\d{3})([A-Z]{3})$",
    rf"^([{_LETTERS}])\s*(\d{{4}})\s*([{_LETTERS}]{{2}})$",
    r"^([A-Z])\s*(\d{4})\s*([A-Z]{2})$",
    r"^([A-Z])\s*(\d{4})\s*([A-Z])$",
]
# Prefixes and their region, tried in this order.
PREFIX_REGIONS = [
    (("В", "B"), "Bishkek"), (("З", "Z"), "Osh"), (("01",), "Bishkek"), (("02",), "Osh"), (("03",), "Jalal-Abad"),
    (("04",), "Issyk-Kul"), (("05",), "Naryn"), (("06",), "Batken"), (("07",), "Talas"), (("08",), "Chui"),
]


def classify_national(codes: DataFrame, text: str = "text") -> DataFrame:
    """Region, type and format of codes that match one of the national patterns; null otherwise."""
    clean = F.upper(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    rows = codes.withColumn("cleaned", clean)
    c = F.col("cleaned")
    rule = F.coalesce(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(NATIONAL_RULES)])
    region = F
    for prefixes, name in PREFIX_REGIONS:
        region = region.when(reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes]), name)
    kind = (
        F.when((F.length(c) >= 8) & (F.substring(c, 3, 2) == "KG"), "kg_new_format")
        .when(c.rlike(f"[{_LETTERS}]"), "kg_old_individual_cyrillic")
        .otherwise("kg_individual_latin")
    )
    packed = F.length(F.regexp_replace(c, " ", ""))
    shape = (
        F.when((F.length(c) >= 8) & c.contains("KG"), "NNKGNNNAAA")
        .when(packed == 7, "LNNNNLL")
        .when(packed == 6, "LNNNL")
        .otherwise("unknown")
    )
    hit = F.col("rule_no").isNotNull()
    return rows.withColumn("rule_no", rule).withColumns(
        {
            "country": F.when(hit, F.lit("Kyrgyzstan")),
            "region": F.when(hit, region.otherwise("Unknown")),
            "type": F.when(hit, kind),
            "format": F.when(hit, shape),
        }
    )


# --- tokens ------------------------------------------------------------------------------

REGION_FIXES = [  # Fixed values: letters misread in a region code, replaced in this order.
    ("G", "0"), ("D", "0"), ("TO", "01"), ("O", "0"), ("61", "01"),
    ("To", "01"), ("T0", "01"), ("10", "01"), ("1O", "01"), ("1o", "01"),
]


def fix_region(text: Column) -> Column:
    """Region code with common misreadings repaired."""
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), REGION_FIXES, text)


def fix_number(text: Column) -> Column:
    """Number whose first three places had G or O for 0."""
    head = F.translate(F.substring(text, 1, 3), "GO", "00")
    return F.when(F.length(text) >= 3, F.concat(head, F.substring(text, 4, 1_000_000))).otherwise(text)


def tokens_from_arrays(crops: DataFrame) -> DataFrame:
    """Token rows of crops with parallel arrays texts, scores, boxes, polygons, angles.

    Texts beyond the shorter of texts and scores and blank texts are dropped; positions are
    counted over what is left.
    """
    zipped = F.slice(
        F.arrays_zip("texts", "scores", "boxes", "polygons", "angles"), 1, F.least(F.size("texts"), F.size("scores"))
    )
    kept = F.filter(zipped, lambda z: z["texts"].isNotNull() & (F.trim(z["texts"]) != ""))
    rows = crops.select("crop_id", F.posexplode(kept).alias("pos", "z")).select(
        "crop_id", "pos", F.col("z.texts").alias("text"), F.col("z.scores").alias("confidence"),
        F.col("z.boxes").alias("box"), F.col("z.polygons").alias("polygon"), F.col("z.angles").alias("angle"),
    )
    return with_bounds(rows)


def tokens_from_lines(crops: DataFrame) -> DataFrame:
    """Token rows of crops with one array ``lines`` of structs (polygon, text, confidence)."""
    kept = F.filter("lines", lambda z: z["text"].isNotNull() & (F.trim(z["text"]) != ""))
    rows = crops.select("crop_id", F.posexplode(kept).alias("pos", "z")).select(
        "crop_id", "pos", "z.text", "z.confidence", "z.polygon"
    )
    return with_bounds(rows)


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def _token_features(tokens: DataFrame, crop: str) -> DataFrame:
    """One row per crop: counts, and for its first four tokens their texts, readings and relations.

    Columns per token i: x (text), u (upper case), r (repaired region code or null), d (three
    digits), l (two or three letters), m (number token), e (box).  Columns per pair: ab_ij
    (i above j) and be_ij (i left of j on one line).
    """
    text = F.col("text")
    is_main = (F.length(text) >= 4) & F.upper(text).rlike("[A-Z]") & text.rlike(r"\d")
    box = F.struct("left", "top", "right", "bottom")
    token = F.struct("pos", "text", box.alias("e"), is_main.alias("main"))
    crops = tokens.groupBy(crop).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_main).alias("mains"),
        F.min_by(F.when(is_main, text), F.when(is_main, F.col("pos"))).alias("main_text"),
        F.avg("confidence").alias("mean_confidence"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < 4, token))).alias("tok"),
    )
    head = [crop, "n", "mains", "main_text", "mean_confidence"]
    one = {}
    for i in range(4):
        t = F.get("tok", i)
        one |= {f"x{i}": t["text"], f"e{i}": t["e"], f"m{i}": t["main"]}
    rows = crops.select(*head, *[c.alias(k) for k, c in one.items()])
    two = {}
    for i in range(4):
        x = F.col(f"x{i}")
        fixed = fix_region(x)
        two |= {
            f"u{i}": F.upper(x), f"r{i}": F.when(fixed.rlike(r"^\d{2}$"), fixed),
            f"d{i}": x.rlike(r"^\d{3}$"), f"l{i}": F.upper(x).rlike(r"^[A-Z]{2,3}$"),
        }
    def edges(i: int) -> dict[str, Column]:
        return {side: F.col(f"e{i}")[side] for side in ("left", "top", "right", "bottom")}

    no = F.lit(False)
    for i in range(4):
        for j in range(4):
            if i != j:
                two[f"ab_{i}{j}"] = F.coalesce(G.is_above(edges(i), edges(j)), no)
            if i < j:
                two[f"be_{i}{j}"] = F.coalesce(G.is_beside(edges(i), edges(j)), no)
    kept = [f"{k}{i}" for i in range(4) for k in ("x", "m", "e")]
    return rows.select(*head, *kept, *[c.alias(k) for k, c in two.items()])


def _outcome(layout, number, region, country, ok: bool = True) -> Column:
    def text(v) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    return F.struct(
        text(layout).alias("layout"), text(number).alias("number"), text(region).alias("region"),
        text(country).alias("country"), F.lit(ok).alias("ok"),
    )


def assemble_layout(tokens: DataFrame, crop: str = "crop_id") -> DataFrame:
    """Region, country and number of each crop from its tokens (pos dense from 0).

    One token of 4 or more characters with letters and digits is the number; one or two other
    tokens then give region and country.  Without such a token, three or four tokens are
    tried side by side and stacked, in order of position.  Success needs a number and a
    region or country.  The rules look at no more than four tokens, and the other cases need
    only counts, so a crop is never gathered beyond its first four tokens.
    """
    rows = _token_features(tokens, crop)
    c = F.col
    main, n = c("main_text"), c("n")

    def kg(value: Column) -> Column:
        return F.when(value.isin("KG", "KS"), F.lit("KG"))

    def likely(region: Column) -> Column:
        return F.when(region.isNotNull(), F.lit("KG?"))

    # Number token with one other token: a region, or a country.
    region = F.when(c("m0"), c("r1")).otherwise(c("r0"))
    other = F.when(c("m0"), c("u1")).otherwise(c("u0"))
    country = F.when(region.isNotNull(), "KG?").when(other.isin("KG", "KS"), "KG").when(other == "KZ", "KZ")
    one_other = _outcome(F.when(country.isNotNull(), "linear").otherwise("unknown"), main, region, country)

    # Number token with two other tokens, region over country.
    up, low = F, F
    for k in range(3):
        i, j = [x for x in range(3) if x != k]
        is_k = c(f"m{k}")
        up = up.when(is_k & c(f"ab_{i}{j}"), F.lit(i)).when(is_k & c(f"ab_{j}{i}"), F.lit(j))
        low = low.when(is_k & c(f"ab_{i}{j}"), F.lit(j)).when(is_k & c(f"ab_{j}{i}"), F.lit(i))
    rows = rows.withColumn("up", up).withColumn("low", low)
    up_region = F.get(F.array("r0", "r1", "r2"), c("up"))
    low_text = F.get(F.array("u0", "u1", "u2"), c("low"))
    two_others = _outcome(
        F.when(up_region.isNotNull(), "stacked").otherwise("unknown"), main, up_region,
        F.when(up_region.isNotNull(), kg(low_text)),
    )
    alone = _outcome("unknown", main, None, None)

    # Three tokens: a pair side by side, then a pair stacked; the third token is the region.
    three = []
    for i, j in _pairs(3):
        r = c(f"r{3 - i - j}")
        number_first, letters_first = c(f"d{i}") & c(f"l{j}"), c(f"u{i}").rlike("^[A-Z]{3}$") & c(f"d{j}")
        three.append(
            F.when(
                c(f"be_{i}{j}") & (number_first | letters_first),
                _outcome("linear_3_elements", F.concat(c(f"u{i}"), c(f"u{j}")), r, likely(r)),
            )
        )
    for i in range(3):
        for j in range(3):
            if i != j:
                r = c(f"r{3 - i - j}")
                three.append(
                    F.when(
                        c(f"ab_{i}{j}") & c(f"d{i}") & c(f"l{j}"),
                        _outcome("stacked_with_region", F.concat(c(f"x{i}"), c(f"u{j}")), r, likely(r)),
                    )
                )
    three_tokens = F.coalesce(*three, _outcome("unrecognized_3_elements", None, None, None, False))

    # Four tokens: a pair side by side that forms a number, the other two region and country.
    four, stack = [], []
    for i, j in _pairs(4):
        k, m = [x for x in range(4) if x not in (i, j)]
        number = F.concat(c(f"u{i}"), c(f"u{j}"))
        fits = (F.length(number) >= 4) & number.rlike("[A-Z]") & number.rlike(r"\d")

        def found(a: int, b: int) -> Column:
            """Region of a over country b, else of b under country a."""
            return F.coalesce(
                F.when(c(f"u{b}").rlike("KG|KS"), c(f"r{a}")), F.when(c(f"u{a}").rlike("KG|KS"), c(f"r{b}"))
            )

        r = F.when(c(f"ab_{k}{m}"), found(k, m)).when(c(f"ab_{m}{k}"), found(m, k))
        four.append(
            F.when(c(f"be_{i}{j}") & fits, F.struct(number.alias("number"), r.alias("region")))
        )
        stack.append(
            F.when(
                c(f"ab_{i}{j}"),
                F.struct(
                    F.least(c(f"e{i}.left"), c(f"e{j}.left")).alias("x"), (c(f"d{i}") & c(f"l{j}")).alias("is_number"),
                    F.concat(c(f"x{i}"), c(f"u{j}")).alias("number"), c(f"r{i}").alias("region"), c(f"u{j}").alias("low"),
                ),
            )
        )
    rows = rows.withColumn("side", F.coalesce(*four)).withColumn(
        "stack", F.filter(F.array(*stack), lambda s: s.isNotNull())
    )
    # Two stacked pairs: the right one is the number, the left one region over country.
    p0, p1 = F.get("stack", 0), F.get("stack", 1)
    rows = rows.withColumn("right_pair", F.when(p1["x"] > p0["x"], p1).otherwise(p0)).withColumn(
        "left_pair", F.when(p1["x"] > p0["x"], p0).otherwise(p1)
    )
    four_tokens = (
        F.when(
            c("side").isNotNull(),
            _outcome("linear_4_elements", c("side.number"), c("side.region"), F.when(c("side.region").isNotNull(), "KG")),
        )
        .when(F.size("stack") != 2, _outcome("unrecognized_4_elements", None, None, None, False))
        .when(~c("right_pair.is_number"), _outcome("invalid_stacked_pattern", None, None, None, False))
        .otherwise(_outcome("double_stacked", c("right_pair.number"), c("left_pair.region"), kg(c("left_pair.low"))))
    )
    single = F.when(F.length("x0") >= 4, _outcome("single", c("x0"), None, None)).otherwise(
        _outcome("unknown", None, None, None, False)
    )
    unhandled = F.concat(F.lit("unhandled_"), n.cast("string"), F.lit("_elements"))
    outcome = (
        F.when(c("mains") > 1, _outcome("ambiguous_multiple_plates", None, None, None, False))
        .when((c("mains") == 1) & (n == 2), one_other)
        .when((c("mains") == 1) & (n == 3), two_others)
        .when(c("mains") == 1, alone)
        .when(n == 3, three_tokens)
        .when(n == 4, four_tokens)
        .when(n == 1, single)
        .otherwise(_outcome(unhandled, None, None, None, False))
    )
    o = rows.select(crop, "n", "mains", "mean_confidence", outcome.alias("o"))
    shown = F.when(c("o.country") != "KG?", c("o.country"))
    located = c("o.region").isNotNull() | c("o.country").isNotNull()
    return o.select(
        crop, c("n").alias("tokens"), c("o.layout").alias("layout_type"), c("o.region").alias("region_code"),
        c("o.country").alias("country_code"), c("o.number").alias("plate_number"),
        F.when(c("o.ok"), F.concat_ws(" ", c("o.region"), shown, c("o.number"))).otherwise("").alias("full_text"),
        (c("o.ok") & c("o.number").isNotNull() & located).alias("extraction_success"),
        F.when(c("mains") > 1, 0.0).otherwise(c("mean_confidence")).alias("confidence"),
    )


def region_rewrites(tokens: DataFrame) -> DataFrame:
    """How many two-digit texts the region repair turns into another code."""
    fixed = fix_region(F.col("text"))
    return (
        tokens.filter(F.col("text").rlike(r"^\d{2}$"))
        .groupBy(F.col("text").alias("code"), fixed.alias("repaired"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def region_texts(tokens: DataFrame, keys: tuple[str, ...] = ("region_id",)) -> DataFrame:
    """Text of each region, always one row: tokens above 0.3 in order, without spaces, upper case."""
    rows = tokens.filter("confidence > 0.3").select(
        *keys, "pos", F.upper(F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), " ", "")).alias("text")
    )
    first = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(first, lambda x: x["text"]), "").alias("text"))


def overlay_readings(tokens: DataFrame, image: str = "image_id") -> DataFrame:
    """Speed, unit, direction, clock and confidence read from the overlay texts of each image.

    The last matching token of an image wins; the confidence is the best of the tokens with a
    speed.  Aggregates only, so they combine before the shuffle.
    """
    text, pos = F.col("text"), F.col("pos")
    pattern = r"(?i)(\d+)\s*(km/h|mph)"
    speed = F.regexp_extract(text, pattern, 1)
    has_speed = speed != ""
    lower = F.lower(text)
    direction = F.when(lower.contains("head"), "approaching").when(lower.contains("tail"), "receding")
    clock = F.regexp_extract(text, r"\d{2}:\d{2}:\d{2}", 0)
    return tokens.groupBy(image).agg(
        F.max_by(F.when(has_speed, speed.try_cast("long")), F.when(has_speed, pos)).alias("speed"),
        F.coalesce(
            F.max_by(F.when(has_speed, F.lower(F.regexp_extract(text, pattern, 2))), F.when(has_speed, pos)), F.lit("km/h")
        ).alias("speed_unit"),
        F.max_by(direction, F.when(direction.isNotNull(), pos)).alias("direction"),
        F.max_by(F.when(clock != "", clock), F.when(clock != "", pos)).alias("clock"),
        F.coalesce(F.max(F.when(has_speed, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.count(F.lit(1)).alias("tokens"),
    )
