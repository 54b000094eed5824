"""Codes, layouts, responses, transcripts, stills, tables and sinks on small literals."""

import itertools
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from mediaops.operators import codes, labels, responses, sequences, tables, transcripts
from mediaops.sources import readers, writers


def test_region_repair(spark):
    df = spark.createDataFrame([("GD",), ("TO",), ("61",), ("10",), ("07",)], "t string")
    assert [r[0] for r in df.select(codes.fix_region(F.col("t"))).collect()] == ["00", "01", "01", "01", "07"]
    fixed = spark.createDataFrame([("GO5ADG",), ("AB",)], "t string").select(codes.fix_number(F.col("t")))
    assert [r[0] for r in fixed.collect()] == ["005ADG", "AB"]


def layout_model(toks):
    """Plain reading of the layout rules for one crop of (text, left, top, right, bottom)."""
    import re

    def reg(t):
        for a, b in codes.REGION_FIXES:
            t = t.replace(a, b)
        return t if re.fullmatch(r"\d{2}", t) else None

    def above(a, b):
        if a[4] < b[2]:
            return True
        if a[2] >= b[2] or a[4] - b[2] > min(a[4] - a[2], b[4] - b[2]) * 0.4:
            return False
        return max(0, min(a[3], b[3]) - max(a[1], b[1])) >= min(a[3] - a[1], b[3] - b[1]) * 0.5

    def beside(a, b):
        h, w = min(a[4] - a[2], b[4] - b[2]), min(a[3] - a[1], b[3] - b[1])
        lap = min(a[3], b[3]) - max(a[1], b[1])
        return abs(a[2] - b[2]) < h * 0.25 and abs(a[4] - b[4]) < h * 0.25 and a[1] < b[1] and (lap <= 0 or lap / w < 0.3)

    def d3(t):
        return bool(re.fullmatch(r"\d{3}", t))

    def l23(t):
        return bool(re.fullmatch(r"[A-Z]{2,3}", t.upper()))

    n = len(toks)
    mains = [i for i, t in enumerate(toks) if len(t[0]) >= 4 and re.search("[A-Z]", t[0].upper()) and re.search(r"\d", t[0])]
    if len(mains) > 1:
        return "ambiguous_multiple_plates", None, None, None
    if mains:
        number, rest = toks[mains[0]][0], [t for i, t in enumerate(toks) if i != mains[0]]
        if len(rest) == 1:
            up = rest[0][0].upper()
            if reg(rest[0][0]):
                return "linear", reg(rest[0][0]), "KG?", number
            if up in ("KG", "KS", "KZ"):
                return "linear", None, "KZ" if up == "KZ" else "KG", number
        if len(rest) == 2:
            for a, b in (rest, rest[::-1]):
                if above(a, b):
                    if reg(a[0]):
                        return "stacked", reg(a[0]), "KG" if b[0].upper() in ("KG", "KS") else None, number
                    break
        return "unknown", None, None, number
    if n == 3:
        for i, j in itertools.combinations(range(3), 2):
            a, b, r = toks[i], toks[j], reg(toks[3 - i - j][0])
            if beside(a, b):
                if d3(a[0]) and l23(b[0]):
                    return "linear_3_elements", r, "KG?" if r else None, a[0] + b[0].upper()
                if re.fullmatch("[A-Z]{3}", a[0].upper()) and d3(b[0]):
                    return "linear_3_elements", r, "KG?" if r else None, a[0].upper() + b[0]
        for i, j in itertools.permutations(range(3), 2):
            a, b, r = toks[i], toks[j], reg(toks[3 - i - j][0])
            if above(a, b) and d3(a[0]) and l23(b[0]):
                return "stacked_with_region", r, "KG?" if r else None, a[0] + b[0].upper()
        return "unrecognized_3_elements", None, None, None
    if n == 4:
        for i, j in itertools.combinations(range(4), 2):
            text = (toks[i][0] + toks[j][0]).upper()
            if beside(toks[i], toks[j]) and len(text) >= 4 and re.search("[A-Z]", text) and re.search(r"\d", text):
                a, b = [toks[k] for k in range(4) if k not in (i, j)]
                if not above(a, b):
                    a, b = b, a
                region = None
                if above(a, b):
                    region = (reg(a[0]) if re.search("KG|KS", b[0].upper()) else None) or (
                        reg(b[0]) if re.search("KG|KS", a[0].upper()) else None
                    )
                return "linear_4_elements", region, "KG" if region else None, text
        found = [(i, j) for i, j in itertools.combinations(range(4), 2) if above(toks[i], toks[j])]
        if len(found) != 2:
            return "unrecognized_4_elements", None, None, None
        x = [min(toks[i][1], toks[j][1]) for i, j in found]
        right, left = (found[1], found[0]) if x[1] > x[0] else (found[0], found[1])
        a, b = toks[right[0]][0], toks[right[1]][0]
        if not (d3(a) and l23(b)):
            return "invalid_stacked_pattern", None, None, None
        low = toks[left[1]][0].upper()
        return "double_stacked", reg(toks[left[0]][0]), "KG" if low in ("KG", "KS") else None, a + b.upper()
    if n == 1:
        return ("single", None, None, toks[0][0]) if len(toks[0][0]) >= 4 else ("unknown", None, None, None)
    return f"unhandled_{n}_elements", None, None, None


def test_layouts_against_model(spark):
    rnd = random.Random(17)
    texts = ["459", "ADG", "adg", "01", "KG", "KS", "kz", "GD", "61", "459ADG", "AB12", "SOLO", "A", "KG1", "123"]
    data, want = [], {}
    for crop in range(1500):
        toks = []
        for _ in range(rnd.randrange(1, 6)):
            x, y = rnd.choice([0, 38, 45, 100]), rnd.choice([0, 2, 16, 18, 30])
            toks.append((rnd.choice(texts), x, y, x + 40, y + rnd.choice([18, 20])))
        data += [(crop, i, t[0], 0.5, *t[1:]) for i, t in enumerate(toks)]
        want[crop] = layout_model(toks)
    df = spark.createDataFrame(data, "crop_id long, pos int, text string, confidence double, left int, top int, right int, bottom int")
    got = codes.assemble_layout(df).collect()
    assert {r["crop_id"]: (r["layout_type"], r["region_code"], r["country_code"], r["plate_number"]) for r in got} == want
    assert len({w[0] for w in want.values()}) >= 11
    for r in got:
        assert r["extraction_success"] == bool(r["plate_number"] and (r["region_code"] or r["country_code"]))


def test_documented_layout(spark):
    df = spark.createDataFrame(
        [(1, 0, "01", 0.8, 0, 0, 40, 20), (1, 1, "459", 0.9, 50, 0, 90, 20), (1, 2, "ADG", 0.7, 95, 0, 140, 20)],
        "crop_id long, pos int, text string, confidence double, left int, top int, right int, bottom int",
    )
    r = codes.assemble_layout(df).first()
    assert (r["region_code"], r["country_code"], r["full_text"], r["extraction_success"]) == ("01", "KG?", "01 459ADG", True)


def test_code_rules(spark):
    texts = ["123ABC02", "А123ВС77", "АВ12377", "1234ТР199", "12-34МСК", "B-MW 1234", "ab", "А777АА05", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: (r["rule"], r["region"]) for r in codes.classify_codes(df).collect()}
    assert got[0] == ("kz_new", "Almaty Region") and got[1] == ("kz_old", "Region 77")
    assert got[2] == ("ru_taxi", "Moscow") and got[3] == ("ru_transit", "Moscow")
    assert got[4] == got[5] == got[6] == got[8] == (None, None)
    kept = {r["id"]: r["rule"] for r in codes.classify_codes(df, keep_separators=True).collect()}
    assert kept[4] == "soviet"


def test_responses(spark):
    cases = [
        ('```json\n{"description": "a", "keywords": ["x", "y",],}\n```', "fenced", {"description": "a", "keywords": ["x", "y"]}),
        ('text ```json {"a": 1}', "fenced", {"a": 1}),
        ('```\n{"a": 2}\n```', "fenced", {"a": 2}),
        ('{"description": "b"', "closed", {"description": "b"}),
        ("  ", "empty", {}),
        ('{"a": "\x07b"}  ', "plain", {"a": "b"}),
        ("nothing", "invalid", None),
        ("- Description: big room\n- Keywords: k1; k2\n- Content type: talk\n\nend", "markdown",
         {"description": "big room", "keywords": ["k1", "k2"], "content_type": "talk"}),
        ("**Описание:** Комната\n\n**ключевые слова:** * a\n* b\n\n", "markdown", {"description": "Комната"}),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, response string")
    got = {r["id"]: r for r in responses.repair_responses(df).collect()}
    for i, (_, outcome, want) in enumerate(cases):
        assert got[i]["outcome"] == outcome, (i, got[i])
        if want is not None:
            parsed = json.loads(got[i]["json_text"])
            assert {k: parsed[k] for k in want} == want


def test_field_repair(spark):
    texts = ['{"mchange": true, "keywords": "one"}', '{"keywords": 5, "scene_change": false, "mchange": true}', '{"keywords": ["a"], "confidence": "low"}', "bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, json_text string")
    got = {r["id"]: r["analysis"] for r in responses.repair_fields(df).collect()}
    assert got[0]["scene_change"] == "true" and got[0]["keywords"] == ["one"] and got[0]["description"] == responses.NO_DESCRIPTION
    assert got[1]["scene_change"] == "false" and got[1]["keywords"] == []
    assert got[2]["keywords"] == ["a"] and got[2]["confidence"] == "low" and got[3] is None


def test_quality_flags(spark):
    long = "a description of enough length"
    data = [
        ("m", 0, "r", (long, "high", ["w"] * 500, "t")), ("m", 1, "字", (long, "sure", [], "t")),
        ("m", 2, "r", ("", "", None, " ".join(["ab"] * 60))), ("n", 0, "r", (long, "HIGH", list("abcdefgh"), None)),
    ]
    schema = "media string, segment_index int, response string, analysis struct<description:string,confidence:string,keywords:array<string>,search_terms:string>"
    for max_rows in (10**6, 2):
        got = {(r["media"], r["segment_index"]): (r["flags"], r["critical"]) for r in responses.quality_flags(spark.createDataFrame(data, schema), max_rows=max_rows).collect()}
        assert got[("m", 0)] == (["keyword_loop", "keyword_flood"], True)
        assert got[("m", 1)] == (["chinese_characters", "duplicate_description", "invalid_confidence"], False)
        assert got[("m", 2)] == (["short_description", "empty_required_fields", "search_terms_loop"], True)
        assert got[("n", 0)] == ([], False)


def test_translations(spark):
    answers = spark.createDataFrame([("m", 0, '0.0,1.5,"Hi, you",00:00:00,00:00:01\n\nbroken\n[TRANSLATION_FAILED] x')], "media string, chunk int, answer string")
    originals = spark.createDataFrame([("m", 0, i, f"o{i}") for i in range(4)], "media string, chunk int, line_no int, text string")
    got = [(r["line_no"], r["original_text"], r["translated_text"]) for r in transcripts.match_translations(answers, originals).orderBy("line_no").collect()]
    assert got == [(0, "o0", "Hi, you"), (2, "o2", transcripts.PARSE_FAILED), (2, "o2", transcripts.MISSING), (3, "o3", transcripts.MISSING)]


def test_file_names(spark):
    names = ["20250922144438199-1.jpg", "20250922144438-12.png", "2025-1.jpg", "x.jpg", "20251322144438199-1.jpg", "20250922144438199-a.jpg"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [(str(r["taken_at"]), r["frame_no"]) for r in sequences.parse_file_names(df).collect()]
    assert got[0] == ("2025-09-22 14:44:38.199000", 1) and got[1] == ("2025-09-22 14:44:38", 12)
    assert all(g == ("None", None) for g in got[2:])


def sequence_model(files):
    """(name, ms, frame) of one directory in name order -> {name: (first name, position)}."""
    open_, out = [], {}
    for name, ms, frame in sorted(files):
        hit = next((s for s in open_ if frame > 1 and s["frame"] == frame - 1 and abs(ms - s["ms"]) <= 500), None)
        if hit is None:
            hit = {"id": name, "n": 0}
            open_.append(hit)
        hit.update(frame=frame, ms=ms, n=hit["n"] + 1)
        out[name] = (hit["id"], hit["n"])
    return out


@pytest.mark.parametrize("max_rows", [10**6, 40])
def test_sequences_interleave(spark, max_rows):
    rnd = random.Random(23)
    data, want = [], {}
    for d in ("a", "b"):
        ms, files = 0, []
        for _ in range(150):
            ms += rnd.choice([0, 40, 200, 499, 501, 900])
            frame = rnd.randrange(1, 4)
            stamp = f"20250922{14 + ms // 3600000:02d}{ms // 60000 % 60:02d}{ms // 1000 % 60:02d}{ms % 1000:03d}"
            files.append((f"{stamp}-{frame}.jpg", ms, frame))
        files = sorted(set(files))
        want |= {(d, n): v for n, v in sequence_model(files).items()}
        data += [(d, f[0]) for f in files]
    data.append(("a", "odd.jpg"))
    want[("a", "odd.jpg")] = ("odd.jpg", 1)
    df = sequences.parse_file_names(spark.createDataFrame(data, "dir string, name string"))
    got = sequences.build_sequences(df.select("dir", "name", "taken_at", "frame_no"), max_rows).collect()
    assert {(r["dir"], r["name"]): (r["sequence_id"], r["pos"]) for r in got} == want


def test_upsert_rules(spark):
    base = spark.createDataFrame([("s1", 0.0, "old", 1), ("s2", 5.0, "keep", 2)], "id string, start_time double, description string, n int")
    new = spark.createDataFrame([("s1", 9.0, "first", 1), ("s1", 9.0, None, 2), ("s3", 7.0, "new", 1)], "id string, start_time double, description string, seq int")
    got = rows(tables.upsert(base, new, ["id"], {"description": tables.NEW, "n": tables.INCREMENT}, {"n": F.lit(1)}, ["seq"]))
    # The last update wins; each of the two counts.
    assert got == [("s1", 0.0, None, 3), ("s2", 5.0, "keep", 2), ("s3", 7.0, "new", 1)]
    twice = new.filter("seq = 1").unionByName(new.filter("id = 's3'").withColumn("seq", F.lit(2)))
    got = rows(tables.upsert(base, twice, ["id"], {"n": tables.INCREMENT}, {"n": F.lit(1)}))
    assert got == [("s1", 0.0, "old", 2), ("s2", 5.0, "keep", 2), ("s3", 7.0, "new", 2)]


def test_speed_band(spark):
    df = spark.createDataFrame([(31.0,), (30.0,), (0.0,), (None,), (71.0,)], "speed double")
    got = [(r["fine"], r["article"]) for r in labels.speed_bands(df).collect()]
    assert [g[0] for g in got] == [3000, 1000, 0, 0, 7500] and got[2][1] == labels.NO_ARTICLE
    assert got[0][1] == "ст. 187 ч.2 КоАП КР"


def test_make_table(spark):
    df = spark.createDataFrame([(0, 0.9), (430, 0.9), (431, 0.9), (5, 0.3)], "class_id int, confidence double")
    got = [(r["make"], r["model"], r["year"]) for r in labels.make_model(df).collect()]
    assert got == [("Toyota", "Camry", "2010"), ("Ford", "Explorer", "2020"), ("Unknown",) * 3, ("Unknown",) * 3]


def test_result_files(spark, tmp_path):
    doc = {"video_info": {"video_name": "v"}, "segments": [{"segment_index": i, "analysis": "{}", "success": True} for i in range(3)]}
    (tmp_path / "talk_phase2_vllm_analysis.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_results(spark, str(tmp_path))
    assert [(r["media"], r["segment_index"]) for r in got.orderBy("segment_index").collect()] == [("talk", i) for i in range(3)]
    empty = spark.range(0).select(F.lit("m").alias("media"), "id")
    with pytest.raises(ValueError):
        writers.export_csv(empty, str(tmp_path), "objects")


def test_image_listing(spark, tmp_path):
    (tmp_path / "cam").mkdir()
    (tmp_path / "cam" / "a.JPG").write_bytes(b"\xff\xd8\xff\xe0\x00\x10JFIF")
    (tmp_path / "cam" / "b.png").write_bytes(b"\x89PNG\r\n")
    (tmp_path / "cam" / "c.bmp").write_bytes(b"")
    (tmp_path / "cam" / "d.webp").write_bytes(b"xx")
    (tmp_path / "e.gif").write_bytes(b"GIF89a")
    files = readers.list_images(spark, str(tmp_path))
    # Spark's file source does not list empty files.
    assert [r["name"] for r in files.collect()] == ["a.JPG", "b.png", "d.webp"]
    good, bad = readers.check_headers(files)
    assert {r["name"] for r in good.collect()} == {"a.JPG", "b.png"}
    assert {r["name"]: r["error"] for r in bad.collect()} == {"d.webp": "file too small"}


def test_ids_are_consecutive(spark):
    got = writers.assign_ids(spark.range(1000).withColumnRenamed("id", "k"), ["k"], after=10)
    assert sorted(r["id"] for r in got.collect()) == list(range(11, 1011))
