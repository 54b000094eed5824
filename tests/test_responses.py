"""Responses made of whole texts: whatever a text holds, its description survives the repair."""

import json
import re

import duckdb
import pytest

from mediaops.workloads import texting

TEXTS = [
    "Строка на русском,\nс переносом и \"кавычками\"", "tab\there, back\\slash and 'quotes'", "", "   \n ", "一只猫 sits here and there, quite long",
    "ends in blanks   \n  \nsecond part after a gap", "bold **mark** inside", "list [1, 2, ] and {a, }", "{\"json\": [1, 2]} within", "é à ü ß ñ",
    "a" * 30_000, "word " * 60, "same same same same same same same", "x\u0085y\u007fz", "\x01\x02 control \x1b marks", "dash - Keywords: not a heading",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("responses")
    rows = [(6 * i + form, t, ["high", "en", ""][i % 3], f"s{form % 2}", len(t)) for i, t in enumerate(TEXTS) for form in range(6)]
    rows += [(6 * len(TEXTS) + form, None, "en", "s0", 0) for form in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["x7_response_outcomes", "x7_outcome_counts", "x8_field_repair", "x9_quality_flags", "a15_parse_quality", "p10_search_documents"])
def test_whole_texts_equal_sql(spark, folder, name):
    from __spark_entry__ import oracle_sql, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    result = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(c) for c in columns]
    expected = sorted((tuple(row[i] for i in at) for row in result.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in queries()[name](spark, folder).collect()), key=repr)
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert [float(v) if type(v).__name__ in ("Decimal", "float") else v for v in g] == [float(v) if type(v).__name__ in ("Decimal", "float") else v for v in e]


def test_descriptions_by_hand(spark, folder):
    """JSON forms against Python's own parser, headings against a plain search."""
    got = {r.segment_index: r.description for r in texting.outcomes(spark, folder).collect()}
    for i, text in enumerate(TEXTS):
        written = re.sub(r",[ \t\n\x0b\f\r]*([}\]])", r"\1", re.sub("[\x7f-\x9f]", "", json.dumps(text, ensure_ascii=False)))
        for form in (0, 1, 2, 5):
            assert got[6 * i + form] == json.loads(written), (i, form)
        assert got[6 * i + 4] is None
    assert got[3] == re.sub("[\x7f-\x9f]", "", TEXTS[0]) and got[6 * 6 + 3] == "bold" and got[6 * 3 + 3] == "**Keywords:"
    flags = {r.segment_index: r.flags.split(",") for r in texting.quality(spark, folder).collect()}
    assert "chinese_characters" in flags[6 * 4] and "chinese_characters" not in flags[0]
    assert "keyword_loop" in flags[6 * 12] and "empty_required_fields" in flags[6 * 3] and "search_terms_loop" in flags[6 * 11]
