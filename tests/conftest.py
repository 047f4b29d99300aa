import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session

    return session(4)


def paragraphs(spark, rows, **defaults):
    """Rows of (doc_id, para_id, text, ...) dicts with structure defaults."""
    base = {
        "zone": "BODY", "box_type": None, "box_marker": None, "box_label": None,
        "box_title": False, "caption_type": None, "source_line": False, "list_kind": None,
        "list_position": None, "has_bullet": False, "has_xml_list": False, "in_ref": False,
        "is_header_row": False, "is_stub_col": False, "ref_heading": False, "is_table": False,
        "tag": "TXT", "confidence": 0.8, "text": "x", "doc_id": 1,
    }
    base.update(defaults)
    filled = [{**base, "para_id": i + 1, **r} for i, r in enumerate(rows)]
    schema = (
        "doc_id long, para_id long, text string, zone string, box_type string, box_marker string, "
        "box_label string, box_title boolean, caption_type string, source_line boolean, list_kind string, "
        "list_position string, has_bullet boolean, has_xml_list boolean, in_ref boolean, is_header_row boolean, "
        "is_stub_col boolean, ref_heading boolean, is_table boolean, tag string, confidence double"
    )
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in filled], schema)
