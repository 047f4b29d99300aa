"""Window passes against plain folds on random sequences, and small cases."""

import random

from pyspark.sql import functions as F

from folioscope.functions.styles import Vocabulary
from folioscope.operators import quality, references, repair, zones
from tests.conftest import paragraphs

KEYS = ["doc_id", "para_id"]


def _table(spark, docs, columns):
    rows = [(d, i + 1, *r) for d, doc in enumerate(docs) for i, r in enumerate(doc)]
    return spark.createDataFrame(rows, f"doc_id long, para_id long, {columns}")


def test_zones_match_a_fold(spark):
    rng = random.Random(1)
    lines = ["book title: x", "chapter 3", "Introduction", "plain", "References", "<note>", "</note>", "<red flag>", "</red flag>", "more"]
    docs = [[(rng.choice(lines),) for _ in range(rng.randint(1, 25))] for _ in range(250)]

    def fold(texts):
        first = texts[0].lower()
        zone = {"book title: x": "METADATA", "chapter 3": "FRONT_MATTER", "introduction": "BODY"}.get(first, "FRONT_MATTER")
        box, out = None, []
        for t in texts:
            low = t.lower()
            if box:
                zone = box
                if low.startswith("</"):
                    box = None
            elif low in ("<note>", "<red flag>"):
                zone = box = "BOX_NBX" if low == "<note>" else "BOX_BX2"
            elif zone == "BODY":
                zone = "BACK_MATTER" if low == "references" else "BODY"
            elif zone != "BACK_MATTER":
                if low == "introduction":
                    zone = "BODY"
                elif low == "chapter 3":
                    zone = "FRONT_MATTER"
            out.append(zone)
        return out

    got = zones.segment_zones(_table(spark, docs, "text string")).orderBy(*KEYS).collect()
    want = [z for doc in docs for z in fold([t for (t,) in doc])]
    assert [r.zone for r in got] == want


def test_heading_hierarchy_matches_a_fold(spark):
    rng = random.Random(2)
    v = Vocabulary(["H1", "H2", "H3", "H4", "TXT"])
    tags = ["H1", "H2", "H3", "H4", "H5", "H6", "TXT"]
    docs = [[(rng.choice(tags), rng.choice([0.5, 0.75, 0.95]), rng.random() < 0.3) for _ in range(rng.randint(1, 14))] for _ in range(900)]

    def fold(doc):
        last, h1, h2, out = 0, False, False, []
        for tag, conf, came in doc:
            new = tag
            if not (tag in v and conf >= 0.9) and tag.startswith("H"):
                level = int(tag[1])
                if level >= 4:
                    new = "H3"
                if level == 2 and not h1:
                    new = "H1" if conf >= 0.7 else "TXT"
                if level == 3 and not h2 and not came:
                    new = "H2"
                if last and level > last + 1:
                    new = f"H{min(last + 1, 2)}" if conf >= 0.7 else "TXT"
            if new == "H1":
                h1, h2, last = True, False, 1
            elif new == "H2":
                h2, last = True, 2
            elif new == "H3":
                last = 3
            out.append(new)
        return out

    df = _table(spark, docs, "tag string, confidence double, from_h4h5 boolean").withColumns(
        {"repaired": F.lit(False), "repair_reason": F.lit(None).cast("string")})
    got = repair.fix_heading_hierarchy(df, v).orderBy(*KEYS).collect()
    assert [r.tag for r in got] == [t for doc in docs for t in fold(doc)]


def test_reference_zone_ends_after_a_streak(spark):
    cited = [("Smith, J. (2001). Journal of Things, vol. 3.",)] * 4
    prose = [("Ordinary prose without any cues at all",)] * 16
    docs = [[("Bibliography",)] + cited + prose, [("intro text here",), ("References",)] + cited + [("<H1>Next",)], [("no heading",)] * 5]
    rows = references.with_reference_zone(_table(spark, docs, "text string")).orderBy(*KEYS).collect()
    ends = {r.doc_id: (r.ref_trigger, r.ref_start, r.ref_end) for r in rows}
    assert ends[0] == ("heading_match", 0, 5)
    assert ends[1] == ("heading_match", 1, 6)
    assert ends[2] == ("none", None, None)


def test_secondary_heading_needs_citations(spark):
    cites = [(f"{i}. Smith, Jones et al. Journal of Tests. 2001;1:2.",) for i in range(1, 5)]
    far = [("plain words here",)] * 60
    rows = references.with_reference_start(_table(spark, [far + [("Sources",)] + cites, far + [("Sources",)] + far[:4]], "text string"))
    got = {r.doc_id: (r.ref_trigger, r.ref_start) for r in rows.select("doc_id", "ref_trigger", "ref_start").distinct().collect()}
    assert got == {0: ("secondary_heading_validated", 60), 1: ("none", None)}


def test_list_positions(spark):
    docs = [[("• a",), ("• b",), ("• c",), ("text",), ("1. x",), ("• y",)]]
    rows = zones.structure(_table(spark, docs, "text string")).orderBy(*KEYS).collect()
    assert [r.list_position for r in rows] == ["FIRST", "MID", "LAST", None, "FIRST", "FIRST"]


def _scored(spark, txt, extra=()):
    rows = [{"tag": "TXT" if i < txt else "PMI", "confidence": 0.95} for i in range(100)]
    return quality.score_documents(paragraphs(spark, rows + list(extra)), Vocabulary(["TXT", "PMI", "H1"]), "flag").first()


def test_quality_actions(spark):
    assert _scored(spark, 10).action == "PASS"
    assert _scored(spark, 30).action == "RETRY"
    assert _scored(spark, 80).action == "REVIEW"
    bad = _scored(spark, 1, [{"tag": "NOPE"}])
    assert bad.score is None and bad.unknown_style_count == 1


def _repaired(spark, rows, allowed, **options):
    df = repair.repair(paragraphs(spark, rows), Vocabulary(allowed), **options)
    return [r.tag for r in df.orderBy("para_id").collect()]


def test_table_cells(spark):
    styles = ["T2", "T4", "T", "TFN"]
    rows = [
        {"zone": "TABLE", "is_header_row": True}, {"zone": "TABLE", "is_stub_col": True},
        {"zone": "TABLE", "text": "plain cell value."}, {"zone": "TABLE", "text": "Note: see below"},
    ]
    assert _repaired(spark, rows, styles) == ["T2", "T4", "T", "TFN"]


def test_headings_and_flush(spark):
    styles = ["H1", "H2", "H3", "TXT", "TXT-FLUSH"]
    assert _repaired(spark, [{"tag": "H2", "confidence": 0.8}], styles) == ["H1"]
    assert _repaired(spark, [{"tag": "H2", "confidence": 0.6}], styles) == ["TXT"]
    assert _repaired(spark, [{"tag": "H1", "confidence": 0.9}, {"tag": "H3", "confidence": 0.8}], styles) == ["H1", "H2"]
    assert _repaired(spark, [{"tag": "H1", "confidence": 0.95}, {"text": "words"}], styles) == ["H1", "TXT-FLUSH"]


def test_back_matter_float(spark):
    styles = ["FIG-LEG", "FIG-SRC", "TSN", "TXT"]
    alone = [{"zone": "BACK_MATTER", "tag": "FIG-LEG", "confidence": 0.95}]
    assert _repaired(spark, alone, styles) == ["TSN"]
    pair = alone + [{"zone": "BACK_MATTER", "tag": "FIG-SRC", "confidence": 0.95}]
    assert _repaired(spark, pair, styles) == ["FIG-LEG", "FIG-SRC"]
