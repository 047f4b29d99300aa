import pytest
from pyspark.sql import functions as F

from folioscope import fixed
from folioscope.functions import styles as st
from folioscope.sources.vocabulary import load_zone_rules

NAMES = {
    "  H1 ": "H1", "SK_H2": "TH2", "TBL-H5": "TH5", "T-DIR": "T", "EFP_H1": "H1",
    "BX-TTL": "TTL", "EFP_BX-TXT": "TXT", "BL-FIRST": "BL-FIRST", "H1-MID": "H1",
    "NBX-BL-LAST": "NBX-BL-LAST", "BL2-MID": "BL2", "EOC_NL": "NL", "TXT_FLUSH": "FLUSH",
    "Ref-H1": "REFH1", "A  B": "A B", "NBX1-TTL": "TTL", "": "", "SK_H7": "H7",
}


def test_normal_form_in_spark_and_for_parameters(spark):
    df = spark.createDataFrame([(k,) for k in NAMES], "raw string")
    got = {r.raw: r.n for r in df.select("raw", st.normalize_style(F.col("raw")).alias("n")).collect()}
    assert got == NAMES
    assert {k: st.normalize_name(k) for k in NAMES} == NAMES


@pytest.mark.parametrize("allowed,tag,expected", [
    (["H1", "H2", "H3", "TXT"], "H5", "H3"),
    (["BL-MID", "TXT"], "BL-FIRST", "BL-MID"),
    (["BX2-TXT-FLUSH", "BX2-TXT-MORE", "TXT"], "BX2-TXT", "BX2-TXT-MORE"),
    (["TXT"], "QQQQ", "TXT"),
    (["FIG-LEG"], "WXYZ", "WXYZ"),
    (["FIG-LEGS", "TXT"], "FIGLEGS", "FIG-LEGS"),
])
def test_semantic_remap(spark, allowed, tag, expected):
    v = st.Vocabulary(allowed)
    df = spark.createDataFrame([(tag,)], "t string")
    assert df.select(st.ensure_allowed(F.col("t"), v)).first()[0] == expected


def test_zone_tables(spark):
    rows = [("T", "TABLE"), ("T9", "TABLE"), ("H1", "TABLE"), ("H1", "BODY"), ("ZZ", "BOX_EXER"), ("EOC-BL-MID", "BACK_MATTER")]
    df = spark.createDataFrame(rows, "tag string, zone string")
    listed = spark.createDataFrame([("table", " T "), ("TABLE", "T"), ("BACK_MATTER", "EOC-BL-MID")], "zone string, style string")
    rules = load_zone_rules(listed)
    assert rules == {"TABLE": ["T"], "BACK_MATTER": ["EOC-BL-MID"]}
    exact = [r[0] for r in df.select(st.zone_accepts_exact("tag", "zone", rules)).collect()]
    wild = [r[0] for r in df.select(st.zone_accepts_wildcard("tag", "zone")).collect()]
    assert exact == [True, True, False, True, True, True]
    assert wild == [True, False, False, True, True, True]


def test_alias_ladder(spark):
    v = st.Vocabulary(fixed.default_vocabulary())
    cases = [
        ("BIBITEM", "BODY", True, "• Smith", "REF-U"), ("BIBITEM", "BODY", False, "", "REF-U"),
        ("COUT", "BODY", False, "", "COUT-1"), ("TTL", "BOX_BX2", False, "", "BX2-TTL"),
        ("1-TTL", "BOX_NBX", False, "", "NBX-TTL"), ("TBL-BL-MID", "TABLE", False, "", "TBL-MID"),
        ("H2", "TABLE", False, "", "TH1"), ("T1", "BACK_MATTER", False, "12. x", "REF-N"),
        ("Tag: h1!", "BODY", False, "", "H1"), ("2-TXT", "BODY", False, "", "BX2-TXT"),
    ]
    df = spark.createDataFrame([c[:4] for c in cases], "tag string, zone string, in_ref boolean, text string")
    got = [r.mapped_tag for r in st.map_tag_alias(df, "tag", v).collect()]
    assert got == [c[4] for c in cases]


def test_styles_of_another_length_are_not_compared(spark, monkeypatch):
    """Free text in a tag is not held against every style; what is near is found as before."""
    plain = st.edit_similarity
    apart = lambda a, b: F.abs(F.length(a) - F.length(b)) > 0.5 * F.greatest(F.length(a), F.length(b))
    monkeypatch.setattr(st, "edit_similarity", lambda a, b: F.when(apart(a, b), F.raise_error("compared")).otherwise(plain(a, b)))
    vocabulary = st.Vocabulary(["TXT", "BL-MID", "REF-U", "Heading-1"])
    want = {"TXTS": "TXT", "bl-mit": "BL-MID", "REF": "REF-U", "heading1": "Heading-1", "WORDS" * 30: None, "": None, "H": None, "T": None}
    tags = spark.createDataFrame([*want.items(), (None, None)], "tag string, want string")
    rows = tags.select("tag", "want", st.nearest(F.col("tag"), vocabulary, fold_case=True).alias("got")).collect()
    assert [(r.tag, r.got) for r in rows] == [(r.tag, r.want) for r in rows]
