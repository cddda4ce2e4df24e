"""The SQL functions agree with the Column functions; golden cases of the normalisers."""

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import classify as C
from parcelflow.functions import normalize as N
from parcelflow.functions import sql

VALUES = [None, "", "  ", "(212) 555-0100", "1-212-555-0100", "+44 20 7946 0958", "12", " A@B.Com ", "HTTPS://www.X.com//", "The Big Fund", "an apple", "L.L.C. & Sons"]


def test_sql_functions(spark):
    names = sql.register(spark)
    mine = {"norm_phone": N.norm_phone, "phone_e164": N.phone_e164, "norm_email": N.norm_email, "norm_website": N.norm_website, "norm_entity_alnum": N.alnum_upper, "strip_article": N.strip_article}
    df = spark.createDataFrame([(v,) for v in VALUES], "s string")
    assert set(names) == set(mine)
    for name, f in mine.items():
        bad = df.select(F.expr(f"{name}(s)").alias("a"), f(F.col("s")).alias("b")).filter("NOT (a <=> b)").collect()
        assert not bad, (name, bad)


@pytest.mark.parametrize(
    "f, value, want",
    [
        (N.norm_entity, " Acme  L.L.C. ", "ACME LLC"), (N.norm_entity, "n/a", None), (N.norm_entity, "Foo Incorporated", "FOO INC"), (N.canon_street, "East 12th Street", "E 12 ST"),
        (N.house_number, "0012-14 Main St", "12-14"), (N.street_of, "5 West 3rd Ave, Brooklyn, NY", "W 3 AVE"), (N.street_of, "Main St", None), (N.normalize_address, "5 East 12th Street, New York, NY", "5 e 12 st"),
        (N.canonicalize_address, "5 Main Street Brooklyn NY 11201 Kings County", "5 MAIN ST"), (N.phone_e164, "212 555 0100", "+12125550100"), (N.iso_date_pad, "2026-6-8", "2026-06-08"), (N.iso_date_pad, "2026-13-8", None),
        (N.parse_money, "$1,200.50", 1200.5), (N.parse_money, "x", None), (N.parse_int_loose, "1,200.0", 1200), (C.borough_from_zip, "11004", "Queens"), (C.borough_from_text, "Sold in Astoria", "Queens"),
    ],
)
def test_golden(spark, f, value, want):
    assert spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("asset, cls, want", [("Condo", None, "banned_asset_type"), ("Office", "B1", "one_two_family"), ("Office", "RM", "condo_unit"), ("Office", "S1", "ok"), (None, None, "ok")])
def test_gate(spark, asset, cls, want):
    assert spark.createDataFrame([(asset, cls)], "a string, c string").select(C.residential_gate(F.col("a"), F.col("c"))).first()[0] == want
