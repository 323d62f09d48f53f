import pytest
from pyspark.sql import functions as F

from relaygrid.operators.security import LabelScheme, access_expr

# fixed values: the label scheme the decisions below belong to
SCHEME = LabelScheme(
    levels={"LOW": 10, "LOW: LY": 20, "MEDIUM": 30, "HIGH": 40, "TOP HIGH": 50},
    caveats=("MOD1", "MOD2", "MOD3", "HANOVERLAP", "OVER", "RESTRICTED1", "RESTRICTED2"),
    groups=("REL:APPLE", "REL:BEE", "REL:CAR"),
    markings=("TLP:CLEAR", "TLP:GREEN", "TLP:AMBER", "TLP:AMBER+STRICT"),
)


@pytest.mark.parametrize("limit, allowed, denied", [
    ("MEDIUM MOD1 REL:APPLE", ["LOW", "LOW MOD1", "MEDIUM MOD1", "MEDIUM", "MEDIUM REL:APPLE", "MEDIUM REL:APPLE,BEE"], []),
    ("MEDIUM", ["LOW", "low: ly"], ["HIGH", "TOP HIGH", "HIGH MOD1", "HIGH REL:APPLE", "LOW MOD1", "LOW MOD2", "MEDIUM MOD3", "Random"]),
    ("Random", [], ["MEDIUM", "Random"]),
    ("TOP HIGH REL:CAR OVER", ["HIGH OVER", "TOP HIGH REL:BEE REL:CAR"], ["HIGH HANOVERLAP", "HIGH REL:BEE", "HIGH REL:DOG"]),
])
def test_access(spark, limit, allowed, denied):
    rows = spark.createDataFrame([(x, x in allowed) for x in allowed + denied], "label string, want boolean")
    for row in rows.withColumn("got", access_expr(F.lit(limit), F.col("label"), SCHEME)).collect():
        assert row.got == row.want, row.label
