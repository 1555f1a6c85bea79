import pytest
from pyspark.sql import functions as F

from shutterloom.functions import instants

DAY = 86_400 * 10**9


@pytest.mark.parametrize(
    "text,want",
    [("1970:01:02 00:00:00", DAY), ("1970:01:02 00:00:00.5", DAY + 5 * 10**8), ("1970:01:02 02:00:00+02:00", DAY), ("1969:12:31 23:59:59.000000001", -(10**9) + 1), ("0000:00:00 00:00:00", None), ("x", None), (None, None)],
)
def test_exif(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(instants.exif_ns(F.col("t"))).first()[0] == want


def test_other_texts(spark):
    row = spark.createDataFrame([("1970-01-02T02:00:00.123456789+02:00", "1970-01-02T00:00:00", "1970:01:02 02:00:00", "-9223372036854775808", "9223372036854775808")], "a string, b string, c string, d string, e string")
    c = F.col
    got = row.select(instants.rfc3339_ns(c("a")), instants.rfc3339_ns(c("b")), instants.exif_ns(c("c"), F.lit("+02:00")), instants.decimal_ns(c("d")), instants.decimal_ns(c("e"))).first()
    assert tuple(got) == (DAY + 123_456_789, None, DAY, -(2**63), None)
