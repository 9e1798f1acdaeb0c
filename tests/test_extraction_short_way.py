"""The short ways through cleaning and mending give what the long ones do, and rows that need no cleaning take them."""

import random
import time

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import extraction


def long_mended(line):
    for pattern in extraction.DAMAGED:
        line = F.regexp_replace(line, pattern, "<|#|>")
    return line


def test_short_ways(spark):
    r = random.Random(3)
    damage = ["<|#|>", "<|#>", "<#|>", "<|>", "<||>", "<<|#|>", "<|#|>>", "<|#|>|", "|#|>", "||#||", "<|", "|>", "<", ">", "|", "#", "\\", ":", "a", " ", "\x01", "<x|#|y>", "<|##|>"]
    clean = list("aB 09.,-_<>&\"'\t\n\x00\x7f\x85  　“”Ａ—é") + ["中", "文", "&lt;", "&amp;", "<br>", "12", "1.5", "  "]
    rows = [("".join(r.choices(damage, k=r.randrange(9))), "".join(r.choices(clean, k=r.randrange(8)))) for _ in range(6000)]
    rows += [(None, None), ("", ""), *((d + e, x) for d, e, x in zip(damage, damage[1:], [" 7 ", "12", "1.", " .5 ", "123", "a12", "1 2"] * 4))]
    df = spark.createDataFrame(rows, "line string, t string")
    for a, b in ((extraction.mended(F.col("line")), long_mended(F.col("line"))), *((text.cleaned(F.col("t"), q), text.normalized(text.sanitize(F.col("t")), q)) for q in (False, True))):
        assert df.select("line", "t", a.alias("a"), b.alias("b")).filter("not a <=> b").collect() == []


def test_plain_records_are_quick(spark):
    row = F.concat(F.lit("relation<|#|>Part "), F.col("id"), F.lit("<|#|>Supplier "), F.col("id"), F.lit("<|#|>supplies<|#|>is supplied by"))
    lines = spark.range(0, 200_000, 1, 4).select(row.alias("line"))

    def seconds(mend, clean):
        fields = lines.select(F.split(mend(F.col("line")), "\\Q<|#|>\\E").alias("f")).select(F.explode("f").alias("t"))
        began = time.time()
        fields.select(clean(F.col("t")).alias("t")).write.format("noop").mode("overwrite").save()
        return time.time() - began

    quick = lambda: seconds(extraction.mended, text.cleaned)
    slow = lambda: seconds(long_mended, lambda t: text.normalized(text.sanitize(t)))
    quick()
    assert 2 * quick() < slow()
