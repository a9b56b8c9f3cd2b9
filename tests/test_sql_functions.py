from pyspark.sql import functions as F

from postingflow.functions import identity as idn, infer, text
from postingflow.functions.sql import register


def test_sql_functions_equal_columns(spark):
    register(spark)
    rows = [("  Sênior .NET – Sãó Paulo/SP \t", "R$ 8.000,00 a 9,5 por mês"), ("C# e Java's", "1,234.56"), (None, None), ("̀x", "nada")]
    df = spark.createDataFrame(rows, "a string, b string")
    df.createOrReplaceTempView("sql_input")
    got = spark.sql("SELECT normalize_text(a) n, fingerprint(a, b, a, b) f, url_hash_id(a) u, parse_salary(b) s, infer_tags(a, b) t FROM sql_input").collect()
    want = df.select(text.normalize_text(F.col("a")).alias("n"), idn.fingerprint(*[F.col(c) for c in "abab"]).alias("f"),
                     idn.url_hash_id(F.col("a")).alias("u"), infer.parse_salary(F.col("b")).alias("s"), infer.infer_tags(F.col("a"), F.col("b")).alias("t")).collect()
    assert got == want
    objs = spark.sql("""SELECT o.ord, o.object FROM VALUES ('{"a":[{"b":1}]}'), ('{bad') t(j), LATERAL json_objects(j) o ORDER BY ord""").collect()
    assert [(r.ord, r.object) for r in objs] == [(0, '{"a":[{"b":1}]}'), (1, '{"b":1}')]
