"""What must not grow with the rows: records of few files stay spread over many tasks, and
projections of a batch are short enough for the JVM to compile."""

import re

from pyspark.sql import functions as F

from carelake import schema as S
from carelake.functions.expr import clean_text, null_if_token, strip
from carelake.sources import records as RC
from carelake.streaming import replay as R

#: Bytes of a method beyond which the JVM leaves it interpreted.
COMPILED = 8000


def test_records_of_one_file_stay_spread(spark, tmp_path):
    """The rows of a file were gathered by its path, so four files made four tasks."""
    (tmp_path / "a.csv").write_text("No,Text\n" + "".join(f'{i},"x{i}\ny"\n' for i in range(2000)))
    conf = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = RC.by_header(spark, [str(tmp_path / "a.csv")])
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 1000
        assert [(r.row_id, r.No) for r in rows.orderBy("row_id").collect()] == [(i, str(i)) for i in range(2000)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_judged_records_are_compiled(spark):
    data = {f: None for f in R.DATA_FIELDS}
    rows = [(1, "visit", 1, data | {"doctor_name": "d", "visit_date": "02-01-2024"}, "2024-01-01 10:00:00", False),
            (2, "patient", None, data | {"first_name": "a", "last_name": "b", "phone_number": "55500", "date_of_birth": "31-02-1980"}, "x", False)]
    judged = R._judged(R._offered(spark.createDataFrame(rows, R.PENDING_SCHEMA)).checkpoint(), "2024-01-02")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    text = debug.codegenString(judged._jdf.queryExecution().executedPlan())
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
    assert sizes and max(sizes) < COMPILED
    got = {r.id: (r.visit_date and str(r.visit_date), r.date_of_birth, r.reason) for r in judged.collect()}
    assert got == {1: ("2024-01-02", None, None), 2: (None, None, f"{S.MSG_BAD_TIMESTAMP}; {S.MSG_BAD_DOB}")}


def test_placeholders_as_before(spark):
    texts = ["", " ", "\n", "nan", " NaN\r\n", "None\n\n", " nat　", "nane", "na n", "n", "x nan", "nan x", "İ", "K", None, " a "]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    given = ~F.lower(strip("c")).isin(S.NULL_TOKENS)
    wrong = rows.where(~null_if_token("c").eqNullSafe(F.when(given, F.col("c"))) | ~clean_text("c").eqNullSafe(F.when(given, strip("c"))))
    assert wrong.count() == 0
