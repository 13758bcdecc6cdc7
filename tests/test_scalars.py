import pytest
from pyspark.sql import functions as F

from schemaloom.functions import draws, scalars, vectors


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} string" for k in row)
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("declared,group", [
    (None, "BLOB"), ("", "BLOB"), ("int", "INTEGER"), ("POINT", "INTEGER"), ("VARCHAR(20)", "TEXT"), ("blob", "BLOB"),
    ("float", "REAL"), ("DATETIME", "DATE"), ("timestamp", "DATE"), ("DECIMAL(8,2)", "NUMERIC"), ("CHARINT", "INTEGER"),
])
def test_affinity_takes_first_rule(spark, declared, group):
    assert one(spark, scalars.affinity(F.col("t")), t=declared) == group


@pytest.mark.parametrize("declared,expected", [
    ("int", ("INT", "INTEGER")), ("timestamp", ("TIMESTAMP", "TEXT")), ("VARCHAR(20)", ("TEXT", "TEXT")), ("Double", ("DOUBLE", "REAL")),
])
def test_exact_type_falls_back_to_text(spark, declared, expected):
    assert tuple(one(spark, scalars.exact_type(F.col("t")), t=declared)) == expected


@pytest.mark.parametrize("text", [
    "singerId names?", "a_b  c\t\nD", "", "  lead", " x y　z", "__", "x\x1cy\x85z",
])
def test_tokens_equal_python_split(spark, text):
    assert one(spark, scalars.tokens(F.col("t")), t=text) == text.lower().replace("_", " ").split()


@pytest.mark.parametrize("sql,names", [
    ("select * from a join b on 1=1", {"a", "b"}),
    ('SELECT x FROM "main"."Tab" t', {"tab"}),
    ("select * from (select 1) x join [c]", {"c"}),
    ("select * from a, b", {"a"}),
    ("select extract(year from d) from t", {"d", "t"}),
    ("xfrom y", {"y"}),
    ("select * from from x", {"from", "x"}),
    ("select * from café", {"café"}),
    (None, set()),
])
def test_table_refs(spark, sql, names):
    assert set(one(spark, scalars.table_refs(F.col("q")), q=sql)) == names


@pytest.mark.parametrize("args,sql", [('{"sql": "select 1"}', "select 1"), ('{"k": 1}', None), ("{bad", None), (None, None)])
def test_tool_sql(spark, args, sql):
    assert one(spark, scalars.tool_sql(F.col("a")), a=args) == sql


def test_prompt_line_marks_not_null_as_asked(spark):
    df = spark.createDataFrame([("id", "int", True, 1), ("x", "text", False, 2)], "name string, type string, nn boolean, pk int")
    cols = [F.col(c) for c in ("name", "type", "nn", "pk")]
    fixed = [r[0] for r in df.select(scalars.prompt_column_line(*cols)).collect()]
    published = [r[0] for r in df.select(scalars.prompt_column_line(*cols, fix_not_null=False)).collect()]
    assert fixed == ["(id: INT, PRIMARY KEY, NOT NULL),\n", "(x: TEXT,),\n"]
    assert published == ["(id: INT, PRIMARY KEY,),\n", "(x: TEXT, NOT NULL),\n"]


def test_cosine_has_the_small_constant(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([24 / (25 + 1e-8), 0.0])


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20000)
    u = draws.uniform("t", F.col("id"))
    a = df.repartition(7).agg(F.avg(u), F.min(u), F.max(u), F.sum(F.round(u, 6))).first()
    b = df.coalesce(1).agg(F.avg(u), F.min(u), F.max(u), F.sum(F.round(u, 6))).first()
    assert abs(a[0] - 0.5) < 0.01 and a[1] >= 0 and a[2] < 1
    assert a[3] == pytest.approx(b[3], abs=1e-6)
    ends = df.agg(F.min(draws.integer("i", 6, 12, F.col("id"))), F.max(draws.integer("i", 6, 12, F.col("id")))).first()
    assert tuple(ends) == (6, 12)


def test_ratios_of_nothing_are_null(spark):
    assert spark.range(1).select(scalars.percent(F.lit(0), F.lit(0))).first()[0] is None


def test_first_token_is_the_first_of_tokens(spark):
    texts = [None, "", " ", "_  ", "one", " Two three", "__A_b", "x y z", "tail ", "ΑΣ b", "a,b c_d e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select(scalars.first_token(F.col("text")).alias("one"), F.get(scalars.tokens(F.col("text")), F.lit(0)).alias("of_all")).collect()
    assert [r.one for r in rows] == [r.of_all for r in rows] and rows[5].one == "two"
