import json
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from schemaloom.operators import catalog, profile
from schemaloom.sources import files

COLUMNS = "db_id string, table_name string, col_ord int, name string, type string, typegroup string, not_null boolean, pk int"
FKS = "db_id string, table_name string, fk_ord int, local_col string, ref_table string, ref_col string"


def fixture(spark):
    tables = spark.createDataFrame(
        [("s", "m", "singer", 0, "original"), ("s", "m", "song", 1, "original"), ("s", "e", "empty", 0, "original")],
        "dataset string, db_id string, table_name string, table_ord bigint, origin string",
    )
    columns = spark.createDataFrame([
        ("m", "singer", 0, "id", "int", "INTEGER", True, 1), ("m", "singer", 1, "Name", "text", "TEXT", False, 0),
        ("m", "song", 0, "sid", "int", "INTEGER", True, 1), ("m", "song", 1, "owner", "int", "INTEGER", False, 2),
    ], COLUMNS)
    fks = spark.createDataFrame([("m", "song", 0, "owner", "singer", "id")], FKS)
    return tables, columns, fks


def test_documents_survive_json(spark, tmp_path):
    tables, columns, fks = fixture(spark)
    docs = catalog.assemble(tables, columns, fks)
    path = str(tmp_path / "docs")
    files.write_schema_documents(docs, path)
    back = files.read_schema_documents(spark, path)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(catalog.explode_columns(catalog.explode_tables(back))) == key(columns)
    assert key(catalog.explode_fks(catalog.explode_tables(back))) == key(fks)
    names = {(r.db_id, r.table_name, r.table_ord) for r in catalog.explode_tables(back).collect()}
    assert names == {("m", "singer", 0), ("m", "song", 1), ("e", "empty", 0)}


def test_table_rows_survive_json(spark, tmp_path):
    tables, columns, fks = fixture(spark)
    path = str(tmp_path / "defs")
    files.write_table_defs(catalog.table_defs(tables, columns, fks), path)
    back = files.read_table_defs(spark, path)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(catalog.explode_columns(back)) == key(columns) and key(catalog.explode_fks(back)) == key(fks)
    assert {(r.dataset, r.db_id, r.table_name, r.table_ord) for r in back.collect()} == {("s", "m", "singer", 0), ("s", "m", "song", 1), ("s", "e", "empty", 0)}


def test_pretty_printed_document(spark, tmp_path):
    doc = {"dataset": "s", "db_id": "m", "schema": {
        "b": {"columns": [{"name": "x", "type": "int", "typegroup": "INTEGER", "notnull": True, "pk": 1}], "primary_keys": ["x"], "foreign_keys": []},
        "a": {"columns": [], "primary_keys": [], "foreign_keys": [{"sourceTable": "b", "sourceColumn": "x", "targetColumn": "y"}]},
    }}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=4))
    docs = files.read_schema_documents(spark, str(tmp_path), one_per_file=True)
    assert [(r.table_name, r.table_ord) for r in catalog.explode_tables(docs).orderBy("table_ord").collect()] == [("b", 0), ("a", 1)]
    assert catalog.explode_fks(catalog.explode_tables(docs)).select("local_col", "ref_table", "ref_col").first() == ("y", "b", "x")


@pytest.mark.parametrize("n", [3, 800])
def test_shape_does_not_depend_on_size(spark, n):
    tables = spark.range(n).select(
        F.lit("s").alias("dataset"), F.lit("d").alias("db_id"), F.concat(F.lit("t"), "id").alias("table_name"), F.col("id").alias("table_ord")
    )
    columns = tables.select("db_id", "table_name", F.lit(0).alias("col_ord"), F.lit("c").alias("name"), F.lit("int").alias("type"),
                            F.lit("INTEGER").alias("typegroup"), F.lit(True).alias("not_null"), F.lit(1).alias("pk"))
    fks = tables.filter("table_ord > 0").select("db_id", "table_name", F.lit(0).alias("fk_ord"), F.lit("c").alias("local_col"), F.lit("t0").alias("ref_table"), F.lit("c").alias("ref_col"))
    docs = catalog.assemble(tables, columns, fks)
    assert docs.count() == 1
    assert {(r.table_name, r.table_ord) for r in catalog.explode_tables(docs).collect()} == {(f"t{i}", i) for i in range(n)}
    assert catalog.schema_pieces(tables, columns, fks).count() == 2 * n
    (row,) = catalog.schema_prompt(tables, columns, fks).collect()
    text = row.schema_text
    assert text.count("# Table: ") == n and text.count("## Foreign Keys") == 1 and text.count(" REFERENCES ") == n - 1
    assert text.startswith("## Database Name: d \n\n## Database Schema \n\n# Table: ")


def test_whole_prompt_over_several_runs(spark, monkeypatch):
    tables, columns, fks = fixture(spark)
    want = {}
    for r in catalog.schema_pieces(tables, columns, fks).orderBy("db_id", "seq").collect():
        want[r.db_id] = want.get(r.db_id, "") + r.piece
    monkeypatch.setattr(catalog, "PIECE_RUN", 2)
    assert {r.db_id: r.schema_text for r in catalog.schema_prompt(tables, columns, fks).collect()} == want


def test_pieces_of_all_questions_are_read_from_zstd_files(spark):
    from schemaloom.operators.augment import Catalog
    from schemaloom.plans import pipelines

    tables, columns, fks = fixture(spark)
    questions = spark.createDataFrame([(1, "m", "q"), (2, "m", "q"), (3, "e", "q"), (4, "x", "q")], "idx long, db_id string, question string")
    found = pipelines.unfiltered_pieces(Catalog(tables, columns, fks), questions)
    pieces = sorted(tuple(r) for r in catalog.schema_pieces(tables, columns, fks).collect())
    assert sorted(tuple(r)[1:] for r in found.where("idx <> 2").collect()) == pieces
    assert found.where("idx = 2").count() == found.where("idx = 1").count()
    written = [f for f in found.inputFiles() if "schema-pieces" in f]
    assert written and all(f.endswith(".zstd.parquet") for f in written)


@pytest.mark.parametrize("name", ["schema_prompt", "schema_prompt_as_published"])
def test_prompt_queries_return_whole_texts(spark, name):
    """One row with the whole text per database, not its pieces."""
    from schemaloom.plans.registry import QUERIES

    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert len({r.db_id for r in rows}) == len(rows)
    assert all(r.schema_text.startswith(f"## Database Name: {r.db_id} ") and "# Table: " in r.schema_text for r in rows)


def test_table_defs_are_written_compressed(spark, tmp_path):
    defs = catalog.table_defs(*fixture(spark))
    files.write_table_defs(defs, str(tmp_path / "defs"))
    written = [p.name for p in (tmp_path / "defs").glob("part-*")]
    assert written and all(p.endswith(".json.gz") for p in written)
    assert sorted(map(str, files.read_table_defs(spark, str(tmp_path / "defs")).select("table_name", "columns").collect())) == sorted(
        map(str, defs.select("table_name", "columns").collect()))


def test_table_text_names_the_referenced_column(spark):
    text = catalog.table_text(*fixture(spark)).filter("table_name = 'song'").first().text
    assert text == "table song column sid type INTEGER primary key column owner type INTEGER primary key foreign key id references singer"


def test_prompt_layout(spark):
    text = catalog.schema_prompt(*fixture(spark)).filter("db_id = 'm'").first().schema_text
    assert "# Table: song\n[\n(sid: INT, PRIMARY KEY, NOT NULL),\n(owner: INT,),\n]\n\n" in text
    assert text.endswith("## Foreign Keys \nsong.owner REFERENCES singer.id\n")


def test_compress_keeps_references_inside_the_selection(spark):
    _, _, fks = fixture(spark)
    picked = spark.createDataFrame([(1, "m", "song"), (1, "m", "singer"), (2, "m", "song")], "idx int, db_id string, table_name string")
    assert [r.idx for r in catalog.compress(fks, picked, ["idx", "db_id"]).collect()] == [1]


def test_union_ignores_case(spark):
    a = spark.createDataFrame([("d", "Song", "original")], "db_id string, table_name string, origin string")
    b = spark.createDataFrame([("d", "song", "entity"), ("d", "new", "entity")], a.schema)
    assert {r.table_name for r in catalog.union_catalogs(a, b).collect()} == {"Song", "new"}


def test_profile_and_keys_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "a")], "k int, v string")
    rows = {r.name: r for r in profile.profile_columns(df, "t").collect()}
    assert (rows["k"].n_rows, rows["k"].n_non_null, rows["k"].n_distinct, rows["k"].min_value, rows["k"].max_value) == (4, 3, 2, 1.0, 2.0)
    assert (rows["v"].n_distinct, rows["v"].not_null, rows["v"].min_text, rows["v"].max_text) == (2, False, "a", "b")
    assert (rows["k"].min_text, rows["v"].min_value) == (None, None)
    check = profile.key_check(df, "t", ["k"]).first()
    assert (check.n_rows, check.n_distinct, check.n_non_null, check.is_key) == (4, 2, 3, False)
    parent = spark.createDataFrame([(1,)], "p int")
    fk = profile.inclusion_check(df, "t", "k", parent, "q", "p").first()
    assert (fk.n_values, fk.n_orphans, fk.holds) == (2, 1, False)


def test_questions_of_several_files(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"db_id": name, "question": f"q{i}", "query": "select 1"} for i in range(n)]))
    asked = files.read_questions(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.db_id, r.question) for r in asked] == [(i, "a", f"q{i}") for i in range(5)] + [(5 + i, "b", f"q{i}") for i in range(3)]


# --- response log -------------------------------------------------------------
RESPONSES = "index bigint, db_id string, model string, response struct<sql: string>"


def log_file(spark, tmp_path, n=4):
    rows = [(i, "m", "é" * i, (f"select '\n{i}'",)) for i in range(n)]
    path = tmp_path / "log"
    files.append_responses(spark.createDataFrame(rows, RESPONSES).coalesce(1), str(path))
    (part,) = [f for f in path.iterdir() if f.name.startswith("part-")]
    for crc in path.glob(".*.crc"):
        crc.unlink()  # the file is about to be cut
    return path, part


def test_log_cut_at_any_byte(spark, tmp_path):
    """Whatever a cut leaves, the whole records before it are read and nothing is taken for damage."""
    path, part = log_file(spark, tmp_path)
    data = part.read_bytes()
    ends = [i + 1 for i, b in enumerate(data) if b == 10]
    frames = spark.createDataFrame([(cut,) for cut in range(len(data) + 1)], "cut int")
    whole = tmp_path / "cuts"
    whole.mkdir()
    for cut in range(len(data) + 1):
        (whole / f"cut{cut:05d}").write_bytes(data[:cut])
    read = files.read_frames(spark, str(whole)).withColumn("cut", F.regexp_extract("file", r"cut(\d+)$", 1).cast("int"))
    found = {r.cut: (r.n, r.bad) for r in read.groupBy("cut").agg(F.count_if(F.col("state") == "whole").alias("n"), F.count_if(F.col("state") == "damaged").alias("bad")).collect()}
    for cut in range(1, len(data) + 1):
        complete = sum(e - 1 <= cut for e in ends)  # the line feed itself may be missing
        assert found.get(cut, (0, 0)) == (complete, 0), cut
    assert files.damaged_files(files.read_frames(spark, str(whole))).collect() == []
    assert frames.count() == len(data) + 1


def test_any_other_damage_is_an_error(spark, tmp_path):
    path, part = log_file(spark, tmp_path)
    data = part.read_bytes()
    lines = data.split(b"\n")
    for bad in (data.replace(b"select", b"selekt", 1), b"\n".join([lines[0], lines[2], lines[3], b""]), b"\n".join([lines[0][:-9], *lines[1:]]), b"x" + data):
        part.write_bytes(bad)
        with pytest.raises(ValueError, match="damaged"):
            files.read_responses(spark, str(path))


def test_resume_by_variant(spark, tmp_path):
    path, part = log_file(spark, tmp_path)
    part.write_bytes(part.read_bytes()[:-3])  # the record of question 3 is torn
    asked = spark.range(6).select(F.col("id").alias("idx"), F.lit("m").alias("db_id"))
    assert [r.idx for r in files.resume(asked, spark, str(path)).orderBy("idx").collect()] == [3, 4, 5]
    models = asked.withColumn("model", F.lit("é"))
    assert [r.idx for r in files.resume(models, spark, str(path), ("model", "idx")).orderBy("idx").collect()] == [0, 2, 3, 4, 5]
    again = [(3, "m", "ééé", ("select 3",)), (4, "m", "x", None)]
    files.append_responses(spark.createDataFrame(again, RESPONSES), str(path))
    assert [r.idx for r in files.resume(asked, spark, str(path)).orderBy("idx").collect()] == [5]


# --- discovery ----------------------------------------------------------------
def keys_by_hand(rows, names, most):
    full = [i for i in range(len(names)) if all(r[i] is not None for r in rows)]
    found = []
    for size in range(1, most + 1):
        for s in combinations(full, size):
            if rows and not any(set(k) <= set(s) for k in found) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return {",".join(names[i] for i in s) for s in found}


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys(spark, seed):
    rng = random.Random(seed)
    n, names = rng.choice([1, 40, 200]), list("abcdef")
    rows = [(i % 10, i // 10, rng.randint(0, 3), None if i == 3 and seed % 2 else i, rng.randint(0, 30), str(rng.randint(0, 14))) for i in range(n)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f string")
    got = profile.discover_keys(df, "t", 3).collect()
    assert {r.key_columns for r in got} == keys_by_hand(rows, names, 3) and all(r.n_rows == n for r in got)


def test_no_keys_without_rows_and_with_repeated_rows(spark):
    assert profile.discover_keys(spark.createDataFrame([], "a int"), "t").collect() == []
    assert profile.discover_keys(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), "t").collect() == []


def test_inclusions_of_all_columns(spark):
    rng = random.Random(5)
    data = {
        "t": [(i, i % 4, rng.choice([1.5, 2.0]), rng.choice("xy"), None) for i in range(20)],
        "u": [(i, 100 + i, 2.0, rng.choice("xyz"), "long " * 20) for i in range(8)],
        "empty": [],
    }
    schema = "k int, p bigint, d double, s string, w string"
    tables = {name: spark.createDataFrame(rows, schema) for name, rows in data.items()}
    values = {(t, c): {r[i] for r in rows} - {None} for t, rows in data.items() for i, c in enumerate("kpdsw")}
    kind = {"k": 0, "p": 0, "d": 1, "s": 2, "w": 2}
    want = {(*a, *b, len(values[a])) for a in values for b in values if a != b and values[a] and kind[a[1]] == kind[b[1]] and values[a] <= values[b]}
    assert {tuple(r) for r in profile.inclusions(tables).collect()} == want
    marked = {tuple(r)[:4]: r.in_key for r in profile.references(tables).collect()}
    assert marked[("t", "p", "u", "k")] and marked[("u", "k", "t", "k")] and not marked[("u", "d", "t", "d")]


def test_sketches_are_near(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("a"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("s"), F.lit(None).cast("double").alias("n"))
    rows = {r.name: r for r in profile.sketch_columns(df, "t").collect()}
    assert abs(rows["a"].est_distinct - 1000) < 40 and abs(rows["s"].est_distinct - 5000) < 200 and rows["n"].est_distinct == 0
    assert abs(rows["a"].median - 500) < 5 and rows["s"].high == 5 and rows["n"].median is None


def test_inclusions_of_many_columns_collect_no_lists(spark, monkeypatch):
    """the columns of a value are bits of numbers (three here), so no rows are sorted for them."""
    from schemaloom.operators import profile

    plans, store = [], profile.materialize
    monkeypatch.setattr(profile, "materialize", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), store(df, name))[1])
    values = {f"c{i}": {i % 3, i % 5, 7} for i in range(130)}
    rows = [tuple(sorted(v)[k % len(v)] for v in values.values()) for k in range(6)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in values))
    got = {(r.child_col, r.parent_col, r.n_values) for r in profile.inclusions({"t": df}).collect()}
    assert got == {(a, b, len(values[a])) for a in values for b in values if a != b and values[a] <= values[b]}
    assert plans and not any(kind in p for p in plans for kind in ("ObjectHashAggregate", "SortAggregate"))
