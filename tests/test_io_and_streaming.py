from pyspark.sql import functions as F

from paragram.functions import text as T
from paragram.sources import io
from paragram.streaming import pages as stream


def test_csv_with_bom_nul_and_newlines(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_bytes("\ufeffname,text\na,\"x\ny \"\"q\"\"\x00\"\nb,\n".encode())
    rows = io.read_csv(spark, str(f), ["name", "text", "missing"]).collect()
    assert [(r.name, r.text, r.missing) for r in rows] == [("a", 'x\ny "q"', ""), ("b", "", "")]


def test_parallel_files(spark, tmp_path):
    (tmp_path / "a.src").write_text("One  A\nTwo\nx\u2028y\n", encoding="utf-8")
    (tmp_path / "a.tgt").write_text("eins\n\ndrei\nvier\nfünf", encoding="utf-8")
    got = io.read_parallel(spark, str(tmp_path / "a.src"), str(tmp_path / "a.tgt"), T.clean_text).orderBy("line_no").collect()
    assert [(r.line_no, r.src, r.tgt) for r in got] == [(1, "one a", "eins"), (2, "two", ""), (3, "x", "drei"), (4, "y", "vier")]
    got = io.read_parallel(spark, str(tmp_path / "a.src"), str(tmp_path / "a.tgt"), drop_empty=True, max_pairs=2)
    assert [r.line_no for r in got.orderBy("line_no").collect()] == [1, 3]
    m = io.read_modes(spark, {"train": (str(tmp_path / "a.src"), str(tmp_path / "a.tgt"))})
    assert sorted(r.row_id for r in m.collect())[0] == "train:1"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "B", True), (1, "a\nx", "A", False)], "o int, src string, tgt string, flag boolean")
    io.write_parallel(df, str(tmp_path / "s"), str(tmp_path / "t"), "o")
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["a x", "b"]
    io.write_csv(df, str(tmp_path / "c"), {"src": "source", "flag": "is_new"}, "o")
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(str(tmp_path / "c")).collect()
    assert [(r.source, r.is_new) for r in back] == [("a\nx", "false"), ("b", "true")]
    assert "- rows: 2" in io.report(spark.createDataFrame([("rows", 2)], "stage string, value int"), df)
    io.write_json(df.select("o"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    lines = [f"line {i}" + ("\u2028more" if i % 50 == 0 else "") for i in range(4000)]
    (tmp_path / "t").write_bytes("\r\n".join(lines[:2000]).encode() + b"\n" + "\n".join(lines[2000:]).encode() + b"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = io.read_lines(spark, str(tmp_path / "t"))
        assert got.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 4
        assert [r.line for r in got.orderBy("line_no").collect()] == "\n".join(lines).splitlines()
        assert [r.line_no for r in got.orderBy("line_no").collect()] == list(range(1, 4081))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (tmp_path / "empty").write_bytes(b"")
    assert io.read_lines(spark, str(tmp_path / "empty")).count() == 0
    df = spark.range(1000).selectExpr("id", "concat('x', 999 - id) AS line").repartition(5)
    io.write_lines(df, str(tmp_path / "many"), "line", "id")
    assert [r.line for r in io.read_lines(spark, str(tmp_path / "many")).orderBy("line_no").collect()] == [f"x{999 - i}" for i in range(1000)]


def test_progress(spark, caplog):
    assert "[###############               ] 5/10 (50%), 4 s, 4 s left" in io.progress_line("t", 5, 10, 4.0)
    assert "no estimate" in io.progress_line("t", 0, 0, 1.0)
    with caplog.at_level("INFO", logger="paragram"), io.progress(spark, "counting", 0.05):
        spark.range(10**7).selectExpr("sum(hash(id))").collect()
    assert any("counting: done" in m for m in caplog.messages)


def test_boolean_flags_reach_the_scan(spark, tmp_path):
    df = io.to_parquet(spark.createDataFrame([(1, "True "), (2, None), (3, "no")], "i int, has_source string"), str(tmp_path / "p"), ("has_source",))
    hit = df.where("has_source")
    assert [r.i for r in hit.collect()] == [1]
    assert "PushedFilters: [IsNotNull(has_source), EqualTo(has_source,true)]" in hit._jdf.queryExecution().toString()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"um-ma l{i}\nthe man and you of it in the city") for i in range(6)]
    spark.createDataFrame(rows, "page long, body string").repartition(3).write.parquet(str(tmp_path / "in"))
    pages_ = stream.stream_pages(spark, str(tmp_path / "in"), "page long, body string", "page", "body", 1)
    q = stream.start(stream.mined_stream(pages_), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.countDistinct("page_id")).first()[0] == 6


def test_one_file_is_merged_from_sorted_files(spark, tmp_path):
    """No task holds all rows: the files are sorted by many tasks and streamed into one, in order."""
    import random

    rows = [(i, f"line {i}") for i in range(3000)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "i int, src string").withColumn("tgt", F.upper("src")).repartition(6)
    tasks = []
    real = io._write_lines

    def counted(ordered, *args):
        tasks.append(ordered.rdd.getNumPartitions())
        real(ordered, *args)

    io._write_lines = counted
    try:
        io.write_parallel(df, f"{tmp_path}/s", f"{tmp_path}/t", "i", one_file=True)
    finally:
        io._write_lines = real
    assert min(tasks) > 1
    for side, f in (("s", str), ("t", str.upper)):
        files = list((tmp_path / side).glob("part-*"))
        assert len(files) == 1 and files[0].read_text().splitlines() == [f(f"line {i}") for i in range(3000)]
