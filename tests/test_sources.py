import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from commentlens import schemas as S
from commentlens.operators import dynamics
from commentlens.operators.rows import require_columns
from commentlens.sources import readers, writers
from commentlens.sources.ordinals import with_ord

POST_HEADER = ",".join(S.POSTS)


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture
def posts(tmp_path):
    folder = tmp_path / "posts with space"
    write(
        folder / "7.csv", POST_HEADER,
        '1,u,a,Ann,the post,http,5,0,3,01/02/2024 07:04:10 PM',
        '2,u,a,Bob,"two',
        'lines, and ""quotes""",http,1,1,0,01/02/2024 07:05:10 PM',
        '3,u,a,,,http,2.0,1,many,01/02/24 19:06',
    )
    write(folder / "a+b c.csv", POST_HEADER, *[f"{i},u,a,A{i},text {i},http,{i},1,0,x" for i in range(500)])
    return folder


def test_posts(spark, posts):
    df = readers.read_posts(spark, f"{posts}/*.csv")
    rows = {(r.post_id, r.ord): r for r in df.collect()}
    assert len(rows) == 503
    assert rows["7", 1].content == 'two\nlines, and "quotes"'
    assert rows["7", 2].content is None and rows["7", 2].author is None
    assert (rows["7", 2].reactions, rows["7", 2].sub_comments) == (2, None)
    assert [rows["a+b c", i].content for i in range(500)] == [f"text {i}" for i in range(500)]


def test_positions_continue_across_batches_and_files(spark, tmp_path):
    for name in range(6):
        write(tmp_path / f"{name}.csv", POST_HEADER, *[f"{i},,,,{i},,,,," for i in range(name * 7)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        df = readers.read_posts(spark, str(tmp_path / "*.csv")).persist()
        assert df.count() == sum(n * 7 for n in range(6))
        assert df.where(F.col("content").cast("bigint") != F.col("ord")).count() == 0
        df.unpersist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_positions_in_a_file_read_in_splits(spark, tmp_path):
    write(tmp_path / "big.csv", POST_HEADER, *[f"{i},,,,{i},,,,," for i in range(5000)])
    write(tmp_path / "small.csv", POST_HEADER, *[f"{i},,,,{i},,,,," for i in range(10)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = readers.read_posts(spark, str(tmp_path / "*.csv"), multi_line=False)
        assert df.rdd.getNumPartitions() > 5
        assert df.groupBy("post_id").count().orderBy("post_id").collect() == [("big", 5000), ("small", 10)]
        assert df.where(F.col("content").cast("bigint") != F.col("ord")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_annotations_survive_ragged_rows_and_mangled_numbers(spark, tmp_path):
    write(
        tmp_path / "3.csv", ",".join(S.ANNOTATION),
        "a,1,0,x,neutral,6.191.463.470.458.980,neutral",
        "b,1,0,x,neutral,0.25",
        'c,1,0,x,neutral,0.5,""',
    )
    rows = readers.read_annotations(spark, str(tmp_path / "*.csv")).orderBy("ord").collect()
    assert [r.confidence for r in rows] == [None, 0.25, 0.5]
    assert [r.validation for r in rows] == ["neutral", None, None]


def test_stage_suffixes_leave_the_post(spark, tmp_path):
    write(tmp_path / "11_classified_comments.csv", ",".join(S.CLASSIFIED), "a,1,0,x,neutral,0.5")
    write(tmp_path / "r" / "11_suspect_comments_explained.csv", ",".join(S.REPORT), "a,1,0,x,neutral,.5,irony,.9,e")
    assert readers.read_classified(spark, str(tmp_path / "*.csv")).first().post_id == "11"
    suspect = readers.read_report(spark, str(tmp_path / "r" / "*.csv")).first()
    assert (suspect.post_id, suspect.sarcasm_score) == ("11", 0.9)


def test_wrong_header_and_missing_files_are_errors(spark, tmp_path):
    write(tmp_path / "1.csv", "Content,Id", "a,1")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_posts(spark, str(tmp_path / "*.csv")).collect()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_posts(spark, str(tmp_path / "none" / "*.csv"))


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, "id") is df
    with pytest.raises(ValueError, match="'content'"):
        require_columns(df, "id", "content")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_written_comments_read_back(spark, tmp_path, fmt):
    rows = [
        ("1", 0, 'a "quoted"\nline, with comma', 3, 0, "01/02/2024 07:04:10 PM", "neutral", 0.25),
        ("1", 1, None, 0, None, None, None, None),
        ("007", 5, "caffè 😂", 1, 2, "x", "neutral", 1.0),
    ]
    df = spark.createDataFrame(rows, S.comment_schema(S.CLASSIFIED))
    out = str(tmp_path / "out")
    writers.write_comments(df, out, fmt)
    back = readers.read_comments(spark, out, S.CLASSIFIED, fmt).select(df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert (tmp_path / "out" / "post_id=007").is_dir()


def test_gold_reads_back(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", "neutral"), (None, "x")], "text string, stance string")
    writers.write_gold(df, str(tmp_path / "gold"))
    assert sorted(readers.read_gold(spark, str(tmp_path / "gold")).collect(), key=str) == sorted(df.collect(), key=str)
    writers.write_gold(df, str(tmp_path / "gold_parquet"), fmt="parquet")
    assert readers.read_gold(spark, str(tmp_path / "gold_parquet"), "parquet").count() == 2


def test_metrics_are_json(spark, tmp_path, posts):
    from commentlens.functions.times import parse_comment_time

    df = readers.read_posts(spark, f"{posts}/7.csv").withColumn("ts", parse_comment_time(F.col("comment_at")))
    writers.write_metrics(dynamics.metrics_report(df), str(tmp_path / "m"))
    lines = [json.loads(x) for f in (tmp_path / "m").glob("*.json") for x in f.read_text().splitlines()]
    by_post = {x["post_id"]: x for x in lines}
    assert set(by_post) == {"7", "aggregated"}
    assert by_post["7"]["views"] == 8 and by_post["7"]["unique_authors"] == 3
    assert by_post["7"]["min_spread_time_minutes"] == 1.0


def test_with_ord_counts_across_blocks(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 'hot', if(id % 3 = 1, 'cold', null)) post_id", "id * 7 as key")
    got = with_ord(df, "key", blocks=10).orderBy("post_id", "key").collect()
    assert len(got) == 1000
    for post in ("hot", "cold", None):
        ords = [r.ord for r in got if r.post_id == post]
        assert ords == list(range(len(ords)))


def test_with_ord_of_sparse_keys(spark):
    """Time-shaped keys: few blocks, however far apart the keys are."""
    df = spark.range(500).selectExpr("if(id % 3 = 0, 'hot', 'cold') post_id", "id * 86400000000 + id % 7 as key")
    got = with_ord(df, "key", blocks=8)
    blocks = got.groupBy("post_id", F.floor(F.col("ord") / 1000)).count().count()
    assert blocks == 2
    for post in ("hot", "cold"):
        rows = [r.ord for r in got.where(F.col("post_id") == post).orderBy("key").collect()]
        assert rows == list(range(len(rows)))
