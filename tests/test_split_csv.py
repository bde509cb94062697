import random

import pytest

from commentlens import schemas as S
from commentlens.sources import readers

HEADER = ",".join(S.POSTS)


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def contents(seed, n):
    r = random.Random(seed)
    pieces = ["word", "two words", "\n", "\n\n", '"', '""', ",", "ünï 😂", "\r\n", "'", " ", "\\", "x" * 50]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 9))) for _ in range(n)]


def text(rows, end="\n"):
    return end.join([HEADER, *[f"{k},u,a,{'' if k % 5 == 0 else f'A{k}'},{quoted(c)},http,{k},1,0,01/02/2024 07:05:10 PM" for k, c in enumerate(rows)]])


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("csv files")
    (out / "7_classified_comments.csv").write_bytes(text(contents(1, 400)).encode() + b"\n")
    (out / "a+b c.csv").write_bytes(text(contents(2, 150), "\r\n").encode())  # no line end after the last row
    (out / "none.csv").write_bytes(HEADER.encode() + b"\n")
    (out / "empty lines.csv").write_bytes(text(["a", "b\n\nc", "d"]).replace("\n2,", "\n\n\n2,").encode() + b"\n\n")
    (out / "short.csv").write_bytes(HEADER.encode() + b'\n1,u,a,Ann,"short\nrow"\n2,u,a,Bob,,\n3,u,a,,"",http,2.0,1,many,x\n')
    (out / "long.csv").write_bytes(text(["one\n" * 3000, "b", "two\r\n" * 2000]).encode())
    return out


@pytest.mark.parametrize("size", ["211", "3000", "134217728"])
def test_same_rows_and_positions_as_the_reader_of_whole_files(spark, folder, size):
    whole = {(r.post_id, r.ord): tuple(r) for r in readers.read_posts(spark, f"{folder}/*.csv").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = readers.read_posts(spark, f"{folder}/*.csv", in_splits=True)
        rows = df.collect()
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(name)
    assert len(rows) == len(whole) and {(r.post_id, r.ord): tuple(r) for r in rows} == whole
    assert whole["7", 17][3] is not None or whole["7", 17][2] is None


def test_other_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,Other\n1,2\n")
    with pytest.raises(Exception, match="header"):
        readers.read_posts(spark, str(tmp_path / "a.csv"), in_splits=True).collect()


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text(text([f"line {k}\nsecond, of {k}" for k in range(20_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        df = readers.read_posts(spark, str(tmp_path / "big.csv"), in_splits=True)
        assert df.where("content = concat('line ', ord, '\n', 'second, of ', ord) AND reactions = ord").count() == df.count() == 20_000
        scan = spark.read.option("lineSep", "\n").text(str(tmp_path / "big.csv"))
        assert scan.rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
