import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.sources import keyed
from corpuslab.sources.corpora import CORPUS_DOC


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "97")
    spark.conf.set(names[1], "1")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def odd_text(rng):
    pieces = ['"', "\\", "{", "}", "[", "]", ",", ":", "\n", "é", "日", "\\\"", "plain words", '","', "}{", "\\\\", "\t"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))


def documents(n, seed):
    rng = random.Random(seed)
    return {f"k{i}{odd_text(rng)}": {
        "title": odd_text(rng), "abstract": None if i % 5 == 0 else odd_text(rng),
        "text": {f"s{j}{odd_text(rng)}": odd_text(rng) for j in range(rng.randint(0, 4))}, "doi": f"10/{i}", "file_name": "f", "rd": "Mixed"}
        for i in range(n)}


@pytest.mark.parametrize("indent,ascii_", [(None, True), (4, False), (None, False)])
def test_many_tasks_equal_the_whole_file(spark, tmp_path, small_ranges, indent, ascii_):
    data = documents(60, 1)
    path = tmp_path / "big.json"
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    found = keyed.read_keyed(spark, str(path), CORPUS_DOC)
    ranges = spark.read.option("lineSep", ",").text(str(path)).select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
    assert ranges > 50
    rows = found.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(60)) and [r.key for r in rows] == list(data)
    for r, doc in zip(rows, data.values()):
        assert {k: r.value[k] for k in ("title", "abstract", "text", "doi")} == {k: doc[k] for k in ("title", "abstract", "text", "doi")}


def test_several_files_empty_and_flat_values(spark, tmp_path, small_ranges):
    (tmp_path / "a.json").write_text(json.dumps({str(i): ["x,y", "}", "z" * (i % 90)] for i in range(40)}))
    (tmp_path / "b.json").write_text(" { } \n")
    (tmp_path / "c.json").write_text('\n{ "only" : [ ] }\n')
    rows = keyed.read_keyed(spark, str(tmp_path), T.ArrayType(T.StringType())).collect()
    got = {r.key: r.value for r in rows}
    assert len(rows) == 41 and got["only"] == [] and got["39"] == ["x,y", "}", "z" * 39]
