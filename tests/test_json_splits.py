"""JSON array files by byte range: equal to the multi-line reader."""

import json
import random

import pytest

from sentibar.sources import io as IO
from sentibar.sources import json_splits as JS

ODD = ['plain', 'a "quoted" {brace} }{', 'back\\slash \\" }', '[1, 2] ] }', '', 'é } ü " 日本 \U0001f600', '\\', '"', '}', '{',
       '\n\t}', '\\\\"}', ', {', '],[']


def records(rng, n):
    out = []
    for i in range(n):
        r = {"id": i, "headline": rng.choice(ODD) * rng.randint(0, 3), "body": "".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))),
             "tags": [rng.choice("ab") for _ in range(rng.randint(0, 3))]}
        if rng.random() < 0.3:
            r["category"] = {"x": {"y": [{"z": rng.choice(ODD)}, []]}}
        out.append(r)
    return out


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def both(spark, path):
    cols = ["id", "headline", "body", "tags", "category", "_file"]

    def rows(df):
        # a nested value under a text column keeps or loses white space: compare its content
        return [(*r[:3], r.tags and json.loads(r.tags), r.category and json.loads(r.category), r[5])
                for r in df.orderBy("_file", "_pos").select(*cols).collect()]
    return rows(JS.read_json_splits(spark, path)), rows(IO.read_json_articles(spark, path))


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("layout", [dict(), dict(indent=2), dict(ensure_ascii=False, separators=(",", ":"))])
def test_one_file_in_many_ranges(spark, tmp_path, small_ranges, layout):
    rows = records(random.Random(1), 150)
    rows[50]["body"] = "}{" * 8000                       # a record over many ranges
    rows[51]["body"] = '\\"' * 5000
    put(tmp_path, "a.json", json.dumps(rows, **layout))
    got, want = both(spark, str(tmp_path))
    assert got == want and len(got) == 150
    assert JS.fragments(spark, str(tmp_path)).rdd.getNumPartitions() > 7


def test_bad_files_are_skipped_whole(spark, tmp_path, small_ranges):
    rows = records(random.Random(2), 60)
    good = json.dumps(rows)
    put(tmp_path, "1good.json", good)
    put(tmp_path, "2cut.json", good[:len(good) // 2])
    put(tmp_path, "3empty.json", "[]")
    put(tmp_path, "4spaces.json", " [ ] \n")
    put(tmp_path, "5nocomma.json", good.replace("}, {\"id\": 7", "} {\"id\": 7"))
    put(tmp_path, "6value.json", good.replace('"id": 30', '"id": nope'))
    put(tmp_path, "7object.json", json.dumps(rows[0], indent=1))
    put(tmp_path, "8nothing.json", "")
    put(tmp_path, "9tail.json", good + "\n\n")
    got, want = both(spark, str(tmp_path))
    assert got == want
    assert {r[-1][-6:-5] for r in got} and {r[-1].rsplit("/", 1)[1][0] for r in got} == set("179")


def test_without_broadcast(spark, tmp_path, small_ranges):
    put(tmp_path, "a.json", json.dumps(records(random.Random(3), 120)))
    rows = JS.split_records(spark, str(tmp_path), max_bytes=0)
    assert [json.loads(bytes(r.value))["id"] for r in rows.orderBy("_pos").collect()] == list(range(120))


def test_written_array_reads_back(spark, tmp_path):
    df = spark.range(1000).selectExpr("to_json(struct(id, concat('h}', id) AS headline)) AS value")
    JS.write_json_arrays_streamed(df.coalesce(1), str(tmp_path / "out"))
    got = JS.read_json_splits(spark, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in got) == list(range(1000)) and got[0].headline.startswith("h}")
    JS.write_json_arrays_streamed(df.limit(0), str(tmp_path / "none"))
    assert JS.read_json_splits(spark, str(tmp_path / "none")).count() == 0
