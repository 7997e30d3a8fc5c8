import json

import pytest
from pyspark.sql import functions as F

from topicloom.sources import readers, sinks
from topicloom.sources.workbook import sheets, workbook
from topicloom.streaming import topics as streams


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_csv_in_any_encoding(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes('id;text\n1;"café; ""x"""\n2;naïve “€”\n'.encode(encoding))
    df = readers.read_table(spark, f"file://{path}")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 'café; "x"'), (2, "naïve “€”")]


@pytest.mark.parametrize(("raw", "want"), [
    ("a;é".encode("utf-16"), ("a;é", "utf-16")), ("abcé".encode("utf-16-be"), ("abcé", "utf-16-be")), (b"caf\xe9 \x93x", ("café “x", "cp1252")), (b"\x81\xe9", ("\x81é", "latin1")), ("日本é".encode()[:-1], ("日本\ufffd", "utf-8")), (b"", ("", "utf-8")), (b"\xef\xbb\xbfx", ("x", "utf-8-sig")),
])
def test_decoded(raw, want):
    assert readers.decoded(raw) == want


def test_large_files_are_split_unless_fields_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n" + "\n".join(f'{i},"x ""{i}"""' for i in range(50)))
    (tmp_path / "b.csv").write_text('id,t\n1,"x\ny"\n2,z\n')
    assert readers.read_csv(spark, f"file://{tmp_path}/a.csv").count() == 50
    assert [r.t for r in readers.read_csv(spark, f"file://{tmp_path}/b.csv").orderBy("id").collect()] == ["x\ny", "z"]


def test_pasted(spark):
    assert readers.read_pasted(spark, "a\n\n b ").columns == ["text"]
    assert readers.read_pasted(spark, "a\tb,c\n1\t2").columns == ["a", "b,c"]
    assert readers.read_pasted(spark, "1;2\n3;4", header=False).columns == ["col_1", "col_2"]
    assert readers.read_pasted(spark, 'a,b\n"x,y",2').first().a == "x,y"
    for empty in ("", "  \n", "a,b"):
        with pytest.raises(readers.ReadError):
            readers.read_pasted(spark, empty)


def test_workbook(spark, tmp_path):
    raw = workbook({"one": (["a"], [(1,)]), "two": (["a", "b", "a"], [("x & <y>", 2.5, 3), (None, None, None)])})
    assert sheets(raw)["one"] == [["a"], ["1"]]
    path = tmp_path / "t.xlsx"
    path.write_bytes(raw)
    df = readers.read_table(spark, f"file://{path}")
    assert df.columns == ["a", "b"] and df.first().a == "x & <y>"
    assert readers.read_table(spark, f"file://{path}", "one").columns == ["a"]
    with pytest.raises(readers.ReadError):
        readers.read_table(spark, "x.xls")


def test_other_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    for kind in ("parquet", "json", "csv"):
        sinks.write_table(df, f"file://{tmp_path}/{kind}", kind)
    assert spark.read.parquet(f"file://{tmp_path}/parquet").count() == spark.read.json(f"file://{tmp_path}/json").count() == 1
    files = readers.decoded_files(spark, f"file://{tmp_path}/csv/*.csv").collect()
    assert files[0].text.startswith("id,text") and files[0].encoding == "utf-8"


def test_outputs(spark, tmp_path):
    dictionary = spark.createDataFrame([(0, 2)], "topic_id int, num_docs_assigned int")
    docs, stats = spark.createDataFrame([(1, "é")], "id int, text string"), spark.createDataFrame([("K", 1.0)], "metric string, value double")
    out = sinks.write_all(tmp_path / "o", dictionary, docs, stats, 1, turning={"K": 1})
    assert not [k for k in out if k.endswith("_error")]
    assert (tmp_path / "o/topic_dictionary_K1.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    assert json.loads((tmp_path / "o/run_summary_K1.json").read_text())["topic_dictionary"] == [{"topic_id": 0, "num_docs_assigned": 2}]
    assert "DocAssignments_K1" in sheets((tmp_path / "o/topics_K1.xlsx").read_bytes())
    assert next((tmp_path / "o/doc_assignments_K1").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfid,text")
    words = spark.createDataFrame([(0, w, 0.1 * i) for i, w in enumerate("abcdefg", 1)], "topic_id int, word string, weight double")
    named = dictionary.withColumn("topic_short_name", F.lit("a name"))
    assert "salient" in sinks.write_all(tmp_path / "q", named, docs, stats, 1, words=words)
    assert [(r.rank, r.word, r.share) for r in sinks.top_words_grid(named, words).collect()] == [(i, w, 1.0) for i, w in enumerate("gfedc", 1)]
    broken = sinks.write_all(tmp_path / "p", dictionary, docs.select(F.expr("array(1) AS a")), stats, 1)
    assert "documents_error" in broken and "dictionary" in broken
    named = sinks.with_topics(docs, "id", spark.createDataFrame([(1, 4, 0.5)], "id int, topic_id int, score double"), spark.createDataFrame([], "topic_id int, name string"))
    assert named.first().Topic == "Topic 5"


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([("2024-01-01 00:00:00", 1, ["a", "b"]), ("2024-01-01 12:00:00", 1, ["a"]), ("2024-01-09 00:00:00", 2, ["c"])], "t string, who int, tokens array<string>").withColumn("t", F.col("t").cast("timestamp"))
    data.write.parquet(f"file://{tmp_path}/in")

    def run(make, name):
        source = spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/in")
        make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert sorted((r.token, r.n) for r in run(lambda s: streams.token_counts(s, "t", "tokens"), "s1").collect()) == [("a", 2), ("b", 1)]
    assert [r.n for r in run(lambda s: streams.topic_counts(s, "t", "who"), "s2").collect()] == [2]
    assert [r.n for r in run(lambda s: streams.sessions(s, "t", "who", "13 hours"), "s3").collect()] == [2]
    seen = []
    streams.each_batch(spark.readStream.schema(data.schema).parquet(f"file://{tmp_path}/in"), lambda df, i: seen.append(df.count()), f"{tmp_path}/s4").awaitTermination()
    assert sum(seen) == 3
