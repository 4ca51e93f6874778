"""Column functions, samples, sinks and hooks that no catalogued query reaches."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays, geometry, text
from tessera.operators import enrich, packing, reshape, sampling, scoring, templates
from tessera.plans import catalogue_files
from tessera.plans.catalogue import ORACLE, QUERIES
from tessera.sources import readers, writers
from tessera.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*x):
    return F.array(*map(F.lit, x))


def test_records_and_prompts(spark):
    row = spark.createDataFrame([("ab", [1, 2, 3], 4, 5)], "t string, c array<int>, w int, h int")
    made = reshape.training_record(row, F.col("t"), F.col("c"), F.col("w"), F.col("h")).first()
    assert (made["length"], made["vqcode_512"], made["vqcode_multi768"], made["width"]) == (14.0, "[1,2,3]", "no", "4")
    assert one(spark, reshape.record_text(F.lit(None), F.lit("c"))) == "c" and one(spark, reshape.record_text(F.lit(""), F.lit("c"))) == ""
    assert one(spark, reshape.size_prefixed(F.lit("p"), F.lit("i2t_multi"), F.lit(3), F.lit(4))) == "Image Size: Width is 3 Height is 4.p"
    assert one(spark, reshape.size_prefixed(F.lit("p"), F.lit("i2t"), F.lit(3), F.lit(4))) == "p"
    asked = [r["x"] for r in spark.range(60).select(reshape.instruction_prompt(F.lit("i"), F.lit("g"), F.lit("o"), F.col("id"), "<e>").alias("x")).collect()]
    assert {a["masked"] for a in asked} == {"i" + "\n" * n + "g" for n in (1, 2, 3)} and {a["graded"] for a in asked} == {"\n" * n + "o<e>" for n in (1, 2, 3)}
    assert one(spark, reshape.without_image_mark(F.lit("see <image> here"))) == "<image>\nsee  here"
    assert one(spark, reshape.without_image_mark(F.lit("plain"))) == "plain"
    assert one(spark, reshape.code_count_ok(array(1, 2), 2)) and not one(spark, reshape.code_count_ok(array(1), 2))


def test_request_parameters(spark):
    assert one(spark, reshape.request_parameter(None, F.lit("all"))) is None
    assert one(spark, reshape.request_parameter("text", F.lit("all"))) == "text"
    assert one(spark, reshape.request_parameter("all", F.lit("text"))) is None
    assert one(spark, reshape.request_parameter(0.5, F.lit(0.9))) == 0.5 and one(spark, reshape.request_parameter(None, F.lit(7))) == 7


def test_interleaving(spark):
    ids = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    images = F.array(array(1, 2), array(3))
    assert one(spark, reshape.interleaved(F.lit("a<image>b<image>c"), images, ids)) == [97, 1, 2, 98, 3, 99]
    assert one(spark, reshape.interleaved(F.lit("a<image>b"), images, ids)) is None


def test_answers(spark):
    rows = spark.createDataFrame([(1, "q", "A", "A", False), (2, "q", "B", "A", False), (3, "q", "Error: x", "A", True)], "index int, question string, raw string, truth string, failed boolean")
    made = {r["index"]: r["correct"] for r in reshape.answer_record(rows, F.col("raw"), text.choice(F.col("raw")), F.col("truth"), F.col("failed")).collect()}
    assert made == {1: True, 2: False, 3: None}
    got = scoring.accuracy(spark.createDataFrame([(True,), (False,), (None,), (True,)], "c boolean"), "c").first()
    assert (got["accuracy"], got["n"]) == (0.5, 4)


def test_scorers(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "a", None)], "k int, x string, y string")
    made = {r["k"]: r["answer"] for r in enrich.scored(rows, ["x", "y"], lambda x, y: x + y).collect()}
    assert made == {1: "ab", 2: "error"}


def test_translated_fields(spark):
    rows = spark.createDataFrame([("a", "", [("human", "hi")]), (None, "t", None)], "caption string, text string, conversations array<struct<from: string, value: string>>")
    first, second = reshape.translated_fields(rows, F.upper).collect()
    assert (first["caption"], first["text"], first["conversations"][0]["value"]) == ("A", "", "HI")
    assert (second["caption"], second["text"], second["conversations"]) == (None, "T", None)


def test_names_and_scores(spark):
    assert one(spark, text.stem(F.lit("/a/b/c.d.png"))) == "c" and one(spark, text.layer_of(F.lit("model.layers.12.mlp"))) == 12
    assert one(spark, text.layer_of(F.lit("model.norm"))) is None
    assert one(spark, text.contains_any(F.lit("stop here"), ["end", "stop"])) and not one(spark, text.contains_any(F.lit("go"), ["stop"]))
    low = float("-inf")
    assert one(spark, sampling.allowed_scores(array(0.5, 1.5, 2.5), [0, 2])) == [0.5, low, 2.5]
    assert one(spark, arrays.code_ids(array(0, 5), 100)) == [100, 105] and one(spark, arrays.ids_code(array(99, 105), 100)) == [0, 5]
    assert one(spark, arrays.squared_distance(array(1.0, 2.0), array(3.0, 1.0))) == 5.0


def test_sizes(spark):
    cell = one(spark, geometry.grid_cell(F.lit(5), 3))
    assert (cell["row"], cell["column"]) == (1, 2)
    for w, h in ((100, 50), (4000, 1000), (900, 1000), (1344, 1344)):
        made = one(spark, geometry.bounded_resize(F.lit(w), F.lit(h)))
        assert max(made) <= 1344 and min(made) <= 672 and (made["width"] >= made["height"]) == (w >= h)


def test_chance_follows_keys(spark):
    rows = spark.range(4000)
    share = lambda c: rows.filter(c).count() / 4000
    assert share(sampling.layout("id", 0.3) == "t2i") == pytest.approx(0.3, abs=0.04)
    assert share(sampling.with_unconditional(F.lit("p"), "id") == "<unconditional>") == pytest.approx(0.1, abs=0.03)
    assert share(sampling.halves("id") == 1) == pytest.approx(0.5, abs=0.04)
    assert {r["p"] for r in rows.select(sampling.prompt_from(["a", "b", "c"], "id").alias("p")).collect()} == {"a", "b", "c"}
    dealt = {r["id"]: r["shard"] for r in sampling.round_robin(spark.range(10), ["id"], 3).collect()}
    assert dealt == {i: i % 3 for i in range(10)}
    known = sampling.drop_missing(spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a int, b string"), ["a", "b"])
    assert [tuple(r) for r in known.collect()] == [(2, "x")]


def test_placeholder_of_packs_without_image(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7, 8], [1, 1, 2, 2], True), (2, [5, 6, 7, 8], [1, 1, 2, 2], False)], "k int, ids array<int>, sequence_ids array<long>, image boolean")
    made = {r["k"]: r for r in packing.image_placeholder(rows.withColumn("labels", F.col("ids")), ["k"], F.col("image"), 90, 100).collect()}
    assert made[1]["ids"] == [5, 6, 7, 8] and made[1]["sequence_ids"] == [1, 1, 2, 2]
    assert made[2]["ids"][:3] == [5, 6, 90] and 100 <= made[2]["ids"][3] < 100 + 8192 and made[2]["sequence_ids"] == [1, 1, 3, 3] and len(made[2]["labels"]) == 4


def test_injected_tokenizer_and_roles(spark):
    rows = spark.createDataFrame([("ab",), (None,), ("abcd",)], "t string")
    made = packing.tokenised(rows, "t", lambda texts: [[ord(c) for c in t] for t in texts], most=3).collect()
    assert [r["ids"] for r in made] == [[97, 98], [], [97, 98, 99]]
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("x").alias("text")), F.struct(F.lit("system").alias("role"), F.lit("y").alias("text")))
    assert [m["role"] for m in one(spark, templates.named_roles(said, templates.template("v1")))] == ["USER", "system"]


def test_subsets_images_and_kept_tables(spark, tmp_path):
    for name in ("b", "a", "c"):
        spark.createDataFrame([(name,)], "x string").write.parquet(str(tmp_path / "root" / name))
    got = readers.subsets(spark, str(tmp_path / "root"), ["b", "a"])
    assert sorted((r["x"], r["subset"]) for r in got.collect()) == [("a", "a"), ("b", "b")]
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "1.png").write_bytes(b"png")
    (tmp_path / "images" / "1.txt").write_bytes(b"no")
    assert [(r["length"], bytes(r["content"])) for r in readers.images(spark, str(tmp_path / "images")).collect()] == [(3, b"png")]
    kept = readers.warmed(spark.range(5))
    assert kept.is_cached and kept.count() == 5
    kept.unpersist()


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k int, line string")
    read = lambda name: [r["value"] for r in spark.read.text(str(tmp_path / name)).collect()]
    for _ in range(2):
        writers.append_lines(rows.select("line"), str(tmp_path / "log"))
    assert sorted(read("log")) == ["a", "a", "b", "b", "c", "c"]
    writers.ordered_text(rows, str(tmp_path / "sorted"), ["k"], "line")
    parts = sorted((tmp_path / "sorted").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "a\nb\nc\n"
    writers.report(rows.select("line"), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*"))) == 1
    writers.with_summary(rows, rows.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "both"))
    assert spark.read.json(str(tmp_path / "both" / "summary")).first()["n"] == 3 and spark.read.json(str(tmp_path / "both" / "results")).count() == 3
    assert writers.versioned("/out/", "20250102_0304") == "/out/run=20250102_0304"
    lines = spark.createDataFrame([("prompts/a.txt", "k.txt")], "value string, key string")
    assert writers.cleaned_lines(lines).first()["value"] == "a" and writers.cleaned_lines(lines, whole_line=False).first()["key"] == "k"


def test_line_stream_and_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0").write_text("x\ny\n")
    (tmp_path / "in" / "other").write_text("z\n")
    assert sorted(r["value"] for r in jobs.run_once(jobs.text_lines(spark, str(tmp_path / "in")), "some_lines").collect()) == ["x", "y"]
    events = spark.sql("SELECT timestamp'2025-01-01 00:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2025-01-01 00:50:00', 'a' UNION ALL SELECT timestamp'2025-01-01 01:00:00', 'a'")
    assert sorted(r["count"] for r in jobs.windowed_counts(events, "ts", ["k"]).collect()) == [1, 2]


def test_request_flatten_whole_has_all_of_a_page(spark, tmp_path):
    html = "a" * 199 + "<img>b<image>" + "c" * 500
    spark.createDataFrame([(1, html, "u")], "page_id long, html string, url string").write.parquet(str(tmp_path / "pages.parquet"))
    r = QUERIES["request_flatten_whole"](spark, str(tmp_path)).first()
    assert r["prompt"] == "<|vision_start|><img><|vision_end|>\n" + "a" * 199 + "b" + "c" * 500 + " end" and r["n_images"] == 1


def test_whole_queries_leave_nothing_out(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("documents", [(1, " \t\n"), (2, None), (3, "so B")], "doc_id long, text string")
    put("embeddings", [(1, [0.5] * 64)], "vec_id long, embedding array<float>")
    put("conversations", [("c", t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "x" * 30) for t in range(6)], "conv_id string, turn int, role string, text string")
    put("customer", [(1, 1), (2, 1), (3, 2)], "c_custkey long, c_nationkey int")
    put("orders", [(3,), (1,), (1,)], "o_custkey long")
    rows = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["answer"] for r in rows("server_normalize_whole")} == {1: "", 2: None, 3: "B"}
    assert rows("separators_insert_whole")[0]["ids"] == ",".join(["50,50,50,50,-7"] * 16)
    r = rows("dialogue_export_whole")[0]
    assert (r["roles"], r["texts"], r["messages"]) == ("user assistant " * 2 + "user assistant", " ".join(f"turn {t} " + "x" * 30 for t in range(6)), 6)
    assert sorted(r["c_custkey"] for r in rows("group_intersection_whole")) == [1, 3]


def test_microbatches_are_runs_of_rows(spark, tmp_path):
    spark.range(2500).selectExpr("7 + 3 * id AS event_id", "'a' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    made = QUERIES["microbatch_requests"](spark, str(tmp_path)).collect()
    assert sorted((r["batch"], r["n"]) for r in made) == [(0, 1000), (1, 1000), (2, 500)]


def test_audit_decodes_files(spark, tmp_path):
    pq, n = pytest.importorskip("pyarrow.parquet"), 5000
    table = pytest.importorskip("pyarrow").table({"a": list(range(n)), "b": [f"text {i}" for i in range(n)]})
    pq.write_table(table, tmp_path / "good.parquet", row_group_size=1000)
    whole = (tmp_path / "good.parquet").read_bytes()
    (tmp_path / "pages.parquet").write_bytes(whole[:4] + bytes(len(whole) // 2) + whole[4 + len(whole) // 2 :])
    (tmp_path / "foot.parquet").write_bytes(whole[:-60] + bytes(52) + whole[-8:])
    (tmp_path / "marks.parquet").write_bytes(b"PAR1" + bytes(20) + b"PAR1")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    for want in (None, schema):
        rows = readers.audit(spark, str(tmp_path), schema=want).collect()
        assert {r["path"].split("/")[-1]: r["readable"] for r in rows} == {"good.parquet": True, "pages.parquet": False, "foot.parquet": False, "marks.parquet": False}
        assert all((r["problem"] is None) == r["readable"] for r in rows)
    assert not any(r["readable"] for r in readers.audit(spark, str(tmp_path), schema=T.StructType(schema.fields[:1])).collect())


def test_long_summaries_are_whole(spark, tmp_path):
    rows = spark.range(10_500).select(F.col("id").cast("string").alias("value"))
    writers.with_summary(rows.limit(1), rows, str(tmp_path / "s"))
    writers.report(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "s/summary")).count() == spark.read.text(str(tmp_path / "r")).count() == 10_500


def odd_matches_sql(spark, folder, name):
    con = pytest.importorskip("duckdb").connect()
    for p in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}/*.parquet'")
    ours, theirs = QUERIES[name](spark, str(folder)), con.sql(ORACLE[name])
    return sorted(map(repr, (tuple(r[c] for c in theirs.columns) for r in ours.collect()))) == sorted(map(repr, theirs.fetchall()))


def test_pictures_of_a_grid_are_painted_once(spark, tmp_path, monkeypatch):
    calls, picture = str(tmp_path / "calls"), catalogue_files._picture

    def counted(key):
        with open(calls, "ab") as f:
            f.write(b".")
        return picture(key)

    monkeypatch.setattr(catalogue_files, "_picture", counted)
    monkeypatch.setattr(catalogue_files, "BAND", 8, raising=False)
    rows = [(1, k) for k in range(300)] + [(2, 5), (2, 5), (2, None), (2, None), (None, 6), (3, None)]
    spark.createDataFrame(rows, "s_nationkey int, s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    assert odd_matches_sql(spark, tmp_path, "pixels_grid")
    assert 0 < (tmp_path / "calls").stat().st_size <= len(rows)


def test_first_codes_are_multiplied_in_single_precision(spark, tmp_path):
    rows = [(1, [0.29, -0.29, 0.57, 0.58] * 16), (2, None), (3, []), (4, [0.1, 0.29, 0.3, 0.4, 0.5]), (5, [0.1, None, 0.3, 0.4])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert odd_matches_sql(spark, tmp_path, "separators_insert")


def test_whole_codes_are_multiplied_in_single_precision(spark, tmp_path):
    rows = [(1, [0.5] * 60 + [0.29, -0.29, 0.57, 0.58]), (2, None), (3, []), (4, [0.1, None, 0.29, 0.4])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert odd_matches_sql(spark, tmp_path, "separators_insert_whole")
