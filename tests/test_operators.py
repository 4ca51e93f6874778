"""Operators on small fixtures, and what SQL doesn't reach: files, streams, injected functions."""

import math

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import arrays, geometry, text
from tessera.operators import enrich, packing, reshape, sampling, scoring, stats, templates, vectors
from tessera.plans.store import ordinal, running
from tessera.sources import readers, writers
from tessera.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said, answer", [("(yes)", "yes"), ("no)", "no"), ("Yes, sure.", "yes"), ("yes and no", "no"), ("是", "yes"), ("perhaps", "no"), ("not", "no"), ("(YES)", "yes")])
def test_yes_no(spark, said, answer):
    assert one(spark, text.yes_no(F.lit(said))) == answer


def test_text_functions(spark):
    assert one(spark, text.choice(F.lit("the b"))) == "B"
    assert one(spark, text.choice(F.lit("xyz"))) == "unknown"
    assert one(spark, text.served_answer(F.lit("  "))) == ""
    assert one(spark, text.unfence(F.lit("```json\n{}\n```"))) == "{}"
    assert [one(spark, text.pad_id(F.lit(x))) for x in ("7", "12345678")] == ["000007", "12345678"]
    assert one(spark, text.longest_value(F.lit('{"a": "xx", "b": "yy", "c": "z"}'))) == "xx"
    assert one(spark, text.longest_value(F.lit("nothing"))) == ""
    assert one(spark, text.reply_content(F.lit('{"response": {"body": {"choices": [{"message": {"content": "hi"}}]}}}'))) == "hi"
    assert one(spark, text.reply_content(F.lit("{}"))) == ""
    assert one(spark, text.from_base64(F.lit("%%"))) is None
    assert one(spark, text.int_array(F.lit("no"))) is None
    first, second = text.category_levels(F.lit("entity - whole (x)"))
    assert (one(spark, first), one(spark, second)) == ("entity", "entity - whole")


def test_arrays(spark):
    ids = F.array(*map(F.lit, (1, 2, 3, 4)))
    assert one(spark, arrays.masked_prefix(ids, 2)) == [-100, -100, 3, 4]
    assert one(spark, arrays.insert_separators(ids, 2, 9)) == [1, 2, 9, 3, 4, 9]
    with pytest.raises(Exception, match="multiple"):
        one(spark, arrays.insert_separators(ids, 3, 9))
    assert one(spark, arrays.rotated(ids, F.lit(1))) == [2, 3, 4, 1]
    assert one(spark, arrays.until(ids, 3)) == [1, 2]
    assert one(spark, arrays.left_padded(ids, 6, 0)) == [0, 0, 1, 2, 3, 4]
    assert one(spark, arrays.attention(ids, 6)) == [0, 0, 1, 1, 1, 1]
    assert one(spark, arrays.is_vision(ids, 4, start=1)) == [True, False, False, True]
    assert one(spark, arrays.guided(F.array(F.lit(2.0)), F.array(F.lit(1.0)), 3.0)) == [4.0]
    assert one(spark, arrays.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    mask = F.array(F.lit(True), F.lit(False), F.lit(True), F.lit(False))
    assert one(spark, arrays.selected(ids, mask)) == [1, 3]
    assert one(spark, arrays.chosen(mask, ids, arrays.rotated(ids, F.lit(1)))) == [1, 3, 3, 1]


def test_geometry(spark):
    assert one(spark, geometry.aspect_ok(F.lit(250), F.lit(100))) is True
    assert one(spark, geometry.aspect_ok(F.lit(251), F.lit(100))) is False
    assert one(spark, geometry.centre_crop(F.lit(1000), F.lit(500))).asDict() == {"width": 1024, "height": 512, "left": 256, "top": 0}
    assert [one(spark, geometry.is_square(F.lit(n))) for n in (16, 15)] == [True, False]


def test_with_pixels(spark):
    made = geometry.with_pixels(spark.createDataFrame([(b"ab",), (b"",), (None,)], "image binary"), "image", lambda b: [b[0]])
    assert [r["codes"] for r in made.collect()] == [[97], None, None]


def test_dialogue_round_trip(spark):
    rows = spark.createDataFrame([([("a", "b"), ("c", None)],)], "texts array<struct<user:string,assistant:string>>")
    flat = rows.select(reshape.flatten_dialogue(F.col("texts")).alias("x")).first()["x"]
    assert flat == "a^^^pair_split^^^b^^^turn_split^^^c^^^pair_split^^^"
    assert [m["value"] for m in one(spark, reshape.split_dialogue(F.lit(flat)))] == ["a", "b", "c", ""]
    assert one(spark, reshape.split_dialogue(F.lit("no pair"))) is None
    assert one(spark, reshape.split_dialogue(F.lit("^^^pair_split^^^b"), F.lit("Describe it.")))[0]["value"] == "Describe it."


def test_templates(spark):
    m = F.array(F.struct(F.lit("USER").alias("role"), F.lit("hi <image>").alias("text")), F.struct(F.lit("ASSISTANT").alias("role"), F.lit(None).cast("string").alias("text")))
    t = templates.template("vicuna_v1")
    assert one(spark, templates.prompt(m, t)) == t.system + " USER: hi <image> ASSISTANT:"
    assert one(spark, templates.image_first(m, t))[0]["text"] == "<image>\nhi"
    assert len(one(spark, templates.image_first(m, templates.template("v1_mmtag")))) == 4
    assert templates.template("nothing") is t and templates.template("my-gemma").style == "gemma"
    assert len(templates.TEMPLATES) == 20
    assert one(spark, templates.prompt(m, templates.template("mistral_instruct"))) == "[INST] hi <image> [/INST]"


def test_ordinal_is_gapless(spark):
    rows = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    found = sorted((r["k"], r["ordinal"]) for r in ordinal(rows, ["k"]).collect())
    assert [o for _, o in found] == list(range(1000))
    assert ordinal(spark.range(0), ["id"]).count() == 0


def test_head_fraction_and_splits(spark):
    rows = spark.range(10)
    assert sorted(r["id"] for r in sampling.head_fraction(rows, ["id"], 0.35).collect()) == [0, 1, 2]
    assert [r["shard"] for r in sampling.contiguous(rows, ["id"], 3).orderBy("id").collect()] == [0] * 4 + [1] * 3 + [2] * 3
    assert [r["shard"] for r in sampling.proportional(rows, ["id"], 4).orderBy("id").collect()] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
    assert [r["id"] for r in sampling.hash_shuffled(rows, "id", 3).collect()] != list(range(10))


def test_sampled_choice(spark):
    rows = spark.createDataFrame([(g, i, 0.25) for g in range(40) for i in range(4)], "g int, i int, p double")
    drawn = sampling.sampled_choice(rows, ["g"], "p", ["i"]).collect()
    assert len(drawn) == 40 and len({r["i"] for r in drawn}) == 4


@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums_of_groups_of_any_size(spark, parts):
    key = lambda i: None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}"
    data = [(key(i), i, None if i % 5 == 0 or i < 4 else i % 13) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, i long, n long").repartition(parts)
    for itself in (True, False):
        want, so_far = {}, {}
        for g, i, n in data:
            after = so_far.get(g) if n is None else (so_far.get(g) or 0) + n
            want[i] = after if itself else so_far.get(g)
            so_far[g] = after
        made = running(rows, ["g"], ["i"], {"s": "n"}, itself)
        assert made.columns == ["g", "i", "n", "s"]
        assert {r["i"]: r["s"] for r in made.collect()} == want
    back = {r["i"]: r["s"] for r in running(rows, ["g"], [F.desc("i")], {"s": "n"}).collect()}
    hot = [(i, n or 0) for g, i, n in data if g == "hot"]
    assert all((back[i] or 0) == sum(n for j, n in hot if j >= i) for i, _ in hot)
    assert running(rows.limit(0), ["g"], ["i"], {"s": "n"}).count() == 0


def test_lead_and_nucleus_of_a_group_that_holds_most_rows(spark):
    data = [(None if i % 9 == 0 else "hot" if i % 4 else "small", i) for i in range(120)]
    rows = spark.createDataFrame(data, "g string, i long")
    ahead = {r["i"]: r["next"] for r in vectors.lead_over(rows, ["g"], ["i"], "i", "next", 2).collect()}
    for g in (None, "hot", "small"):
        own = [i for h, i in data if h == g]
        assert [ahead[i] for i in own] == own[2:] + [None, None]
    shares = spark.createDataFrame([("a", i, p) for i, p in enumerate([0.5, 0.25, 0.125, 0.125])] + [("b", 9, 1.0)], "g string, i int, p double")
    kept = sorted((r["g"], r["i"]) for r in sampling.nucleus(shares, ["g"], "p", ["i"], 0.6).collect())
    assert kept == [("a", 0), ("a", 1), ("b", 9)]


def test_gate_follows_the_order_of_the_file(spark):
    rows = spark.createDataFrame([(1, 2, [0], 0, 1), (1, 1, [2], 1, 2), (1, 3, [1], 1, 0)], "item int, qid int, parents array<int>, score int, line int")
    # 3 comes first and sees 1 ungated; 1 is gated by 2; by qid, 3 would be gated through 1
    assert scoring.gate_scores(rows, "item", "qid", "parents", "score", "line").first()["gated"] == pytest.approx(1 / 3)
    assert scoring.gate_scores(rows, "item", "qid", "parents", "score").first()["gated"] == 0


def test_entropy_bounds(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "a", "b"]), (1, ["c"]), (2, [])], "id int, t array<string>")
    assert stats.conditional_entropy(rows, "t", 2, []).first()["h"] == pytest.approx(0.0)
    h = stats.conditional_entropy(rows, "t", 1, []).first()["h"]
    assert h == pytest.approx(-(2 * 0.4 * math.log2(0.4) + 0.2 * math.log2(0.2)))
    across = stats.conditional_entropy(rows, "t", 2, [], cross=["id"]).first()
    assert across["n_grams"] == 4
    with pytest.raises(ValueError):
        stats.ngram_counts(rows, "t", 0, [])


def test_layouts(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    made = one(spark, packing.layout_text_to_image(a(1, 2), a(50, 51), 7, 8, 9))
    assert (made["ids"], made["labels"]) == ([1, 2, 7, 50, 51, 8, 9], [-100] * 3 + [50, 51, 8, 9])
    made = one(spark, packing.layout_caption(a(3), a(1, 2), a(50), 7, 8, 9))
    assert (made["ids"], made["labels"]) == ([7, 50, 8, 3, 1, 2, 9], [-100] * 5 + [2, 9])
    made = one(spark, packing.layout_dialogue(F.array(a(1, 2), a(3)), a(50), 7, 8, 5))
    assert (made["ids"], made["labels"]) == ([7, 50, 8, 1, 2], [-100] * 5)
    assert one(spark, packing.cumulative(a(3, 1, 2))) == [0, 3, 4, 6]


def test_packs_conserve_tokens(spark):
    lengths = [5, 3, 9, 1, 1, 10, 12, 2]
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate(lengths)], "key string, ordinal long, n long")
    made = packing.plan(rows, "key", "ordinal", "n", 10).orderBy("ordinal").collect()
    assert [(r["pack"], r["at"], r["keep"]) for r in made] == [(0, 0, 5), (0, 5, 3), (0, 8, 2), (1, 0, 1), (1, 1, 1), (1, 2, 8), (2, 0, 10), (3, 0, 2)]
    tokens = spark.createDataFrame([("k", i, [i] * n, [i] * n) for i, n in enumerate(lengths)], "key string, ordinal long, ids array<int>, labels array<int>")
    packs = packing.packed(packing.plan(rows, "key", "ordinal", "n", 10).join(tokens, ["key", "ordinal"]), "key").orderBy("pack").collect()
    assert [len(p["ids"]) for p in packs] == [10, 10, 10, 2]
    assert packs[0]["sequence_ids"] == [1] * 5 + [2] * 3 + [3] * 2 and packs[0]["cu_seqlens"] == [0, 5, 8, 10]


def test_gate_is_transitive_only_forwards(spark):
    rows = spark.createDataFrame([(1, 1, [0], 0), (1, 2, [1], 1), (1, 3, [2], 1), (2, 1, [2], 1), (2, 2, [0], 1), (3, 1, [9], 1)], "item int, qid int, parents array<int>, score int")
    made = {r["item"]: (r["raw"], r["gated"]) for r in scoring.gate_scores(rows, "item", "qid", "parents", "score").collect()}
    assert made == {1: (pytest.approx(2 / 3), 0.0), 2: (1.0, 1.0)}


def test_binary_report_guards(spark):
    rows = spark.createDataFrame([("no", "no"), ("yes", "what")], "t string, p string")
    r = scoring.binary_report(rows, "t", "p").first()
    assert (r["n"], r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1, 1.0, 0.0, 0.0, 0.0)


def test_last_runs(spark):
    rows = spark.createDataFrame(list(enumerate("aabba")), "i int, k string")
    assert sorted((r["k"], r["i"]) for r in scoring.last_runs(rows, "i", "k").collect()) == [("a", 4), ("b", 2), ("b", 3)]


def test_nearest_code_odd_vectors(spark):
    book = spark.createDataFrame([(3, [0.0, 0.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0])], "code_id int, code_vec array<double>")
    rows = spark.createDataFrame([(1, [0.9, 0.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])], "id int, v array<double>")
    assert {r["id"]: r["code_id"] for r in vectors.nearest_code(rows, "v", book).collect()} == {1: 5, 2: None, 3: None, 4: None}


def test_nearest_code_in_blocks(spark, monkeypatch):
    book = spark.createDataFrame([((7 * i) % 23 + (1 << 60), [float(i % 12), 0.5 * (i % 12)]) for i in range(23)], "code_id long, code_vec array<double>")
    rows = spark.createDataFrame([(i, [i / 3, 1.0]) for i in range(40)] + [(40, None), (41, [1.0]), (42, [float("nan"), 0.0])], "id int, v array<double>")
    entries = [(r["code_id"], r["code_vec"]) for r in book.collect()]
    want = {r["id"]: min(((r["v"][0] - x) ** 2 + (r["v"][1] - y) ** 2, i) for i, (x, y) in entries)[::-1] if r["id"] < 40 else (None, None) for r in rows.collect()}
    for block in (1 << 16, 23, 22, 5):
        monkeypatch.setattr(vectors, "CODEBOOK", block)
        made = vectors.nearest_code(rows, "v", book)
        assert made.columns == ["id", "v", "code_id", "code_dist"]
        got = {r["id"]: (r["code_id"], r["code_dist"]) for r in made.collect()}
        assert {i: c for i, (c, _) in got.items()} == {i: c for i, (c, _) in want.items()}
        assert all(d == pytest.approx(want[i][1]) for i, (_, d) in got.items() if d is not None)


def test_routed_keeps_rows(spark):
    made = vectors.routed(spark.range(6).withColumn("m", F.col("id") % 2 == 0), "m", lambda d: d.withColumn("x", F.lit(1)), lambda d: d.withColumn("x", F.lit(2)))
    assert sorted((r["id"], r["x"]) for r in made.collect()) == [(i, 1 + i % 2) for i in range(6)]


def test_enrich_keeps_failures(spark):
    def fn(t):
        if t == "bad":
            raise RuntimeError
        return t.upper(), {"total_tokens": 3}

    made = enrich.enrich(spark.createDataFrame([("a",), ("bad",), ("",), (None,)], "t string"), "t", fn, tries=2).collect()
    assert [r["t"] for r in made] == ["A", "bad", "", None]
    assert [r["t_usage"]["failed"] for r in made] == [False, True, False, False]


def test_write_back_and_references(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "id int, x string, y string")
    done = spark.createDataFrame([("000001_x", "A"), ("000002_y", "")], "custom_id string, value string")
    assert sorted(tuple(r) for r in enrich.write_back(rows, "id", ["x", "y"], done).collect()) == [(1, "A", "b"), (2, "c", "")]
    refs = spark.createDataFrame([(1, "own", "v1"), (2, "1", "v2"), (3, "9", "v3")], "k long, ref string, v string")
    assert sorted((r["k"], r["v"]) for r in enrich.resolve_references(refs, "k", "ref", "v").collect()) == [(1, "v1"), (2, "v1")]


def test_files_round_trip(spark, tmp_path):
    rows = spark.range(10).withColumn("s", F.concat(F.lit('q"'), F.col("id").cast("string")))
    writers.rolling_shards(rows, str(tmp_path / "r"), ["id"], 4)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "r")).groupBy("shard").count().collect()) == [2, 4, 4]
    writers.equal_shards(rows, str(tmp_path / "e"), ["id"], 3)
    assert sorted(r["count"] for r in spark.read.parquet(str(tmp_path / "e")).groupBy("shard").count().collect()) == [3, 3, 4]
    writers.delimited(rows, str(tmp_path / "t"))
    assert readers.table_file(spark, str(tmp_path / "t"), strings=True).filter("s = 'q\"3'").count() == 1
    writers.json_lines(rows.withColumn("subset", F.col("id") % 2), str(tmp_path / "j"), "subset")
    assert readers.json_files(spark, str(tmp_path / "j")).count() == 10
    assert {r["readable"] for r in readers.audit(spark, str(tmp_path / "r")).collect()} == {True}
    (tmp_path / "bad.parquet").write_bytes(b"nothing of the kind")
    assert [r["readable"] for r in readers.audit(spark, str(tmp_path / "bad.parquet")).collect()] == [False]


def test_line_sources(spark, tmp_path):
    (tmp_path / "part-1").write_text('x\t{"a": "long one", "b": "s"}\tx\tx\tYWI=\tx\tx\nbad line\n')
    got = readers.image_lines(spark, str(tmp_path)).collect()
    assert [(r["caption"], bytes(r["image"])) for r in got] == [("long one", b"ab")]
    (tmp_path / "p.txt").write_text("first\n\nthird\n")
    assert [(r["line"], r["text"]) for r in readers.lines(spark, str(tmp_path / "p.txt")).collect()] == [(0, "first"), (2, "third")]
    (tmp_path / "COCOval7.txt").write_text("a cat")
    assert readers.whole_files(spark, str(tmp_path), "COCO*").first()["origin"] == "COCOval"
    (tmp_path / "l.jsonl").write_text('{"id": "a"}\nnot json\n')
    good, bad = readers.checked_json(spark, str(tmp_path / "l.jsonl"), schemas.T.StructType([schemas.T.StructField("id", schemas.T.StringType())]))
    assert [r["id"] for r in good.collect()] == ["a"]
    assert [r[0] for r in bad.collect()] == ["not json"]
    (tmp_path / "checkpoint-10").mkdir()
    assert [r["step"] for r in readers.checkpoints(spark, str(tmp_path)).collect()] == [10]
    assert tuple(one(spark, readers.entropy_log(F.lit("wiki: n=3 entropy=1.5")))) == ("wiki", 3, 1.5)


def test_records_schema(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "text": "t", "height": "no"}\n')
    (tmp_path / "b.json").write_text('{"id": "2", "caption": "c"}\n')
    rows = readers.many_records(spark, f"{tmp_path}/a.json^^{tmp_path}/b.json", [1.0], ["id"], "json")
    assert rows.schema == schemas.TRAIN_SCHEMA and rows.count() == 2
    with pytest.raises(ValueError):
        readers.many_records(spark, "a^^b^^c", [0.1, 0.2], ["id"])


def test_stream_pack_equals_batch(spark, tmp_path):
    lengths = [5, 3, 9, 1, 1, 10, 12, 2, 4]
    for k in range(3):
        spark.createDataFrame([("k", i, lengths[i]) for i in range(3 * k, 3 * k + 3)], "key string, ordinal long, n long").coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
    batch = spark.read.parquet(*[str(tmp_path / f"x{k}") for k in range(3)])
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        file = next((tmp_path / f"x{k}").glob("*.parquet"))
        file.rename(folder / f"{k}.parquet")
    stream = jobs.files(spark, str(folder), batch.schema, per_batch=3)
    got = jobs.run_once(jobs.stream_pack(stream, "key", "ordinal", "n", 10), "packs").orderBy("ordinal").collect()
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate(lengths)], "key string, ordinal long, n long")
    want = packing.plan(rows, "key", "ordinal", "n", 10).orderBy("ordinal").collect()
    assert [(r["pack"], r["at"], r["keep"]) for r in got] == [(r["pack"], r["at"], r["keep"]) for r in want]


def test_serve_micro_batches(spark, tmp_path):
    spark.range(5).selectExpr("id", "concat('r', id) as text").write.parquet(str(tmp_path / "in"))
    stream = jobs.files(spark, str(tmp_path / "in"), "id long, text string")
    jobs.serve(stream, lambda d: d.withColumn("answer", F.upper("text")), str(tmp_path / "out"), str(tmp_path / "c"), every=None).awaitTermination()
    assert sorted(r["answer"] for r in spark.read.json(str(tmp_path / "out")).collect()) == [f"R{i}" for i in range(5)]
