"""More queries with their SQL: sources and sinks as round trips through files, streams over them, pixels, and the column
functions, each over whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays, geometry, pixels, text
from tessera.operators import enrich, packing, reshape, sampling, scoring, stats, templates, vectors
from tessera.plans import experiments
from tessera.plans.catalogue import _PACKS, _TURNS, _dialogues, _lengths, _sql, query, read
from tessera.plans.store import running, shared_dir, spread
from tessera.schemas import CODES, PATH_SPLIT
from tessera.sources import readers, writers
from tessera.streaming import jobs

S, L, I = T.StringType(), T.LongType(), T.IntegerType()  # noqa: E741
BAND = 1024  # pictures that one call paints; even, so that grids of two columns are cut between rows
WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


def docs(spark, sf_dir, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(*columns)


# ---------------------------------------------------------------- sources and sinks
@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE doc_id % 5 <> 0")
def source_records_split(spark, sf_dir):
    at = folder(spark, "records")
    docs(spark, sf_dir, "doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")).write.parquet(at)
    return readers.records(spark, at, "parquet", fields(doc_id=L, text=S, split=S), "train").select("doc_id", F.md5("text").alias("text_md5"))


@query("""
    WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)
    SELECT id, 'documents' AS origin FROM a WHERE r < floor(n * 0.37) UNION ALL SELECT item_id, 'benchmark' FROM benchmark
""")
def source_many_records(spark, sf_dir):
    a, b = folder(spark, "many"), folder(spark, "many")
    docs(spark, sf_dir, F.col("doc_id").alias("id"), F.lit("documents").alias("origin")).write.json(a)
    read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin")).write.json(b)
    return readers.many_records(spark, f"{a}{PATH_SPLIT}{b}", [0.37, 1.0], ["id"], "json", fields(id=L, origin=S))


@query("SELECT doc_id, source, md5(text) AS text_md5, lang FROM documents")
def sink_json_lines(spark, sf_dir):
    at = folder(spark, "lines")
    writers.json_lines(docs(spark, sf_dir, "doc_id", "source", "text", "lang"), at, subset="lang")
    return readers.json_files(spark, at, "*.json", fields(doc_id=L, source=S, text=S, lang=S)).select("doc_id", "source", F.md5("text").alias("text_md5"), "lang")


@query("SELECT conv_id, turn, 'good' AS kind FROM conversations WHERE turn % 3 <> 0 UNION ALL SELECT NULL, length(text)::INT, 'bad' FROM conversations WHERE turn % 3 = 0")
def source_checked_json(spark, sf_dir):
    at = folder(spark, "checked")
    line = F.to_json(F.struct("conv_id", "turn"))
    spoilt = F.concat(F.lit('{"conv_id": "'), F.repeat(F.lit("x"), F.length("text")))
    read(spark, sf_dir, "conversations").select(F.when(F.col("turn") % 3 == 0, spoilt).otherwise(line)).write.text(at)
    good, bad = readers.checked_json(spark, at, fields(conv_id=L, turn=L))
    good = good.select("conv_id", F.col("turn").cast("int").alias("turn"), F.lit("good").alias("kind"))
    return good.unionByName(bad.select(F.lit(None).cast("long").alias("conv_id"), (F.length("line") - 13).cast("int").alias("turn"), F.lit("bad").alias("kind")))


@query("SELECT 'shard_' || lpad((r // 300)::VARCHAR, 5, '0') || '.parquet' AS file, count(*) AS \"rows\", true AS readable FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) GROUP BY ALL")
def sink_numbered_shards_audit(spark, sf_dir):
    at = folder(spark, "numbered")
    made = writers.numbered_shards(docs(spark, sf_dir, "doc_id", "text"), at, ["doc_id"], 300)
    found = readers.audit(spark, at, schema=fields(doc_id=L, text=S)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "readable")
    return made.join(found, "file").select("file", "rows", "readable")


@query("SELECT doc_id, ntile(8) OVER (ORDER BY doc_id) - 1 AS shard FROM documents")
def sink_equal_shards(spark, sf_dir):
    at = folder(spark, "equal")
    writers.equal_shards(docs(spark, sf_dir, "doc_id"), at, ["doc_id"], 8)
    return spark.read.parquet(at).select("doc_id", F.col("shard").cast("long").alias("shard"))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 2000 AS shard FROM orders")
def sink_rolling_shards(spark, sf_dir):
    at = folder(spark, "rolling")
    writers.rolling_shards(read(spark, sf_dir, "orders").select("o_orderkey"), at, ["o_orderkey"], 2000)
    return spark.read.parquet(at).select("o_orderkey", F.col("shard").cast("long").alias("shard"))


@query("""
    WITH r AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 700 + 1 AS k FROM part)
    SELECT p_partkey AS "key", CASE WHEN (SELECT max(k) FROM r) = 1 THEN 'requests.jsonl' ELSE 'requests_part_' || k || '.jsonl' END AS file, count(*) OVER (PARTITION BY k) AS in_file FROM r
""")
def sink_request_files(spark, sf_dir):
    at = folder(spark, "requests")
    rows = read(spark, sf_dir, "part").select("p_partkey", reshape.batch_request(F.col("p_partkey").cast("string"), F.col("p_name"), "m").alias("request"))
    made = writers.request_files(rows, at, ["p_partkey"], "request", 700)
    lines = spark.read.text(at).select(F.get_json_object("value", "$.custom_id").cast("long").alias("key"), F.col("_metadata.file_name").alias("file"))
    return lines.join(made.withColumnRenamed("rows", "in_file"), "file").select("key", "file", "in_file")


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_brand END AS p_brand, p_size::VARCHAR AS p_size FROM part")
def sink_delimited_strings(spark, sf_dir):
    at = folder(spark, "tsv")
    writers.delimited(read(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).alias("p_brand"), "p_size"), at)
    return readers.table_file(spark, at, strings=True).select("p_partkey", "p_name", "p_brand", "p_size")


@query("SELECT doc_id, md5(text) AS text_md5, n_chars FROM documents")
def sink_delimited_quoted(spark, sf_dir):
    at = folder(spark, "csv")
    writers.delimited(docs(spark, sf_dir, "doc_id", F.concat(F.lit('"q", '), "text").alias("text"), "n_chars"), at, ",")
    found = readers.table_file(spark, at, ",", fields(doc_id=L, text=S, n_chars=L))
    return found.select("doc_id", F.md5(F.expr("substring(text, 6)")).alias("text_md5"), "n_chars")


@query("SELECT item_id - (SELECT min(item_id) FROM benchmark) + item_id // 7 AS line, md5(replace(text, chr(10), ' ')) AS text_md5 FROM benchmark")
def source_numbered_lines(spark, sf_dir):
    at = folder(spark, "numbered")
    body = F.when(F.col("item_id") % 7 == 6, "\n").otherwise("")
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), body).alias("line"))
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "line"))), lambda x: x["line"]), "\n").alias("all"))  # a few lines
    whole.coalesce(1).write.text(at)
    return readers.lines(spark, at).select(F.col("line").cast("long").alias("line"), F.md5("text").alias("text_md5"))


@query("SELECT n_name || '.txt' AS file, 'nation ' || n_nationkey AS text, regexp_extract(n_name, '^([A-Za-z]+)', 1) AS origin FROM nation")
def source_whole_files(spark, sf_dir):
    at = folder(spark, "prompts")
    rows = read(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".txt")).alias("name"), F.encode(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), "UTF-8").alias("content"))
    writers.named_files(rows, at, "name", "content")
    return readers.whole_files(spark, at)


def _picture(key: int) -> np.ndarray:
    """A small picture that a key decides: red is the key, green and blue the place, opacity falls by columns."""
    h, w = 2 + key % 3, 3 + key % 2
    out = np.zeros((h, w, 4), np.uint8)
    out[:, :, 0] = key % 256
    out[:, :, 1], out[:, :, 2] = np.arange(h)[:, None] * 10, np.arange(w)[None, :] * 20
    out[:, :, 3] = 255 - 51 * np.arange(w)[None, :]
    return out


def _pictures(spark, sf_dir) -> DataFrame:
    made = F.udf(lambda k: pixels.png(_picture(k)), T.BinaryType())
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("name"), made("s_suppkey").alias("content"))


@query("SELECT s_suppkey, (2 + s_suppkey % 3)::INT AS height, (3 + s_suppkey % 2)::INT AS width, true AS same FROM supplier")
def source_images(spark, sf_dir):
    at = folder(spark, "images")
    writers.named_files(_pictures(spark, sf_dir), at, "name", "content")

    def facts(data: bytes) -> tuple:
        image = pixels.from_png(data)
        h, w = image.shape[:2]
        return h, w, bool((image[:, :, 1] == np.arange(h)[:, None] * 10).all() and (image[:, :, 3] == 255 - 51 * np.arange(w)[None, :]).all())

    known = F.udf(facts, "height int, width int, same boolean")
    key = F.regexp_extract("path", r"p(\d+)\.png$", 1).cast("long").alias("s_suppkey")
    return readers.images(spark, at).select(key, known("content").alias("f")).select("s_suppkey", "f.*")


@query("SELECT s_nationkey, 'nation_' || s_nationkey || '.tar' AS file, count(*) AS \"rows\" FROM supplier GROUP BY s_nationkey")
def sink_archives(spark, sf_dir):
    at = folder(spark, "tar")
    named = _pictures(spark, sf_dir).join(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    made = writers.archives(named.withColumn("archive", F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"), F.lit(".tar"))), at, "archive", "name", "content")
    return made.select(F.regexp_extract("file", r"_(\d+)\.", 1).cast("int").alias("s_nationkey"), "file", "rows")


@query("""
    WITH p AS (SELECT s_suppkey AS k, 2 + s_suppkey % 3 AS h, 3 + s_suppkey % 2 AS w FROM supplier),
         c AS (SELECT k, (255 - 51 * x)::DOUBLE / 255 AS a, x, y FROM p, (SELECT unnest(range(4)) AS x) xs, (SELECT unnest(range(4)) AS y) ys WHERE x < w AND y < h),
         v AS (SELECT k, x, y, floor(255 * (1 - a) + a * (k % 256))::BIGINT AS r, floor(255 * (1 - a) + a * (y * 10))::BIGINT AS g, floor(255 * (1 - a) + a * (x * 20))::BIGINT AS b FROM c)
    SELECT k AS s_suppkey, sum(r)::BIGINT AS red, sum(g)::BIGINT AS green, sum(b)::BIGINT AS blue FROM v GROUP BY k
""")
def pixels_on_white(spark, sf_dir):
    def sums(data: bytes) -> list[int]:
        white = pixels.on_white(pixels.from_png(data))
        back = pixels.unscaled(pixels.scaled(white))
        assert np.abs(back.astype(int) - white).max() <= 1
        return white.reshape(-1, 3).astype(int).sum(axis=0).tolist()

    made = geometry.with_pixels(_pictures(spark, sf_dir), "content", sums, "sums").filter("sums is not null")
    return made.select("s_suppkey", *[F.col("sums")[i].cast("long").alias(c) for i, c in enumerate(("red", "green", "blue"))])


@query("SELECT s_suppkey, 4::INT AS codes FROM supplier WHERE s_suppkey % 10 <> 0")
def pixels_undecodable_rows(spark, sf_dir):
    spoilt = F.when(F.col("s_suppkey") % 10 == 0, F.encode(F.lit("no picture"), "UTF-8")).otherwise(F.col("content"))
    rows = geometry.with_pixels(_pictures(spark, sf_dir).withColumn("content", spoilt), "content", lambda d: pixels.square(pixels.on_white(pixels.from_png(d))).reshape(-1)[:4].tolist())
    return sampling.drop_missing(rows, ["codes"]).select("s_suppkey", F.size("codes").alias("codes"))


@query("""
    WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
    SELECT g AS s_nationkey, k AS s_suppkey, (i // 2)::INT AS "row", (i % 2)::INT AS "column", (2 * ((n + 1) // 2))::INT AS height, sqrt(n) = floor(sqrt(n)) AS square FROM s
""")
def pixels_grid(spark, sf_dir):
    rows = spread(read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")).withColumn("one", F.lit(1))
    placed = running(rows, ["s_nationkey"], [F.col("s_suppkey").asc_nulls_last()], {"i": "one"}, itself=False).withColumn("i", F.coalesce("i", F.lit(0)))
    bands = placed.groupBy(F.col("s_nationkey").alias("grid"), F.floor(F.col("i") / BAND)).agg(F.count(F.lit(1)).alias("n"))
    painted = F.udf(lambda n: pixels.grid([_picture(0)[:2, :3, :3]] * n, 2).shape[0], "int")  # whole rows of a grid, so heights add up
    grids = bands.withColumn("height", painted("n")).groupBy("grid").agg(F.sum("n").alias("n"), F.sum("height").cast("int").alias("height"))
    cell = geometry.grid_cell(F.col("i"), 2)
    each = placed.join(grids, F.col("s_nationkey").eqNullSafe(F.col("grid")))
    return each.select("s_nationkey", "s_suppkey", cell["row"].alias("row"), cell["column"].alias("column"), "height", geometry.is_square(F.col("n")).alias("square"))


@query("SELECT p_type, count(*) AS n, (SELECT count(*) FROM part) AS total FROM part GROUP BY p_type")
def sink_with_summary(spark, sf_dir):
    at = folder(spark, "summary")
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    writers.with_summary(rows, rows.agg(F.count(F.lit(1)).alias("total")), at)
    found = readers.json_files(spark, f"{at}/results").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(readers.json_files(spark, f"{at}/summary")))  # one row


@query("SELECT n_name AS line, 2::BIGINT AS n FROM nation UNION ALL SELECT 'report ' || count(*), 1 FROM nation")
def sink_text_lines(spark, sf_dir):
    at, names = folder(spark, "log"), read(spark, sf_dir, "nation")
    for _ in range(2):
        writers.append_lines(names.select("n_name"), at)
    writers.report(names.agg(F.concat(F.lit("report "), F.count(F.lit(1)).cast("string")).alias("line")), f"{at}-report")
    return spark.read.text(at).unionByName(spark.read.text(f"{at}-report")).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, (row_number() OVER (ORDER BY c_name) - 1) AS place FROM customer")
def sink_ordered_text(spark, sf_dir):
    at = writers.versioned(folder(spark, "ordered"), "20250102_0304")
    writers.ordered_text(read(spark, sf_dir, "customer").select("c_name", F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name").alias("line")).coalesce(1), at, ["c_name"], "line")
    whole = spark.read.text(at, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")  # files in order of their names
    lines = whole.select("file", F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("at", "line"))
    return sampling.ordinal(lines, ["file", "at"], "place").select(F.substring_index("line", " ", 1).cast("long").alias("c_custkey"), "place")


@query("SELECT s_suppkey, 'a' || s_suppkey || ' b' AS whole, '{\"key\":\"k' || s_suppkey || '\",\"text\":\"prompts/x.txt\"}' AS keyed FROM supplier")
def cleaned_prompt_lines(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("prompts/a"), k, F.lit(".txt b")).alias("value"), F.concat(F.lit("prompts/k"), k, F.lit(".txt")).alias("key"))
    both = writers.cleaned_lines(writers.cleaned_lines(rows), whole_line=False)
    return both.select("s_suppkey", F.col("value").alias("whole"), F.to_json(F.struct("key", F.lit("prompts/x.txt").alias("text"))).alias("keyed"))


@query("""
    SELECT doc_id, CASE WHEN length(coalesce(lang, '')) > length(source) THEN lang ELSE source END AS caption, md5(encode(text)) AS image_md5 FROM documents WHERE doc_id % 9 <> 0
""")
def source_image_lines(spark, sf_dir):
    at = folder(spark, "parts")
    caption = F.to_json(F.struct("source", "lang"))
    image = F.when(F.col("doc_id") % 9 == 0, "?not base64?").otherwise(F.regexp_replace(F.base64(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0").cast("binary"), F.encode("text", "UTF-8"))), "\\s", ""))
    docs(spark, sf_dir, F.concat_ws("\t", F.lit("first"), caption, F.lit("x"), F.lit("y"), image, F.lit("z"), F.lit("last"))).write.text(at)
    found = readers.image_lines(spark, at)
    return found.select(F.substring("image", 1, 12).cast("string").cast("long").alias("doc_id"), "caption", F.md5(F.expr("substring(image, 13)")).alias("image_md5"))


@query("SELECT n_regionkey, n_name, 'sub' || n_regionkey AS subset FROM nation WHERE n_regionkey IN (0, 2)")
def source_subsets(spark, sf_dir):
    at = folder(spark, "root")
    for k in range(3):
        read(spark, sf_dir, "nation").filter(F.col("n_regionkey") == k).select("n_regionkey", "n_name").write.parquet(f"{at}/sub{k}")
    return readers.subsets(spark, at, ["sub2", "sub0"])


@query("SELECT 'checkpoint-' || k AS checkpoint, k::INT AS step FROM (SELECT unnest([5, 10, 200]) AS k)")
def source_checkpoints(spark, sf_dir):
    at = folder(spark, "run")
    for k in (10, 200, 5):
        spark.range(1).write.parquet(f"{at}/checkpoint-{k}")
    spark.range(1).write.parquet(f"{at}/other")
    return readers.checkpoints(spark, at).select(F.element_at(F.split("checkpoint", "/"), -1).alias("checkpoint"), "step")


@query("""
    SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_name END AS source, CASE WHEN s_suppkey % 4 < 3 THEN (s_suppkey % 7 + 1)::INT END AS n, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey / 8.0 END AS entropy
    FROM supplier WHERE s_suppkey % 4 = 3 OR s_suppkey % 7 + 1 <= 5
""")
def source_entropy_log(spark, sf_dir):
    k = F.col("s_suppkey")
    line = F.concat(F.lit("  "), "s_name", F.lit(": n="), (k % 7 + 1).cast("string"), F.lit(" entropy="), (k / 8).cast("string"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 4 == 3, "no such line").otherwise(line).alias("line"))
    return rows.select("s_suppkey", readers.entropy_log(F.col("line")).alias("e")).select("s_suppkey", "e.*").filter("n is null or n <= 5")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def source_warmed(spark, sf_dir):
    kept = readers.warmed(docs(spark, sf_dir, "lang"))
    found = spark.createDataFrame(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), "lang string, n long")  # a row for each language
    kept.unpersist()
    return found


# ---------------------------------------------------------------- streams
@query(f'WITH RECURSIVE {_PACKS} SELECT shard::VARCHAR AS "key", doc_id AS ordinal, pack, "at", sequence, keep FROM p')
def stream_packing(spark, sf_dir):
    at = folder(spark, "lengths")
    _lengths(spark, sf_dir).write.parquet(at)
    stream = jobs.files(spark, at, fields(shard=L, doc_id=L, n=L))
    made = jobs.stream_pack(stream, "shard", "doc_id", "n", 512)
    return jobs.run_once(made, f"packed_{uuid.uuid4().hex}")


@query("SELECT conv_id, turn::BIGINT AS turn, reverse(text) AS answer, (turn % 2)::BIGINT AS beams FROM conversations")
def stream_served_requests(spark, sf_dir):
    at, out = folder(spark, "asked"), folder(spark, "answered")
    read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text").repartition(4).write.parquet(at)
    requests = jobs.files(spark, at, fields(conv_id=L, turn=L, text=S), per_batch=2)
    respond = lambda rows: rows.select("conv_id", "turn", F.reverse("text").alias("answer"), (F.col("turn") % 2).alias("beams"))
    jobs.serve(requests, respond, out, f"{out}-checkpoint", every=None, workers=3).awaitTermination()
    found = spark.read.schema(fields(conv_id=L, turn=L, answer=S, beams=L)).json(out)
    return enrich.correlate(read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), F.concat_ws("-", "conv_id", "turn").alias("id")), found.withColumn("id", F.concat_ws("-", "conv_id", "turn")).select("id", "answer"), "id", "answer", "none").select(
        "conv_id", "turn", "answer", (F.col("turn") % 2).alias("beams"))


@query("SELECT n_name AS value FROM nation")
def stream_text_lines(spark, sf_dir):
    at = folder(spark, "stream")
    writers.append_lines(read(spark, sf_dir, "nation").select("n_name"), at)
    return jobs.run_once(jobs.text_lines(spark, at), f"lines_{uuid.uuid4().hex}")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    at = folder(spark, "events")
    read(spark, sf_dir, "events").select("ts", "event_type").write.parquet(at)
    stream = jobs.files(spark, at, T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("event_type", S)]))
    made = jobs.run_once(jobs.windowed_counts(stream, "ts", ["event_type"]), f"counts_{uuid.uuid4().hex}", "complete")
    return made.select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


# ---------------------------------------------------------------- requests and replies
@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN trim('New ' || p_name) WHEN p_partkey % 3 = 1 THEN p_name WHEN p_partkey % 6 = 2 THEN '' ELSE p_name END AS p_name, p_brand FROM part
""")
def replies_write_back(spark, sf_dir):
    """Replies that failed, lack an id or are malformed leave their cells alone; a reply without content empties its."""
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    k, name = F.col("p_partkey"), text.request_id(F.col("p_partkey"), "p_name")
    said = F.concat(F.lit("```json\n New "), "p_name", F.lit("\n```"))
    content = F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices"))
    empty = F.struct(F.array(F.struct(F.struct(F.lit("").alias("content")).alias("message"))).alias("choices"))
    whole = lambda status, body: F.to_json(F.struct(name.alias("custom_id"), F.struct(F.lit(status).alias("status_code"), body.alias("body")).alias("response")))
    line = F.when(k % 3 == 0, whole(200, content)).when(k % 3 == 1, whole(500, content)).when(k % 6 == 2, whole(200, empty)).otherwise(F.concat(F.lit('{"custom_id": '), k.cast("string")))
    return enrich.write_replies(rows, "p_partkey", ["p_name", "p_brand"], enrich.replies(rows.select(line.alias("line")), "line"))


@query("""
    WITH o AS (SELECT doc_id AS k, CASE WHEN doc_id % 4 = 1 THEN (doc_id - 1)::VARCHAR WHEN length(text) > 0 AND text IS NOT NULL THEN text ELSE 'x' END AS image FROM documents)
    SELECT a.k, md5(coalesce(b.image, a.image)) AS image_md5 FROM o a LEFT JOIN o b ON try_cast(a.image AS BIGINT) = b.k AND length(b.image) > 100 WHERE try_cast(a.image AS BIGINT) IS NULL OR b.k IS NOT NULL
""")
def inline_images_resolved(spark, sf_dir):
    image = F.when(F.col("doc_id") % 4 == 1, (F.col("doc_id") - 1).cast("string")).when(F.length("text") > 0, F.col("text")).otherwise("x")
    found = enrich.resolve_references(docs(spark, sf_dir, F.col("doc_id").alias("k"), image.alias("image")), "k", "image", "image", inline=100)
    return found.select("k", F.md5("image").alias("image_md5"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_name ELSE 'set' END AS kind, 0.5::DOUBLE AS temperature FROM part
""")
def request_parameters(spark, sf_dir):
    asked = F.when(F.col("p_partkey") % 3 == 0, "all").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_partkey") % 3 == 2, reshape.request_parameter("set", asked)).otherwise(reshape.request_parameter(None, asked))
    return read(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), reshape.request_parameter(0.5, F.lit(0.9)).cast("double").alias("temperature"))


@query("SELECT doc_id, 'A-' || upper(lang) AS answer, CASE WHEN lang = 'de' THEN 'error' ELSE lang || source END AS scored FROM documents")
def injected_functions(spark, sf_dir):
    def translate(t):
        return "A-" + t, {"total_tokens": 1}

    def score(lang, source):
        if lang == "de":
            raise RuntimeError("no answer")
        return lang + source

    rows = docs(spark, sf_dir, "doc_id", "lang", "source", F.upper("lang").alias("answer"))
    return enrich.scored(enrich.enrich(rows, "answer", translate), ["lang", "source"], score, "scored").select("doc_id", "answer", "scored")


@query("""
    SELECT p_partkey AS "index", p_name AS question, ['A', 'B', 'C', 'D'][p_partkey % 4 + 1] AS ground_truth, CASE WHEN p_partkey % 5 = 4 THEN 'unknown' ELSE ['A', 'B', 'C', 'D', 'unknown'][p_partkey % 5 + 1] END AS prediction,
           CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 <> 4 AND p_partkey % 5 = p_partkey % 4 END AS correct FROM part
""")
def answer_records(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*map(F.lit, ["(a) x", "b.", "Go C", "d", "?!"])), (F.col("p_partkey") % n + 1).cast("int"))
    truth = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.col("p_name").alias("question"), F.regexp_replace(pick(5), "Go ", "").alias("raw"), truth.alias("truth"), (F.col("p_partkey") % 7 == 0).alias("failed"))
    made = reshape.answer_record(rows, F.col("raw"), text.choice(F.col("raw")), F.col("truth"), F.col("failed"))
    return made.select("index", "question", "ground_truth", "prediction", "correct")


# ---------------------------------------------------------------- records, prompts and layouts
@query("SELECT doc_id, coalesce(text, source) AS text, 'image_text' AS data_type, '[1,' || n_chars || ']' AS vqcode_512, 'no' AS vqcode_multi768, (length(coalesce(text, source)) + 8)::DOUBLE AS length FROM documents")
def training_records(spark, sf_dir):
    rows = docs(spark, sf_dir, "doc_id", "text", "source", "n_chars")
    codes = F.array(F.lit(1), F.col("n_chars").cast("int"))
    out = reshape.training_record(rows.withColumn("text", reshape.record_text(F.col("text"), F.col("source"))).withColumn("doc", F.col("doc_id")), F.concat(F.col("doc_id").cast("string"), F.lit(" "), "text"), codes, F.lit(1), F.lit(2))
    key = F.substring_index("text", " ", 1)
    return out.select(key.cast("long").alias("doc_id"), F.expr("substring(text, length(substring_index(text, ' ', 1)) + 2)").alias("text"), "data_type", "vqcode_512", "vqcode_multi768", (F.col("length") - F.length(key) - 1).alias("length"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Image Size: Width is ' || n_chars || ' Height is 7.' ELSE '' END || source AS prompt, n_chars % 3 = 0 AS whole FROM documents")
def size_prefixes(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "i2t_multi").otherwise("i2t")
    codes = F.array_repeat(F.lit(1), (F.col("n_chars") % 3 + 4).cast("int"))
    return docs(spark, sf_dir, "doc_id", reshape.size_prefixed(F.col("source"), kind, F.col("n_chars").cast("string"), F.lit("7")).alias("prompt"), reshape.code_count_ok(codes, 4).alias("whole"))


@query("SELECT doc_id, source || '|' || lang AS masked, '|' || n_chars || '<end>' AS graded, true AS lines_ok FROM documents")
def instruction_prompts(spark, sf_dir):
    made = docs(spark, sf_dir, "doc_id", reshape.instruction_prompt(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.col("doc_id"), "<end>").alias("p"))
    lines = lambda c: F.length(F.regexp_extract(c, "\n+", 0)).between(1, 3)
    one = lambda c: F.regexp_replace(c, "\n+", "|")
    return made.select("doc_id", one("p.masked").alias("masked"), one("p.graded").alias("graded"), (lines(F.col("p.masked")) & lines(F.col("p.graded"))).alias("lines_ok"))


def _led(version: str):
    t = templates.template(version)
    bare = "trim(replace(text, '<image>', ''), ' ' || chr(10) || chr(9) || chr(13))"
    if "mmtag" in t.version:
        first = f"{_sql(t.roles[0] + '=<Image><image></Image>|' + t.roles[1] + '=Received.|')} || role || '=' || {bare}"
    else:
        first = f"role || '=<image>' || chr(10) || {bare}"
    sql = f"""
        WITH t AS (SELECT conv_id, i, CASE role WHEN 'user' THEN {_sql(t.roles[0])} ELSE {_sql(t.roles[1])} END AS role, CASE WHEN i = 0 THEN ' see <image> ' || text ELSE text END AS text FROM ({_TURNS}))
        SELECT conv_id, md5(string_agg(CASE WHEN i = 0 THEN {first} ELSE role || '=' || text END, '|' ORDER BY i)) AS said FROM t GROUP BY conv_id
    """

    @query(sql, f"image_first_{version}")
    def run(spark, sf_dir):
        said = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), F.when(i == 0, F.concat(F.lit(" see <image> "), m["text"])).otherwise(m["text"]).alias("text")))
        moved = templates.image_first(templates.named_roles(said, t), t)
        return _dialogues(spark, sf_dir).select("conv_id", F.md5(F.array_join(F.transform(moved, lambda m: F.concat_ws("=", m["role"], m["text"])), "|")).alias("said"))


for _version in ("v1", "v1_mmtag"):
    _led(_version)


_SPLIT = f"w AS (SELECT doc_id, list_transform({WORDS}[1:20], lambda x: length(x)::INT) AS w, (doc_id % 5)::INT AS c FROM documents)"


def _ids() -> F.Column:
    return F.transform(F.slice(stats.words_of(F.col("text")), 1, 20), lambda w: F.length(w))


def _joined(column) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(f"""
    WITH {_SPLIT}, s AS (SELECT doc_id, w, [c + 1000, c + 2000] AS v FROM w)
    SELECT doc_id, array_to_string(list_concat(list_append(w, 900), list_append(list_append(v, 901), 902)), ',') AS image_ids, array_to_string(list_concat(list_transform(list_append(w, 900), lambda x: -100), list_append(list_append(v, 901), 902)), ',') AS image_labels,
           array_to_string(list_concat([900], v, [901, 7, 8], w, [902]), ',') AS caption_ids,
           array_to_string(CASE WHEN len(w) = 0 THEN list_transform(list_concat([900], v, [901, 7, 8, 902]), lambda x: -100) ELSE list_concat(list_transform(list_concat([900], v, [901, 7, 8, 0]), lambda x: -100), w[2:], [902]) END, ',') AS caption_labels FROM s
""")
def record_layouts(spark, sf_dir):
    codes = F.array((F.col("doc_id") % 5).cast("int") + 1000, (F.col("doc_id") % 5).cast("int") + 2000)
    rows = docs(spark, sf_dir, "doc_id", _ids().alias("w"), codes.alias("v"))
    image, caption = packing.layout_text_to_image(F.col("w"), F.col("v"), 900, 901, 902), packing.layout_caption(F.array(F.lit(7), F.lit(8)), F.col("w"), F.col("v"), 900, 901, 902)
    return rows.select("doc_id", *[_joined(c[f]).alias(f"{n}_{f}") for n, c in (("image", image), ("caption", caption)) for f in ("ids", "labels")])


@query(f"""
    WITH {_SPLIT} SELECT doc_id, array_to_string(CASE WHEN doc_id % 4 = 3 THEN NULL ELSE list_concat(w[1:3], [1, 2], w[4:], [3]) END, ',') AS ids FROM w
""")
def interleaved_ids(spark, sf_dir):
    words = F.slice(stats.words_of(F.col("text")), 1, 20)
    said = F.concat(F.array_join(F.slice(words, 1, 3), " "), F.lit("<image>"), F.array_join(F.slice(words, 4, 20), " "), F.lit("<image>"))
    images = F.when(F.col("doc_id") % 4 == 3, F.array(F.array(F.lit(1)))).otherwise(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))))
    ids = reshape.interleaved(said, images, lambda c: F.transform(stats.words_of(c), lambda w: F.length(w)))
    return docs(spark, sf_dir, "doc_id", _joined(ids).alias("ids"))


@query(f"""
    WITH {_SPLIT}, z AS (SELECT doc_id, w, len(w) AS n FROM w)
    SELECT doc_id, array_to_string(list_concat(list_transform(range(24 - n), lambda x: -1), w), ',') AS padded, array_to_string(list_concat(list_transform(range(24 - n), lambda x: 0), list_transform(range(n), lambda x: 1)), ',') AS mask FROM z
""")
def left_padding(spark, sf_dir):
    rows = docs(spark, sf_dir, "doc_id", _ids().alias("w"))
    return rows.select("doc_id", _joined(arrays.left_padded(F.col("w"), 24, -1)).alias("padded"), _joined(arrays.attention(F.col("w"), 24)).alias("mask"))


@query(f"""
    WITH {_SPLIT}, m AS (SELECT doc_id, w, list_transform(w, lambda x: x % 2 = 0) AS m FROM w)
    SELECT doc_id, array_to_string(list_filter(w, lambda x: x % 2 = 0), ',') AS chosen, array_to_string(list_transform(w, lambda x: CASE WHEN x % 2 = 0 THEN x * 10 ELSE x END), ',') AS back, array_to_string(list_transform(w, lambda x: CASE WHEN x % 2 = 0 THEN x ELSE -x END), ',') AS either,
           array_to_string(CASE WHEN list_position(w, 3) > 0 THEN w[1:(list_position(w, 3) - 1)::BIGINT] ELSE w END, ',') AS until_three, array_to_string(list_transform(w, lambda x: x + 100), ',') AS shifted, array_to_string(list_transform(w, lambda x: greatest(0, least(8191, x - 5))), ',') AS codes, list_contains(w, 4) AS has_four FROM m
""")
def array_functions(spark, sf_dir):
    w, mask = F.col("w"), F.transform("w", lambda x: x % 2 == 0)
    tens, minus = F.transform(arrays.selected(w, mask), lambda x: x * 10), F.transform(w, lambda x: -x)
    made = docs(spark, sf_dir, "doc_id", _ids().alias("w")).select(
        "doc_id", _joined(arrays.selected(w, mask)).alias("chosen"), _joined(arrays.scattered(w, mask, tens)).alias("back"), _joined(arrays.chosen(mask, w, minus)).alias("either"), _joined(arrays.until(w, 3)).alias("until_three"),
        _joined(arrays.code_ids(w, 100)).alias("shifted"), _joined(arrays.ids_code(w, 5)).alias("codes"), F.array_contains(w, 4).alias("has_four"),
    )
    return made


@query("""
    SELECT vec_id, array_to_string(list_transform(range(8), lambda i: CASE WHEN i < 4 THEN floor(embedding[i + 1]::DOUBLE * 1000)::BIGINT::VARCHAR ELSE 'x' END), ',') AS as_text,
           array_to_string(list_transform(range(8), lambda i: CASE WHEN vec_id % 4 = 3 THEN CASE WHEN i = 5 THEN '0' ELSE 'x' END WHEN i < 4 THEN 'x' ELSE floor(embedding[i + 1]::DOUBLE * 1000)::BIGINT::VARCHAR END), ',') AS as_image,
           array_to_string(list_transform(range(8), lambda i: CASE WHEN i IN (1, 6) THEN floor(embedding[i + 1]::DOUBLE * 1000)::BIGINT::VARCHAR ELSE 'x' END), ',') AS as_listed FROM embeddings
""")
def modal_score_masks(spark, sf_dir):
    scores = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.when(x == float("-inf"), "x").otherwise(F.floor(x * 1000).cast("string"))), ",")
    listed = arrays.chosen(sampling.allow_mask([1, 6], 8), sampling.allowed_scores(scores, [1, 6]), F.transform(scores, lambda x: F.lit(float("-inf"))))
    image = sampling.modal_scores(scores, F.col("vec_id"), 4, "image", separator=5, every=3)
    return read(spark, sf_dir, "embeddings").select("vec_id", said(sampling.modal_scores(scores, F.col("vec_id"), 4, "text")).alias("as_text"), said(image).alias("as_image"), said(listed).alias("as_listed"))


@query("""
    SELECT doc_id, list_contains(['en', 'de'], lang) AS listed, source AS unfenced, contains(text, 'die') OR contains(text, 'the') AS stopped, (n_chars + 6) // 7 AS chunks, 2.0 ** (n_chars % 5) / 2 AS wait FROM documents
""")
def text_functions(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), "source", F.lit("\n```"))
    return docs(spark, sf_dir, "doc_id", F.col("lang").isin("en", "de").alias("listed"), text.unfence(fenced).alias("unfenced"), text.contains_any(F.col("text"), ["die", "the"]).alias("stopped"),
                scoring.ceiling(F.col("n_chars"), 7).alias("chunks"), scoring.backoff(F.col("n_chars") % 5, 0.5).alias("wait"))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey % 40)::INT END AS layer, 'Brand' AS first, p_brand AS second, 'x' || p_partkey AS name, ltrim('--> ' || p_name, '-> ') AS stripped FROM part
""")
def name_functions(spark, sf_dir):
    k = F.col("p_partkey")
    dotted = F.when(k % 5 == 0, "model.norm").otherwise(F.concat(F.lit("model.layers."), (k % 40).cast("string"), F.lit(".mlp")))
    rows = read(spark, sf_dir, "part").withColumn("label", F.concat(F.lit("Brand-x"), F.lit(" "), "p_brand", F.lit(" (")))
    label = F.concat(F.regexp_replace("p_brand", "#", "-#"), F.lit(" (size)"))
    made = scoring.levels(rows.withColumn("label", label), "label")
    return made.select("p_partkey", text.layer_of(dotted).alias("layer"), "first", F.regexp_replace("second", "-#", "#").alias("second"), text.stem(F.concat(F.lit("/a/b/x"), k.cast("string"), F.lit(".c.png"))).alias("name"), F.ltrim(F.concat(F.lit("--> "), "p_name"), F.lit("-> ")).alias("stripped"))


@query("SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds, md5(to_base64(encode(event_type))) AS key_md5, encode(event_type) = from_base64(to_base64(encode(event_type))) AS same FROM events")
def hashes_and_times(spark, sf_dir):
    data = F.encode("event_type", "UTF-8")
    return read(spark, sf_dir, "events").select("event_id", text.epoch(F.col("ts")).alias("seconds"), text.md5_base64(data).alias("key_md5"), (text.from_base64(F.base64(data)) == data).alias("same"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id + 5 END::BIGINT AS total, CASE WHEN length(event_type) > 5 THEN event_type ELSE 'second' END AS longest, CASE WHEN event_type = 'error' THEN 'E' ELSE 'none' END AS named, upper(event_type) AS caption, upper(event_type) AS said FROM events
""")
def json_functions(spark, sf_dir):
    codes = F.when(F.col("event_id") % 3 == 0, "no list").otherwise(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(",5]")))
    total = F.aggregate(text.int_array(codes), F.lit(0), lambda a, x: a + x).cast("long")
    captions = F.to_json(F.struct(F.when(F.length("event_type") > 5, F.col("event_type")).otherwise("first").alias("a"), F.when(F.length("event_type") > 5, "first").otherwise("second").alias("b")))
    named = F.coalesce(F.try_element_at(F.create_map(F.lit("error"), F.lit("E")), F.col("event_type")), F.lit("none"))
    rows = read(spark, sf_dir, "events").withColumns({"caption": F.col("event_type"), "conversations": F.array(F.struct(F.lit("human").alias("from"), F.col("event_type").alias("value")))})
    made = reshape.translated_fields(rows, F.upper)
    return made.select("event_id", total.alias("total"), text.longest_value(captions).alias("longest"), named.alias("named"), "caption", F.col("conversations")[0]["value"].alias("said"))


@query(f"SELECT doc_id, array_to_string(list_transform({WORDS}[1:5], lambda w: length(w)), ',') AS ids FROM documents")
def truncated_tokens(spark, sf_dir):
    rows = packing.tokenised(docs(spark, sf_dir, "doc_id", "text"), "text", lambda texts: [[len(w) for w in t.split()] for t in texts], most=5)
    return rows.select("doc_id", _joined(F.col("ids")).alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<image>' || chr(10) || 'see  ' || source ELSE source END AS said FROM documents")
def image_marks(spark, sf_dir):
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("see <image> "), "source")).otherwise(F.col("source"))
    return docs(spark, sf_dir, "doc_id", reshape.without_image_mark(marked).alias("said"))


# ---------------------------------------------------------------- geometry, samples, scores and sets
@query("""
    WITH p AS (SELECT p_partkey, p_size * 60 + 20 AS w, (p_partkey % 97) * 20 + 300 AS h FROM part), r AS (SELECT *, greatest(w, h)::DOUBLE / least(w, h) AS ratio FROM p),
         s AS (SELECT *, floor(least(1344 / ratio, 672, least(w, h)))::INT AS short FROM r)
    SELECT p_partkey, CASE WHEN greatest(w, h) <= 1344 THEN w WHEN h > w THEN short ELSE floor(short * ratio) END::INT AS width, CASE WHEN greatest(w, h) <= 1344 THEN h WHEN h > w THEN floor(short * ratio) ELSE short END::INT AS height, 336 AS fixed FROM s
""")
def display_sizes(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60 + 20).alias("w"), ((F.col("p_partkey") % 97) * 20 + 300).alias("h"))
    size, fixed = geometry.display_size(F.col("w"), F.col("h")), geometry.display_size(F.col("w"), F.col("h"), fixed=336)
    return rows.select("p_partkey", size["width"].alias("width"), size["height"].alias("height"), fixed["width"].alias("fixed"))


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 50 <> 0 THEN value / 100 END AS x FROM events), m AS (SELECT *, exp(x - max(x) OVER (PARTITION BY kind)) AS e FROM e)
    SELECT event_id, kind, round(e / sum(e) OVER (PARTITION BY kind), 9) AS p FROM m
""")
def softmax_null_groups(spark, sf_dir):
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    rows = read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.when(F.col("event_id") % 50 != 0, F.col("value") / 100).alias("x"))
    return sampling.softmax(rows, ["kind"], "x").select("event_id", "kind", F.round("p", 9).alias("p"))


@query("""
    WITH RECURSIVE n AS (SELECT event_type AS shard, event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE user_id END AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events),
         p AS (SELECT shard, event_id, r, n, 0::BIGINT AS pack, 0::BIGINT AS "at", 1::BIGINT AS sequence, least(n, 300)::BIGINT AS keep FROM n WHERE r = 1
               UNION ALL SELECT n.shard, n.event_id, n.r, n.n, CASE WHEN p."at" + p.n >= 300 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p."at" + p.n >= 300 THEN 0 ELSE p."at" + p.n END,
                                CASE WHEN p."at" + p.n >= 300 THEN 1 ELSE p.sequence + 1 END, least(n.n, 300 - CASE WHEN p."at" + p.n >= 300 THEN 0 ELSE p."at" + p.n END)::BIGINT FROM p JOIN n ON n.shard = p.shard AND n.r = p.r + 1)
    SELECT shard, event_id, pack, "at", sequence, keep FROM p
""")
def pack_null_lengths(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("shard"), "event_id", F.when(F.col("event_id") % 6 != 0, F.col("user_id")).alias("n"))
    return packing.plan(rows, "shard", "event_id", "n", 300)


@query("""
    WITH r AS (SELECT o_orderkey AS k, o_custkey AS _range, o_custkey + 1 AS _before, o_custkey + 2 AS _n, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n, sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS s, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS part FROM orders)
    SELECT k, _range, _before, _n, r AS ordinal, s::BIGINT AS so_far, part FROM r WHERE r < floor(n * 0.6)
""")
def users_column_names(spark, sf_dir):
    """Ordinals, running sums, splits and head fractions beside columns that are named like those used inside."""
    c = F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", c.alias("_range"), (c + 1).alias("_before"), (c + 2).alias("_n"))
    summed = stats.running_totals(rows, ["o_orderstatus"], ["k"], ["_range"])
    placed = sampling.contiguous(sampling.ordinal(summed, ["k"]), ["k"], 7, "part")
    return sampling.head_fraction(placed, ["k"], 0.6).select("k", "_range", "_before", "_n", "ordinal", F.col("_range_so_far").alias("so_far"), "part")


@query("SELECT count(*) AS n, true AS shares_ok, true AS values_ok, true AS order_ok FROM documents")
def chance_by_keys(spark, sf_dir):
    near = lambda c, share: F.abs(F.avg(c.cast("double")) - share) < 0.06
    made = docs(spark, sf_dir, "doc_id", sampling.layout("doc_id", 0.3).alias("a"), sampling.with_unconditional(F.lit("p"), "doc_id").alias("b"), sampling.halves("doc_id").alias("c"), sampling.prompt_from(["x", "y", "z"], "doc_id").alias("d"))
    shuffled, same = sampling.hash_shuffled(docs(spark, sf_dir, "doc_id"), "doc_id", 5), sampling.hash_shuffled(docs(spark, sf_dir, "doc_id"), "doc_id", 5)
    head = lambda df: df.limit(20).agg(F.collect_list("doc_id").alias("ids"))
    order = head(shuffled).join(head(same).withColumnRenamed("ids", "again")).select((F.col("ids") == F.col("again")).alias("order_ok"))  # one row each
    facts = made.agg(
        F.count(F.lit(1)).alias("n"), (near(F.col("a") == "t2i", 0.3) & near(F.col("b") == "<unconditional>", 0.1) & near(F.col("c") == 1, 0.5) & near(F.col("d") == "x", 1 / 3)).alias("shares_ok"),
        (F.every(F.col("a").isin("t2i", "i2t")) & F.every(F.col("b").isin("p", "<unconditional>")) & F.every(F.col("d").isin("x", "y", "z"))).alias("values_ok"),
    )
    return facts.join(F.broadcast(order))


@query("SELECT 1::BIGINT AS ok FROM (SELECT DISTINCT event_type FROM events)")
def sampled_rows(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.join(counts.groupBy("event_type").agg(F.sum("n").alias("t")), "event_type").withColumn("p", F.col("n") / F.col("t"))
    return sampling.sampled_choice(rows, ["event_type"], "p", ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("ok")).select("ok")


@query("""
    WITH r AS (SELECT lang, quality = 1 AS ok FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, round(avg(coalesce(ok, false)::INT), 6) AS accuracy, count(*) AS n FROM r GROUP BY lang
""")
def accuracy_with_missing(spark, sf_dir):
    results = docs(spark, sf_dir, F.col("doc_id").cast("string").alias("doc_id"), "lang")
    labels = read(spark, sf_dir, "labels").withColumn("ok", F.col("quality") == 1)
    made = scoring.accuracy(scoring.with_category(results, labels, "doc_id", "ok"), "ok", ["lang"])
    return made.select("lang", F.round("accuracy", 6).alias("accuracy"), "n")


@query("SELECT p_type AS category, count(*) AS n, count(DISTINCT p_size) AS items FROM part GROUP BY p_type")
def category_counts(spark, sf_dir):
    return scoring.category_counts(read(spark, sf_dir, "part").withColumn("category", F.col("p_type")), "p_size", "category")


@query("SELECT 8::BIGINT AS ranks, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem")
def gathered_mean(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.pmod("l_orderkey", F.lit(8)).alias("rank"), F.col("l_quantity").cast("double").alias("v"))
    return scoring.gathered_mean(rows, "rank", "v").select("ranks", "n", F.round("mean", 6).alias("mean"))


@query("""
    WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), m AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM l GROUP BY ALL)
    SELECT l_orderkey, string_agg(l_linenumber || '=' || p, ',' ORDER BY l_linenumber) AS parts FROM m GROUP BY l_orderkey
""")
def item_maps(spark, sf_dir):
    made = reshape.item_maps(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_partkey"])
    return made.select("l_orderkey", F.array_join(F.transform(F.map_entries("l_partkey"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("parts"))


@query("SELECT p_type, string_agg(DISTINCT v, ',' ORDER BY v) AS seen FROM (SELECT p_type, p_brand AS v FROM part UNION ALL SELECT p_type, p_name FROM part) GROUP BY p_type")
def set_unions(spark, sf_dir):
    made = reshape.union_of_sets(read(spark, sf_dir, "part").select("p_type", F.array("p_brand", "p_name").alias("s")), ["p_type"], "s", "seen")
    return made.select("p_type", F.array_join("seen", ",").alias("seen"))


@query("SELECT event_id, event_type, lead(user_id, 2) OVER (PARTITION BY event_type ORDER BY event_id) AS ahead FROM events")
def lead_in_groups(spark, sf_dir):
    return vectors.lead_over(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), ["event_type"], ["event_id"], "user_id", "ahead", 2).select("event_id", "event_type", "ahead")


@query(f"""
    WITH RECURSIVE {_PACKS}, k AS (SELECT shard, pack, sum(keep) AS tokens, max(CASE WHEN keep > 0 THEN sequence END) AS last FROM p WHERE keep > 0 GROUP BY shard, pack)
    SELECT shard, pack, tokens::INT AS tokens, CASE WHEN pack % 2 = 0 THEN last ELSE last + 1 END::BIGINT AS last_sequence, pack % 2 = 1 AS placed FROM k WHERE tokens >= 2
""")
def image_placeholders(spark, sf_dir):
    planned = packing.plan(_lengths(spark, sf_dir), "shard", "doc_id", "n", 512)
    words = docs(spark, sf_dir, "doc_id", F.transform(stats.words_of(F.col("text")), lambda w: F.length(w)).alias("ids"))
    made = packing.packed(planned.join(words, "doc_id").withColumn("labels", F.col("ids")), "shard").filter(F.size("ids") >= 2)
    out = packing.image_placeholder(made, ["shard", "pack"], F.col("pack") % 2 == 0, -5, 1_000_000)
    code = F.element_at("ids", -1)
    placed = (F.element_at("ids", -2) == -5) & code.between(1_000_000, 1_000_000 + CODES - 1)
    return out.select("shard", "pack", F.size("ids").alias("tokens"), F.array_max("sequence_ids").cast("long").alias("last_sequence"), placed.alias("placed"))


@query("SELECT 'e' || k AS name, kind, 'run' || k || '_20250101_120' || k AS run, CASE WHEN k % 2 = 0 THEN 'checkpoint-5' END AS checkpoint FROM (SELECT unnest(range(4)) AS k), (SELECT unnest(['text', 'image']) AS kind) WHERE NOT (k = 1 AND kind = 'text')")
def planned_experiments(spark, sf_dir):
    declared = [{"name": f"e{k}", "path": f"/m/run{k}/20250101_120{k}" + ("/checkpoint-5" if k % 2 == 0 else ""), "kinds": ["text", "image"]} for k in range(4)]
    planned = experiments.experiments(spark, declared, {"repeats": 1}, ["text", "image"])
    return experiments.pending(planned, spark.createDataFrame([("e1", "text")], "name string, kind string")).select("name", "kind", "run", "checkpoint")


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch, event_id FROM events")
def fixed_batches(spark, sf_dir):
    rows = sampling.batches(read(spark, sf_dir, "events").select("event_id"), ["event_id"], 1000)
    return rows.select(F.col("batch").cast("long").alias("batch"), "event_id")


@query("SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS d FROM embeddings")
def squared_distances(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.squared_distance(F.col("embedding"), F.reverse("embedding")), 6).alias("d"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name ELSE '' END AS content FROM part")
def reply_contents(spark, sf_dir):
    message = F.array(F.struct(F.struct(F.col("p_name").alias("content")).alias("message")))
    whole = F.to_json(F.struct(F.struct(F.struct(message.alias("choices")).alias("body")).alias("response")))
    said = F.when(F.col("p_partkey") % 3 == 0, whole).when(F.col("p_partkey") % 3 == 1, '{"response": {}}').otherwise("no object")
    return read(spark, sf_dir, "part").select("p_partkey", text.reply_content(said).alias("content"))


@query("""
    SELECT o_orderkey, -o_totalprice AS negative, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority IS NOT NULL AND o_orderpriority <> '' AND o_totalprice > 0 AND o_custkey = (SELECT max(o_custkey) FROM orders)
    UNION ALL SELECT o_orderkey, -o_totalprice, 'top' FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
""")
def plain_operations(spark, sf_dir):
    """Spark's own drop, negation, filters, sort along several columns and limit."""
    orders = read(spark, sf_dir, "orders").drop("o_orderdate")
    last = orders.agg(F.max("o_custkey").alias("o_custkey"))  # one row
    known = orders.filter(F.col("o_orderstatus").isin("F", "O") & F.col("o_orderpriority").isNotNull() & (F.col("o_orderpriority") != "") & (F.col("o_totalprice") > 0)).join(F.broadcast(last), "o_custkey", "left_semi")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40).withColumn("o_orderstatus", F.lit("top"))
    return known.unionByName(top).select("o_orderkey", (-F.col("o_totalprice")).alias("negative"), "o_orderstatus")
