"""Reshaping of records: dialogues, prompts, rotations, wide to long and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.arrays import rotated, unit_hash
from tessera.functions.text import any_of, data_url_payload, pad_id
from tessera.schemas import CODES_PER_IMAGE, MISSING, PAIR_SPLIT, TURN_SPLIT

LETTERS = ("A", "B", "C", "D")


def message(sender: str, value: Column) -> Column:
    return F.struct(F.lit(sender).alias("from"), value.alias("value"))


def pairs_to_conversations(texts: Column) -> Column:
    """[{user, assistant}] to alternating [{from, value}]."""
    return F.flatten(F.transform(texts, lambda t: F.array(message("human", t["user"]), message("assistant", t["assistant"]))))


def flatten_dialogue(texts: Column) -> Column:
    """Turns as one string; missing sides are empty."""
    side = lambda c: F.coalesce(c, F.lit(""))
    return F.array_join(F.transform(texts, lambda t: F.concat(side(t["user"]), F.lit(PAIR_SPLIT), side(t["assistant"]))), TURN_SPLIT)


def split_dialogue(text: Column, prompt: Column | None = None) -> Column:
    """The inverse as [{from, value}]; a turn without exactly two sides makes the whole null. An empty question of a
    dialogue of one turn becomes ``prompt``."""
    turns = F.transform(F.split(text, rf"\Q{TURN_SPLIT}\E"), lambda t: F.split(t, rf"\Q{PAIR_SPLIT}\E"))
    human = lambda t: t[0] if prompt is None else F.when((t[0] == "") & (F.size(turns) == 1), prompt).otherwise(t[0])
    return F.when(F.forall(turns, lambda t: F.size(t) == 2), F.flatten(F.transform(turns, lambda t: F.array(message("human", human(t)), message("assistant", t[1])))))


def training_record(df: DataFrame, text: Column, codes: Column, width: Column, height: Column, data_type: str = "image_text") -> DataFrame:
    """Canonical image-text columns; length counts characters plus four for each code."""
    return df.select(
        text.alias("text"), F.lit(data_type).alias("data_type"), F.to_json(codes).alias("vqcode_512"), F.lit(MISSING).alias("vqcode_multi768"),
        width.cast("string").alias("width"), height.cast("string").alias("height"), (F.length(text) + 4 * F.size(codes)).cast("double").alias("length"),
    )


def record_text(text: Column, caption: Column) -> Column:
    """text, or the caption where text is null; empty text stays."""
    return F.coalesce(text, caption)


def size_prefixed(prompt: Column, data_type: Column, width: Column, height: Column) -> Column:
    prefix = F.concat(F.lit("Image Size: Width is "), width, F.lit(" Height is "), height, F.lit("."))
    return F.when(data_type.contains("multi"), F.concat(prefix, prompt)).otherwise(prompt)


def instruction_prompt(instruction: Column, given: Column, output: Column, key: Column, end: str, seed: int = 0) -> Column:
    """(masked, graded): instruction and input, then output, each after one to three line ends chosen by the key's hash."""
    lines = lambda k: F.repeat(F.lit("\n"), (F.floor(unit_hash(key, seed=seed + k) * 3) + 1).cast("int"))
    return F.struct(F.concat(instruction, lines(0), given).alias("masked"), F.concat(lines(1), output, F.lit(end)).alias("graded"))


def choice_prompt(question: Column, hint: Column, options: list[Column]) -> Column:
    """The question, its hint, the options that aren't null, and the fixed request for a letter."""
    listed = F.filter(F.array(*[F.when(c.isNotNull(), F.concat(F.lit(f"{x}. "), c)) for x, c in zip(LETTERS, options)]), lambda x: x.isNotNull())
    head = F.concat(question, F.coalesce(F.concat(F.lit(" "), hint), F.lit("")))
    return F.concat(head, F.lit("\n"), F.array_join(listed, "\n"), F.lit("\nPlease answer with the letter of the correct option."))


def rotations(df: DataFrame, options: list[str], answer: str) -> DataFrame:
    """Four rows for each: shift, shifted (array of options), truth (the right letter after the shift).

    Rows with fewer than two options or an answer that isn't one of A to D are left out (they fail as a whole).
    """
    given = F.array(*[F.col(c) for c in options])
    at = F.array_position(F.array(*map(F.lit, LETTERS)), F.col(answer)).cast("int") - 1
    rows = df.filter((F.size(F.filter(given, lambda x: x.isNotNull())) >= 2) & (at >= 0))
    shifts = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    truth = F.element_at(F.array(*map(F.lit, LETTERS)), (F.pmod(at - F.col("shift") + 4, F.lit(4)) + 1).cast("int"))
    return shifts.withColumns({"shifted": rotated(given, F.col("shift")), "truth": truth})


def flatten_request(df: DataFrame, messages: str = "messages", suffix: str = "") -> DataFrame:
    """prompt and images of the last message of a chat request: its text parts without image marks, each image adding
    a mark in front; image payloads follow the last comma of their URL."""
    parts = F.element_at(F.col(messages), -1)["content"]
    # The mark of an image in a prompt, and marks that are removed from text.
    mark = "<|vision_start|><img><|vision_end|>\n"
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.replace(F.replace(p["text"], F.lit("<img>"), F.lit("")), F.lit("<image>"), F.lit("")))
    images = F.transform(F.filter(parts, lambda p: p["type"] == "image_url"), lambda p: data_url_payload(p["image_url"]))
    return df.withColumns({"prompt": F.concat(F.repeat(F.lit(mark), F.size(images)), F.array_join(texts, ""), F.lit(suffix)), "images": images})


def request_parameter(override: object, asked: Column) -> Column:
    """The server's own setting before the request's, of any type; "all" means no limit."""
    value = asked if override is None else F.lit(override)
    return F.when(value.cast("string") != "all", value)


def repeated(df: DataFrame, n: int, key: str) -> DataFrame:
    """n rows for each, with key_0, key_1, ... as keys if n is over 1."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("repeat"))
    return rows.withColumn(key, F.concat_ws("_", F.col(key).cast("string"), "repeat")) if n > 1 else rows.withColumn(key, F.col(key).cast("string"))


def wide_to_long(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(custom_id, column, value) of cells that aren't empty; custom_id is the padded id and the column's name."""
    long = df.select(F.col(id_col), *[F.col(c).cast("string") for c in columns]).unpivot(id_col, columns, "column", "value")
    return long.filter("value is not null and value <> ''").select(F.concat_ws("_", pad_id(F.col(id_col)), "column").alias("custom_id"), id_col, "column", "value")


def batch_request(custom_id: Column, prompt: Column, model: str, most_tokens: int = 2048) -> Column:
    """One request of a batch interface as JSON."""
    turn = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    body = F.struct(F.lit(model).alias("model"), turn.alias("messages"), F.lit(most_tokens).alias("max_tokens"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))


def answer_record(df: DataFrame, raw: Column, normalised: Column, truth: Column, error: Column | None = None) -> DataFrame:
    """index, question, ground_truth, prediction, raw_prediction, correct; correct is null where ``error`` holds."""
    right = normalised == truth
    return df.select(
        "index", "question", truth.alias("ground_truth"), normalised.alias("prediction"), raw.alias("raw_prediction"),
        (right if error is None else F.when(~error, right)).alias("correct"),
    )


def interleaved(text: Column, images: Column, tokenise, mark: str = "<image>") -> Column:
    """Token ids of text with each mark replaced by the next image's ids; null if their numbers differ."""
    chunks = F.split(text, rf"\Q{mark}\E")
    empty = F.array().cast("array<int>")
    ids = F.transform(chunks, lambda c, i: F.concat(tokenise(c), F.coalesce(F.try_element_at(images, i + 1), empty)))
    return F.when(F.size(chunks) == F.size(images) + 1, F.flatten(ids))


def without_image_mark(text: Column) -> Column:
    return F.when(any_of(text, ("<image>",)), F.concat(F.lit("<image>\n"), F.btrim(F.replace(text, F.lit("<image>"), F.lit("")), F.lit(" \n\t\r")))).otherwise(text)


def translated_fields(df: DataFrame, fn) -> DataFrame:
    """caption, text and each conversation value passed through a column function, where present."""
    out = df
    for c in ("caption", "text"):
        if c in df.columns:
            out = out.withColumn(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), fn(F.col(c))).otherwise(F.col(c)))
    if "conversations" in df.columns:
        out = out.withColumn("conversations", F.transform("conversations", lambda x: x.withField("value", fn(x["value"]))))
    return out


def code_count_ok(codes: Column, n: int = CODES_PER_IMAGE) -> Column:
    return F.size(codes) == n


def item_maps(df: DataFrame, item: str, key: str, values: list[str]) -> DataFrame:
    """One row for each item, with a map from key to each value column. An item's rows are few; of equal keys the one with
    the greatest value counts."""
    rows = df.groupBy(item, key).agg(*[F.max(v).alias(v) for v in values])
    return rows.groupBy(item).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, v)))).alias(v) for v in values])


def union_of_sets(df: DataFrame, by: list[str], values: str, to: str = "values") -> DataFrame:
    """Sorted distinct elements of the arrays of each group, counted apart before they are gathered."""
    each = df.select(*by, F.explode(values).alias(to)).distinct()
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(to)).alias(to))
