"""String, JSON, hash and date columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that separates words in answers, besides ASCII's.
CJK_PUNCTUATION = "，。？！“”‘’｜、·～"
# Words and bracketed forms that mean yes or no.
YES_WORDS, NO_WORDS = ("yes", "是"), ("no", "否", "不")
YES_FORMS, NO_FORMS = ("(yes)", "[yes]", "<yes>", "yes)"), ("(no)", "[no]", "<no>", "no)")
BLANKS = " \n\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """Lower-case words between single spaces, punctuation counting as space; empty words stay."""
    marks = string.punctuation + CJK_PUNCTUATION
    return F.split(F.translate(F.lower(strip(text)), marks, " " * len(marks)), " ")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def yes_no(text: Column) -> Column:
    """yes or no: bracketed forms first (yes before no, case counts), then whole words; no if in doubt."""
    yes, no = (F.arrays_overlap(words(text), F.array(*map(F.lit, x))) for x in (YES_WORDS, NO_WORDS))
    return F.when(any_of(text, YES_FORMS), "yes").when(any_of(text, NO_FORMS), "no").when(yes & ~no, "yes").otherwise("no")


def choice(text: Column) -> Column:
    """The first letter A to D in either case, upper-cased, or unknown."""
    found = F.upper(F.regexp_extract(text, "[A-Da-d]", 0))
    return F.when(found == "", "unknown").otherwise(F.coalesce(found, F.lit("unknown")))


def served_answer(text: Column) -> Column:
    """The first capital A to D, else yes or no by sign, else the text; blank: empty."""
    letter = F.regexp_extract(text, "[A-D]", 0)
    return F.when(strip(text) == "", "").when(letter != "", letter).when(text.contains("是"), "yes").when(any_of(text, ("否", "不")), "no").otherwise(text)


def unfence(text: Column) -> Column:
    """Text without Markdown code fences at line starts and ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?m)^```(json)?\s*", ""), r"(?m)\s*```$", ""))


def pad_id(value: Column, width: int = 6) -> Column:
    text = value.cast("string")
    return F.call_function("lpad", text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def middle_cut(text: Column, most: int = 500) -> Column:
    half = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("..."), F.right(text, F.lit(half))))


def category_levels(label: Column) -> tuple[Column, Column]:
    """(level 1, level 2): what stands before "(", and of that what stands before "-"."""
    second = F.trim(F.substring_index(label, "(", 1))
    return F.trim(F.substring_index(second, "-", 1)), second


def run_and_checkpoint(path: Column) -> tuple[Column, Column]:
    """Of .../NAME/YYYYMMDD_HHMM[/CHECKPOINT]: NAME_time and the checkpoint; other paths: their last part and null."""
    pattern = r"([^/]+)/(\d{8}_\d{4})/?([^/]+)?$"
    name, time, check = (F.regexp_extract(path, pattern, i) for i in (1, 2, 3))
    last = F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)
    return F.when(name != "", F.concat_ws("_", name, time)).otherwise(last), F.nullif(check, F.lit(""))


def language_of_path(path: Column) -> Column:
    return F.when(path.contains("zh"), "zh").otherwise("en")


def data_url_payload(url: Column) -> Column:
    return F.substring_index(url, ",", -1)


def from_base64(text: Column) -> Column:
    """Bytes, or null if the text isn't base64."""
    return F.try_to_binary(text, F.lit("base64"))


def int_array(json: Column) -> Column:
    """An int array written as JSON; null for anything else."""
    return F.from_json(json, "array<int>")


def longest_value(json: Column) -> Column:
    """The longest value of a JSON object of strings; the first of equals; empty if there is none."""
    values = F.map_values(F.from_json(json, "map<string,string>"))
    return F.coalesce(F.aggregate(values, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(""))


def reply_content(json: Column) -> Column:
    """response.body.choices[0].message.content, empty where the path ends early."""
    shape = "struct<response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>>"
    body = F.from_json(json, shape)
    return F.coalesce(F.try_element_at(body["response"]["body"]["choices"], F.lit(1))["message"]["content"], F.lit(""))


def reply(json: Column) -> Column:
    """(custom_id, value) of a batch reply: its content without code fences. Null unless there is an id, status 200 and a
    well-formed reply; a message that is missing is empty."""
    shape = "struct<custom_id:string,response:struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>>"
    whole = F.from_json(json, shape)
    choices = whole["response"]["body"]["choices"]
    content = F.coalesce(F.try_element_at(choices, F.lit(1))["message"]["content"], F.lit(""))
    good = (F.coalesce(whole["custom_id"], F.lit("")) != "") & (whole["response"]["status_code"] == 200) & (choices.isNull() | (F.size(choices) > 0))
    return F.when(good, F.struct(whole["custom_id"].alias("custom_id"), unfence(content).alias("value")))


def request_id(key: Column, column: Column | str) -> Column:
    """key-column, filled up with zeros to six characters."""
    return pad_id(F.concat_ws("-", key.cast("string"), F.lit(column) if isinstance(column, str) else column))


def md5_base64(data: Column) -> Column:
    return F.md5(F.base64(data))


def epoch(time: Column) -> Column:
    return F.unix_timestamp(time)


def origin(file_name: Column) -> Column:
    """The letters that a file name begins with."""
    return F.regexp_extract(file_name, "^([A-Za-z]+)", 1)


def base_key(key: Column) -> Column:
    """A key without its last _suffix."""
    return F.regexp_replace(key, "_[^_]*$", "")


def stem(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def stamp(time: Column, style: str = "minute") -> Column:
    return F.date_format(time, {"minute": "yyyyMMdd_HHmm", "second": "yyyyMMdd_HHmmss", "log": "yyMMdd-HHmmss"}[style])


def contains_any(text: Column, keywords: list[str]) -> Column:
    return any_of(text, tuple(keywords))


def layer_of(name: Column) -> Column:
    """The number that is the third part of a dotted parameter name; null if it isn't one."""
    return F.try_element_at(F.split(name, r"\."), F.lit(3)).try_cast("int")
