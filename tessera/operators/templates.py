"""Prompt templates in six styles, rendered from arrays of messages."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    style: str
    system: str = ""
    roles: tuple[str, str] = ("USER", "ASSISTANT")
    sep: str = "###"
    sep2: str | None = None
    version: str = "Unknown"


# The system prompts, role names and separators of the templates.
_CHAT = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
_SEES = (
    "A chat between a curious user and an artificial intelligence assistant. The assistant is able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
    "The visual content will be provided with the following format: <Image>visual content</Image>."
)
_VISION = "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language."
_LLAMA = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe.  Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. If you don't know the answer to a question, please don't share false information."
)
_MPT = "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers."
_PEOPLE, _IM = ("Human", "Assistant"), ("<|im_start|>user\n", "<|im_start|>assistant\n")

_single = Template("single", _HUMAN, _PEOPLE)
_two = Template("two", _CHAT, sep=" ", sep2="</s>", version="v1")
_plain = Template("plain", roles=("", ""), sep="\n")
_llama = Template("llama_2", _LLAMA, sep="<s>", sep2="</s>", version="llama_v2")
_direct = Template("mpt", "<|im_start|>system\nAnswer the questions.", _IM, "<|im_end|>", version="mpt")

#: "default" and "v0" are without the example turns that some users of these templates put first; pass them as messages.
TEMPLATES = {
    "default": _single, "v0": _single, "llava_v0": _single, "v0_mmtag": replace(_single, system=_SEES, version="v0_mmtag"),
    "v1": _two, "vicuna_v1": _two, "imgsp_v1": replace(_two, version="imgsp_v1"), "phi_2": replace(_two, sep2="<|endoftext|>", version="phi2"),
    "llava_v1": replace(_two, system=_HUMAN), "v1_mmtag": replace(_two, system=_SEES, version="v1_mmtag"),
    "llama_2": _llama, "llava_llama_2": replace(_llama, system=_VISION), "mistral_instruct": replace(_llama, system=""),
    "mpt": Template("mpt", _MPT, _IM, "<|im_end|>", version="mpt"), "chatml_direct": _direct, "mistral_direct": _direct,
    "gemma": Template("gemma", roles=("user", "model"), sep="", sep2="<eos>", version="gemma"),
    "plain": _plain, "v0_plain": _plain, "plain_guided": replace(_plain, version="plain_guided"),
}


def template(name: str) -> Template:
    """The template of a name; unknown names give vicuna_v1, or gemma if the name mentions it."""
    return TEMPLATES.get(name) or TEMPLATES["gemma" if "gemma" in name else "vicuna_v1"]


def messages_of(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each dialogue: messages (role, text) in order of turn. A dialogue is bounded by its turns."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    return df.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def named_roles(messages: Column, t: Template) -> Column:
    """Messages with user and assistant replaced by the template's names."""
    name = lambda m: F.when(m["role"] == "user", t.roles[0]).when(m["role"] == "assistant", t.roles[1]).otherwise(m["role"])
    return F.transform(messages, lambda m: F.struct(name(m).alias("role"), m["text"].alias("text")))


def image_first(messages: Column, t: Template) -> Column:
    """Messages whose first has an image: its mark moves to the front, or into a pair of messages of its own."""
    bare = lambda m: F.btrim(F.replace(m["text"], F.lit("<image>"), F.lit("")), F.lit(" \n\t\r"))
    said = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    first, rest = messages[0], F.slice(messages, F.lit(2), F.size(messages))
    if "mmtag" in t.version:
        opening = F.array(said(F.lit(t.roles[0]), F.lit("<Image><image></Image>")), said(F.lit(t.roles[1]), F.lit("Received.")), said(first["role"], bare(first)))
    else:
        opening = F.array(said(first["role"], F.concat(F.lit("<image>\n"), bare(first))))
    return F.concat(opening, rest)


def prompt(messages: Column, t: Template) -> Column:
    """The dialogue as text. A message without text opens its role's turn. In the llama_2 style the first message
    must have text and come from the first role, else the result is null."""
    second = t.sep if t.sep2 is None else t.sep2
    turn_end = lambda i: F.when(i % 2 == 0, t.sep).otherwise(second)
    said = lambda m: F.coalesce(m["text"], F.lit("")) != ""
    lit = F.lit

    def llama(m: Column, i: Column) -> Column:
        system = f"<<SYS>>\n{t.system}\n<</SYS>>\n\n" if t.system else ""
        asked = F.concat(lit(t.sep + "[INST] "), F.when(i == 0, system).otherwise(""), m["text"], lit(" [/INST]"))
        return F.when(~said(m), "").when(i % 2 == 0, asked).otherwise(F.concat(lit(" "), m["text"], lit(" " + second)))

    each = {
        "single": lambda m, i: F.when(said(m), F.concat(m["role"], lit(": "), m["text"], lit(t.sep))).otherwise(F.concat(m["role"], lit(":"))),
        "two": lambda m, i: F.when(said(m), F.concat(m["role"], lit(": "), m["text"], turn_end(i))).otherwise(F.concat(m["role"], lit(":"))),
        "mpt": lambda m, i: F.when(said(m), F.concat(m["role"], m["text"], lit(t.sep))).otherwise(m["role"]),
        "gemma": lambda m, i: F.concat(lit("<start_of_turn>"), m["role"], lit("\n"), F.when(said(m), F.concat(m["text"], lit("<end_of_turn>\n"), turn_end(i))).otherwise("")),
        "plain": lambda m, i: F.when(said(m), F.concat(m["text"], turn_end(i))).otherwise(""),
        "llama_2": llama,
    }[t.style]
    body = F.array_join(F.transform(messages, each), "")
    if t.style == "llama_2":
        lead = F.ltrim(body, lit(t.sep))  # any of the separator's characters
        return F.when(F.size(messages) == 0, "").when(said(messages[0]) & (messages[0]["role"] == t.roles[0]), lead)
    return F.concat(lit(t.system + ("" if t.style == "plain" else t.sep)), body)


def chat_pairs(messages: Column) -> Column:
    """[{asked, answered}] of neighbouring messages; the last question may lack an answer."""
    ahead = lambda i: F.try_element_at(messages, i + 2)["text"]
    pairs = F.transform(messages, lambda m, i: F.when(i % 2 == 0, F.struct(m["text"].alias("asked"), ahead(i).alias("answered"))))
    return F.filter(pairs, lambda p: p.isNotNull())


def exported(messages: Column, t: Template) -> Column:
    """The dialogue as a JSON object."""
    return F.to_json(F.struct(F.lit(t.system).alias("system"), F.array(*map(F.lit, t.roles)).alias("roles"), messages.alias("messages"), F.lit(t.sep).alias("sep"), F.lit(t.sep2).alias("sep2")))
