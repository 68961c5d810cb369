"""Conversation templates and rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# System texts, roles and separators of the public chat formats.
CURIOUS_HUMAN = "A chat between a curious human and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the human's questions."
CURIOUS_USER = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."


@dataclass(frozen=True)
class Template:
    style: str  # single, two, mpt, llama_2, gemma, plain
    system: str
    user: str
    assistant: str
    sep: str
    sep2: str = ""


TEMPLATES = {
    "v0": Template("single", CURIOUS_HUMAN, "Human", "Assistant", "###"),
    "vicuna_v1": Template("two", CURIOUS_USER, "USER", "ASSISTANT", " ", "</s>"),
    "llava_v1": Template("two", CURIOUS_HUMAN, "USER", "ASSISTANT", " ", "</s>"),
    "phi_2": Template("two", CURIOUS_USER, "USER", "ASSISTANT", " ", "<|endoftext|>"),
    "mistral_instruct": Template("llama_2", "", "USER", "ASSISTANT", "<s>", "</s>"),
    "llava_llama_2": Template("llama_2", "You are a helpful language and vision assistant. You are able to understand the visual content that the user provides, and assist the user with a variety of tasks using natural language.", "USER", "ASSISTANT", "<s>", "</s>"),
    "gemma": Template("gemma", "", "user", "model", "", "<eos>"),
    "mpt": Template("mpt", "<|im_start|>system\nA conversation between a user and an LLM-based AI assistant. The assistant gives helpful and honest answers.", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>"),
    "chatml_direct": Template("mpt", "<|im_start|>system\nAnswer the questions.", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>"),
    "plain": Template("plain", "", "", "", "\n", ""),
}


def turn_text(t: Template, i: Column, role: Column, text: Column, system: Column) -> Column:
    """What one turn adds; i counts from 0, role is human or gpt, an empty text is an open turn."""
    name = F.when(role == "human", t.user).otherwise(t.assistant)
    odd = i % 2 == 1
    sep = F.when(odd, t.sep2).otherwise(t.sep)
    if t.style in ("single", "two"):
        full, open_ = F.concat(name, F.lit(": "), text, sep if t.style == "two" else F.lit(t.sep)), F.concat(name, F.lit(":"))
    elif t.style == "mpt":
        full, open_ = F.concat(name, text, F.lit(t.sep)), name
    elif t.style == "gemma":
        full, open_ = F.concat(F.lit("<start_of_turn>"), name, F.lit("\n"), text, F.lit("<end_of_turn>\n"), sep), F.concat(F.lit("<start_of_turn>"), name, F.lit("\n"))
    elif t.style == "llama_2":
        first = F.when((i == 0) & (F.length(system) > 0), F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"), text)).otherwise(text)
        full, open_ = F.when(odd, F.concat(F.lit(" "), text, F.lit(" " + t.sep2))).otherwise(F.concat(F.lit(t.sep + "[INST] "), first, F.lit(" [/INST]"))), F.lit("")
    else:
        full, open_ = F.concat(text, sep), F.lit("")
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, full).otherwise(open_)


def render(turns: Column, t: Template, system: Column | None = None) -> Column:
    """F16: the prompt of array<struct<from, value>>; a conversation's own system text replaces the template's."""
    system = F.coalesce(system, F.lit(t.system)) if system is not None else F.lit(t.system)
    body = F.array_join(F.transform(turns, lambda x, i: turn_text(t, i, x["from"], x["value"], system)), "")
    if t.style == "llama_2":  # the original strips the separator's letters from the left
        return F.regexp_replace(body, "^[" + "".join(sorted(set(t.sep))) + "]+", "") if t.sep else body
    return F.concat(system, F.lit("" if t.style == "plain" else t.sep), body)


def alternating(turns: Column) -> Column:
    """Q11: whether roles alternate from human on."""
    return F.forall(F.transform(turns, lambda x, i: x["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda ok: ok)


def from_first_human(turns: Column) -> Column:
    """Q11: without a leading turn that is not human."""
    return F.when(F.get(turns, F.lit(0))["from"] != "human", F.slice(turns, 2, F.size(turns))).otherwise(turns)


def place_image(turns: Column) -> Column:
    """Q10: the first turn with an image mark gets the image tokens in front; without any mark the first turn does."""
    mark = F.array_position(F.transform(turns, lambda x: F.contains(x["value"], F.lit("<image>"))), F.lit(True)) - 1
    at = F.greatest(mark, F.lit(0).cast("long"))
    return F.transform(turns, lambda x, i: F.struct(x["from"].alias("from"), F.when(i == at, F.concat(F.lit("<boi><eoi>\n"), F.trim(F.replace(x["value"], F.lit("<image>"), F.lit(""))))).otherwise(x["value"]).alias("value")))


def sft_route(source: Column, has_codes: Column, t2i_sources: list[str]) -> Column:
    """Q9."""
    return F.when(source.isin(t2i_sources), "t2i").when(has_codes, "qa").otherwise("text")


def choice_prompt(question: Column, hint: Column, options: Column) -> Column:
    """hint, question and lettered options, a line each."""
    lettered = F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat_ws("\n", hint, question, F.array_join(lettered, "\n"))
