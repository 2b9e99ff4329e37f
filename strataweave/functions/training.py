"""Training rows in the usual formats, as structs that ``to_json`` writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(text: Column, longest: int | None = None) -> Column:
    """Without white space at its ends; what is longer is cut and marked. Null is empty."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(x) > longest, F.concat(F.substring(x, 1, longest), F.lit("..."))).otherwise(x) if longest else x


def _turn(name: str, role: Column | str, value: str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias(name), text.alias(value))


def dpo(prompt: Column, chosen: Column, rejected: Column, longest: int | None = None) -> Column:
    return F.struct(cleaned(prompt, longest).alias("prompt"), cleaned(chosen, longest).alias("chosen"), cleaned(rejected, longest).alias("rejected"))


def sft(instruction: Column, given: Column, output: Column, longest: int | None = None) -> Column:
    """Prompt and completion; an input follows its instruction after a blank line."""
    prompt = F.when(F.coalesce(F.length(given), F.lit(0)) > 0, F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction)
    return F.struct(cleaned(prompt, longest).alias("prompt"), cleaned(output, longest).alias("completion"))


def alpaca(instruction: Column, given: Column, output: Column, longest: int | None = None) -> Column:
    return F.struct(cleaned(instruction, longest).alias("instruction"), cleaned(given, longest).alias("input"), cleaned(output, longest).alias("output"))


def _asked(instruction: Column, given: Column) -> Column:
    return F.when(F.coalesce(F.length(given), F.lit(0)) > 0, given).otherwise(instruction)


def sharegpt(instruction: Column, given: Column, output: Column, system: str | None = None, longest: int | None = None) -> Column:
    turns = [_turn("from", "human", "value", cleaned(_asked(instruction, given), longest)), _turn("from", "gpt", "value", cleaned(output, longest))]
    return F.struct(F.array(*([_turn("from", "system", "value", F.lit(system))] if system else []), *turns).alias("conversations"))


def chat(instruction: Column, given: Column, output: Column, system: str | None = None, longest: int | None = None) -> Column:
    turns = [_turn("role", "user", "content", cleaned(_asked(instruction, given), longest)), _turn("role", "assistant", "content", cleaned(output, longest))]
    return F.struct(F.array(*([_turn("role", "system", "content", F.lit(system))] if system else []), *turns).alias("messages"))


def dpo_chat(prompt: Column, chosen: Column, rejected: Column, system: str | None = None, longest: int | None = None) -> Column:
    said = lambda role, x: F.array(_turn("role", role, "content", cleaned(x, longest)))
    head = F.array(_turn("role", "system", "content", F.lit(system)), _turn("role", "user", "content", cleaned(prompt, longest))) if system else said("user", prompt)
    return F.struct(head.alias("prompt"), said("assistant", chosen).alias("chosen"), said("assistant", rejected).alias("rejected"))
