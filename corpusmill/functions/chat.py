"""Expressions over ``messages array<struct<role, content>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import strip


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def question_answer(question: Column, answer: Column) -> Column:
    """A two-message conversation; null texts stay null and render as empty."""
    return F.array(message("user", question), message("assistant", answer))


def nth_content(messages: Column, n: int = 0) -> Column:
    """Content of message ``n``; null when the conversation is shorter."""
    return F.get(messages, F.lit(n))["content"]


def first_content(messages: Column, role: str) -> Column:
    """Content of the first message with this role, '' when there is none."""
    return _text(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"])


def sft_piece(role: Column, content: Column, eos: str, skip_other_roles: bool = False) -> Column:
    """One message as training text. Other roles add only the end marker, or nothing on request."""
    speaks = F.lower(_text(role)).isin("user", "assistant")
    spoken = F.concat(_text(content), F.lit("\n\n" + eos))
    return F.when(speaks, spoken).otherwise(F.lit("" if skip_other_roles else eos))


def sft_text(messages: Column, eos: str, skip_other_roles: bool = False) -> Column:
    pieces = F.transform(
        messages, lambda m: sft_piece(m["role"], m["content"], eos, skip_other_roles)
    )
    return strip(F.array_join(pieces, ""))


def instruction(question: Column, answer: Column) -> Column:
    return F.concat(
        F.lit("### Instruction:\n"), question, F.lit("\n\n### Response:\n"), answer
    )


def instruction_text(messages: Column) -> Column:
    """First user message and first assistant message under their headings."""
    return instruction(first_content(messages, "user"), first_content(messages, "assistant"))


def role_piece(role: Column, content: Column, start: str, eos: str) -> Column:
    """``start role newline content eos newline``; roles outside the template add nothing."""
    known = role.isin("user", "system", "assistant")
    body = F.concat(F.lit(start), role, F.lit("\n"), _text(content), F.lit(eos + "\n"))
    return F.when(known, body).otherwise(F.lit(""))


def role_template(
    messages: Column, start: str, eos: str, add_generation_prompt: bool = False
) -> Column:
    pieces = F.transform(messages, lambda m: role_piece(m["role"], m["content"], start, eos))
    body = F.array_join(pieces, "")
    if not add_generation_prompt:
        return body
    return F.when(F.size(messages) > 0, F.concat(body, F.lit("assistant\n"))).otherwise(body)


def with_system(messages: Column) -> Column:
    """Put an empty system message in front unless one is there already."""
    opening = F.get(messages, F.lit(0))["role"]
    return F.when(opening.eqNullSafe(F.lit("system")), messages).otherwise(
        F.concat(F.array(message("system", F.lit(""))), messages)
    )
