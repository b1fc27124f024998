"""Prompt, chat-message and conversation-style columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import _col

MESSAGE = "struct<role:string,content:string>"
MESSAGES = f"array<{MESSAGE}>"

# Fixed values: (fragment of the lower-cased model name, conversation style), first hit wins.
CONVERSATION_STYLES = (
    ("llama-2", "llava_llama_2"),
    ("mistral", "mistral_instruct"),
    ("v1.6-34b", "chatml_direct"),
    ("v1", "llava_v1"),
    ("mpt", "mpt"),
)
DEFAULT_STYLE = "llava_v0"


def fill_template(template: str, *holes: Column) -> Column:
    """Replace each ``{}`` of ``template`` in turn; ``{{`` and ``}}`` stand for single braces."""
    pieces = re.split(r"\{\}", template.replace("{{", "\x00").replace("}}", "\x01"))
    if len(pieces) != len(holes) + 1:
        raise ValueError(f"template has {len(pieces) - 1} holes, {len(holes)} values given")
    literal = [F.lit(p.replace("\x00", "{").replace("\x01", "}")) for p in pieces]
    parts = [literal[0]]
    for hole, text in zip(holes, literal[1:]):
        parts += [hole, text]
    return F.concat(*parts)


def as_json(columns: list[str], hide: tuple[str, ...] = ()) -> Column:
    """The row as JSON text for a prompt, without the hidden columns."""
    return F.to_json(F.struct(*[c for c in columns if c not in hide]))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def opening_messages(system: str, prompt: Column) -> Column:
    """The two messages every chat starts with."""
    return F.array(message("system", F.lit(system)), message("user", prompt))


def conversation_style(model_name: Column | str, explicit: Column | None = None) -> Column:
    """Style named by the model; an explicit style overrides it."""
    name = F.lower(_col(model_name))
    style = F
    for fragment, label in CONVERSATION_STYLES:
        style = style.when(name.contains(fragment), F.lit(label))
    style = style.otherwise(F.lit(DEFAULT_STYLE))
    return style if explicit is None else F.coalesce(explicit, style)


def style_overridden(model_name: Column | str, explicit: Column) -> Column:
    """True where an explicit style differs from the inferred one (worth a warning)."""
    return F.coalesce(explicit != conversation_style(model_name), F.lit(False))


def vqa_prompt(
    question: Column | str,
    *,
    image_token: str = "<image>",
    placeholder: str = "<image-placeholder>",
    wrap: tuple[str, str] | None = None,
    separator: str = "\n",
) -> Column:
    """Put the image token where the question asks for it, else in front of the question.

    ``wrap`` is the model's pair of start/end marks around the token; models that want token
    and question without a line break pass ``separator=""``.
    """
    q = _col(question)
    token = image_token if wrap is None else wrap[0] + image_token + wrap[1]
    return F.when(
        q.contains(placeholder), F.replace(q, F.lit(placeholder), F.lit(token))
    ).otherwise(F.concat(F.lit(token + separator), q))


def decoding_options(model: str) -> Mapping[str, object]:
    """Generation settings per model family, handed to the caller's predictor."""
    return DECODING[model]


# Generation settings that change results.
DECODING: dict[str, dict[str, object]] = {
    "blip2": {"do_sample": False, "num_beams": 5, "max_length": 256, "repetition_penalty": 1.5},
    "instruct_blip": {"do_sample": False, "num_beams": 5, "max_length": 256, "repetition_penalty": 1.5},
    "cogvlm": {"do_sample": False, "max_length": 2048},
    "git": {"max_length": 50},
    "llava": {"temperature": 0.0, "num_beams": 1, "max_new_tokens": 512},
    "mplug_owl2": {"do_sample": True, "temperature": 0.7, "max_new_tokens": 512},
    "pali_gemma": {"max_length": 496},
    "qwen_vl": {"seed": 1234},
}
