"""Prompt templates, language labels, chat messages and file naming.

Everything here is a Column expression: prompts are assembled JVM-side inside
whole-stage codegen, never in Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These strings must equal the pipeline's for identical prompts.
# ---------------------------------------------------------------------------
# Language code -> English label (12 entries).
LANG_LABELS = {
    "eng": "English", "ben": "Bengali", "guj": "Gujarati",
    "hin": "Hindi", "kan": "Kannada", "mal": "Malayalam",
    "mar": "Marathi", "ori": "Odia", "pan": "Punjabi",
    "tam": "Tamil", "tel": "Telugu", "urd": "Urdu",
}
# Second spelling, of the system+user chat dialect (F9); used for parity only.
CHAT_LABELS = {
    "ben": "Bengali", "guj": "Gujarati", "hin": "Hindi", "kan": "Kannada",
    "mal": "Malayalam", "mar": "Marathi", "ori": "Odiya", "pan": "Punjabi",
    "tam": "Tamil", "tel": "Telugu", "urd": "Urdu",
}
# The eleven language pairs of the task, English on the left.
TASK_PAIRS = [
    "eng_ben", "eng_guj", "eng_hin", "eng_kan", "eng_mal",
    "eng_mar", "eng_ori", "eng_pan", "eng_tam", "eng_tel", "eng_urd",
]
# Few-shot prompt: instruction, example blocks and final block joined by BLOCK_SEP.
FEWSHOT_INSTRUCTION = ("Translate the given input document to {tgt_lbl} language. "
                       "Generate only the translation. Do not generate any other tokens.")
EXAMPLE_BLOCK = "{src_lbl}: {src}\n\n{tgt_lbl}: {tgt}"
FINAL_BLOCK = "{src_lbl}: {src}\n\n{tgt_lbl}:"
BLOCK_SEP = "\n\n"
# System instruction of the system+user chat dialect.
CHAT_SYSTEM_TEMPLATE = "Translate the text below to {label}."
# Quick-start system sentence ({src}/{tgt} are codes) and literal chat markup.
QUICKSTART_SYSTEM = ("You are a professional translator. Translate the user message precisely "
                     "from {src} to {tgt}, preserving meaning, tone, and any markup.")
QUICKSTART_TEMPLATE = "<|begin_of_text|><|system|>\n{system}\n<|user|>\n{text}\n<|assistant|>"
# Fine-tuning prompt ({src_lang}/{tgt_lang} are codes).
SFT_TEMPLATE = "Translate from {src_lang} to {tgt_lang}:\n\n{src}\n\nTranslation:"

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """Split a template into (literal, placeholder-or-None) pieces, in order."""
    out: list[tuple[str, str | None]] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        out.append((template[pos:m.start()], m.group(1)))
        pos = m.end()
    out.append((template[pos:], None))
    return out


def fill(template: str, **values: Column) -> Column:
    """A template as a Column: literals and named Column values concatenated."""
    parts: list[Column] = []
    for literal, name in template_pieces(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def between(template: str, before: str, after: str | None) -> str:
    """The literal text between two placeholders of a template (``None``: to the end)."""
    pieces = template_pieces(template)
    names = [n for _, n in pieces]
    i = names.index(before)
    j = len(pieces) - 1 if after is None else names.index(after)
    return "".join(lit for lit, _ in pieces[i + 1:j + 1])


def chat_labels(parity: bool = False) -> dict[str, str]:
    """F9 label table: the one table of P1. ``parity`` takes the second spelling and keeps its gaps (D7): no English
    entry, and ``tel`` unmatched, so both fall back to the code."""
    return {k: v for k, v in CHAT_LABELS.items() if k != "tel"} if parity else LANG_LABELS


def label_map(labels: dict[str, str] | None = None) -> Column:
    labels = labels or LANG_LABELS
    items = []
    for k, v in sorted(labels.items()):
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def label_of(code: Column | str, override: Column | str | None = None,
             labels: dict[str, str] | None = None) -> Column:
    """Explicit label, else the table's label, else the code itself."""
    c = _col(code)
    parts = []
    if override is not None:
        parts.append(_col(override))
    parts += [F.element_at(label_map(labels), c), c]
    return F.coalesce(*parts)


def example_block(src: Column, tgt: Column, src_lbl: Column, tgt_lbl: Column,
                  trailing_newline: bool = False) -> Column:
    """F1 (and F2 with ``trailing_newline``): ``EXAMPLE_BLOCK``."""
    block = fill(EXAMPLE_BLOCK, src_lbl=src_lbl, src=src, tgt_lbl=tgt_lbl, tgt=tgt)
    return F.concat(block, F.lit("\n")) if trailing_newline else block


def final_block(src: Column, src_lbl: Column, tgt_lbl: Column, bare: bool = False) -> Column:
    """F3 ``FINAL_BLOCK``; F4 (``bare``) the document alone."""
    if bare:
        return src
    return fill(FINAL_BLOCK, src_lbl=src_lbl, src=src, tgt_lbl=tgt_lbl)


def instruction(tgt_lbl: Column, parity: bool = False) -> Column:
    """The few-shot instruction. ``parity`` keeps the literal ``{tgt_lbl}``."""
    if parity:
        return F.lit(FEWSHOT_INSTRUCTION)
    return fill(FEWSHOT_INSTRUCTION, tgt_lbl=tgt_lbl)


def fewshot_prompt(blocks: Column, final: Column, instr: Column) -> Column:
    """instruction + example blocks + final block joined by a blank line.

    ``blocks`` is an array<string> (null = no examples).
    """
    parts = F.concat(F.array(instr), F.coalesce(blocks, F.array().cast("array<string>")), F.array(final))
    return F.array_join(parts, BLOCK_SEP)


def sft_prompt(src: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """``SFT_TEMPLATE`` (codes, not labels)."""
    return fill(SFT_TEMPLATE, src_lang=src_lang, tgt_lang=tgt_lang, src=src)


def quickstart_prompt(src: Column, src_lang: Column, tgt_lang: Column) -> Column:
    """literal chat markup around a system sentence and the user text."""
    system = fill(QUICKSTART_SYSTEM, src=src_lang, tgt=tgt_lang)
    return fill(QUICKSTART_TEMPLATE, system=system, text=src)


def user_messages(prompt: Column) -> Column:
    """F8: ``[{"role": "user", "content": prompt}]``."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def system_user_messages(text: Column, tgt_label: Column) -> Column:
    """system ``CHAT_SYSTEM_TEMPLATE`` + user text."""
    system = fill(CHAT_SYSTEM_TEMPLATE, label=tgt_label)
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), text.alias("content")),
    )


# Default chat markup for F10. The real strings belong to the model's tokenizer,
# so they are job configuration; this neutral default is used by the tests.
DEFAULT_CHAT_MARKUP = {
    "open": "<|{role}|>\n",
    "close": "<|end|>\n",
    "generation_cue": "<|assistant|>\n",
}


def render_chat(messages: Column, markup: dict | None = None) -> Column:
    """render a message list to one string and add the generation cue."""
    m = markup or DEFAULT_CHAT_MARKUP
    one = lambda msg: render_message(msg["role"], msg["content"], m)
    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit(m["generation_cue"]))


def render_message(role: Column, content: Column, markup: dict | None = None) -> Column:
    """F10 for one message (no generation cue)."""
    m = markup or DEFAULT_CHAT_MARKUP
    return F.concat(fill(m["open"], role=role), content, F.lit(m["close"]))


def direction_name(src_lang: Column, tgt_lang: Column) -> Column:
    """``{src}_2_{tgt}``."""
    return F.concat(src_lang, F.lit("_2_"), tgt_lang)


def prompt_file_name(src_lang: Column, tgt_lang: Column, k: Column, pred: bool = False) -> Column:
    """F16: ``doc.{src}_2_{tgt}.{k}[.pred].jsonl``."""
    return F.concat(F.lit("doc."), direction_name(src_lang, tgt_lang), F.lit("."), k.cast("string"),
                    F.lit(".pred.jsonl" if pred else ".jsonl"))


FILE_NAME_RE = r"^doc\.([A-Za-z0-9]+?)_2_([A-Za-z0-9]+?)\.(\d+)(\.pred)?\.jsonl$"


def parse_file_name(name: Column) -> Column:
    """F16 back: struct(src_lang, tgt_lang, k, is_pred) from a file name."""
    return F.struct(
        F.regexp_extract(name, FILE_NAME_RE, 1).alias("src_lang"),
        F.regexp_extract(name, FILE_NAME_RE, 2).alias("tgt_lang"),
        F.regexp_extract(name, FILE_NAME_RE, 3).cast("int").alias("k"),
        (F.regexp_extract(name, FILE_NAME_RE, 4) != "").alias("is_pred"),
    )


def model_dir_name(model: Column) -> Column:
    """Model basename with ``/`` and ``:`` replaced by ``_``."""
    return F.translate(F.element_at(F.split(model, "/"), -1), "/:", "__")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
