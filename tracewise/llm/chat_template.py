"""One conversation as one text: turn marks, reversible escapes, loss mask, and back."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Control strings: fixed values of the template and of common chat formats.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
ROLE_OPEN, ROLE_END, ROLE_CLOSE = "<|role|>", "<|text|>", "<|end|>"
CONTROL = [*OPEN.values(), *CLOSE.values(), ROLE_OPEN, ROLE_END, ROLE_CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>"]

# A backslash is doubled; inside a control string one follows the first character, which breaks it up.
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_OPENING = re.compile("|".join(re.escape(c) for c in [*OPEN.values(), ROLE_OPEN]))
_ROLE_OF = {mark: role for role, mark in OPEN.items()}


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and its loss mask: (start, end) code points of each assistant turn's escaped text."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role in OPEN:
            before, after = OPEN[role], CLOSE[role]
        else:
            before, after = f"{ROLE_OPEN}{escape(role)}{ROLE_END}", ROLE_CLOSE
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError on a text that is none."""
    out, at = [], 0
    while at < len(formatted):
        mark = _OPENING.match(formatted, at)
        if not mark:
            raise ValueError(f"no turn starts at {at}")
        at = mark.end()
        role = _ROLE_OF.get(mark.group())
        close = ROLE_CLOSE if role is None else CLOSE[role]
        if role is None:
            end = formatted.index(ROLE_END, at)
            role, at = unescape(formatted[at:end]), end + len(ROLE_END)
        end = formatted.index(close, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(close)
    return out


def masked_text(formatted: str, spans: Iterable[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)
