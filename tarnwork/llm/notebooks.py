"""The words of a notebook's text, without the marks and escapes of its layout."""

from __future__ import annotations

import json
import re

INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
WORD = re.compile(r"[^\W_]+")
#: what a layout writes at the start of a line: cell heads, prompts, fences
MARKS = re.compile(r"^(?:# %%.*|# output: ?\w*|```\w*|[ \t]*\.\.\.: ?|(?:In|Out) ?\[[ \d]*\]: ?)", re.MULTILINE)
ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrtbf\"\\/])")


def _unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)


def _joined(part: object) -> str:
    return "".join(map(str, part)) if isinstance(part, list) else "" if part is None else str(part)


def plain_text(text: str) -> str:
    """Cells in order, a code cell's source before its outputs; broken JSON is unescaped as it stands."""
    if text.lstrip()[:1] == "{" and '"cells"' in text:
        try:
            out = []
            for cell in json.loads(text)["cells"]:
                out.append(_joined(cell.get("source")))
                for o in cell.get("outputs") or []:
                    out.append(_joined(o.get("text")))
                    out += [_joined(v) for k, v in (o.get("data") or {}).items() if k.startswith("text/")]
                    out += [_joined(o.get("ename")), _joined(o.get("evalue")), _joined(o.get("traceback"))]
            text = "\n".join(out)
        except (ValueError, TypeError, KeyError, AttributeError):
            pass
    text = MARKS.sub(" ", text)
    return _unescape(text) if "\\" in text else text


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, in small letters; invisible characters are taken out first."""
    if not text:
        return []
    text = plain_text(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return WORD.findall(text.lower())
