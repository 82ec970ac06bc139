"""Words: longest runs of letters and digits after NFC and lower-casing."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"[^\W_]+")


def normal(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()


def words(text: str) -> list[str]:
    return WORD.findall(normal(text))
