"""Token ids by the tokenizers library, each distinct piece of text encoded once.

A byte-pair tokenizer splits text into pre-tokens and merges inside them only,
so a text's ids are those of its pre-tokens laid end to end, and pre-tokens
repeat. Texts in Latin letters are split by the tokenizer's own pattern and a
new pre-token goes straight to the library's model. Any other text is split at
white space, which no merge crosses, and new parts go through the whole library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence

from .common import process_state

# fixed values: the white space of \s in Unicode regular expressions, and the
# public pattern of byte-level tokenizers that do not name their own
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEEPS_SPACE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
TO_SPACE = {c: " " for c in range(9, 14)}
# characters of plain texts are ASCII, Latin letters, and marks that are neither letter, number nor space;
# none of them is changed by normal form C, and lower-casing takes each to one other
LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NOT_PLAIN = re.compile("[\x85\xa0\xb2\xb3\xb9\xbc-\xbe\u0130\u0250-\u200f\u2028-\u202f\u205f-\U0010ffff]")
NOT_PLAIN_BYTES = b"\x85\xa0\xb2\xb3\xb9\xbc\xbd\xbe"
SPECIAL = "<|"  # special tokens open so
LIMIT = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def _latin(pattern: str) -> re.Pattern:
    """The pattern for plain texts, where letters are Latin and numbers are digits."""
    inside = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", f"[^\\\\t-\\\\r {LATIN}0-9]", pattern)
    for name, members in ((r"\p{L}", LATIN), (r"\p{N}", "0-9"), (r"\s", r"\t-\r "), (r"\S", r"^\t-\r ")):
        inside = inside.replace(f"[{name}]", f"[{members}]").replace(name, f"[{members}]")
    return re.compile(inside)


def is_plain(text: str) -> bool:
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return not NOT_PLAIN.search(text) and SPECIAL not in text
    return len(data.translate(None, NOT_PLAIN_BYTES)) == len(data) and SPECIAL not in text


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    Supports tokenizers files whose pre-tokenizer is byte level with its own
    pattern (white space stays with the following word) or a split by a pattern
    that removes white space, with or without lower-casing.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        steps = described["pre_tokenizer"].get("pretokenizers", [described["pre_tokenizer"]])
        split = next((s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]), None)
        self.keeps_space = any(s["type"] == "ByteLevel" and s["use_regex"] for s in steps)
        if not split and not self.keeps_space:
            raise ValueError(f"{path}: this pre-tokenizer is not known to part texts at white space")
        self.plain = _latin(BYTE_LEVEL if self.keeps_space else split["pattern"]["Regex"])
        self.lowers = any(n["type"] == "Lowercase" for n in (described["normalizer"] or {}).get("normalizers", []))
        self.ids = _Known(self)

    def units(self, text: str) -> list[str]:
        """Parts of a text whose ids, one after the other, are the text's ids."""
        if is_plain(text):
            return self.plain.findall(text.lower() if self.lowers else text)
        return KEEPS_SPACE.findall(text) if self.keeps_space else text.translate(TO_SPACE).split(" ")

    def encode_unit(self, unit: str) -> bytes:
        """Ids of a part; a lone pre-token needs nothing but the library's model."""
        if self.plain.fullmatch(unit) and is_plain(unit) and (not self.lowers or unit == unit.lower()):
            ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in unit.encode()]))]
        else:
            ids = self.library.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text."""
        known = self.ids.__getitem__
        return [b"".join(map(known, self.units(t))) for t in texts]


class _Known(dict):
    """Ids of the parts in use; emptied when they outgrow ``LIMIT``."""

    def __init__(self, encoder: UnitEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> bytes:
        if len(self) > LIMIT:
            self.clear()
        value = self[unit] = self.encoder.encode_unit(unit)
        return value


def unit_encoder(path: str) -> UnitEncoder:
    """The process's encoder for a tokenizer file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoders = process_state("unit_encoders", dict)
    if path not in encoders:
        encoders[path] = UnitEncoder(path)
    return encoders[path]
