"""Token ids of whole texts, word by word where the tokenizer allows it."""

from __future__ import annotations

import json
import os
from array import array

#: Steps of a tokenizer file under which ids of words stand side by side in the ids of a text.
_SPLITTING_NORMALIZERS = ("NFC", "Lowercase", "Replace")


def splits_at_spaces(spec: dict) -> bool:
    """True if no token and no normalisation reaches across ASCII white space.

    That holds where white space is folded to a blank, the pre-tokenizer removes whatever its
    pattern does not match, and the pattern matches no blank.
    """
    import regex

    normalizer, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, cuts = normalizer.get("normalizers", [normalizer]), pre.get("pretokenizers", [pre])
    folds = any(s.get("type") == "Replace" and s["pattern"].get("Regex") == "\\s+" and s["content"] == " " for s in steps)
    cut = cuts[0] if cuts else {}
    pattern = (cut.get("pattern") or {}).get("Regex")
    return bool(
        folds
        and all(s.get("type") in _SPLITTING_NORMALIZERS for s in steps)
        and cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert") and pattern
        and not regex.search(pattern, " ")
        and not any(" " in t["content"] for t in spec.get("added_tokens", []))
        and [c.get("type") for c in cuts[1:]] == ["ByteLevel"]
        and not any(c.get("add_prefix_space") or c.get("use_regex") for c in cuts)
        and not spec.get("post_processor") and not spec.get("truncation")
    )


#: Marks that often end a word; without them the rest of most words is letters alone.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"


#: What a byte-level model calls each byte: printable ones of Latin-1 themselves, the others what follows U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_NAMES = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


class _Known(dict):
    """Ids of words and parts of words as bytes, made when first asked for."""

    def __init__(self, tokenizer, spec: dict):
        import regex

        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.lowers = any(s["type"] == "Lowercase" for s in spec["normalizer"]["normalizers"])

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            text = word.decode()
            ids = array("I", [t.id for t in self.model.tokenize(text.lower() if self.lowers else text)]).tobytes()
        elif word.isascii() and not word.strip(_MARKS) and b"'" not in word:
            ids = self._part(word)
        else:
            stem = word.rstrip(_MARKS)
            if stem.isalpha():
                ids = self[stem] + self[word[len(stem) :]]
            elif not word.isascii():
                text = stem.decode().lower() if self.lowers else stem.decode()
                # letters up to U+024F have forms of their own that no neighbour changes
                if not (text.isalpha() and max(text) < "\u0250"):
                    ids = self._whole(word)
                else:
                    ids = self[stem] + self[word[len(stem) :]] if len(stem) < len(word) else self._letters(text)
            elif any(s in word for s in self.special):
                ids = self._whole(word)
            else:
                text = word.decode()
                parts = self.cut(text.lower() if self.lowers else text)
                ids = b"".join(map(self._part, map(str.encode, parts))) if len(parts) > 1 else self._part(word)
        self[word] = ids
        return ids

    def _part(self, part: bytes) -> bytes:
        """Ids of ASCII letters, or of other ASCII characters, that the tokenizer doesn't cut; its model alone.

        Control characters have other names in the model.
        """
        text = part.decode()
        if not text.isprintable():
            return self._whole(part)
        return array("I", [t.id for t in self.model.tokenize(text.lower() if self.lowers else text)]).tobytes()

    def _letters(self, text: str) -> bytes:
        """Ids of letters that stay one part, by the model alone, which knows bytes by their names."""
        named = text.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array("I", [t.id for t in self.model.tokenize(named)]).tobytes()

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def trim(self, most: int) -> None:
        """Beyond ``most`` entries long ones go, as those rarely come again; then all, if that isn't enough."""
        if len(self) > most:
            short = {w: ids for w, ids in self.items() if len(w) <= 8}
            self.clear()
            if len(short) < most // 2:
                self.update(short)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Where a tokenizer's ids go word by word, each distinct word is cut as the tokenizer cuts it, and
    the parts are encoded by its model; a table of about ``most_words`` keeps them, so memory is bounded
    for any vocabulary. Other tokenizers get whole texts. Workers that run several tasks keep their
    table (:meth:`of`).
    """

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str, most_words: int = 250_000) -> Encoder:
        kept = cls._kept.setdefault(path, None)
        if kept is None:
            kept = cls._kept[path] = cls(path)
        kept.most_words = most_words
        return kept

    def __init__(self, path: str, most_words: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word, self.most_words = splits_at_spaces(spec), most_words
        self.known = _Known(self.tokenizer, spec) if self.by_word else None

    def _whole(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array("I", e.ids).tobytes() for e in encode(texts, add_special_tokens=False)]

    def _words(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        raw = text.encode()
        # A-Z may be lowered first where no mark (U+0300 to U+036F) may join a letter into another
        plain = self.known.lowers and not any(s in raw for s in self.known.special) and b"\xcc" not in raw and b"\xcd" not in raw
        return (raw.lower() if plain else raw).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._whole([t or "" for t in texts])
        self.known.trim(self.most_words)
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._words(t))) for t in texts]
