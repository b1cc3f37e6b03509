"""Token ids of whole texts, exactly as the given tokenizer makes them, by a faster merger where the text allows it."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

# The parts of a tokenizer file under which the words of a text can be merged apart from each other.
WORD_END = "</w>"
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What PIECE finds at an apostrophe that begins a run of marks.
CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")

#: A longer word leaves its text to the tokenizer: the merger's time grows with the square of a word's length.
LONG_WORD = 256

#: Characters of texts that are merged in one call; bounds memory, but for one longer text.
CHARS_AT_ONCE = 1 << 20

BLANK, MARK, LETTER, NUMBER, UNUSUAL = range(5)


def _kinds() -> np.ndarray:
    """Kind of every character below 65,536.

    A character is unusual if the Unicode versions may class it differently,
    if it may join with the next one in normal form, or if its lower case
    depends on its neighbours; texts with such characters are encoded whole.
    """
    of = {"L": LETTER, "N": NUMBER, "P": MARK, "S": MARK}
    old = unicodedata.ucd_3_2_0
    kinds = np.full(1 << 16, UNUSUAL, np.uint8)
    for k in range(1 << 16):
        c = chr(k)
        group = unicodedata.category(c)[0]
        if group in of and old.category(c)[0] == group and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c:
            kinds[k] = of[group]
    kinds[0x1100:0x1200] = kinds[0x03A3] = UNUSUAL  # parts of Korean syllables; the sigma with two lower cases
    kinds[list(b"\t\n\x0b\x0c\r ")] = BLANK
    kinds[0] = NUMBER  # stands between texts, apart from its neighbours as a digit is
    return kinds


def _byte_letters() -> dict[str, int]:
    """Letter -> byte by the usual rule of byte-level vocabularies: printable bytes are themselves, the rest follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merger(spec: dict):
    """A merger of words that end in one space, or None if ``spec`` is no tokenizer of the known form.

    The space stands for the mark of a word's end. Merges come in the order of
    their ids, so the ids are the ranks that a byte-pair merger needs.
    """
    import tiktoken

    model, parts = spec["model"], [p.get("type") for p in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if model.get("end_of_word_suffix") != WORD_END or parts != NORMALIZER or splits[:1] != [PIECE] or model.get("dropout"):
        return None
    vocab, letters = model["vocab"], _byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    cores = {t: t.removesuffix(WORD_END) or t for t in vocab}
    if made != sorted(made) or not set().union(*cores.values()) <= letters.keys():
        return None
    ranks = {bytes(map(letters.__getitem__, c)) + (b" " if c != t else b""): vocab[t] for t, c in cores.items()}
    return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})


class TextEncoder:
    """Texts -> ids, the same as those of the tokenizer at ``path``.

    The tokenizer drops white space and never joins across the pieces that its
    pattern finds. So texts without unusual characters, very long words or
    names of special tokens are spaced out into their pieces and merged, many
    in one call; all other texts, and tokenizers of another form, go the plain
    way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = _merger(spec)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.kinds = _kinds()
        self.between = self.merger.encode_single_token(b"\0 ") if self.merger else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def _usual(self, text: str) -> bool:
        units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
        named = "\0" in text or any(s in text for s in self.specials)
        return not named and not (self.kinds[units] == UNUSUAL).any() and max(map(len, text.split()), default=0) <= LONG_WORD

    def _merged(self, texts: list[str]) -> list[np.ndarray] | None:
        """Ids of usual texts, or None if one of them is not."""
        # each text is followed by the zero character, which is a piece of its own and in no usual text
        joined = "".join([t + "\0" for t in texts])
        units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), "<u2")
        kind = self.kinds[units]
        if (kind == UNUSUAL).any() or joined.count("\0") > len(texts) or any(s in joined for s in self.specials):
            return None
        before, after = kind[:-1], kind[1:]
        cut = ((before != after) | (after == NUMBER)) & (before != BLANK) & (after != BLANK)
        if "'" in joined:
            for m in CONTRACTION.finditer(joined.lower()):
                if not m.start() or kind[m.start() - 1] != MARK:
                    cut[m.start()] = False
                    cut[m.end() - 1] |= kind[m.end()] == LETTER
        spaced = np.insert(np.where(kind == BLANK, np.uint16(32), units), np.flatnonzero(cut) + 1, 32)
        if np.diff(np.flatnonzero(spaced == 32), prepend=-1, append=len(spaced)).max() > LONG_WORD + 1:
            return None
        ids = self.merger.encode_to_numpy(spaced.tobytes().decode("utf-16-le").lower() + " ", disallowed_special=()).astype("<u4", copy=False)
        ends = np.flatnonzero(ids == self.between)
        return [ids[i:j] for i, j in zip([0, *(ends[:-1] + 1)], ends, strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.merger:
            return [self._whole(t) for t in texts]
        out, part, size = [], [], 0
        for t in [*texts, None]:
            if part and (t is None or size + len(t) > CHARS_AT_ONCE):
                if (found := self._merged(part)) is None:
                    usual = [self._usual(t) for t in part]
                    own = iter(self._merged([t for t, u in zip(part, usual, strict=True) if u]) if any(usual) else [])
                    found = [next(own) if u else self._whole(t) for t, u in zip(part, usual, strict=True)]
                out += found
                part, size = [], 0
            if t is not None:
                part.append(t)
                size += len(t)
        return out


@lru_cache(2)
def encoder(path: str) -> TextEncoder:
    """One encoder a Python process, for all tasks that run in it."""
    return TextEncoder(path)
