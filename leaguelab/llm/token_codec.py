"""Token ids of whole texts with a public tokenizer file, word by word through a bounded memo.

Both supported tokenizers cut a text into pieces before the merges, and a piece never reaches
past a white space followed by a word. So the ids of a text are those of its words, one after the
other, and a word that comes again is looked up instead of merged again. The library encodes every
word that is not in the memo.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re

import numpy as np

# Characters that Python counts as white space and the tokenizers do not.
_ODD = "\x1c\x1d\x1e\x1f"
_RUN, _TWO = re.compile(r"(\s{2,})"), re.compile(r"\s\s")
# All ways in which the white spaces of most texts meet, and all other white spaces.
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_OTHER_BLANKS = [c for c in map(chr, range(0x10000)) if c not in " \n" and re.match(r"\s", c)]
# Signs that often end a word.
_ENDS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
MEMO_BYTES, _ENTRY_BYTES = 120 << 20, 200
# One piece of the byte-level pattern, in letters that no version of Unicode treats otherwise.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")
# The normalizer and the cut of the public word tokenizer, as its file states them.
_LOWERED = str({"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]})
_BY_LETTERS = str({
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed", "invert": True,
})
# From here on, lower-casing and composing may not be exchanged.
_MARKS = re.compile("[\u0130\u0300-\U0010ffff]")


def _has_run(text: str) -> bool:
    """Whether two white spaces meet. Substrings are found faster than a class of characters."""
    if not any(c in text for c in _OTHER_BLANKS):
        return any(pair in text for pair in _PAIRS)
    return _TWO.search(text) is not None


def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in seen else next(rest)) for b in range(256))


_BYTE_LETTERS = _byte_letters()


class WordEncoder:
    """Encodes whole texts to packed little-endian unsigned 32-bit ids.

    Texts that hold the string of a special token go to the library as a whole, which decides what it
    is. ``memo_bytes`` bounds the memory: when the words that are looked up take so much, they become
    the older of two generations.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES):
        from tokenizers import Tokenizer

        # Spark runs a worker on each core; a thread pool in each would only wait.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        # Case is left open, as some tokenizers lower-case a text before they look for them.
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self.special_starts = {s[0] for s in added} | {s[0].swapcase() for s in added}
        # Either white space is dropped, or one blank belongs to the word after it.
        self.blank_kept = "Removed" not in str(spec["pre_tokenizer"])
        # A word and its ids are two small objects and an entry of a table.
        self.memo_words = memo_bytes // _ENTRY_BYTES
        self.young: dict[str, dict] = {"": {}, " ": {}}
        self.old: dict[str, dict] = {"": {}, " ": {}}
        self.lower_first = not self.blank_kept and "Lowercase" in str(spec["normalizer"])
        self.tails: dict[str, bytes] = {}
        # These two forms cut no word of letters and have nothing else to do for it, if it is in lower
        # case where they lower it.
        cut, by_words = spec["pre_tokenizer"], str(spec["normalizer"]) == _LOWERED
        parts = [cut] if cut["type"] == "ByteLevel" else cut.get("pretokenizers", [])
        plain = spec["model"]["type"] == "BPE" and not any(x.get("add_prefix_space") for x in parts)
        self.of_letters = None
        if plain and spec["normalizer"] is None and len(parts) == 1 and cut.get("use_regex"):
            self.of_letters = _LETTERS.fullmatch
        elif plain and by_words and len(parts) == 2 and str(parts[0]) == _BY_LETTERS and not parts[1].get("use_regex", True):
            self.of_letters = lambda w: w.islower() and _LETTERS.fullmatch(w)

    def _has_special(self, text: str) -> bool:
        # Most texts have not even the first character of one.
        return any(c in text for c in self.special_starts) and bool(self.special.search(text))

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _letters(self, prefix: str, words: list[str]) -> list[bytes]:
        """Ids of words of letters, from the library's merges alone; all bytes are mapped at once."""
        lines = "".join([f"{prefix}{w}\n" for w in words]).encode()
        pieces = codecs.charmap_decode(lines, "strict", _BYTE_LETTERS)[0].split(_BYTE_LETTERS[10])
        merged = self.tokenizer.model.tokenize
        ids, ends = [], [0]
        for piece in pieces[:-1]:
            ids += [t.id for t in merged(piece)]
            ends.append(4 * len(ids))
        packed = np.asarray(ids, dtype="<u4").tobytes()
        return [packed[a:b] for a, b in itertools.pairwise(ends)]

    def _fill(self, prefix: str, words: set) -> None:
        """Put words among the young."""
        young = self.young[prefix]
        if len(young) > self.memo_words:
            self.old[prefix], self.young[prefix] = young, {}
            young = self.young[prefix]
        old = self.old[prefix]
        missing = words.difference(young)
        new = missing.difference(old)
        for w in missing - new:
            young[w] = old[w]
        stems, fresh = [], set()
        for w in new:
            stem = w.rstrip(_ENDS)
            if len(stem) < len(w) and stem[-1:].isalnum() and stem[-1] != "\u0130":
                # A letter or digit and the signs after it are never in one piece. (The one letter
                # that ends in a sign when it is lower-cased is left out.)
                stems.append((w, stem))
                if stem in old:
                    young[stem] = old[stem]
                elif stem not in young:
                    fresh.add(stem)
            else:
                fresh.add(w)
        of_letters = list(filter(self.of_letters, fresh)) if self.of_letters else []
        others = list(fresh.difference(of_letters))
        for some in _by_number(of_letters):
            young.update(zip(some, self._letters(prefix, some)))
        for some in _by_number(others):
            # A line end takes the place of the prefix.
            young.update(zip(some, self._raw([w if w[:1] == "\n" else prefix + w for w in some])))
        for w, stem in stems:
            tail = w[len(stem) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {}
                self.tails[tail] = self._raw([tail])[0]
            young[w] = young[stem] + self.tails[tail]

    def _chunks(self, text: str) -> list[tuple[str, list[str]]]:
        """Words in order, as runs of (blank or nothing before each word, words)."""
        if not self.blank_kept:
            if self.lower_first and (text.isascii() or not _MARKS.search(text)):
                text = text.lower()
            return [("", text.split())]
        out: list[tuple[str, list[str]]] = []
        parts = _RUN.split(text) if _has_run(text) else [text]
        for at in range(0, len(parts), 2):
            part = parts[at]
            if at:
                run = parts[at - 1]
                # A white space run gives up its last character to what follows it.
                cut = len(run) - bool(part)
                out.append(("", [run[:cut]]))
                part = run[cut:] + part
            # The first word of a line comes with the line end before it, the others with a blank.
            words = part.replace("\n", " \n").split(" ")
            if words[0]:
                out.append(("", words[:1]))
            if len(words) > 1:
                out.append((" ", words[1:]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Call with slices of bounded size."""
        runs, words_of = [], {"": set(), " ": set()}
        for text in texts:
            of_text = []
            if not any(c in text for c in _ODD) and not self._has_special(text):
                of_text = self._chunks(text)
                for prefix, words in of_text:
                    words_of[prefix].update(words)
            runs.append(of_text)
        for prefix, words in words_of.items():
            self._fill(prefix, words)
        ids_of = {prefix: young.__getitem__ for prefix, young in self.young.items()}
        out = []
        for text, of_text in zip(texts, runs):
            if of_text:
                out.append(b"".join([b"".join(map(ids_of[prefix], words)) for prefix, words in of_text]))
            else:
                out.append(self._raw([text])[0])
        return out


def _by_number(words: list[str], most: int = 4096):
    """Parts of at most ``most`` words."""
    for at in range(0, len(words), most):
        yield words[at : at + most]


def slices(texts: list[str], most: int = 500_000):
    """``(from, to)`` ranges of about ``most`` characters."""
    start = size = 0
    for n, text in enumerate(texts):
        size += len(text) + 1
        if size >= most:
            yield start, n + 1
            start, size = n + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, memo_bytes: int = MEMO_BYTES) -> WordEncoder:
    """The encoder of this Python worker; its memo outlives a task. A worker keeps one."""
    key = (path, memo_bytes)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(path, memo_bytes)
    return _ENCODERS[key]


def encoded(texts: list[str | None], path: str, end_id: int, memo_bytes: int = MEMO_BYTES):
    """``(position, ids)`` of each text with ``end_id`` appended; null counts as empty."""
    texts = [t or "" for t in texts]
    end = int(end_id).to_bytes(4, "little")
    codec = encoder(path, memo_bytes)
    for start, stop in slices(texts):
        for n, ids in enumerate(codec.encode(texts[start:stop]), start):
            yield n, ids + end
