"""Words of a word-end BPE tokenizer file, cut and encoded in bulk.

The split is the tokenizer's own (normaliser, pre-tokenizer, special strings),
done over code-point arrays: each code point's class is learned from the
tokenizer itself, and a text with a character whose treatment depends on its
neighbours goes through the library's own steps instead.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Code points from here on take the library's own path.
LIMIT = 0x3000
SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Splits texts into a dictionary of distinct words and codes, and encodes words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["truncation"] = spec["padding"] = None
        self.whole = Tokenizer.from_str(json.dumps(spec))
        added = spec["added_tokens"]
        self.special = {x["content"]: x["id"] for x in added}
        self.cut_special = re.compile("|".join(re.escape(x) for x in self.special)) if self.special else None
        self.special_heads = {x[0] for x in self.special}
        end = spec["model"]["end_of_word_suffix"]
        bare = spec | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        size = 1 + max([*spec["model"]["vocab"].values(), *self.special.values()])
        self.pieces: list[str] = [""] * size
        self.ends = np.zeros(size, bool)
        for w, i in spec["model"]["vocab"].items():
            self.pieces[i] = w
            self.ends[i] = w.endswith(end)
        for w, i in self.special.items():
            self.pieces[i] = w
        alphabet = _byte_alphabet()
        self.to_alphabet = {b: c for b, c in alphabet.items() if b != 32}
        self.from_alphabet = {ord(c): b for b, c in alphabet.items()}
        self._classes()

    def _classes(self) -> None:
        norm, pre = self.whole.normalizer, self.whole.pre_tokenizer
        cls = np.full(LIMIT + 1, ODD, np.uint8)
        source_ok = np.zeros(LIMIT + 1, bool)
        for i in range(LIMIT):
            ch = chr(i)
            cat = unicodedata.category(ch)
            if cat[0] == "M" or 0x1100 <= i < 0x1200 or not unicodedata.is_normalized("NFC", ch):
                continue
            one = pre.pre_tokenize_str(ch)
            if not one:
                kind = SPACE
            elif len(pre.pre_tokenize_str(ch + "a")) == 1:
                kind = LETTER
            elif len(pre.pre_tokenize_str(ch + ch)) == 2:
                kind = DIGIT
            else:
                kind = MARK
            got = norm.normalize_str(ch)
            source_ok[i] = got == ch.lower() or (kind == SPACE and got == " ")
            cls[i] = kind
        self.cls, self.source_ok = cls, source_ok

    def _words_by_library(self, text: str) -> list[str]:
        """A special string's word is a space and its id: words hold no spaces."""
        out: list[str] = []
        at = 0
        for m in [*self.cut_special.finditer(text), None] if self.cut_special else [None]:
            part = text[at : m.start()] if m else text[at:]
            for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(part)):
                out.append(w.translate(self.from_alphabet).encode("latin-1").decode("utf-8"))
            if m:
                out.append(f" {self.special[m[0]]}")
                at = m.end()
        return out

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct words, codes of all words, each text's first code, each text's number of codes)."""
        n = len(texts)
        odd = np.fromiter((any(c in t for c in self.special_heads) and self.cut_special.search(t) is not None for t in texts), bool, n)
        low = [t.lower() if t.isascii() else t.replace("Σ", "σ").lower() for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, n)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        if not all(t.isascii() for t in texts):
            src = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            bad = np.flatnonzero(~self.source_ok[np.minimum(src, LIMIT)])
            if len(bad):
                src_begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, n) + 1)))[:-1]
                odd[np.unique(np.searchsorted(src_begin, bad, side="right") - 1)] = True
            del src
        arr = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.cls[np.minimum(arr, LIMIT)]
        bad = np.flatnonzero(cls == ODD)
        if len(bad):
            odd[np.unique(np.searchsorted(begin, bad, side="right") - 1)] = True
        for i in np.flatnonzero(odd):
            cls[begin[i] : begin[i] + sizes[i]] = SPACE
        before = np.concatenate((np.zeros(1, np.uint8), cls[:-1])) if len(cls) else cls
        start = (cls > 0) & ((cls != before) | (cls == DIGIT))
        marks = np.flatnonzero(start & (arr == 39))
        if len(marks):
            pad = np.concatenate((arr, np.zeros(3, np.uint32)))
            a, b = pad[marks + 1], pad[marks + 2]
            two = np.isin(a, [115, 116, 109, 100])
            three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            for at, size in ((marks[two], 2), (marks[three], 3)):
                start[at + 1] = False
                nxt = at + size
                nxt = nxt[nxt < len(cls)]
                start[nxt[cls[nxt] == LETTER]] = True
        first = np.flatnonzero(start)
        keep = cls > 0
        chars = arr[keep]
        where = np.cumsum(keep, dtype=np.int64)
        offs = np.concatenate((where[first] - 1, [len(chars)]))
        if len(chars) and chars.max() >= 0x80:
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800)
            offs = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[offs]
        data = chars.tobytes().decode("utf-32-le").encode("utf-8")
        flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        words = coded.dictionary
        head = np.searchsorted(first, begin)
        count = np.diff(np.concatenate((head, [len(first)])))
        extra: dict[str, int] = {}
        tail: list[int] = []
        for i in np.flatnonzero(odd):
            got = self._words_by_library(texts[i])
            head[i], count[i] = len(codes) + len(tail), len(got)
            tail += [extra.setdefault(w, len(words) + len(extra)) for w in got]
        if extra:
            codes = np.concatenate((codes, np.asarray(tail, np.int32)))
            words = pa.concat_arrays([words, pa.array(list(extra), pa.string())])
        return words, codes, head, count

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        own = [(i, int(w)) for i, w in enumerate(words) if w[0] == " "]
        plain = [w for w in words if w[0] != " "] if own else words
        parts = [" ".join(plain[i : i + 2000]).encode("utf-8").decode("latin-1").translate(self.to_alphabet) for i in range(0, len(plain), 2000)]
        got = self.bare.encode_batch_fast(parts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, np.uint32) for e in got]) if got else np.zeros(0, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(plain) or (len(ids) and last[-1] != len(ids) - 1):
            raise ValueError("the vocabulary lacks an ending piece for a word")
        lens = np.diff(np.concatenate(([-1], last)))
        if own:
            all_lens = np.ones(len(words), np.int64)
            is_own = np.zeros(len(words), bool)
            is_own[[i for i, _ in own]] = True
            all_lens[~is_own] = lens
            to = np.cumsum(all_lens) - all_lens
            out = np.empty(int(all_lens.sum()), np.uint32)
            own_at = to[is_own]
            rest = np.ones(len(out), bool)
            rest[own_at] = False
            out[own_at] = [x for _, x in own]
            out[rest] = ids
            return out, all_lens
        return ids, lens


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
