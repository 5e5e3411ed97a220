"""Whole-text encoding with the tokenizers library, one encode of each distinct text unit.

A text is cut into units at places where no token can cross, batch by batch in Arrow; each distinct
unit of a batch is looked up in a bounded per-process cache, and only units not yet met are encoded.
Where the cuts would not be safe (runs of white space, or a special token's string in the text, which
the library reads as that token) the whole text is encoded at once.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct units that a worker process remembers; beyond it the cache starts anew.
CACHE_UNITS = 400_000
END_ID = 2
_CUT = "\x00"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_table() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """``encode`` turns an Arrow string array into (ids, offsets); ``kind`` is "byte" or "word".

    "byte" keeps white space: a unit is a word with the space before it, or a line break.
    "word" drops white space, so any white space is a safe cut.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True) if t)
        self.model = self.tokenizer.model
        self.table = _byte_table()
        self.cache: dict[str, bytes] = {}  # ids as little-endian unsigned 32-bit integers

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _letters(self, word: str) -> bytes:
        """Ids of one pre-token of letters (with a space before it in the "byte" kind)."""
        mapped = word.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        body, tail = (unit[:-1], unit[-1]) if unit[-1:] in (",", ".") else (unit, "")
        word = body[1:] if self.kind == "byte" and body[:1] == " " else body
        if not (word.isalpha() and max(word) < "Ā"):  # one pre-token of letters, stable under NFC
            return self.whole(unit).tobytes()
        key = body if self.kind == "byte" else body.lower()
        found = self.cache.get(key)
        if found is None:
            found = self.cache[key] = self._letters(key)
        return found + self._mark(tail) if tail else found

    def _mark(self, mark: str) -> bytes:
        found = self.cache.get(mark)
        if found is None:
            found = self.cache[mark] = self.whole(mark).tobytes()
        return found

    def _risky(self, texts: pa.Array) -> np.ndarray:
        """Texts whose white space could form a token across units."""
        if self.kind == "word":
            pattern = _CUT
        else:
            pattern = r"\x00|[\s\p{Z}\x1c-\x1f\x85]{3}|[\s\p{Z}\x1c-\x1f\x85]{2}\z"
        if self.special:
            pattern += "|" + self.special
        return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 offsets of the texts in them; nulls are empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        risky = self._risky(texts)
        safe = texts if not risky.any() else pc.if_else(pa.array(risky), "", texts)
        if self.kind == "byte":
            cut = pc.replace_substring(safe, " ", _CUT + " ")
            cut = pc.replace_substring(cut, "\n", f"{_CUT}\n{_CUT}")
        else:
            cut = pc.replace_substring(pc.replace_substring(safe, " ", _CUT), "\n", _CUT)
        parts = pc.split_pattern(cut, _CUT)
        bounds = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        bounds = bounds - bounds[0]
        at = coded.indices.to_numpy(zero_copy_only=False)
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        cache, units = self.cache, coded.dictionary.to_pylist()
        ids = [b"" if u == "" else cache.get(u) for u in units]
        for i, found in enumerate(ids):
            if found is None:
                ids[i] = cache[units[i]] = self._unit(units[i])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(starts[at] - (ends - own), own) + np.arange(total)
        out = flat[source] if total else np.empty(0, np.uint32)
        offsets = np.concatenate([[0], ends])[bounds]
        return (out, offsets) if not risky.any() else self._with_whole(texts, risky, out, offsets)

    def _with_whole(self, texts, risky, out, offsets):
        pieces = [
            self.whole(texts[i].as_py()) if risky[i] else out[offsets[i] : offsets[i + 1]] for i in range(len(texts))
        ]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, kind: str) -> Encoder:
    """The process's encoder for a vocabulary file; the file is found on the machine that encodes."""
    found = _ENCODERS.get((name, kind))
    if found is None:
        path = name if os.path.sep in name else tokenizer_path(name)
        found = _ENCODERS[name, kind] = Encoder(path, kind)
    return found


def batches_by_bytes(batches, column: str, most: int = 4 << 20):
    """Cut record batches so that the texts of each hold about ``most`` bytes (one text at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
