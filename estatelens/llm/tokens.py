"""Token ids of whole texts, through the ``tokenizers`` library.

Some tokenizers drop white space and never join text across it, so a text's ids are the ids
of its blank-separated chunks in turn. The tokenizer's own file tells whether it is one of
those (``CHUNKED``). Then Arrow splits the texts of a batch and numbers their distinct chunks;
each Python worker keeps the ids of chunks it has met, in a store of bounded size, and lets the
library encode the others in one call. Texts that may hold a special token, and all texts of
any other tokenizer, are encoded whole.
"""

from __future__ import annotations

import functools
import json
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
#: Parts of chunks that a worker remembers at most, some 20 bytes each.
REMEMBERED = 600_000
#: A control character between the chunks that the library encodes together: its id occurs for nothing else.
MARK = "\x01"
#: Bytes of text that are cut into chunks at a time.
TEXT_BYTES = 8 << 20
#: Last letters after which trailing punctuation is a word of its own: composing and lower-casing leave each of
#: them one letter. (Others can end in a combining mark, which joins the punctuation.)
PLAIN_END = r"[a-zA-Z0-9À-ÖØ-öø-ÿ]$"
# The parts of a tokenizer's file from which chunks may be encoded apart.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Encodes texts; what it has learned is a column of chunks' parts with their ids, looked up by Arrow."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        mark = self._whole(MARK).tolist()
        self.chunked = all(told.get(part) == rule for part, rule in CHUNKED.items()) and len(mark) == 1
        self._special = [t["content"] for t in told.get("added_tokens", [])]
        self._mark = mark[0] if mark else None
        self._remembered = remembered
        # ids of part n: flat[starts[n] : starts[n + 1]]
        self._parts, self._flat, self._starts = pa.array([], pa.string()), np.empty(0, self.dtype), np.zeros(1, np.int64)
        self._used = np.empty(0, bool)

    def encode(self, texts: pa.Array | Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, of ``dtype``, null as empty, without special tokens added."""
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.chunked:
            yield from map(self._whole, (t.as_py() for t in column))
            return
        sizes = np.asarray(pc.binary_length(column), np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(column):  # the chunks of a few texts at a time are in memory
            before = int(ends[at] - sizes[at])
            end = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, side="right")))
            yield from self._ids(column.slice(at, end - at))
            at = end

    def _ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        special = np.zeros(len(texts), bool)
        for content in self._special:
            special |= np.asarray(pc.match_substring(texts, content).to_numpy(zero_copy_only=False), bool)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        lists = pc.ascii_split_whitespace(plain)
        bounds = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        ids, lengths = self._distinct(numbered.dictionary)
        firsts = np.cumsum(lengths) - lengths
        at = np.asarray(numbered.indices)
        own = lengths[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        flat, cuts = ids[np.repeat(firsts[at] - ends[:-1], own) + np.arange(ends[-1])], ends[bounds]
        for k in range(len(texts)):
            yield self._whole(texts[k].as_py()) if special[k] else flat[cuts[k] : cuts[k + 1]]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other, and how many each has.

        Punctuation after a plain letter or digit at the end of a chunk is a word of its own. Only chunks
        of ASCII alone are lower-cased here: elsewhere composing must come before.
        """
        chunks = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
        trimmed = pc.ascii_rtrim(chunks, characters=string.punctuation)
        split = pc.and_(pc.not_equal(trimmed, chunks), pc.match_substring_regex(trimmed, PLAIN_END))
        tails = pc.replace_substring_regex(pc.if_else(split, chunks, ""), r"^(?s:.*)[^!-/:-@\[-`{-~]", "")
        at = self._places(pa.concat_arrays([pc.if_else(split, trimmed, chunks), tails])).reshape(2, -1).T.ravel()
        ids, sizes = _strung(self._flat, self._starts, at)
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def _places(self, parts: pa.Array) -> np.ndarray:
        """Places of the parts among those learned; learns the others first."""
        if len(self._parts) > self._remembered:  # of those met since the last turnover, the newest half stays
            kept = np.flatnonzero(self._used)[-self._remembered // 2 :]
            flat, sizes = _strung(self._flat, self._starts, kept)
            self._parts, self._flat, self._starts, self._used = self._parts.take(pa.array(kept)), flat, np.concatenate([[0], np.cumsum(sizes)]), np.zeros(kept.size, bool)
        found = pc.index_in(parts, self._parts)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            missing = pc.is_null(found)
            asked = parts.filter(missing)
            new = asked.unique()
            flat, sizes = self._encoded(new)
            at[missing.to_numpy(zero_copy_only=False)] = len(self._parts) + pc.index_in(asked, new).to_numpy()
            self._parts = pa.concat_arrays([self._parts, new])
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
            self._flat = np.concatenate([self._flat, flat])
            self._used = np.concatenate([self._used, np.zeros(len(new), bool)])
        self._used[at] = True
        return at

    def _encoded(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, one after the other, and how many each has."""
        texts = parts.to_pylist()
        ids, sizes = [np.empty(0, self.dtype)], np.zeros(len(texts), np.int64)
        # one line with marks between costs the library far less than many short texts
        for k in range(0, len(texts), 2000):
            line = f" {MARK} ".join("" if MARK in t else t for t in texts[k : k + 2000])
            found = np.array(self._tokenizer.encode_batch_fast([f"{line} {MARK}"], add_special_tokens=False)[0].ids, self.dtype)
            marks = found == self._mark
            sizes[k : k + 2000] = np.diff(np.flatnonzero(marks), prepend=-1) - 1
            ids.append(found[~marks])
        alone = [k for k, t in enumerate(texts) if MARK in t]
        flat = np.concatenate(ids)
        if alone:
            cut = np.split(flat, np.cumsum(sizes)[:-1])
            for k in alone:
                cut[k] = self._whole(texts[k])
                sizes[k] = cut[k].size
            flat = np.concatenate(cut)
        return flat, sizes


def _strung(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``at`` of ``flat``, one after the other, and their sizes."""
    sizes = starts[at + 1] - starts[at]
    return flat[np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process: what it has learned serves its later tasks."""
    return ChunkEncoder(path)
