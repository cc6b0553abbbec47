"""Block-wise encoding with the ``tokenizers`` library.

White space never reaches the model, so each white-space-delimited chunk of a text is encoded on its own
and the library is asked once per distinct word of a block; Arrow finds the distinct chunks and NumPy
lays the ids back into document order. The result equals encoding the whole text. This holds for files whose normalizer
and pre-tokenizer are those of SPLITS; with any other file the library encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space outside ASCII, and separators on which libraries differ: such texts are encoded whole.
ODD_SPACE = (
    r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
)
#: Words remembered by a worker between blocks.
MEMO_WORDS = 300_000
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: The same for letters of Latin-1, on which no normalization acts.
_LATIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_OPEN: dict[str, "BlockTokenizer"] = {}


#: The parts of a tokenizer file under which words are independent of each other and split as the patterns above split.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class BlockTokenizer:
    """Encodes Arrow arrays of texts by a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        parts = json.loads(self.library.to_str())
        added = all(t["special"] for t in parts["added_tokens"])
        self.by_words = added and parts["model"]["type"] == "BPE" and not parts["model"].get("dropout") and all(parts[k] == v for k, v in SPLITS.items())
        if not self.by_words:
            return
        self.model = self.library.model
        self.normalize = self.library.normalizer.normalize_str
        self.pieces = self.library.pre_tokenizer.pre_tokenize_str
        self.latin = {c: self.pieces(chr(c))[0][0] for c in range(0xDF, 0x100)}  # their bytes, as the model spells them
        self.words: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}

    @classmethod
    def open(cls, path: str) -> "BlockTokenizer":
        """One tokenizer per worker process and path."""
        if path not in _OPEN:
            _OPEN[path] = cls(path)
        return _OPEN[path]

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk that holds no white space, as raw 32-bit integers."""
        words_known, out = self.words, []
        if chunk.isascii() and chunk.isprintable():
            words = (chunk.lower(),) if chunk.isalpha() else _ASCII.findall(chunk.lower())
        elif _LATIN.fullmatch(chunk):
            words = [w.translate(self.latin) for w in _LATIN_WORDS.findall(chunk.lower())]
        else:
            words = self.split(chunk)
        for word in words:
            ids = words_known.get(word)
            if ids is None:
                ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
                if len(words_known) < MEMO_WORDS and len(word) < 64:
                    words_known[word] = ids
            out.append(ids)
        return b"".join(out) if len(out) != 1 else out[0]

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk, as the library's normalizer and pre-tokenizer give them."""
        return [w for w, _ in self.pieces(self.normalize(chunk))]

    def distinct(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks; those met before are remembered."""
        known = self.memo
        out = list(map(known.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                chunk = chunks[i]
                out[i] = ids = self.chunk(chunk)
                if len(known) < MEMO_WORDS and len(chunk) < 64:
                    known[chunk] = ids
        return out

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def encode_whole(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        end = [] if end_id is None else [end_id]
        ids = [np.array(self.whole(t.as_py()) + end, dtype=np.uint32) for t in texts]
        return np.cumsum([0, *map(len, ids)]), np.concatenate([np.zeros(0, np.uint32), *ids])

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Returns (offsets, ids): document i has ids[offsets[i]:offsets[i + 1]], with end_id last. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_words:
            return self.encode_whole(texts, end_id)
        odd = pc.match_substring_regex(texts, ODD_SPACE)
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        plain = pc.if_else(odd, pa.scalar("", pa.large_string()), texts) if len(odd_rows) else texts
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        per_chunk = self.distinct(coded.dictionary.to_pylist())
        lens = np.fromiter(map(len, per_chunk), dtype=np.int64, count=len(per_chunk)) // 4
        table = np.frombuffer(b"".join(per_chunk), dtype=np.uint32)
        starts = np.cumsum(lens) - lens
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = lens[index]
        upto = np.concatenate(([0], np.cumsum(each)))
        ids = table[np.arange(upto[-1]) - np.repeat(upto[:-1] - starts[index], each)]
        lists = split.offsets.to_numpy()
        offsets = upto[lists - lists[0]]
        if not len(odd_rows) and end_id is None:
            return offsets, ids
        whole = {int(r): np.array(self.whole(texts[int(r)].as_py()), dtype=np.uint32) for r in odd_rows}
        parts, end = [], np.array([] if end_id is None else [end_id], dtype=np.uint32)
        sizes = np.diff(offsets) + len(end)
        for r, own in whole.items():
            sizes[r] = len(own) + len(end)
        out_offsets = np.concatenate(([0], np.cumsum(sizes)))
        if whole:
            for r in range(len(texts)):
                parts += [whole.get(r, ids[offsets[r] : offsets[r + 1]]), end]
            return out_offsets, np.concatenate(parts) if parts else ids
        out = np.empty(out_offsets[-1], dtype=np.uint32)
        if len(end):
            last = np.zeros(len(out), dtype=bool)
            last[out_offsets[1:] - 1] = True
            out[last] = end_id
            out[~last] = ids
        else:
            out[:] = ids
        return out_offsets, out
