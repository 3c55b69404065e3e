"""Token ids of whole texts with the tokenizers library."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kerbside.llm.memory import keep_one
from kerbside.llm.words import split_space_words

# Chunks without their punctuation that a worker remembers at most, twice over: about 400 bytes for each.
REMEMBERED = 600_000
# Characters handed to the library at once.
AT_ONCE = 1_000_000
# Stands between words that are encoded together: a byte that no other character shares.
CONTROL = "\x01"
# Words that are encoded together: more leave the processor's caches.
TOGETHER = 512
# Punctuation that is a token sequence of its own after a letter or digit.
ENDINGS = ".,;:!?%$&#*|)]}"
LETTER_OR_DIGIT = np.array([b < 128 and chr(b).isalnum() for b in range(256)])


class Encoder:
    """Encodes whole texts; ids come as little-endian unsigned bytes.

    The text of a corpus repeats its words, so each white-space-delimited chunk is
    encoded by the library once and remembered. The chunks of many texts are coded
    as Arrow dictionaries, so only distinct ones are looked up. That is exact where
    the tokenizer's own rules never join characters across the cut:

    * a vocabulary that drops white space: cut at every ASCII white space;
    * both kinds begin anew with the punctuation that ends a word;
    * a byte-level vocabulary whose words carry their leading space: cut before a
      single space, and around a single line feed, between two other characters.

    Texts with other white space, and tokenizers of other kinds, go to the library
    whole. Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, width: int = 4, remembered: int | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width, self.dtype, self.remembered = width, f"<u{width}", remembered or REMEMBERED
        with open(path) as f:
            rules = json.load(f)
        self.cut = _cut(rules.get("normalizer"), rules.get("pre_tokenizer"), rules.get("post_processor"))
        self.known: dict[bytes, bytes | None] = {}  # None: only the whole text tells
        self.before: dict[bytes, bytes | None] = {}  # what was known when the memory was last full
        self.endings: dict[bytes, bytes] = {b"": b""}
        self.between = "\n" if self.cut == "spaces" else f" {CONTROL} "
        self.gap = np.frombuffer(self.whole([self.between])[0], dtype=self.dtype)
        self.last = _last_of_words(rules["model"]) if self.cut == "words" else None

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the library alone, a bounded number of characters at a time."""
        out: list[bytes] = []
        batch: list[str] = []
        size = 0
        for text in texts:
            if batch and size + len(text) > AT_ONCE:
                out += self._call(batch)
                batch, size = [], 0
            batch.append(text)
            size += len(text)
        return out + (self._call(batch) if batch else [])

    def _call(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts."""
        return self.column(pa.array(texts, pa.large_binary())).to_pylist()

    def column(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of a column of texts, null as empty, each followed by ``end``."""
        texts = texts.cast(pa.large_binary())
        texts = _joined(pc.fill_null(texts, b""), b"")  # a copy of its own: Arrow lower-cases slices wrongly
        if self.cut is None:
            ids = _large(self.whole([t.decode() for t in texts.to_pylist()]))
        else:
            ids = self._by_chunks(texts)
        return _joined(ids, end) if end else ids

    def _by_chunks(self, texts: pa.Array) -> pa.Array:
        skip = 0
        if self.cut == "words":  # A-Z lower-cased, as the vocabulary's own rule does
            lengths, chunks = split_space_words(texts.cast(pa.large_string()))
            chunks = chunks.cast(pa.large_binary())
        else:
            # a chunk is a word after a space, or a line feed and the word after it
            split = pc.split_pattern(_joined(b"\n", pc.replace_substring(texts, "\n", " \n")), " ")
            lengths, chunks = pc.list_value_length(split).to_numpy(), split.flatten()
            skip = self.gap.nbytes  # the line feed put before each text
        coded = chunks.dictionary_encode()
        flat = self._distinct(coded.dictionary).take(coded.indices)
        bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        offsets, data = buffers(flat)
        bytes_at = offsets[bounds]
        _, ids = _split(bytes_at, np.minimum(bytes_at[:-1] + skip, bytes_at[1:]), data)
        if flat.null_count:
            at = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
            odd = np.unique(np.searchsorted(bounds, at, side="right") - 1)
            order = np.arange(len(texts))
            order[odd] = len(texts) + np.arange(len(odd))
            ids = pa.concat_arrays([ids, _large(self.whole([t.decode() for t in texts.take(odd).to_pylist()]))]).take(order)
        return ids

    def _distinct(self, chunks: pa.Array) -> pa.Array:
        """Ids of each chunk: those of its word and of the punctuation that ends it; null if only the whole text tells."""
        offsets, data = buffers(chunks)
        starts, sizes = offsets[:-1], np.diff(offsets)
        words = np.array(pc.binary_length(pc.ascii_rtrim(chunks.cast(pa.large_string()), ENDINGS)), dtype=np.int64)
        ended = (words < sizes) & (words > 0)
        ended[ended] = LETTER_OR_DIGIT[data[(starts + words)[ended] - 1]]
        word, ending = (p.dictionary_encode() for p in _split(offsets, starts + np.where(ended, words, sizes), data))
        for e in ending.dictionary.to_pylist():
            if e not in self.endings:
                self.endings[e] = self.whole([e.decode()])[0]
        ends = _large([self.endings[e] for e in ending.dictionary.to_pylist()])
        return _joined(_large(self._words(word.dictionary.to_pylist())).take(word.indices), ends.take(ending.indices))

    def _words(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of distinct words."""
        if len(self.known) > self.remembered:
            self.before, self.known = self.known, {}
        known = self.known
        found = list(map(known.get, words))
        holes = [i for i, f in enumerate(found) if f is None]
        self._learn([words[i] for i in holes if words[i] not in known])
        for i in holes:
            found[i] = known[words[i]]
        return found

    def _learn(self, new: list[bytes]) -> None:
        """Know the words: from before or from the library."""
        known, before = self.known, self.before
        unknown = []
        for w in new:
            if w in before:
                known[w] = before[w]
            else:
                unknown.append(w)
        if self.cut == "spaces":
            odd = [w for w in unknown if not _clean(w)]
            known.update(dict.fromkeys(odd))
            unknown = [w for w in unknown if w not in known] if odd else unknown
        feed = self.gap.tobytes()
        if self.last is not None:
            texts = {w: w.decode() for w in unknown}
            plain = [w for w, t in texts.items() if t.isalpha()]
            for i in range(0, len(plain), TOGETHER):
                part = plain[i : i + TOGETHER]
                known.update(zip(part, self._letters([texts[w] for w in part])))
            unknown = [w for w, t in texts.items() if not t.isalpha()]
        for i in range(0, len(unknown), TOGETHER):
            part = unknown[i : i + TOGETHER]
            texts = [w.decode() for w in part]
            if self.cut == "words":
                known.update(zip(part, self._together(texts)))
                continue
            found = self._together([w[1:] if w[0] == "\n" else " " + w for w in texts])
            known.update((w, feed + f if w[:1] == b"\n" else f) for w, f in zip(part, found))

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters from one call, where their last tokens tell them apart."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = np.flatnonzero(self.last[ids])
        if len(at) != len(words):  # a word became several
            return self._together(words)
        ends = ((at + 1) * self.width).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words from one call: as one text with a known token between them."""
        joined = self.between.join(words)
        if len(self.gap) != 1 or (self.cut == "words" and joined.count(CONTROL) != len(words) - 1):
            return self._call(words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=self.dtype)
        at = np.flatnonzero(ids == self.gap[0])
        if len(at) != len(words) - 1:
            return self._call(words)
        starts = [0, *((at + 1) * self.width).tolist()]
        ends = [*(at * self.width).tolist(), ids.nbytes]
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(starts, ends)]


def _large(values: list[bytes | None]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def _joined(left: pa.Array | bytes, right: pa.Array | bytes) -> pa.Array:
    """The bytes of each row after one another; null where one is null."""
    sides = [pa.scalar(x, pa.large_binary()) if isinstance(x, bytes) else x for x in (left, right)]
    return pc.binary_join_element_wise(*sides, pa.scalar(b"", pa.large_binary()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large binary column."""
    _, offsets, data = column.buffers()
    found = np.frombuffer(offsets or bytes(8), dtype=np.int64)
    return found[column.offset : column.offset + len(column) + 1], np.frombuffer(data or b"", dtype=np.uint8)


def cut(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """The bytes between neighbouring offsets as a column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _split(offsets: np.ndarray, middles: np.ndarray, data: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The bytes between neighbouring offsets before and after a place between them."""
    cuts = np.append(np.column_stack([offsets[:-1], middles]).ravel(), offsets[-1:])
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    at = np.arange(0, len(cuts) - 1, 2)
    return both.take(at), both.take(at + 1)


def _last_of_words(model: dict) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary marks them and has every byte so that each word ends with one."""
    suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
    if not suffix or sum(len(t) == len(suffix) + 1 and t.endswith(suffix) for t in vocab) < 256:
        return None
    last = np.zeros(1 << 16 if max(vocab.values()) < 1 << 16 else max(vocab.values()) + 1, dtype=bool)
    last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    return last


def _clean(chunk: bytes) -> bool:
    """Whether a chunk, after its line feed, begins and ends with something but white space."""
    word = chunk.decode().removeprefix("\n")
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def _cut(normalizer, pre_tokenizer, post_processor) -> str | None:
    if post_processor is not None or pre_tokenizer is None:
        return None
    if normalizer is None:
        plain = pre_tokenizer["type"] == "ByteLevel" and pre_tokenizer["use_regex"] and not pre_tokenizer["add_prefix_space"]
        return "spaces" if plain else None
    steps = normalizer.get("normalizers", [normalizer])
    known = all(s["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or s.get("pattern") == {"Regex": r"\s+"} for s in steps)
    parts = pre_tokenizer.get("pretokenizers", [pre_tokenizer])
    # a split whose matches are the words, none of which can hold white space
    split = parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    pattern = parts[0].get("pattern", {}).get("Regex", "") if split else ""
    spaceless = split and "[^\\s" in pattern and "\\s" not in pattern.replace("[^\\s", "") and " " not in pattern
    rest = all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in parts[1:])
    return "words" if known and spaceless and rest else None


def encoder(path: str, width: int = 4, remembered: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary."""
    return keep_one(("encoder", path, width, remembered), lambda: Encoder(path, width, remembered))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
