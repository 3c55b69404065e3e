"""Words of whole texts as bytes, the way the operators' contracts define them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# every ASCII byte but digits and letters becomes a space; bytes of other characters stay
ALNUM_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def space_words(text: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.translate(ASCII_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM_LOWER).split()


def split_space_words(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The space_words of a large string column: their number in each text, and all of them."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(column)))
    lengths, flat = pc.list_value_length(split).to_numpy().astype(np.int64), split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    empty = ~full.to_numpy(zero_copy_only=False)  # a text without words splits into one empty word
    if empty.any():
        lengths[np.repeat(np.arange(len(column)), lengths)[empty]] = 0
        flat = flat.filter(full)
    return lengths, flat


def coded_space_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The space_words of many texts: their number in each text, all of them as places, and the distinct words."""
    lengths, flat = split_space_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    coded = flat.dictionary_encode()
    return lengths, coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
