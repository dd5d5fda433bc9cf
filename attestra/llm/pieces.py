"""Splitting texts where byte-level BPE can never join.

In the pre-tokenisation pattern of the 50k byte-level vocabularies a space before a
non-space character opens a new word, whatever stands around it, and so does a single line
end between two non-space characters.  Splitting there gives short pieces that repeat, so
a worker encodes each distinct piece once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters that only some libraries take for white space (the information separators,
# NEL) are never split before; a piece may then be longer, never wrong.
_OPENS = re.compile(r"(?= [^\s\x1c-\x1f\x85])")
#: A text with none of these has single spaces and line ends only, and no mark.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MARK = "\x01"


def pieces(text: str) -> list[str]:
    """The pieces of ``text``, each with the space or line end that opens it; joined they give it again."""
    distinct, codes, _ = interned(pa.array([text], pa.string()))
    return [distinct[c] for c in codes]


def interned(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of some texts (null: empty), the index of each piece in turn, and where each text begins.

    Text k is ``"".join(distinct[i] for i in codes[starts[k]:starts[k + 1]])``.
    """
    texts = pc.fill_null(texts, "")
    rare = pc.match_substring_regex(texts, _ODD)
    odd = {k: _OPENS.split(texts[k].as_py()) for k in np.flatnonzero(rare.to_numpy(zero_copy_only=False)).tolist()}
    plain = pc.if_else(rare, "", texts) if odd else texts
    split = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\x01 "), "\n", "\x01\n"), _MARK)
    sizes = np.diff(split.offsets.to_numpy())
    coded = split.flatten().dictionary_encode()
    distinct, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()  # several times as fast as to_pylist
    if odd:
        at = {p: i for i, p in enumerate(distinct)}
        begin = np.concatenate([[0], np.cumsum(sizes)])
        parts, done = [], 0
        for k, own in odd.items():
            parts += [codes[begin[done] : begin[k]], np.array([at.setdefault(p, len(at)) for p in own], codes.dtype)]
            sizes[k], done = len(own), k + 1
        codes, distinct = np.concatenate([*parts, codes[begin[done] :]]), list(at)
    return distinct, codes, np.concatenate([[0], np.cumsum(sizes)])
