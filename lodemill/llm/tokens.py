"""Token ids of whole columns of text under a public byte-level BPE vocabulary.

A space between two characters that are surely not white space always begins a new unit of the split pattern, and
merges never cross units. So a text is cut there into chunks, each distinct chunk of a block is encoded once, and the
ids of all texts are gathered from those. The ids equal those of encoding each text as a whole. Strings of the added
tokens that a caller names become their ids, as in the vocabulary's JSON; without such names they are ordinary text.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodemill.llm.textblock import TextBlock

#: Fixed value: the public split pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True


@lru_cache(maxsize=2)
def _encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def _cuts(block: TextBlock) -> np.ndarray:
    """Places of the spaces that begin a chunk."""
    d = block.data
    if len(d) < 3:
        return np.zeros(0, np.int64)
    # Beyond ASCII only the letters whose first byte is C3 count as solid; all others merely make chunks longer.
    before, after = _SOLID[d], _SOLID[d] | (d == 0xC3)
    before[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80)
    at = np.flatnonzero((d[1:-1] == 0x20) & before[:-2] & after[2:]) + 1
    # The neighbours must lie in the same text.
    text = np.searchsorted(block.at, at, "right") - 1
    return at[(at > block.at[text]) & (at + 1 < block.at[text + 1])]


def added_tokens(json_path: str) -> dict[str, int]:
    """Content and id of the added tokens of a tokenizers JSON. They are matched as they stand, anywhere in a text."""
    with open(json_path, "rb") as f:
        found = json.load(f)["added_tokens"]
    for token in found:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} is not matched as it stands")
    return {token["content"]: token["id"] for token in found}


def _encode_around(column: pa.Array, ranks_path: str, added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Like encode_column, with the texts cut at added tokens (of two that begin at one place, at the longer)."""
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    parts: list[str] = []
    token: list[int] = []  # the id of a part that is an added token, else -1
    stops: list[int] = []  # parts up to the end of each text
    for text in column.to_pylist():
        for k, part in enumerate(split.split(text or "")):
            parts.append("" if k % 2 else part)
            token.append(added[part] if k % 2 else -1)
        stops.append(len(parts))
    flat, at = encode_column(pa.array(parts, pa.large_string()), ranks_path)
    ids = np.array(token, np.int64)
    is_added = ids >= 0
    # Added tokens go in where their (empty) part stands.
    whole = np.insert(flat, at[:-1][is_added], ids[is_added].astype(np.uint32))
    shifted = at + np.append(0, np.cumsum(is_added))
    return whole, shifted[np.append(0, stops).astype(np.int64)]


def encode_column(column: pa.Array, ranks_path: str, added: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of the texts in them). Null and empty texts have no ids.

    Strings in ``added`` become the ids that it has for them.
    """
    if added and any(pc.any(pc.match_substring(column, content)).as_py() for content in added):
        return _encode_around(column, ranks_path, added)
    encoding, size = _encoding(ranks_path)
    block = TextBlock(column)
    cuts = _cuts(block)
    text = np.searchsorted(block.at, cuts, "right") - 1
    # Chunks in order: the head of each text, then the chunks that begin with a space.
    starts = np.concatenate([block.at[:-1], cuts])
    owner = np.concatenate([np.arange(block.n), text])
    order = np.lexsort((starts, owner))
    head = (np.arange(len(starts)) < block.n)[order]
    starts, owner = starts[order], owner[order]
    ends = np.append(starts[1:], len(block.data)) if len(starts) else starts
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    place = np.zeros(len(starts), np.int64)
    tails = np.flatnonzero(~head)
    ids: list[np.ndarray] = []
    bounds: list[np.ndarray] = []
    n_known = 0
    if len(tails):
        _, first, inverse = np.unique(block.hashes(starts[tails], ends[tails]), return_index=True, return_inverse=True)
        a, b = starts[tails[first]], ends[tails[first]]
        joined = b"".join(block.data[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True))
        found = np.array(encoding.encode_ordinary(joined.decode()), np.uint32)
        # Chunk ends are token ends: count the tokens up to each.
        bounds.append(np.searchsorted(np.cumsum(size[found]), np.cumsum(b - a)) + 1)
        ids.append(found)
        place[tails] = inverse
        n_known = len(first)
    heads = np.flatnonzero(head)
    at = len(ids[0]) if ids else 0
    more, ends_at = [], []
    for i, j in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True):
        own = encoding.encode_ordinary(block.data[i:j].tobytes().decode()) if j > i else []
        more.extend(own)
        ends_at.append(at + len(more))
    ids.append(np.array(more, np.uint32))
    bounds.append(np.array(ends_at, np.int64))
    place[heads] = n_known + np.arange(len(heads))
    flat, stop = np.concatenate(ids), np.concatenate(bounds)
    begin = np.concatenate([[0], stop[:-1]])
    length = (stop - begin)[place]
    total = np.concatenate([[0], np.cumsum(length)])
    gather = np.repeat(begin[place] - total[:-1], length) + np.arange(total[-1])
    return flat[gather], total[np.append(heads, len(starts))]
