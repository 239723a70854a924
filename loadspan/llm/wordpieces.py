"""Encoding with the tokenizers library, each distinct chunk of a batch once."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from loadspan.llm.chunks import ChunkEncoder

#: Chunks that go to the library in one call, with a special token between them.
CALL = 512


@lru_cache(maxsize=4)
def chunk_encoder(tokenizer_path: str) -> ChunkEncoder:
    """ids as Tokenizer.encode(text, add_special_tokens=False) gives; special tokens' strings are ordinary text.

    The library splits a text at its special tokens before all else, so chunks joined by one are encoded as if each
    came alone, at a fraction of the cost of a call for each. Chunks that hold its string get a call of their own.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path)
    plain.encode_special_tokens = True
    joining = Tokenizer.from_file(tokenizer_path)
    special = {i: t.content for i, t in joining.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
    between, text = max(special.items(), default=(-1, ""))

    def alone(chunk: str) -> np.ndarray:
        return np.array(plain.encode(chunk, add_special_tokens=False).ids, np.int32)

    def encode(chunks: list[str]) -> list[np.ndarray | bytes]:
        out: list[np.ndarray | bytes] = []
        for a in range(0, len(chunks), CALL):
            some = chunks[a : a + CALL]
            joined = text.join(some)
            if not text or any(joined.count(s) != (len(some) - 1) * (s == text) for s in special.values()):
                out += map(alone, some)
                continue
            ids = np.array(joining.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
            ends, raw = [*(4 * np.flatnonzero(ids == between)).tolist(), 4 * len(ids)], ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        return out

    steps = (json.loads(plain.to_str())["normalizer"] or {}).get("normalizers", [])
    lower = any(x["type"] == "Lowercase" for x in steps) and alone(" a").tolist() == alone("\na").tolist() == alone("a").tolist()
    return ChunkEncoder(encode, bare=lower)
