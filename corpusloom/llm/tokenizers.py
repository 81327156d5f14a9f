"""Token counts under an existing tokenizer; the vocabulary files' folder is a parameter."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the vocabulary files and file of the tokenizer used by default
FOLDER = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of the byte-level BPE vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def tokenizer_hash(folder: str = FOLDER, name: str = NAME) -> str:
    """Identifies a vocabulary by its content, so that a changed file never meets old counts."""
    with open(os.path.join(folder, name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:16]


def encoder(folder: str = FOLDER, name: str = NAME):
    """A function text -> list of token ids; loaded once a process."""
    key = os.path.join(folder, name)
    if key not in _loaded:
        if name.endswith(".tiktoken"):
            import tiktoken

            with open(key, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _loaded[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        elif name.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=key)
            _loaded[key] = lambda t: own.encode(t, num_threads=1)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(key)
            t.encode_special_tokens = True
            _loaded[key] = lambda s: t.encode(s, add_special_tokens=False).ids
    return _loaded[key]


def counted(texts: DataFrame, text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The other columns of `texts` and tokens; a null text has 0 tokens."""
    rest = [f for f in texts.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", tokens bigint"
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(folder, name)
        for b in batches:
            yield b[names].assign(tokens=pd.array([len(encode(t)) if t else 0 for t in b[text]], dtype="int64"))

    return texts.mapInPandas(run, schema)


def hashed_and_counted(texts: DataFrame, text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """The other columns of `texts`, content (sha256 of the text, null as empty) and tokens, in the scan's own stage; a task encodes equal texts once."""
    rest = [f for f in texts.schema.fields if f.name != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest) + "content string, tokens bigint"
    names = [f.name for f in rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, known = encoder(folder, name), {}
        for b in batches:
            content, tokens = [], []
            for t in b[text]:
                h = hashlib.sha256((t or "").encode()).digest()
                if h not in known:
                    if len(known) > 500_000:
                        known.clear()
                    known[h] = len(encode(t)) if t else 0
                content.append(h.hex())
                tokens.append(known[h])
            yield b[names].assign(content=content, tokens=pd.array(tokens, dtype="int64"))

    return texts.mapInPandas(run, schema)
