"""Token counts of whole texts by a public tokenizer file.

Texts go to the library in batches of about equal UTF-8 bytes.  A text longer than a
batch is split first, at boundaries that no token can cross; only lengths come
back.  The tokenizer is loaded once in each Python worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 18
#: Byte-level pre-tokenizers begin a new piece where white space follows a word character, or another sign than ASCII a letter or digit.
_CUT = re.compile(r"(?<=\w)(?=[ \n])|(?<=[^\W_])(?=[^\w\s\x00-\x7f])")
_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Lengths of texts for the library that the file belongs to; special strings as the library has it by default, none added."""
    if path not in _loaded:
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            _loaded[path] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            import sentencepiece

            s = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"neither a tokenizers nor a sentencepiece file: {path}")
    return _loaded[path]


def can_split(path: str) -> bool:
    """Whether the file's pre-tokenizer is the byte-level one, without normaliser, prefix space, or special strings with white space or beyond ASCII."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    p = j.get("pre_tokenizer") or {}
    plain = all(not (x.get("lstrip") or x.get("rstrip") or re.search(r"\s|[^\x00-\x7f]", x["content"])) for x in j.get("added_tokens", []))
    return plain and j.get("normalizer") is None and p.get("type") == "ByteLevel" and p.get("use_regex", False) and not p.get("add_prefix_space", True)


def pieces(text: str, limit: int) -> list[str]:
    """Parts cut where no token crosses, each at the first such place from ``limit`` UTF-8 bytes on."""
    out, at = [], 0
    while len(text) - at > limit // 4:
        # the characters that lie within the limit; a cut character at its end doesn't count
        inside = len(text[at : at + limit].encode()[:limit].decode(errors="ignore"))
        if inside == len(text) - at or not (m := _CUT.search(text, at + max(1, inside))):
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per input row.

    Null is an empty text: no bytes, no tokens.  Very long texts are split where
    the tokenizer allows it (see ``can_split``) and encoded whole elsewhere.
    Ids may be null or repeat; other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, split = counter(path), can_split(path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes = np.asarray(pa.compute.binary_length(texts.cast(pa.binary())).fill_null(0)).astype(np.int64)
            total = np.zeros(len(texts), np.int64)
            group, owner, size = [], [], 0

            def run() -> None:
                if group:
                    np.add.at(total, owner, lengths(group))

            first: dict[str, int] = {}  # equal texts of a batch are counted once
            same = [first.setdefault(text, i) if text else i for i, text in enumerate(texts.to_pylist())]
            for text, i in first.items():
                for p in pieces(text, batch_bytes) if split and n_bytes[i] > batch_bytes else [text]:
                    group.append(p)
                    owner.append(i)
                    size += len(p.encode())
                    if size >= batch_bytes:
                        run()
                        group, owner, size = [], [], 0
            run()
            total = total[np.array(same, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
