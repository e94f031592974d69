"""Substring dedup by level-wise doubling.

Words are runs of other characters than ASCII white space. Windows repeated at 9 words
are extended to 18, those repeated there to the full 35 words; what occurs once at a
level goes no further. Every word covered by a repeated window is removed, whichever
document or place the other occurrence has. See :mod:`methylake.llm.repeats`.

Null texts have no words. Texts shorter than a window lose nothing. Copies of one text
remove each other. Repeated rows get equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from methylake.llm.repeats import Spec, split_words, sweep


def remove_repeated(docs: DataFrame, length: int = 35, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """Kept columns, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one blank)."""
    spec = Spec("words", length, (length + 1) // 4)

    def render(text, mask):
        words = split_words(text)
        left = b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]) if mask.any() else b" ".join(words)
        out = {"n_words": len(words), "n_removed": int(mask.sum()), "kept_sha256": hashlib.sha256(left).hexdigest()}
        return out | ({"kept_text": left.decode("utf-8", "surrogatepass")} if with_text else {})

    return sweep(docs, spec, render, "n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text, keep, "substring")
