"""Where the public vocabulary lies."""

from __future__ import annotations

import os


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the public tokenizers' package."""
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path(name))
