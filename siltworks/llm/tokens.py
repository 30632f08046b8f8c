"""Public tokenizer vocabularies, opened in workers from a folder that is a parameter."""

from siltworks.functions.subwords import DEFAULT_DIR, PATTERN, byte_bpe, folder

__all__ = ["DEFAULT_DIR", "PATTERN", "byte_bpe", "folder"]
