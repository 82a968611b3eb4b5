"""Opening public tokenizer files inside tasks, once for each Python worker."""

from __future__ import annotations

import functools
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def open_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Bounded(dict):
    """A dictionary of strings that is emptied before it takes more than ``most`` bytes, about."""

    #: Bytes of an entry besides its characters: two objects and their place.
    OVERHEAD = 160

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.bytes = 0

    def room(self, new, each: int = 1) -> None:
        """Make room for the strings ``new``, which take ``each`` bytes a character."""
        more = self.OVERHEAD * len(new) + each * sum(map(len, new))
        if self.bytes + more > self.most:
            self.clear()
            self.bytes = 0
        self.bytes += more
