"""Token ids of the public word-level BPE vocabulary, each distinct word encoded once a task.

The vocabulary's pattern never matches across white space, so a text's ids are those of its words in a row. Only runs
of printable ASCII and Latin-1 are cut into words here, whose ids are those of the tokenizer's model; any other run goes
through the whole tokenizer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

#: The vocabulary's own word pattern, over printable ASCII and Latin-1 in lower case.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \\na-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
SIMPLE = re.compile("[ \\n!-~¡-ÿ]*")
ODD = "\0"
#: Longer texts are read in parts of about so many characters, cut at a space or newline.
PART = 500_000


def words(text: str) -> list[str]:
    """The words of a text; a run between spaces with other characters stays whole, marked as odd."""
    if SIMPLE.fullmatch(text) and "<|" not in text:
        return WORDS.findall(text.lower())
    out = []
    for run in text.replace("\n", " ").split(" "):
        if SIMPLE.fullmatch(run) and "<|" not in run:
            out += WORDS.findall(run.lower())
        else:
            out.append(ODD + run)
    return out


def parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cuts = [k for k in (text.find(" ", at + PART), text.find("\n", at + PART)) if k >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:]


class WordIds(dict):
    """word -> its ids as bytes. One for each task, gone with it; it forgets all words beyond `remembered`."""

    def __init__(self, path: str, remembered: int = 200_000) -> None:
        self.plain, self.remembered = Tokenizer.from_file(path), remembered
        self.model, self.symbols = self.plain.model, ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: str) -> bytes:
        if word[0] == ODD:
            ids = self.plain.encode(word[1:], add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else self.symbols.pre_tokenize_str(word)[0][0])]
        self[word] = out = array("I", ids).tobytes()
        return out

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, equal to those of the library without special tokens."""
        found = []
        for part in parts(text):
            if len(self) > self.remembered:
                self.clear()
            found.append(b"".join(map(self.__getitem__, words(part))))
        return np.frombuffer(b"".join(found), np.uintc)
